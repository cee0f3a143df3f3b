"""The training-data operators as one pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``docs``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varisel.llm import common
from varisel.llm.decontamination import decontaminate
from varisel.llm.line_dedup import line_dedup
from varisel.llm.packing import pack_documents
from varisel.llm.quality import SCORES, select
from varisel.llm.queries import word_bpe
from varisel.llm.simhash import first_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    kept = select(docs, common.table(spark, sf_dir, "labels"))
    return kept.drop(*SCORES).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document of which nothing is left goes."""
    cut = line_dedup(docs)
    return cut.filter((F.col("n_kept") > 0) | (F.col("n_lines") == 0)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id."""
    return first_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


#: Behind the other stages an executor's JVM has grown, so the encoder holds less here than by itself, for more CPU.
PACKING = {"cache_bytes": 12 << 20, "part": 1 << 19}


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and packed: one row for each piece."""
    return pack_documents(docs, word_bpe(), **PACKING).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _bounded(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _bounded(f)) for f in (quality, lines, near_copies, benchmark, packing)]

#: The classifier's fit and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
