"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.intermediate import discard, shared_dir, spent_shuffles_go, written  # noqa: F401  for the operators

#: Of texts that go to a Python worker at once.
BATCH_BYTES = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
#: The same for ``bytes.translate``; ``bytes.split()`` cuts at exactly BLANKS.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches to and from Python hold ``size`` bytes at most, or one row: 10,000 rows of long texts would
    be held several times over in the JVM and in each worker. A smaller setting is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
    if not set_to or not 0 < int(set_to[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[set_to[2]] <= size:
        spark.conf.set(key, f"{size}b")


def give_back() -> None:
    """What the allocators of this Python process keep goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def lean(task: Callable) -> Callable:
    """``task`` for mapInArrow, giving memory back at its end: a Python worker serves many tasks, and what its
    allocators keep would add up over the stages of an application."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def parts_of(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``size`` bytes, one text at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, size + (upto[at - 1] if at else 0), "right")))
        yield at, to
        at = to


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(c: Column) -> Column:
    """Words of a text, A-Z lower-cased; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), BLANKS), lambda w: w != "")


def text_hash(c: Column) -> Column:
    """128 bits of a text, as a binary key for grouping equal texts."""
    return F.unhex(F.md5(c))


def unsigned32(data: bytes) -> int:
    import zlib

    return zlib.crc32(data) & 0xFFFFFFFF


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, rows_per_bucket: int = 1 << 18) -> DataFrame:
    """Number the rows of each group from 0 without gaps, no group in one task.

    Rows are dealt to buckets by a hash of ``order``; the number of buckets grows with the rows. A row's
    number is the count of the rows in its group's earlier buckets plus its place within its bucket, by
    ``order``. Only the counts, one row for each group and bucket, are summed in a window."""
    n = df.count()
    buckets = max(64, -(-n // rows_per_bucket))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    cols = [*group, "_b"]
    counts = dealt.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before")
    before = counts.select(*[F.col(c).alias(f"_r_{c}") for c in cols], before)
    inside = F.row_number().over(Window.partitionBy(*cols).orderBy(*order)) - 1
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    out = dealt.withColumn("_i", inside).join(before, same)
    return out.withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before", *[f"_r_{c}" for c in cols])
