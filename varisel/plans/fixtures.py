"""Sentences of ambiguous units derived from the driver's tables, for Spark and, as SQL, for the oracle.

A sentence is an order, a unit one of its lines: the lemma is the part's type, its tag follows the lemma's
length, 1 to 3 alternatives follow the part's number, the observed translation is flag and status, its
share the discount."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent, pos, sl, tl, frac, n_tl: one row for each order line."""
    # named before the window: sentences then lie as the window dealt their lines, and are not shuffled again
    line, part = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sent_id"), table(spark, sf_dir, "part")
    pos = (F.row_number().over(Window.partitionBy("sent_id").orderBy(*ORDER)) - 1).cast("int")
    # words are made behind the window, so that no shuffle carries them
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("sent_id", pos.alias("pos"), "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "p_type")
    lemma = F.lower("p_type")
    tag = F.element_at(F.array(F.lit("n"), F.lit("vblex"), F.lit("adj"), F.lit("pr")), (F.length(lemma) % 4 + 1).cast("int"))
    sl = F.concat(lemma, F.lit("<"), tag, F.lit(">"))
    tl = F.concat(F.lower("l_returnflag"), F.lower("l_linestatus"), F.lit("<"), tag, F.lit(">"))
    return rows.select("sent_id", "pos", sl.alias("sl"), tl.alias("tl"), F.col("l_discount").alias("frac"), (F.col("l_partkey") % 3 + 1).cast("int").alias("n_tl"), F.concat(lemma, F.lit(".t")).alias("stem"), F.concat(F.lit("<"), tag, F.lit(">")).alias("tag"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, pos, blank, sl, tls."""
    tls = F.transform(F.sequence(F.lit(0), F.col("n_tl") - 1), lambda i: F.concat("stem", i.cast("string"), "tag"))
    return observed(spark, sf_dir).select("sent_id", "pos", F.lit(" ").alias("blank"), "sl", tls.alias("tls"))


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, lus, options: sentences, and their units with the observed word standing for the first translation, from one pass over the lines."""
    tls = F.transform(F.sequence(F.lit(0), F.col("n_tl") - 1), lambda i: F.concat("stem", i.cast("string"), "tag"))
    own = F.array_sort(F.array_distinct(F.concat(F.array("tl"), F.slice(tls, F.lit(2), F.col("n_tl")))))
    one = F.struct("pos", F.lit(" ").alias("blank"), "sl", tls.alias("tls"), own.alias("own"))
    s = observed(spark, sf_dir).groupBy("sent_id").agg(F.array_sort(F.collect_list(one)).alias("u"))
    units = lambda field: F.transform("u", lambda u: F.struct(u["pos"].alias("pos"), u["blank"].alias("blank"), u["sl"].alias("sl"), u[field].alias("tls")))
    return s.select("sent_id", units("tls").alias("lus"), units("own").alias("options"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, lus."""
    one = F.struct("pos", "blank", "sl", "tls")
    return units(spark, sf_dir).groupBy("sent_id").agg(F.array_sort(F.collect_list(one)).alias("lus"))


SQL = """
obs AS (
  SELECT l_orderkey AS sent_id,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::INT AS pos,
    lower(p_type) || g AS sl, lower(l_returnflag) || lower(l_linestatus) || g AS tl, l_discount AS frac,
    (l_partkey % 3 + 1)::INT AS n_tl, lower(p_type) || '.t' AS stem, g AS tag
  FROM lineitem JOIN (SELECT *, '<' || (['n', 'vblex', 'adj', 'pr'])[length(p_type) % 4 + 1] || '>' AS g FROM part) ON l_partkey = p_partkey),
units AS (SELECT sent_id, pos, sl, tag, list_transform(range(0, n_tl), lambda i: stem || i || tag) AS tls FROM obs)"""

TOKENS_SQL = r"""
tok AS (
  SELECT doc_id, unnest(w) AS lemma, generate_subscripts(w, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '(\p{L}+)', 1) AS w FROM documents))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, lemma of whole documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("pos", "lemma"))
