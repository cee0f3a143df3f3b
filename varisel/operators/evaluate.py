"""Error rate of chosen translations against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lu


def judged(src: DataFrame, ref: DataFrame, tst: DataFrame) -> DataFrame:
    """Three tables (line_no, lus) side by side, one row for each position; an LU counts if the source is
    ambiguous and the reference decides it, and fails if the first translation tested is not in the reference."""
    three = src.select("line_no", F.col("lus").alias("s")).join(ref.select("line_no", F.col("lus").alias("r")), "line_no").join(tst.select("line_no", F.col("lus").alias("t")), "line_no")
    each = three.select("line_no", F.posexplode(F.arrays_zip("s", "r", "t")).alias("pos", "x"))
    s, r, t = (F.col(f"x.{c}.tls") for c in "srt")
    counts = (F.size(s) > 1) & (F.size(r) != F.size(s)) & (r != s)
    failed = ~F.array_contains(r, F.element_at(F.concat(t, F.array(F.lit(""))), 1))
    return each.select("line_no", "pos", F.col("x.s.sl").alias("sl"), F.coalesce(counts, F.lit(False)).alias("counts"), F.coalesce(counts & failed, F.lit(False)).alias("failed"))


def error_rate(src: DataFrame, ref: DataFrame, tst: DataFrame) -> DataFrame:
    """fails, total, percent (one decimal, cut off)."""
    j = judged(src, ref, tst)
    fails, total = F.sum(F.col("failed").cast("long")), F.sum(F.col("counts").cast("long"))
    return j.agg(F.coalesce(fails, F.lit(0)).alias("fails"), F.coalesce(total, F.lit(0)).alias("total")).withColumn("percent", lu.truncated_percent(F.col("fails"), F.col("total")))


def sanity(src: DataFrame, ref: DataFrame, tst: DataFrame) -> DataFrame:
    """line_no, pos (null: the line), problem: unequal lengths; translations that the source does not offer."""
    three = src.select("line_no", F.col("lus").alias("s")).join(ref.select("line_no", F.col("lus").alias("r")), "line_no").join(tst.select("line_no", F.col("lus").alias("t")), "line_no")
    unequal = three.filter((F.size("s") != F.size("r")) | (F.size("s") != F.size("t"))).select("line_no", F.lit(None).cast("int").alias("pos"), F.lit("lengths differ").alias("problem"))
    same = three.filter((F.size("s") == F.size("r")) & (F.size("s") == F.size("t"))).select("line_no", F.posexplode(F.arrays_zip("s", "r", "t")).alias("pos", "x"))
    parts = [same.filter(F.size(F.array_except(f"x.{c}.tls", "x.s.tls")) > 0).select("line_no", "pos", F.lit(f"{n} not in source").alias("problem")) for c, n in (("r", "reference"), ("t", "test"))]
    return unequal.union(parts[0]).union(parts[1])
