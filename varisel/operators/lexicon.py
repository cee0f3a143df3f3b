"""Frequency lexicons: how often a source word has a translation, and which one is its default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lu


def aligned_pairs(candidates: DataFrame, ambiguous_only: bool = True) -> DataFrame:
    """candidates (line_no, sl array, bt LUs, tl array, align array<struct<t,s>>) -> line_no, pos, sl, tl:
    the target word that each link of an ambiguous source word points to."""
    links = candidates.select("line_no", "bt", "sl", "tl", F.explode("align").alias("a"))
    inside = (F.col("a.s") < F.size("sl")) & (F.col("a.t") < F.size("tl")) & (F.col("a.s") >= 0) & (F.col("a.t") >= 0)
    pairs = links.filter(inside).select("line_no", F.col("a.s").alias("pos"), F.element_at("sl", F.col("a.s") + 1).alias("sl"), F.element_at("tl", F.col("a.t") + 1).alias("tl"), F.size(F.try_element_at("bt", F.col("a.s") + 1)["tls"]).alias("n"))
    return (pairs.filter("n > 1") if ambiguous_only else pairs).drop("n")


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs of known words with the same first tag."""
    return pairs.filter((lu.first_tag(F.col("sl")) == lu.first_tag(F.col("tl"))) & ~lu.unknown(F.col("tl")))


def frequencies(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """pairs (sl, tl) -> sl, tl, freq; each pair counts 1, or ``weight``."""
    return pairs.groupBy("sl", "tl").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("freq"))


def fractional_pairs(ambiguous: DataFrame, annotated: DataFrame) -> DataFrame:
    """ambiguous (sent_id, lus), annotated (sent_id, path_id, lus, frac): for every ambiguous position the
    translation that each path has there, with the path's share. Sentences of unequal length are left out."""
    a = ambiguous.select("sent_id", F.col("lus").alias("am"))
    both = a.join(annotated.select("sent_id", "path_id", F.col("lus").alias("dm"), "frac"), "sent_id").filter(F.size("am") == F.size("dm"))
    each = both.select("sent_id", "path_id", "frac", F.posexplode(F.arrays_zip("am", "dm")).alias("pos", "x"))
    return each.filter(F.size("x.am.tls") > 1).select("sent_id", "path_id", "pos", F.col("x.am.sl").alias("sl"), F.element_at(F.concat("x.dm.tls", F.array(F.lit(""))), 1).alias("tl"), "frac")


def fractional_sums(ambiguous: DataFrame, annotated: DataFrame) -> DataFrame:
    """``fractional_pairs`` with the shares of a sentence's paths summed: sent_id, pos, sl, tl, frac."""
    return chosen_sums(ambiguous, annotated.select("sent_id", F.transform("lus", lambda u: F.coalesce(F.get(u["tls"], F.lit(0)), F.lit(""))).alias("tls"), "frac"))


def chosen_sums(ambiguous: DataFrame, chosen: DataFrame) -> DataFrame:
    """``fractional_sums`` of paths (sent_id, tls, frac), one translation for each unit. Paths are summed where they are read and
    meet their sentence as one row, so no path is shuffled or sorted."""
    each = chosen.select("sent_id", "frac", F.size("tls").alias("n"), F.posexplode("tls").alias("pos", "tl"))
    sums = each.groupBy("sent_id", "n", "pos", "tl").agg(F.sum("frac").alias("frac"))
    met = ambiguous.select("sent_id", F.col("lus").alias("am")).join(sums.groupBy("sent_id").agg(F.collect_list(F.struct("n", "pos", "tl", "frac")).alias("x")), "sent_id")
    each = met.select("sent_id", "am", F.explode("x").alias("x")).filter(F.size("am") == F.col("x.n")).withColumn("u", F.col("am")[F.col("x.pos")])
    return each.filter(F.size("u.tls") > 1).select("sent_id", "x.pos", F.col("u.sl").alias("sl"), "x.tl", "x.frac")


def bag_pairs(units: DataFrame, targets: DataFrame) -> DataFrame:
    """units (sent_id, pos, sl, tls), targets (sent_id, tl): each occurrence of a translation anywhere in
    the target sentence."""
    options = units.filter(F.size("tls") > 1).select("sent_id", "pos", "sl", F.explode("tls").alias("tl"))
    return options.join(targets.select("sent_id", "tl"), ["sent_id", "tl"])


def ranked(freq: DataFrame, min_freq: float = 0.0) -> DataFrame:
    """sl, tl, freq, tl_idx, is_default: by frequency, ties by text; the first is the default."""
    place = F.row_number().over(Window.partitionBy("sl").orderBy(F.desc("freq"), "tl"))
    return freq.filter(F.col("freq") >= min_freq).withColumn("tl_idx", place - 1).withColumn("is_default", F.col("tl_idx") == 0)


def defaults(freq: DataFrame) -> DataFrame:
    """sl, default_tl, default_freq: a grouping, no window; ties go to the first text."""
    best = F.min_by("tl", F.struct((-F.col("freq")).alias("f"), "tl")).alias("default_tl")
    return freq.groupBy("sl").agg(best, F.max("freq").alias("default_freq"))


def lexicon_lines(rank: DataFrame, decimals: int = 10) -> DataFrame:
    """freq ^sl$ ^tl$, with @ at defaults."""
    line = F.concat(F.format_string(f"%.{decimals}f", "freq"), F.lit(" "), lu.wrap(F.col("sl")), F.lit(" "), lu.wrap(F.col("tl")), F.when(F.col("is_default"), " @").otherwise(""))
    return rank.select("sl", "tl_idx", line.alias("value"))


def target_analysis_counts(units: DataFrame, corpus: DataFrame) -> DataFrame:
    """Counts, in a target corpus (tl), of the translations of ambiguous words only."""
    wanted = units.filter(F.size("tls") > 1).select(F.explode("tls").alias("tl")).distinct()
    return corpus.join(wanted, "tl", "left_semi").groupBy("tl").count().withColumnRenamed("count", "freq")
