"""Context n-grams around ambiguous words, and what they say about translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lu


def contexts(words: Column, pos: Column, max_n: int = 3, parity: bool = False) -> Column:
    """For j = 1 to max_n - 1: words pos - j to pos, pos to pos + j, pos - j to pos + j, joined by spaces.

    Only contexts within the sentence count. ``parity`` keeps what list slices of the original tools give at
    edges: the empty text where a context begins before the sentence (unless the negative index wraps
    round), and the shortened context at its end."""
    n = F.size(words)

    def cut(lo: Column, hi: Column) -> Column:  # words lo to hi - 1 as a slice with wrapping indices
        a = F.when(lo < 0, F.greatest(lo + n, F.lit(0))).otherwise(lo)
        b = F.least(F.when(hi < 0, hi + n).otherwise(hi), n)
        return F.when(a < b, F.array_join(F.slice(words, a + 1, b - a), " ")).otherwise("")

    out = []
    for j in range(1, max_n):
        for lo, hi in ((pos - j, pos + 1), (pos, pos + j + 1), (pos - j, pos + j + 1)):
            text = cut(lo, hi)
            out.append(text if parity else F.when((lo >= 0) & (hi <= n), text))
    return F.array_compact(F.array(*out))


def ngram_counts(observed: DataFrame, sentences: DataFrame, max_n: int = 3, parity: bool = False) -> DataFrame:
    """observed (sent_id, pos, sl, tl, w), sentences (sent_id, words) -> sl, ngram, tl, cnt."""
    met = observed.join(sentences, "sent_id").select("sl", "tl", "w", F.explode(contexts(F.col("words"), F.col("pos"), max_n, parity)).alias("ngram"))
    return met.groupBy("sl", "ngram", "tl").agg(F.sum("w").alias("cnt"))


def translations_present(units: DataFrame, targets: DataFrame) -> DataFrame:
    """units (sent_id, pos, sl, tls): the options that occur in the target sentence, weight 1 each."""
    options = units.filter(F.size("tls") > 1).select("sent_id", "pos", "sl", F.explode("tls").alias("tl"))
    return options.join(targets.select("sent_id", "tl"), ["sent_id", "tl"], "left_semi").withColumn("w", F.lit(1.0))


def totals(ngrams: DataFrame) -> DataFrame:
    """sl, ngram, total, max_freq, best_tl (ties: first text)."""
    best = F.min_by("tl", F.struct((-F.col("cnt")).alias("c"), "tl")).alias("best_tl")
    return ngrams.groupBy("sl", "ngram").agg(F.sum("cnt").alias("total"), F.max("cnt").alias("max_freq"), best)


def crispiness(ngrams: DataFrame, defaults: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Patterns: sign, crisp, weight, total, max_freq, tl_freq, sl, ngram, tl.

    crisp is a translation's share over the default's share in the context, 1 standing for a default that
    does not occur; weight is its share; + marks a crispiness of ``threshold`` or more."""
    base = ngrams.join(defaults.select("sl", "default_tl"), "sl").join(totals(ngrams).drop("best_tl"), ["sl", "ngram"])
    of_default = ngrams.select("sl", "ngram", F.col("tl").alias("default_tl"), F.col("cnt").alias("d"))
    met = base.join(of_default, ["sl", "ngram", "default_tl"], "left").filter("total > 0")
    share = F.col("cnt") / F.col("total")
    of = F.when(F.col("d").isNull() | (F.col("d") == 0), 1.0).otherwise(F.col("d") / F.col("total"))
    out = met.withColumns({"crisp": share / of, "weight": share, "tl_freq": F.col("cnt")})
    sign = F.when(F.col("crisp") >= threshold, "+").otherwise("-").alias("sign")
    return out.select(sign, "crisp", "weight", "total", "max_freq", "tl_freq", "sl", "ngram", "tl")


def prune_ngrams(ngrams: DataFrame, defaults: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Crispiness of each context's best translation only; empty words and contexts are left out."""
    filled = ngrams.filter("sl <> '' and ngram <> ''")
    best = totals(filled).filter("max_freq > 0").select("sl", "ngram", F.col("best_tl").alias("tl"))
    return crispiness(filled, defaults, threshold).join(best, ["sl", "ngram", "tl"], "left_semi")


def top_translations(ngrams: DataFrame, k: int) -> DataFrame:
    """The k most frequent translations of each context, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("sl", "ngram").orderBy(F.desc("cnt"), "tl"))
    return ngrams.withColumn("rank", rank).filter(F.col("rank") <= k)


def pattern_lines(patterns: DataFrame) -> DataFrame:
    """sign and numbers, the word, its context, the translation and its count, parted by tabs; numbers by spaces."""
    number = lambda c: F.format_string("%.10f", c)
    head = F.concat_ws(" ", "sign", *[number(c) for c in ("crisp", "weight", "total", "max_freq", "tl_freq")])
    return patterns.select(F.concat_ws("\t", head, lu.wrap(F.col("sl")), "ngram", lu.wrap(F.col("tl")), number("tl_freq")).alias("value"))


def read_patterns(lines: DataFrame) -> DataFrame:
    """Pattern lines (value) -> sign, strength (the first number), sl, ngram, tl, tl_freq."""
    part = F.split("value", "\t")
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    head = F.filter(F.split(at(1), " "), lambda x: x != "")
    return lines.filter(F.size(part) > 3).select(head[0].alias("sign"), lu.safe_double(F.try_element_at(head, F.lit(2))).alias("weight"), lu.unwrap(F.trim(at(2))).alias("sl"), at(3).alias("ngram"), lu.unwrap(at(4)).alias("tl"), lu.safe_double(at(5)).alias("tl_freq"))


def ngram_lines(ngrams: DataFrame) -> DataFrame:
    return ngrams.select(F.concat_ws("\t", F.format_string("%.10f", "cnt"), "ngram", "sl", "tl").alias("value"))


def pareto(patterns: DataFrame) -> DataFrame:
    """patterns (sl, ngram, tl, weight) -> sl, tl, mass: translations that no other one of their word dominates.

    A translation is a vector of weights over its word's contexts, 0 where it has none. t dominates u if it
    is at least as heavy in every context and heavier in one. A word's translations are numbered and stand for bits, 64 to a block. In
    each context a running union by falling weight gives u the set of those as heavy; the intersection over u's contexts holds whoever
    may dominate it. One of them does if it is heavier in one of them, or has more contexts. No pairs are formed: rows are those of
    the patterns, times the blocks of their word."""
    v = patterns.groupBy("sl", "ngram", "tl").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    size = v.groupBy("sl", "tl").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("mass"))
    own = Window.partitionBy("sl")
    numbered = size.withColumn("i", F.row_number().over(own.orderBy(F.desc("mass"), "tl")) - 1).withColumn("last", F.floor(F.max("i").over(own) / 64).cast("int"))
    each = numbered.select("sl", "tl", "n", "mass", "i", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    bit = F.when(F.floor(F.col("i") / 64) == F.col("block"), F.expr("shiftleft(1L, i % 64)")).otherwise(F.lit(0).cast("long"))

    def heavier(df: DataFrame, keys: list[str], by: str) -> DataFrame:
        """``as_``: bits of the rows with at least as much; ``more``: with more."""
        upto = F.bit_or("bit").over(Window.partitionBy(*keys).orderBy(F.desc(by)))  # rows of equal value come in together
        same = F.bit_or("bit").over(Window.partitionBy(*keys, by))
        return df.withColumns({"as_": upto, "more": upto.bitwiseAND(F.bitwise_not(same))})

    bits = each.withColumn("bit", bit)
    wide = heavier(bits, ["sl", "block"], "n").select("sl", "tl", "block", "mass", "bit", F.col("more").alias("wider"))
    met = heavier(v.join(bits.select("sl", "tl", "block", "bit"), ["sl", "tl"]), ["sl", "ngram", "block"], "weight")
    sets = met.groupBy("sl", "tl", "block").agg(F.bit_and("as_").alias("all_"), F.bit_or("more").alias("some"))
    lost = sets.join(wide, ["sl", "tl", "block"]).withColumn("over", F.col("all_").bitwiseAND(F.bitwise_not(F.col("bit"))).bitwiseAND(F.col("some").bitwiseOR(F.col("wider"))))
    return lost.groupBy("sl", "tl").agg(F.max("mass").alias("mass"), F.bit_or("over").alias("over")).filter("over = 0").select("sl", "tl", "mass")
