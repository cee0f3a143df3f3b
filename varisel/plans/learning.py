"""Rule learning from corpora, each as one graph of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lu
from ..operators import emit, filters, lexicon, maxent, ngrams


def from_parallel(candidates: DataFrame, threshold: float = 3.0, max_n: int = 2, top: int | None = None) -> dict[str, DataFrame]:
    """candidates -> lexicon, patterns and rules of a word-aligned corpus."""
    good = filters.usable(candidates).filter("reason is null")
    pairs = lexicon.agreeing(lexicon.aligned_pairs(good))
    ranked = lexicon.ranked(lexicon.frequencies(pairs))
    observed = pairs.select(F.col("line_no").alias("sent_id"), "pos", "sl", "tl", F.lit(1.0).alias("w"))
    counts = ngrams.ngram_counts(observed, good.select(F.col("line_no").alias("sent_id"), F.col("sl").alias("words")), max_n)
    if top:
        counts = ngrams.top_translations(counts, top).drop("rank")
    patterns = ngrams.crispiness(counts, lexicon.defaults(lexicon.frequencies(pairs)), threshold)
    return {"lexicon": ranked, "patterns": patterns, "rules": emit.pattern_rules(patterns.filter("sign = '+'"), threshold=threshold)}


def from_fractions(ambiguous: DataFrame, annotated: DataFrame, max_n: int = 3, cut: int = 3, **training) -> dict[str, DataFrame]:
    """ambiguous sentences and weighted paths -> lexicon, maximum-entropy weights, Pareto front and rules."""
    pairs = lexicon.fractional_pairs(ambiguous, annotated).filter("tl <> ''")
    ranked = lexicon.ranked(lexicon.frequencies(pairs, F.col("frac")))
    words = ambiguous.select("sent_id", F.transform("lus", lambda u: u["sl"]).alias("words"))
    observed = pairs.groupBy("sent_id", "pos", "sl", "tl").agg(F.sum("frac").alias("w"))
    of = observed.select("sent_id", "pos").distinct().join(words, "sent_id").select("sent_id", "pos", F.explode(ngrams.contexts(F.col("words"), F.col("pos"), max_n)).alias("ngram"))
    ev = maxent.select_features(maxent.events(observed, of, ranked), cut)
    lambdas = maxent.train(ev, **training)
    weighted = maxent.join_lambdas(lambdas, ranked)
    front = ngrams.pareto(weighted)
    kept = weighted.join(front.select("sl", "tl"), ["sl", "tl"], "left_semi")
    return {"lexicon": ranked, "defaults": emit.default_rules(ranked), "lambdas": lambdas, "front": front, "rules": emit.pattern_rules(kept, learned=True)}


def target_words(tl: DataFrame) -> DataFrame:
    """sent_id, tl of tagged target sentences (line_no, tokens)."""
    return tl.select(F.col("line_no").alias("sent_id"), F.explode(F.transform("tokens", lambda t: t["text"])).alias("tl")).filter(~lu.unknown(F.col("tl")))
