"""Back-off language model scores, and ranks of enumerated paths.

lm (ord, ngram, logp, backoff) is an ARPA file as a table; log10 probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"


def sentence_scores(sentences: DataFrame, lm: DataFrame, order: int = 3, unknown: float = -7.0) -> DataFrame:
    """sentences (id, words) -> id, score, n, perplexity.

    For each word the longest n-gram that the model has gives its probability; the back-off weights of the longer
    histories are added, each 0 where the model has none."""
    framed = F.concat(F.array(F.lit(BEGIN)), "words", F.array(F.lit(END)))
    at = sentences.select("id", framed.alias("w")).select("id", "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("i"))
    # every n-gram that ends here, and every history, in one equi-join with the model
    n_of = F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("i")))).alias("n")
    grams = at.select("id", "w", "i", n_of).select("id", "i", "n", F.array_join(F.slice("w", F.col("i") - F.col("n") + 1, F.col("n")), " ").alias("ngram"), F.array_join(F.slice("w", F.col("i") - F.col("n") + 1, F.col("n") - 1), " ").alias("history"))
    probs = grams.join(lm.select("ngram", F.col("ord").alias("n"), "logp"), ["ngram", "n"], "left")
    both = probs.join(lm.select(F.col("ngram").alias("history"), (F.col("ord") + 1).alias("n"), "backoff"), ["history", "n"], "left")
    longest = F.coalesce(F.max(F.when(F.col("logp").isNotNull(), F.col("n"))), F.lit(0))
    per = both.groupBy("id", "i").agg(longest.alias("m"), F.max_by("logp", F.when(F.col("logp").isNotNull(), F.col("n"))).alias("logp"), F.collect_list(F.struct("n", F.coalesce("backoff", F.lit(0.0)).alias("b"))).alias("bs"))
    back = F.aggregate(F.filter("bs", lambda x: x["n"] > F.greatest("m", F.lit(1))), F.lit(0.0), lambda a, x: a + x["b"])
    sums = per.groupBy("id").agg(F.sum(F.coalesce("logp", F.lit(unknown)) + back).alias("score"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("perplexity", F.exp(-F.col("score") * F.log(F.lit(10.0)) / F.greatest(F.col("n") - 1, F.lit(1))))


def normalised(scored: DataFrame) -> DataFrame:
    """scored (sent_id, path_id, score) with prob: 10**score over the sentence's sum, 0 for what is no number."""
    of = Window.partitionBy("sent_id")
    mass = F.pow(F.lit(10.0), F.col("score") - F.max("score").over(of))
    return scored.withColumn("prob", F.coalesce(F.nanvl(mass / F.sum(mass).over(of), F.lit(0.0)), F.lit(0.0)))


def rank_paths(scored: DataFrame, fractional: bool = False, kept: float = 1.0) -> DataFrame:
    """scored (sent_id, path_id, score) -> ``ranked`` paths with ``value``: the log10 score, or with ``fractional`` the share of the
    sentence's probability. Paths that begin at a mass of ``kept`` or more are left out."""
    out = ranked(normalised(scored), 0.5).withColumn("value", F.col("prob") if fractional else F.col("score"))
    return out.filter((F.col("rank") == 1) | (F.col("cumulative") - F.col("prob") < kept)) if kept < 1 else out


def ranked(probable: DataFrame, mass: float = 0.5) -> DataFrame:
    """probable (sent_id, path_id, prob) with rank, cumulative mass and mark: |@| best, |+| while the mass before is
    under ``mass``, |-| else; bucket tells at which of the masses 0.5, 0.6, … the path comes in."""
    w = Window.partitionBy("sent_id").orderBy(F.desc("prob"), "path_id")
    out = probable.withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("cumulative") - F.col("prob")
    mark = F.when(F.col("rank") == 1, "|@|").when(before < mass, "|+|").otherwise("|-|")
    step = sum((F.when(before >= t / 10, 1).otherwise(0) for t in (5, 6, 7, 8, 9)), F.lit(0))
    return out.withColumns({"mark": mark, "bucket": (step + 5) / 10})
