"""Maximum-entropy weights for contexts: events, feature selection, iterative scaling, scoring.

One model for each source word: the probability of class k behind features f is proportional to exp(sum of lambda(f, k)).
Events of a word are aggregated by (class, features), so a model's data are the word's distinct contexts. Generalised
iterative scaling moves lambda(f, k) by (log seen - log expected) / size, size being the word's largest number of features; a
pair of feature and class that no event has keeps 0. A word ends after the step at which its perplexity changed by
``least_gain`` or less.

Words of up to ``group_rows`` contexts are fitted each in one task, on sparse arrays; those of more by a loop of
DataFrame jobs over all of their rows, so that no task gathers them. Both take the same steps with the same options, and
give the same weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.intermediate import discard, spent_shuffles_go, written

LAMBDAS = "sl string, feature string, cls int, lambda double"


def events(observed: DataFrame, ngrams_of: DataFrame, lexicon: DataFrame) -> DataFrame:
    """observed (sent_id, pos, sl, tl, w), ngrams_of (sent_id, pos, ngram), lexicon (sl, tl, tl_idx) -> sl,
    n_cls, cls, w, feats: a word's contexts with the place of its translation, for words with two or more."""
    feats = ngrams_of.groupBy("sent_id", "pos").agg(F.sort_array(F.collect_set("ngram")).alias("feats"))
    return placed_events(observed.join(feats, ["sent_id", "pos"]), lexicon)


def placed_events(placed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``events`` of places (sl, tl, w, feats) that have their sorted contexts already. Equal places are summed before they meet the
    lexicon, so neither a frequent word nor the corpus is shuffled by word."""
    classes = lexicon.groupBy("sl").agg(F.count(F.lit(1)).cast("int").alias("n_cls")).filter("n_cls > 1")
    named = lexicon.select("sl", "tl", F.col("tl_idx").alias("cls")).join(classes, "sl")
    met = placed.groupBy("sl", "tl", "feats").agg(F.sum("w").alias("w")).join(named, ["sl", "tl"])
    return met.groupBy("sl", "n_cls", "cls", "feats").agg(F.sum("w").alias("w")).filter("w > 0").select("sl", "n_cls", "cls", "w", "feats")


@spent_shuffles_go
def stored_events(placed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``placed_events`` as a table: what is made of them does not go back to the corpus."""
    return written(placed_events(placed, lexicon), "events")


def feature_ids(ev: DataFrame) -> DataFrame:
    """feature, feature_id: all features of the events in order of their text, numbered from 0 without gaps.

    They are sorted by range over all tasks; a feature's number is its place in its task plus the counts of the tasks before, one row for
    each in the only window."""
    names = ev.select(F.explode("feats").alias("feature")).distinct()
    tasks = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = names.repartitionByRange(tasks, "feature").sortWithinPartitions("feature").select("feature", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    placed = written(ordered, "features")  # both reads below see the same tasks
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), F.col("part") == F.col("of")).select("feature", (F.col("before") + F.col("i")).alias("feature_id"))


def encoded(ev: DataFrame, ids: DataFrame) -> DataFrame:
    """Events with features as sorted numbers; training and scoring take them as they do texts. Equal lists of features are translated
    once, an event without features keeps none."""
    lists = ev.select("feats").distinct()
    each = lists.select("feats", F.explode("feats").alias("feature")).join(ids, "feature")
    numbers = each.groupBy("feats").agg(F.array_sort(F.collect_list("feature_id")).alias("_ids"))
    return ev.join(numbers, "feats", "left").withColumn("feats", F.coalesce("_ids", F.array().cast("array<bigint>"))).select(*ev.columns)


def decoded(lambdas: DataFrame, ids: DataFrame) -> DataFrame:
    """Weights of numbered features with the features' texts."""
    return lambdas.withColumnRenamed("feature", "feature_id").join(ids, "feature_id").select("sl", "feature", "cls", "lambda")


def count_lines(ev: DataFrame) -> DataFrame:
    """sl, value: feature:class and the weight that the word's events of the class give it, a file of counts that ``readers.weights`` reads."""
    seen = ev.select("sl", "cls", "w", F.explode("feats").alias("feature")).groupBy("sl", "feature", "cls").agg(F.sum("w").alias("seen"))
    return seen.select("sl", F.format_string("%s:%d %.6f", "feature", "cls", "seen").alias("value"))


def known_features(ev: DataFrame, counts: DataFrame) -> DataFrame:
    """Events with those of their features only that counts (sl, feature) of another corpus have; so a model can be fitted to a new
    corpus without new features."""
    known = counts.select("sl", "feature").distinct()
    lists = ev.select("sl", "feats").distinct()
    kept = lists.select("sl", "feats", F.explode("feats").alias("feature")).join(known, ["sl", "feature"]).groupBy("sl", "feats").agg(F.sort_array(F.collect_list("feature")).alias("_f"))
    none = F.array().cast(ev.schema["feats"].dataType)
    out = ev.join(kept, ["sl", "feats"], "left").withColumn("feats", F.coalesce("_f", none))
    return out.groupBy("sl", "n_cls", "cls", "feats").agg(F.sum("w").alias("w")).select("sl", "n_cls", "cls", "w", "feats")


def event_lines(ev: DataFrame) -> DataFrame:
    """class $ weight # features # features # for each class, as trainers read it."""
    block = F.array_join("feats", " ")
    per_class = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cls") - 1), lambda k: F.concat(F.lit("# "), F.array_join(F.transform("feats", lambda f: F.concat(f, F.lit(":"), k.cast("string"))), " "), F.lit(" "))), "")
    return ev.withColumn("_b", block).select("sl", F.concat(F.col("cls").cast("string"), F.lit(" $ "), F.format_string("%d", (F.col("w") * 10_000).cast("long")), F.lit(" "), per_class, F.lit("#")).alias("value"))


def select_features(ev: DataFrame, cut: int = 3) -> DataFrame:
    """Features that a word's events have more than ``cut`` times; others are taken out of the events."""
    counts = ev.select("sl", "w", F.explode("feats").alias("f")).groupBy("sl", "f").agg(F.sum("w").alias("n")).filter(F.col("n") > cut)
    keyed = ev.withColumn("_id", F.xxhash64("sl", "cls", "feats"))
    kept = keyed.select("sl", "_id", F.explode("feats").alias("f")).join(counts, ["sl", "f"]).groupBy("sl", "_id").agg(F.sort_array(F.collect_set("f")).alias("_f"))
    out = keyed.join(kept, ["sl", "_id"], "left").withColumn("feats", F.coalesce("_f", F.array().cast("array<string>")))
    return out.groupBy("sl", "n_cls", "cls", "feats").agg(F.sum("w").alias("w")).select("sl", "n_cls", "cls", "w", "feats")


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_word(pdf: pd.DataFrame, iterations: int = 1000, least_gain: float = 0.01, smooth: float = 0.0, label_smooth: float = 0.0, length_norm: bool = False) -> pd.DataFrame:
    """One word's events, with a lambda0 (feature, cls, value) of each event's start where given. ``smooth`` is the deviation of a
    Gaussian prior, ``label_smooth`` the share of an event's weight that goes to other classes, ``length_norm`` lets an
    event's features weigh 1 together."""
    names = sorted({f for fs in pdf.feats for f in fs})
    place = {f: i for i, f in enumerate(names)}
    n, n_cls, m = len(pdf), int(pdf.n_cls.iloc[0]), len(names)
    per = np.array([len(fs) for fs in pdf.feats], "i8")
    row, feature = np.repeat(np.arange(n), per), np.array([place[f] for fs in pdf.feats for f in fs], "i8")
    x = 1.0 / per[row] if length_norm else np.ones(len(row))
    size = 1.0 if length_norm else float(max(per.max(initial=0), 1))
    w, cls = pdf.w.to_numpy(float), pdf.cls.to_numpy(int)
    share = np.full((n, n_cls), label_smooth / max(n_cls - 1, 1))
    share[np.arange(n), cls] = 1 - label_smooth
    sums = lambda v: np.stack([np.bincount(feature, v[row, k] * x, m) for k in range(n_cls)], 1)
    seen = sums(share * w[:, None])
    lam = np.zeros((m, n_cls))
    if "start" in pdf.columns:
        for start in pdf.start:
            for s in () if start is None else start:
                if s["feature"] in place:
                    lam[place[s["feature"]], s["cls"]] = s["lambda"]
    on, before = seen > 0, np.inf
    for _ in range(iterations + 1):
        p = softmax(np.stack([np.bincount(row, lam[feature, k] * x, n) for k in range(n_cls)], 1))
        perplexity = float(np.exp(-(w * np.log(np.maximum(p[np.arange(n), cls], 1e-300))).sum() / w.sum()))
        expected = np.maximum(sums(p * w[:, None])[on], 1e-300)
        step = (np.log(seen[on]) - np.log(expected)) / size
        if smooth:
            inverse = 1.0 / smooth**2
            for _ in range(20):
                grow = expected * np.exp(step * size)
                step = step - (grow + (lam[on] + step) * inverse - seen[on]) / (grow * size + inverse)
        lam[on] += step
        if abs(before - perplexity) <= least_gain:
            break
        before = perplexity
    rows = [(pdf.sl.iloc[0], f, k, float(lam[i, k])) for i, f in enumerate(names) for k in range(n_cls)]
    return pd.DataFrame(rows, columns=["sl", "feature", "cls", "lambda"])


def _with_values(ev: DataFrame, length_norm: bool) -> DataFrame:
    """ev (id, sl, n_cls, feats, …) by feature and class: k, feature, x."""
    x = F.lit(1.0) / F.size("feats") if length_norm else F.lit(1.0)
    each = ev.withColumn("x", x).select(*ev.columns, "x", F.explode("feats").alias("feature")).drop("feats")
    return each.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_cls") - 1)))


def _shares(label_smooth: float) -> Column:
    return F.when(F.col("k") == F.col("cls"), 1.0 - label_smooth).otherwise(F.lit(label_smooth) / F.greatest(F.col("n_cls") - 1, F.lit(1)))


def feature_sums(ev: DataFrame, label_smooth: float = 0.0, length_norm: bool = False) -> DataFrame:
    """sl, feature, cls, seen: what the model has to meet, the weight of events with the feature and class."""
    each = _with_values(ev.withColumn("id", F.lit(0)), length_norm)
    sums = each.groupBy("sl", "feature", F.col("k").alias("cls")).agg(F.sum(F.col("w") * F.col("x") * _shares(label_smooth)).alias("seen"))
    return sums.filter("seen > 0")


def _probabilities(ev: DataFrame, lam: DataFrame, length_norm: bool) -> DataFrame:
    """ev (id, sl, n_cls, feats, …) -> its columns but feats, k, p: probabilities of all classes."""
    classes = ev.drop("feats").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_cls") - 1)))
    terms = _with_values(ev.select("id", "sl", "n_cls", "feats"), length_norm).join(lam.select("sl", "feature", F.col("cls").alias("k"), "lambda"), ["sl", "feature", "k"])
    sums = terms.groupBy("sl", "id", "k").agg(F.sum(F.col("lambda") * F.col("x")).alias("s"))
    of = Window.partitionBy("sl", "id")
    e = classes.join(sums, ["sl", "id", "k"], "left").withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("e", F.exp(F.col("s") - F.max("s").over(of)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(of)).drop("s", "e")


def fit_large(ev: DataFrame, iterations: int = 1000, least_gain: float = 0.01, smooth: float = 0.0, label_smooth: float = 0.0, length_norm: bool = False, start: DataFrame | None = None) -> DataFrame:
    """``fit_word`` for words with very many contexts, as joins and grouped sums; tables cut each step's lineage."""
    ev = written(ev.select("sl", "n_cls", "cls", "w", "feats").withColumn("id", F.monotonically_increasing_id()), "events")
    size = ev.groupBy("sl").agg((F.lit(1) if length_norm else F.greatest(F.max(F.size("feats")), F.lit(1))).cast("double").alias("size"))
    each = _with_values(ev.select("id", "sl", "n_cls", "cls", "w", "feats"), length_norm)
    lam = each.groupBy("sl", "feature", F.col("k").alias("cls")).agg(F.sum(F.col("w") * F.col("x") * _shares(label_smooth)).alias("seen")).join(size, "sl")
    given = F.lit(0.0)
    if start is not None:
        lam, given = lam.join(start.select("sl", "feature", "cls", "lambda"), ["sl", "feature", "cls"], "left"), F.coalesce("lambda", F.lit(0.0))
    lam = written(lam.withColumn("lambda", given), "lambdas")
    state = size.select("sl", F.lit(float("inf")).alias("before"), F.lit(False).alias("done"))
    for _ in range(iterations + 1):
        going = F.broadcast(state.filter("not done").select("sl")) if state.count() < 100_000 else state.filter("not done").select("sl")
        p = written(_probabilities(ev.join(going, "sl", "left_semi"), lam, length_norm), "probabilities")
        now = p.filter("k = cls").groupBy("sl").agg(F.exp(-F.sum(F.col("w") * F.log(F.greatest("p", F.lit(1e-300)))) / F.sum("w")).alias("now"))
        terms = _with_values(ev.join(going, "sl", "left_semi").select("id", "sl", "n_cls", "feats"), length_norm).join(p.select("sl", "id", "k", "p", "w"), ["sl", "id", "k"])
        expected = terms.groupBy("sl", "feature", F.col("k").alias("cls")).agg(F.sum(F.col("w") * F.col("x") * F.col("p")).alias("expected"))
        met = lam.join(expected, ["sl", "feature", "cls"], "left").withColumn("expected", F.greatest("expected", F.lit(1e-300)))
        step = (F.log("seen") - F.log("expected")) / F.col("size")
        if smooth:  # Newton steps, as many as in fit_word
            inverse = 1.0 / smooth**2

            def newton(d: Column, _: Column) -> Column:
                grow = F.col("expected") * F.exp(d * F.col("size"))
                return d - (grow + (F.col("lambda") + d) * inverse - F.col("seen")) / (grow * F.col("size") + inverse)

            step = F.aggregate(F.sequence(F.lit(1), F.lit(20)), step, newton)
        moved = F.when(F.col("expected").isNotNull() & (F.col("seen") > 0), F.col("lambda") + step).otherwise(F.col("lambda"))
        new = written(met.withColumn("lambda", moved).drop("expected"), "lambdas")
        done = F.col("done") | F.coalesce(F.abs(F.col("before") - F.col("now")) <= least_gain, F.lit(False))
        last, state = state, written(state.join(now, "sl", "left").select("sl", F.coalesce("now", "before").alias("before"), done.alias("done")), "state")
        discard(lam, p, *[last] * hasattr(last, "written_at"))
        lam = new
        if state.filter("not done").isEmpty():
            break
    return lam.select("sl", "feature", "cls", "lambda")


def train(ev: DataFrame, iterations: int = 1000, least_gain: float = 0.01, smooth: float = 0.0, label_smooth: float = 0.0, length_norm: bool = False, start: DataFrame | None = None, group_rows: int = 20_000) -> DataFrame:
    """LAMBDAS for every word, with features as the events have them, texts or numbers. ``start``: LAMBDAS to begin with."""
    kind = ev.schema["feats"].dataType.elementType.simpleString()
    sizes = ev.groupBy("sl").agg(F.count(F.lit(1)).alias("n"))
    small = ev.join(sizes.filter(F.col("n") <= group_rows).select("sl"), "sl", "left_semi")
    if start is not None:
        # a word's start goes with its first event only
        given = start.groupBy("sl").agg(F.collect_list(F.struct("feature", "cls", "lambda")).alias("start"))
        first = F.row_number().over(Window.partitionBy("sl").orderBy("cls", "feats")) == 1
        small = small.withColumn("_first", first).join(given, "sl", "left").withColumn("start", F.when(F.col("_first"), F.col("start"))).drop("_first")
    out = small.groupBy("sl").applyInPandas(lambda pdf: fit_word(pdf, iterations, least_gain, smooth, label_smooth, length_norm), LAMBDAS.replace("feature string", f"feature {kind}"))
    large = sizes.filter(F.col("n") > group_rows).select("sl")
    if large.isEmpty():
        return out
    return out.union(fit_large(ev.join(large, "sl", "left_semi"), iterations, least_gain, smooth, label_smooth, length_norm, start))


def score(ev: DataFrame, lambdas: DataFrame, length_norm: bool = False) -> DataFrame:
    """id, sl, cls, p: class probabilities of events (id, sl, n_cls, feats)."""
    return _probabilities(ev.select("id", "sl", "n_cls", "feats"), lambdas, length_norm).select("id", "sl", F.col("k").alias("cls"), "p")


def join_lambdas(lambdas: DataFrame, lexicon: DataFrame) -> DataFrame:
    """sl, ngram, tl, weight = exp(lambda), for translations that the lexicon has."""
    of = lexicon.select("sl", "tl", F.col("tl_idx").alias("cls"))
    return lambdas.join(of, ["sl", "cls"]).select("sl", F.col("feature").alias("ngram"), "tl", F.exp("lambda").alias("weight"))
