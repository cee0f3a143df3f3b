"""Lexicons, contexts, pruning, maximum entropy, language model, evaluation and emitters on small data of our own."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varisel.functions import lu
from varisel.operators import dictionary, emit, evaluate, filters, language_model, legacy, lexicon, maxent, ngrams
from varisel.operators.matching import apply_to_text
from varisel.operators.rules import compile_rules
from varisel.plans import learned, learning
from varisel.sources import readers
from varisel.streaming import apply as streaming


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_lexicon_round_trip(spark):
    pairs = spark.createDataFrame([("a<n>", "x<n>")] * 3 + [("a<n>", "y<n>")] * 5 + [("b<n>", "z<n>")], "sl string, tl string")
    ranked = lexicon.ranked(lexicon.frequencies(pairs))
    text = [r.value for r in lexicon.lexicon_lines(ranked).orderBy("sl", "tl_idx").collect()]
    assert text == ["5.0000000000 ^a<n>$ ^y<n>$ @", "3.0000000000 ^a<n>$ ^x<n>$", "1.0000000000 ^b<n>$ ^z<n>$ @"]
    back = readers.frequency_lexicon(lines(spark, *text)).collect()
    assert {(r.sl, r.tl, r.freq, r.is_default, r.tl_idx) for r in back} == {(r.sl, r.tl, r.freq, r.is_default, r.tl_idx) for r in ranked.collect()}
    assert {(r.sl, r.default_tl) for r in lexicon.defaults(lexicon.frequencies(pairs)).collect()} == {("a<n>", "y<n>"), ("b<n>", "z<n>")}


def test_contexts(spark):
    got = spark.createDataFrame([(["p", "q", "r"], 0), (["p", "q", "r"], 1)], "w array<string>, i int").select(ngrams.contexts(F.col("w"), F.col("i"), 3).alias("x")).collect()
    assert got[0].x == ["p q", "p q r"] and got[1].x == ["p q", "q r", "p q r"]


def test_crispiness(spark):
    counts = spark.createDataFrame([("a", "a b", "x", 6.0), ("a", "a b", "y", 2.0), ("a", "a c", "x", 1.0)], "sl string, ngram string, tl string, cnt double")
    default = spark.createDataFrame([("a", "y")], "sl string, default_tl string")
    got = {(r.ngram, r.tl): (r.sign, r.crisp, r.weight) for r in ngrams.crispiness(counts, default).collect()}
    assert got == {("a b", "x"): ("+", 3.0, 0.75), ("a b", "y"): ("-", 1.0, 0.25), ("a c", "x"): ("-", 1.0, 1.0)}
    assert {(r.ngram, r.tl) for r in ngrams.prune_ngrams(counts, default).collect()} == {("a b", "x"), ("a c", "x")}


def test_pareto_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{s}", f"g{g}", f"t{t}", float(w)) for s in range(6) for t in range(5) for g, w in enumerate(rng.integers(0, 3, 3)) if w]
    rows += [("wide", f"g{g}", f"t{t}", float(w)) for t in range(150) for g, w in enumerate(rng.integers(0, 9, 5)) if w]  # bits in three blocks
    got = {(r.sl, r.tl): r.mass for r in ngrams.pareto(spark.createDataFrame(rows, "sl string, ngram string, tl string, weight double")).collect()}
    vectors = {}
    for s, g, t, w in rows:
        vectors.setdefault((s, t), {})[g] = w
    want = {}
    for (s, t), v in vectors.items():
        beaten = any(
            s2 == s and t2 != t and all(o.get(g, 0) >= v.get(g, 0) for g in {*o, *v}) and any(o.get(g, 0) > v.get(g, 0) for g in {*o, *v})
            for (s2, t2), o in vectors.items()
        )
        if not beaten:
            want[s, t] = sum(v.values())
    assert got == want


def test_maxent(spark):
    """Weights reproduce the conditional shares where the features tell contexts apart, in tasks and as jobs."""
    rows = [("a", 2, 0, 90.0, ["f"]), ("a", 2, 1, 10.0, ["f"]), ("a", 2, 0, 20.0, ["g"]), ("a", 2, 1, 80.0, ["g"])]
    ev = spark.createDataFrame(rows, "sl string, n_cls int, cls int, w double, feats array<string>")
    asked = spark.createDataFrame([(1, "a", 2, ["f"]), (2, "a", 2, ["g"]), (3, "a", 2, [])], "id long, sl string, n_cls int, feats array<string>")
    for group_rows in (100, 1):
        model = maxent.train(ev, iterations=40, least_gain=0.0, group_rows=group_rows)
        p = {(r.id, r.cls): r.p for r in maxent.score(asked, model).collect()}
        assert p[1, 0] == pytest.approx(0.9, abs=0.01) and p[2, 1] == pytest.approx(0.8, abs=0.01)
        assert p[3, 0] + p[3, 1] == pytest.approx(1.0)
    assert np.allclose(maxent.softmax(np.array([[2.0, 1.0]])), [[math.e / (1 + math.e), 1 / (1 + math.e)]])
    kept = maxent.select_features(ev.union(spark.createDataFrame([("a", 2, 0, 1.0, ["rare", "f"])], ev.schema))).collect()
    assert all("rare" not in r.feats for r in kept) and sum(r.w for r in kept) == 201.0
    assert (maxent.fit_word(pd.DataFrame(rows, columns=["sl", "n_cls", "cls", "w", "feats"]), smooth=1.0)["lambda"].abs() < 10).all()


def test_numbered_features_give_the_same_weights(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{s}", 2, int(rng.integers(2)), float(rng.integers(1, 5)), sorted({f"f{x}" for x in rng.integers(0, 6, rng.integers(0, 4))})) for s in range(3) for _ in range(25)]
    ev = spark.createDataFrame(rows, "sl string, n_cls int, cls int, w double, feats array<string>").groupBy("sl", "n_cls", "cls", "feats").agg(F.sum("w").alias("w"))
    ids = maxent.feature_ids(ev)
    assert sorted((r.feature, r.feature_id) for r in ids.collect()) == [(f"f{i}", i) for i in range(6)]
    for size in (20_000, 3):  # in tasks, and as joins
        want = {(r.sl, r.feature, r.cls): r["lambda"] for r in maxent.train(ev, iterations=3, group_rows=size).collect()}
        got = {(r.sl, r.feature, r.cls): r["lambda"] for r in maxent.decoded(maxent.train(maxent.encoded(ev, ids), iterations=3, group_rows=size), ids).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_scaling(events, n_cls, rounds, least_gain, smooth, label_smooth, length_norm):
    """The same model by plain loops over events, classes and features."""
    lam, size = {}, 1.0 if length_norm else max(max(len(f) for *_, f in events), 1)
    value = lambda f: 1 / len(f) if length_norm else 1.0
    seen = {}
    for cls, w, feats in events:
        for k in range(n_cls):
            share = 1 - label_smooth if k == cls else label_smooth / (n_cls - 1)
            for f in feats:
                seen[f, k] = seen.get((f, k), 0) + w * share * value(feats)
                lam[f, k] = 0.0
    before = float("inf")
    for _ in range(rounds + 1):
        expected, loss, total = dict.fromkeys(lam, 0.0), 0.0, 0.0
        for cls, w, feats in events:
            e = [math.exp(sum(lam[f, k] * value(feats) for f in feats)) for k in range(n_cls)]
            p = [x / sum(e) for x in e]
            loss, total = loss - w * math.log(p[cls]), total + w
            for k in range(n_cls):
                for f in feats:
                    expected[f, k] += w * p[k] * value(feats)
        for key in lam:
            if seen[key] > 0:
                step = (math.log(seen[key]) - math.log(expected[key])) / size
                if smooth:
                    for _ in range(20):
                        h = expected[key] * math.exp(step * size)
                        step -= (h + (lam[key] + step) / smooth**2 - seen[key]) / (h * size + 1 / smooth**2)
                lam[key] += step
        pp = math.exp(loss / total)
        if abs(before - pp) <= least_gain:
            break
        before = pp
    return lam


@pytest.mark.parametrize("options", [{}, {"smooth": 2.0}, {"label_smooth": 0.1}, {"length_norm": True}, {"smooth": 0.7, "label_smooth": 0.05}])
def test_maxent_equals_plain_loops(spark, options):
    rng = random.Random(3)
    data = {w: [(rng.randrange(n), float(rng.randint(1, 9)), sorted(rng.sample("pqrstuv", rng.randint(0, 4)))) for _ in range(25)] for w, n in (("a", 3), ("b", 2))}
    data = {w: list({(c, tuple(f)): (c, x, f) for c, x, f in ev}.values()) for w, ev in data.items()}
    classes = {"a": 3, "b": 2}
    ev = spark.createDataFrame([(w, classes[w], c, x, f) for w, own in data.items() for c, x, f in own], "sl string, n_cls int, cls int, w double, feats array<string>")
    full = {"smooth": 0.0, "label_smooth": 0.0, "length_norm": False} | options
    want = {(w, f, k): v for w, own in data.items() for (f, k), v in plain_scaling(own, classes[w], 4, 0.001, **full).items()}
    in_tasks = {(r.sl, r.feature, r.cls): r["lambda"] for r in maxent.train(ev, 4, 0.001, **full).collect()}
    assert in_tasks.keys() == want.keys() and all(in_tasks[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    if options in ({}, {"smooth": 0.7, "label_smooth": 0.05}):
        as_jobs = {(r.sl, r.feature, r.cls): r["lambda"] for r in maxent.train(ev, 4, 0.001, **full, group_rows=1).collect()}
        assert as_jobs.keys() == want.keys() and all(as_jobs[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        start = spark.createDataFrame([(*k, v) for k, v in want.items()], maxent.LAMBDAS)
        more = [{(r.sl, r.feature, r.cls): r["lambda"] for r in maxent.train(ev, 0, 0.0, **full, start=start, group_rows=n).collect()} for n in (100, 1)]
        assert all(more[0][k] == pytest.approx(more[1][k], abs=1e-9) for k in want) and more[0] != in_tasks


def test_language_model(spark):
    arpa = readers.language_model(lines(spark, "\\1-grams:", "-1.0\ta\t-0.5", "-2.0\tb", "-1.5\t</s>", "-9\t<s>\t-0.25", "\\2-grams:", "-0.3\ta b"))
    assert {(r.ord, r.ngram, r.logp, r.backoff) for r in arpa.collect()} == {(1, "a", -1.0, -0.5), (1, "b", -2.0, 0.0), (1, "</s>", -1.5, 0.0), (1, "<s>", -9.0, -0.25), (2, "a b", -0.3, 0.0)}
    lm = spark.createDataFrame([(1, "a", -1.0, -0.5), (1, "b", -2.0, 0.0), (1, "</s>", -1.5, 0.0), (1, "<s>", -9.0, -0.25), (2, "a b", -0.3, 0.0)], "ord int, ngram string, logp double, backoff double")
    got = language_model.sentence_scores(spark.createDataFrame([(1, ["a", "b"])], "id long, words array<string>"), lm, 2).first()
    assert got.score == pytest.approx(-0.25 - 1.0 - 0.3 - 1.5) and got.n == 3
    scored = spark.createDataFrame([(1, k, math.log10(p)) for k, p in enumerate((0.6, 0.3, 0.1))], "sent_id long, path_id int, score double")
    rows = language_model.ranked(language_model.normalised(scored), 0.8).orderBy("rank").collect()
    assert [r.mark for r in rows] == ["|@|", "|+|", "|-|"] and [round(r.prob, 6) for r in rows] == [0.6, 0.3, 0.1]


def test_paths_and_lookup(spark):
    bidix = spark.createDataFrame([("a", ["n"], "x", ["n"]), ("a", ["n"], "y", ["n"]), ("a", ["n", "sg"], "z", ["n"]), ("b", [], "w", [])], "sl_lemma string, sl_tags array<string>, tl_lemma string, tl_tags array<string>")
    units = spark.createDataFrame([(1, 0, " ", "a<n><pl>"), (1, 1, " ", "b<v>"), (1, 2, " ", "c<n>"), (1, 3, " ", "*d"), (1, 4, " ", "a<n><sg>")], "sent_id long, pos int, blank string, sl string")
    got = {r.sl: r.tls for r in dictionary.expand(units, bidix).collect()}
    assert got == {"a<n><pl>": ["x<n><pl>", "y<n><pl>"], "b<v>": ["w<v>"], "c<n>": ["@c<n>"], "*d": ["*d"], "a<n><sg>": ["z<n>"]}
    sents = dictionary.expand(units, bidix).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "blank", "sl", "tls"))).alias("lus"))
    paths = dictionary.paths(sents).orderBy("path_id").collect()
    assert [r.tls for r in paths] == [list(p) for p in itertools.product(["x<n><pl>", "y<n><pl>"], ["w<v>"], ["@c<n>"], ["*d"], ["z<n>"])]
    assert dictionary.path_lines(dictionary.paths(sents)).orderBy("path_id").first().value.startswith(".[][1 0].[]\t^a<n><pl>/x<n><pl>$ ^b<v>/w<v>$")
    again = readers.annotated_paths(dictionary.path_lines(dictionary.paths(sents))).orderBy("path_id").collect()
    assert [[(u.sl, u.tls) for u in r.lus] for r in again] == [[(s, [t]) for s, t in zip(p.sls, p.tls, strict=True)] for p in paths]
    overlap = dictionary.most_overlap(spark.createDataFrame([("a<n><sg>",)], "sl string"), spark.createDataFrame([("a", "a<n><pl>"), ("a", "a<n><sg><x>")], "lemma string, cand string"))
    assert overlap.first().cand == "a<n><sg><x>"
    others = dictionary.most_overlap(spark.createDataFrame([("B<n><sg>",), ("B<np><sg>",), ("*c",), ("d<n>",)], "sl string"), spark.createDataFrame([("b", "b<vblex>"), ("B", "B<np>"), ("c", "c<n>")], "lemma string, cand string"))
    assert {r.sl: r.cand for r in others.collect()} == {"B<n><sg>": "b", "B<np><sg>": "B<np>", "*c": "*c", "d<n>": "d<n>"}


def test_trimming(spark):
    """Tags that a dictionary entry inserts, drops or moves."""
    rows = [("house", ["n"], "casa", ["n", "f"]), ("run", ["v", "past"], "correr", ["past", "v"]), ("old", ["adj"], "viejo", ["adj"]), ("of", ["pr"], "", ["pr"])]
    bidix = spark.createDataFrame(rows, "sl_lemma string, sl_tags array<string>, tl_lemma string, tl_tags array<string>")
    units = spark.createDataFrame([(1, i, s, s) for i, s in enumerate(["house<n><sg>", "run<v><past>", "old<adj><sup>", "*x", "y<n>"])], "sent_id long, pos int, sl string, own string")
    got = {r.own: (r.sl, r.tls) for r in dictionary.expand(units, bidix, trim=True).collect()}
    assert got == {"house<n><sg>": ("house<n><*>", ["casa<n><f><*>"]), "run<v><past>": ("run<*>", ["correr<past><v>"]), "old<adj><sup>": ("old<adj><sup>", ["viejo<adj><*>"]), "*x": ("*x", ["*x"]), "y<n>": ("y<n>", ["@y<n>"])}
    lines_ = {r.sl: r.value for r in dictionary.tagger_units(units, bidix).collect()}
    assert lines_ == {"house<n><sg>": "house<n>/casa<n><f>", "run<v><past>": "run<v><past>/correr<past><v>", "old<adj><sup>": "old<adj>/viejo<adj>", "*x": "*x/@*x", "y<n>": "y<n>/@y<n>"}


def test_admissible_patterns(spark):
    """Every reason of both forms, in their order, and the weight of a rule."""
    cols = "sign string, crisp double, weight double, sl string, ngram string, tl string"
    rows = [
        ("+", 4.0, 0.5, "a<n>", "the<det> a<n>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "a<n> .<sent>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "the<det> A<n>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "the<det> a<n>", "x<adj>"),
        ("+", 4.0, 0.5, "a<n>", "the<det> a<n>", "x<vbmod>"), ("+", 4.0, 0.5, "a<n>", "the<det> a<n>", "x<pr>"), ("+", 3.0, 0.5, "a<n>", "the<det> a<n>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "*u a<n>", "x<n>"),
        ("-", 4.0, 0.5, "a<n>", "the<det> a<n>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "a<n>", "x<n>"), ("+", 4.0, 0.5, "a<adj>", "a<adj> b<n>", "x<n>"), ("+", 4.0, 0.5, "a<n>", "", "x<n>"), ("+", 4.0, 0.5, "a<n>", "a<n> (<lpar>", "x<n>"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], cols + ", i int").repartition(1)
    reasons = lambda **o: [r.reason for r in emit.admissible(df, **o).orderBy("i").collect()]
    assert reasons() == [None, "punctuation", "word not in pattern", "class differs", "class differs", "part of speech", "weight", "unknown word", None, None, None, "word not in pattern", None]
    assert reasons(learned=True) == [None, "punctuation", None, "class differs", "class differs", "part of speech", None, None, "default", "too short", None, None, None]
    rules = [r.rule for r in emit.pattern_rules(df.filter("i in (0, 11)"), learned=True).orderBy("ngram").collect()]
    assert rules == ['<rule weight="4.0000000000"><match lemma="a" tags="n"><select lemma="x" tags="n"/></match></rule>', '<rule weight="4.0000000000"><match lemma="the" tags="det"/><match lemma="a" tags="n"><select lemma="x" tags="n"/></match></rule>']


def test_pattern_lines_round_trip(spark):
    p = spark.createDataFrame([("+", 3.5, 0.25, 8.0, 5.0, 2.0, "a<n>", "the<det> a<n>", "x<n>")], "sign string, crisp double, weight double, total double, max_freq double, tl_freq double, sl string, ngram string, tl string")
    (line,) = ngrams.pattern_lines(p).collect()
    assert line.value == "+ 3.5000000000 0.2500000000 8.0000000000 5.0000000000 2.0000000000\t^a<n>$\tthe<det> a<n>\t^x<n>$\t2.0000000000"
    assert tuple(ngrams.read_patterns(ngrams.pattern_lines(p)).first()) == ("+", 3.5, "a<n>", "the<det> a<n>", "x<n>", 2.0)


def test_filters(spark):
    df = lines(spark, "^a<n>/x/y$", "^a<n>/x$", "^*u/*u$ ^b<pr>/q/r$")
    sents = readers.sentences(df)
    assert [r.sent_id for r in filters.ambiguous_sentences(sents).orderBy("sent_id").collect()] == [0, 2]
    assert [r.sent_id for r in filters.covered(sents).orderBy("sent_id").collect()] == [0, 1]
    assert [(r.sent_id, r.fertility) for r in filters.fertile(sents).orderBy("sent_id").collect()] == [(0, 2), (2, 2)]
    assert [r.sent_id for r in filters.enumerable(sents).collect()] == [0]
    unit = lambda *words: readers.sentences(lines(spark, " ".join(words)))
    # an unknown word counts twice: 1 of 16 is 87.5 %, 1 of 20 is 90 %
    assert filters.enumerable(unit("^a<n>/x/y$", *["^b<n>/z$"] * 14, "^*u/*u$")).isEmpty() and not filters.enumerable(unit("^a<n>/x/y$", *["^b<n>/z$"] * 18, "^*u/*u$")).isEmpty()
    numbers = readers.line_numbers(lines(spark, "0", "2", "x"))
    assert filters.retained(df, numbers).count() == 2 and filters.discarded(df, numbers).count() == 1
    many = spark.range(1000).select(F.col("id").alias("line_no"))
    parts = {r.part: r["count"] for r in filters.split_corpus(many, 50, 70).groupBy("part").count().collect()}
    assert parts == {"dev": 50, "test": 70, "train": 880}
    a, b = filters.sub_corpus(many, 30, 1), filters.sub_corpus(many, 30, 1)
    assert a.count() == 30 and a.exceptAll(b).isEmpty()


def test_missing_entries(spark):
    units = spark.createDataFrame([(1, 0, "a<n>", ["x<n>", "y<n>"]), (1, 1, "b<n>", ["z<n>"]), (2, 0, "a<n>", ["x<n>", "w<n>"])], "sent_id long, pos int, sl string, tls array<string>")
    aligned = spark.createDataFrame([(1, 0, "w<n>"), (1, 0, "v<adj>"), (1, 1, "q<n>"), (2, 0, "w<n>")], "sent_id long, pos int, tl string")
    assert {tuple(r) for r in filters.missing_entries(aligned, units).collect()} == {("a<n>", "w<n>"), ("a<n>", "v<adj>")}
    assert {tuple(r) for r in filters.missing_entries(aligned, units, same_class=True).collect()} == {("a<n>", "w<n>")}
    table = spark.createDataFrame([("n.sg", "NOUN")], "tags string, value string")
    back = dictionary.tag_backoff(spark.createDataFrame([("a<n><sg><x>",), ("b<v><past>",)], "sl string"), table)
    assert {r.sl: (r.tags, r.value) for r in back.collect()} == {"a<n><sg><x>": ("n.sg", "NOUN"), "b<v><past>": (None, "v.past")}


def test_evaluation(spark):
    sents = lambda *v: readers.sentences(lines(spark, *v)).withColumnRenamed("sent_id", "line_no")
    src = sents("^a<n>/x<n>/y<n>$ ^b<n>/p<n>$", "^a<n>/x<n>/y<n>/z<n>$")
    ref = sents("^a<n>/x<n>$ ^b<n>/p<n>$", "^a<n>/y<n>/z<n>$")
    tst = sents("^a<n>/y<n>$ ^b<n>/p<n>$", "^a<n>/z<n>$")
    r = evaluate.error_rate(src, ref, tst).first()
    assert (r.fails, r.total, r.percent) == (1, 2, 50.0)
    assert evaluate.sanity(src, ref, tst).count() == 0
    assert evaluate.sanity(src, ref, sents("^a<n>/y<n>$", "^a<n>/other<n>$")).count() == 2


def test_learned_rules_choose_better(spark):
    """From a word-aligned corpus to rules to their use: context decides between two translations."""
    rows = []
    for k in range(40):
        near = "river<n>" if k % 2 else "money<n>"
        tl = "orilla<n>" if k % 2 and k % 10 != 1 else "banco<n>"  # the default occurs by the river too
        rows.append((k, ["the<det>", near, "bank<n>"], ["el<det>", near, tl]))
    rows.append((40, ["bank<n>", "x<n>"], ["banco<n>", "x<n>"]))
    unit = lambda i, w: (i, " ", w, ["banco<n>", "orilla<n>"] if w == "bank<n>" else [w])
    data = [(k, sl, [unit(i, w) for i, w in enumerate(sl)], tl, [(i, i) for i in range(len(sl))]) for k, sl, tl in rows]
    cands = spark.createDataFrame(data, f"line_no long, sl array<string>, bt {lu.LU_TYPE}, tl array<string>, align array<struct<t:int,s:int>>")
    learned = learning.from_parallel(cands, threshold=1.5)
    xml = "<rules>" + "".join(r.rule for r in learned["rules"].collect()) + "</rules>"
    text = spark.createDataFrame([(1, "^river<n>/río<n>$ ^bank<n>/banco<n>/orilla<n>$"), (2, "^money<n>/dinero<n>$ ^bank<n>/banco<n>/orilla<n>$")], "segment_id long, text string")
    got = {r.segment_id: r.text for r in apply_to_text(text, compile_rules(xml)).collect()}
    assert got[1] == "^river<n>/río<n>$ ^bank<n>/orilla<n>$"
    assert got[2].endswith(("banco<n>$", "banco<n>/orilla<n>$"))


def test_emitters(spark):
    entries = emit.bidix_entries(lines(spark, '<e><p><l>a<s n="n"/></l><r>x<s n="n"/></r></p></e>', '<e r="LR"><p><l>b<s n="n"/></l><r>p<s n="n"/></r></p></e>', '<e r="RL"><p><l>a<s n="n"/></l><r>y<s n="n"/></r></p></e>'))
    got = emit.bidix_default_rules(entries).collect()
    assert [r.rule for r in got] == ['<rule><match lemma="a" tags="n.*"><select lemma="x" tags="n.*"/></match></rule>']
    entry = lambda attrs, a, b: f'<e{attrs}><p><l>{a}<s n="n"/></l><r>{b}<s n="n"/></r></p></e>'
    pairs = [(' r="LR"', "a", "x"), (' r="RL"', "a", "y"), (' r="LR"', "b", "x"), (' r="LR"', "b", "y"), ("", "c", "x"), (' r="LR"', "c", "y"), (' r="RL"', "d", "x"), (' r="RL"', "d", "y"), ("", "e", "x"), ("", "f", "z"), (' r="RL"', "f", "z")]
    one_way = emit.bidix_entries(lines(spark, *[entry(*p) for p in pairs]))
    named = lambda direction: {(r.source[0], r.target[0]) for r in emit.bidix_default_rules(one_way, direction).collect()}
    assert named("lr") == {("a", "x"), ("f", "z")}
    assert named("rl") == set()
    assert emit.constraint_grammar('<rules><rule><match lemma="b"/><match lemma="a" tags="n.*"><select lemma="y"/></match></rule></rules>') == ['SELECT ("y") IF (0 ("a" n)) (-1 ("b")) ;']


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo\n\nfour\n")
    got = {r.line_no: r.value for r in readers.numbered_lines(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {0: "one", 1: "two", 2: "", 3: "four"}
    p = readers.phrase_table(lines(spark, "el gato ||| the cat ||| 0-0 1-1")).first()
    assert p.tl == ["el", "gato"] and p.sl == ["the", "cat"] and [(x.t, x.s) for x in p.align] == [(0, 0), (1, 1)]
    w = readers.word_alignments(lines(spark, "noise", "# Sentence pair (1)", "el gato", "NULL ({ }) the ({ 1 }) cat ({ 2 })")).first()
    assert w.src == ["the", "cat"] and w.tgt == ["el", "gato"] and [(x.t, x.s) for x in w.align] == [(0, 0), (1, 1)]
    a = readers.annotated_paths(lines(spark, ".[][7 1].[]\t^a<n>/x<n>$\t0.25\t|@|", "noise", ".[][7 2].[]\t^a<n>/y<n>$\tnan\t")).orderBy("path_id").collect()
    assert [(r.sent_id, r.path_id, r.frac, r.flag) for r in a] == [(7, 1, 0.25, "|@|"), (7, 2, 0.0, "")]
    e = readers.event_lines(lines(spark, "1 $ 20 # f:0 g:0 # f:1 g:1 #", "TEST", "0 # f:0 # f:1 #")).orderBy("line_no").collect()
    assert (e[0].cls, e[0].w, e[0].feats, e[0].test) == (1, 20.0, [["f:0", "g:0"], ["f:1", "g:1"]], False) and e[-1].test


def test_stream(spark, tmp_path):
    rules = compile_rules('<rules><rule><match lemma="b"/><match lemma="a"><select lemma="y"/></match></rule></rules>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("^b<n>/b<n>$ ^a<n>/x<n>/y<n>$\0^a<n>/x<n>/y<n>$\0")
    q = streaming.run(streaming.read_segments(spark, str(tmp_path / "in")), rules, str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"^b<n>/b<n>$ ^a<n>/y<n>$", "^a<n>/x<n>/y<n>$"}


def test_legacy(spark):
    rules = legacy.parse_rules(spark.createDataFrame([(1, 's\t("a" n)\t("y" n)\t(-1 "b" n)'), (2, 'r\t("a" n)\t("x" n)\t')], "rule_id int, value string"))
    units = spark.createDataFrame([(1, 0, "b<n>", ["b<n>"]), (1, 1, "a<n>", ["x<n>", "y<n>", "z<n>"]), (1, 2, "a<n>", ["x<n>", "y<n>", "z<n>"])], "sent_id long, pos int, sl string, tls array<string>")
    got = {r.pos: r.tls for r in legacy.apply(units, rules).collect()}
    assert got == {0: ["b<n>"], 1: ["y<n>"], 2: ["y<n>", "z<n>"]}
    near = spark.createDataFrame([(1, 0, "a<n>", ["y<n><f>", "yes<n>", "y<vblex>", "z<n>"]), (2, 0, "a<np>", ["y<n>", "z<n>"])], "sent_id long, pos int, sl string, tls array<string>")
    select = legacy.parse_rules(spark.createDataFrame([(1, 's\t("a" n)\t("y" n)\t')], "rule_id int, value string"))
    assert {r.sent_id: r.tls for r in legacy.apply(near, select).collect()} == {1: ["y<n><f>"], 2: ["y<n>", "z<n>"]}
    chosen = legacy.frequency_choice(units, spark.createDataFrame([("y<n>", 5), ("x<n>", 2)], "tl string, freq long"))
    assert {r.pos: r.tls for r in chosen.collect()} == {0: ["b<n>"], 1: ["y<n>"], 2: ["y<n>"]}


def test_events_of_places(spark):
    """Places with their contexts give the events of places and contexts apart; stored, they do not go back to the lines."""
    rows = [(1, 0, "a", "x", 1.0, ["a b"]), (1, 1, "b", "u", 1.0, ["a b", "b c"]), (2, 0, "a", "y", 0.5, ["a b"]), (3, 0, "a", "x", 2.0, ["a b"]), (4, 0, "a", "x", 0.0, ["z"]), (5, 0, "a", "q", 1.0, ["a b"])]
    placed = spark.createDataFrame(rows, "sent_id long, pos int, sl string, tl string, w double, feats array<string>")
    lex = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "u", 0)], "sl string, tl string, tl_idx int")
    got = sorted(map(tuple, maxent.placed_events(placed, lex).collect()))
    assert got == [("a", 2, 0, 3.0, ["a b"]), ("a", 2, 1, 0.5, ["a b"])]
    assert got == sorted(map(tuple, maxent.events(placed.drop("feats"), placed.select("sent_id", "pos", F.explode("feats").alias("ngram")), lex).collect()))
    ev = learned._events(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in ev._jdf.queryExecution().executedPlan().toString()


def test_summed_shares_of_paths(spark):
    """Sums over paths equal those of the pairs of each path, and paths that lie with their sentences are not shuffled."""
    unit = "array<struct<pos:int,blank:string,sl:string,tls:array<string>>>"
    am = spark.createDataFrame([(1, [(0, " ", "a", ["x", "y"]), (1, " ", "b", ["u"])]), (2, [(0, " ", "a", ["x", "y", "x"])]), (3, [])], f"sent_id long, lus {unit}")
    path = lambda *tls: [(i, " ", "", list(t)) for i, t in enumerate(tls)]
    rows = [(1, 0, path("x", "u"), 0.25), (1, 1, path("y", "u"), 0.5), (1, 2, path("x", "u"), 0.125), (1, 3, path("x"), 9.0), (2, 0, path([]), 0.5), (2, 1, path("x"), 0.25), (2, 2, path("xy"), 0.25), (4, 0, path("x"), 1.0)]
    annotated = spark.createDataFrame(rows, f"sent_id long, path_id int, lus {unit}, frac double")
    got = sorted(map(tuple, lexicon.fractional_sums(am, annotated).collect()))
    pairs = lexicon.fractional_pairs(am, annotated).groupBy("sent_id", "pos", "sl", "tl").agg(F.sum("frac").alias("frac"))
    assert got == sorted(map(tuple, pairs.collect())) == [(1, 0, "a", "x", 0.375), (1, 0, "a", "y", 0.5), (2, 0, "a", "", 0.5), (2, 0, "a", "x", 0.5)]
    few = am.groupBy("sent_id").agg(F.first("lus").alias("lus"))
    all_ = dictionary.paths(few).select("sent_id", "path_id", F.transform("tls", lambda t, i: F.struct(i.alias("pos"), F.lit(" ").alias("blank"), F.lit("").alias("sl"), F.array(t).alias("tls"))).alias("lus"), F.lit(0.5).alias("frac"))
    plan = lexicon.fractional_sums(few, all_)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sent_id") == 2  # each side's sentences; no path
