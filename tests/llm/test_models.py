"""Sharding, language model, chat formatting, quality and top-k, against brute force or held-out rows."""

import bisect
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from varisel.llm import chat, lm_scoring, quality, sharding, top_k

BLANK = "[\x20\x09-\x0d]+"
LOW = {i: i + 32 for i in range(65, 91)}


def test_capacity_tree():
    rng = random.Random(1)
    tree, held = sharding.CapacityTree(), []
    for n in range(3000):
        if held and rng.random() < 0.45:
            tree.remove(held.pop(rng.randrange(len(held))))
        else:
            key = (rng.randint(0, 50), n)
            bisect.insort(held, key)
            tree.insert(key)
        size = rng.randint(0, 55)
        at = bisect.bisect_left(held, (size, -1))
        assert tree.tightest(size) == (held[at] if at < len(held) else None)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t.left), depth(t.right))

    assert depth(tree.root) <= 2 * math.log2(len(held) + 1) + 1


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 60))]
        capacity = rng.randint(60, 120)
        got = sharding.best_fit_decreasing(sizes, capacity)
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(capacity - b, k) for k, b in enumerate(bins) if capacity - b >= sizes[i]]
            if fits:
                want[i] = min(fits)[1]
                bins[want[i]] += sizes[i]
            else:
                want[i] = len(bins)
                bins.append(sizes[i])
        assert got == [want[i] for i in range(len(sizes))]
        into = sharding.into_bins(sizes, 4)
        assert set(into) <= set(range(4))


def test_shards(docs, no_docs, texts):
    rows = sharding.shard_documents(docs, 4).toPandas()
    assert sorted((str(r.doc_id) if r.doc_id == r.doc_id else "None", r.size, r.text_crc32) for r in rows.astype({"doc_id": "Int64"}).itertuples() if r.doc_id is not None and str(r.doc_id) != "<NA>") == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    assert len(rows) == len(texts)
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert rows.groupby(["text_crc32", "size"]).shard.nunique().max() == 1  # equal texts stay together
    assert set(rows.shard) <= set(range(4))
    loads = rows.groupby("shard")["size"].sum()
    largest = rows.groupby(["text_crc32", "size"])["size"].sum().max()
    assert loads.max() <= max(largest, rows["size"].sum() / 4 * 1.05)
    assert sharding.shard_documents(no_docs).count() == 0


def test_a_large_group_leaves_the_rest_even(spark):
    for sizes, n, want in (([1000, 500, 500, 500, 500], 16, [1000, 500, 500, 500, 500]), ([1] * 24, 16, [2] * 8 + [1] * 8), ([900, 90, *[1] * 140], 16, [900, 90, *[10] * 14])):
        loads = [0] * n
        for size, b in zip(sizes, sharding.into_bins(sizes, n), strict=True):
            loads[b] += size
        assert sorted(filter(None, loads), reverse=True) == want
    rng = random.Random(12)
    for share in (1 / 3, 0.999):
        small = [(f"g{k}", rng.randint(1, 40)) for k in range(20_000)]
        total = sum(s for _, s in small)
        rows = [*small, *[("large", max(1, int(total * share / (1 - share)) // 10))] * 10]
        got = sharding.assign_shards(spark.createDataFrame(rows, "k string, size long"), "k", "size", 16).toPandas()
        loads = got.groupby("shard")["size"].sum().sort_values()
        assert got[got.k == "large"].shard.nunique() == 1 and len(loads) == 16
        assert loads.iloc[0] >= 0.98 * total / 15 and loads.iloc[-2] <= 1.02 * total / 15


def test_fixed_capacity(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 300)}" if rng.random() < 0.98 else None, rng.randint(-2, 40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, size long")
    got = sharding.assign_shards(df, "k", "size", capacity=2000).toPandas()
    assert len(got) == len(rows)
    assert got.fillna({"k": "null"}).groupby("k").shard.nunique().max() == 1
    loads = got.assign(size=got["size"].clip(lower=0)).groupby("shard")["size"].sum()
    groups = got.assign(size=got["size"].clip(lower=0)).fillna({"k": "null"}).groupby("k")["size"].sum()
    assert loads.max() <= max(2000, groups.max())
    assert len(loads) <= math.ceil(1.25 * loads.sum() / 2000)


def lm_tokens(t):
    return [w for w in re.split(BLANK, (t or "").translate(LOW)) if w] + [None]


def test_language_model(docs, no_docs, texts):
    rows = lm_scoring.score_texts(docs).toPandas()
    assert len(rows) == len(texts)
    train = [lm_tokens(t) for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for w in itertools.chain(*train):
        counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        ws = lm_tokens(t)
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        want.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in counts for w in ws), n, round(base, 4)))
    got = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows.itertuples()]
    assert sorted(got) == sorted(want)
    assert np.isfinite(rows.score).all() and (rows.score < 0).all()
    assert lm_scoring.score_texts(no_docs).count() == 0


def test_held_out_texts_are_likelier(spark):
    """Text with order in its words: the pair model beats the word model on documents that it has not seen."""
    rng = random.Random(4)
    follow = {w: rng.sample(range(200), 3) for w in range(200)}

    def text():
        w, out = rng.randrange(200), []
        for _ in range(120):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.randrange(200)
            out.append(f"w{w}")
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    rows = lm_scoring.score_texts(df).toPandas()
    held = rows[rows.held_out]
    assert len(held) > 20 and held.score.sum() > 0.75 * held.base_score.sum()  # logs: nearer to zero is likelier
    assert (held.score > held.base_score).all()


def filter_of(texts):
    """The filter of some texts by the operator's own steps, at production density, and what scoring needs."""
    import collections

    hashes, per = lm_scoring.tokens(pa.array(texts))
    word, history, pair = lm_scoring.grams(hashes, per)
    keys, counts = np.unique(np.concatenate([word, pair]), return_counts=True)
    level, is_word = lm_scoring.levels_of(counts), keys & np.uint64(1) == 0
    sums = collections.Counter()
    on = ~is_word
    for h, g in zip((keys[on] >> np.uint64(32)).tolist(), lm_scoring.middle(level[on]), strict=True):
        sums[h] += g
    codes = {h: int(lm_scoring.code_of(np.array([g]))[0]) for h, g in sums.items()}
    probes = lm_scoring.probes_for(int(is_word.sum()))
    ones = level[~is_word].sum() * probes + level[is_word].sum() * lm_scoring.WORD_PROBES + sum(c.bit_count() for c in codes.values()) * lm_scoring.CODE_PROBES
    blocks = max(1, -(-int(ones / math.log(2)) // lm_scoring.BLOCK_BITS))
    names = np.array(sorted(codes), "<u8")
    bits = lm_scoring.Bits(np.concatenate([keys, lm_scoring.code_key(names)]), 0, blocks, blocks)
    for j in range(1, level.max() + 1):
        bits.fill(np.flatnonzero((level >= j) & is_word), j, lm_scoring.WORD_PROBES)
        bits.fill(np.flatnonzero((level >= j) & ~is_word), j, probes)
    for d in range(lm_scoring.DIGITS):
        bits.fill(len(keys) + np.flatnonzero([codes[h] >> d & 1 for h in names.tolist()]), d, lm_scoring.CODE_PROBES)
    lookup = lm_scoring.Filter(bits.blocks().ravel(), 0, blocks, probes, int(level.max()))
    norm = lm_scoring.middle(level[is_word]).sum() + is_word.sum() + 1
    return lookup, keys, counts, names, codes, norm, bits.bits.mean()


@pytest.fixture(scope="module")
def filled():
    rng = np.random.default_rng(9)
    # 60,000 words, most of them rare, and runs that repeat
    text = lambda n: " ".join(f"w{x}" for x in (60_000 * rng.random(n) ** 4).astype(int))
    return filter_of([text(2000) for _ in range(500)])


def test_filter_levels(filled):
    lookup, keys, counts, names, codes, _, density = filled
    assert 0.3 < density < 0.55  # as dense as filters of any size are, up to whole blocks
    is_word = keys & np.uint64(1) == 0
    both = lambda f: np.where(is_word, f.levels(keys, lm_scoring.WORD_PROBES), f.levels(keys))
    true, got = lm_scoring.levels_of(counts), both(lookup)
    assert (got >= true).all() and (got == true).mean() > 0.999  # a filter never loses a count
    others = lm_scoring.mixed(np.random.default_rng(1).integers(0, 2**62, 200_000).astype("<u8"))
    assert (lookup.levels(others) > 0).mean() < 0.0001
    own = np.array([codes[h] for h in names.tolist()])
    assert (lookup.codes(names) & own == own).all() and (lookup.codes(names) == own).mean() > 0.9998  # nor a digit
    data = lookup.data
    half = len(data) // 2 // (lm_scoring.BLOCK_BITS // 8) * (lm_scoring.BLOCK_BITS // 8)
    first = lm_scoring.BLOCK_BITS // 8
    slices = [lm_scoring.Filter(data[a:b], a // first, lookup.total, lookup.probes, lookup.top) for a, b in ((0, half), (half, len(data)))]
    assert np.array_equal(sum(both(s) for s in slices), got) and np.array_equal(sum(s.codes(names) for s in slices), lookup.codes(names))


def test_levels_hold_counts():
    c = np.arange(1, 5000)
    level = lm_scoring.levels_of(c)
    assert np.array_equal(level, 1 + np.floor(np.log2(c)))
    assert (np.abs(np.log2(lm_scoring.middle(level) / c)) < 1).all() and lm_scoring.middle(level)[0] == 1 and lm_scoring.middle(np.zeros(1))[0] == 0


def test_scores_equal_a_plain_model(spark):
    """Scores against dictionaries of the same levels, pairs that occur once among them."""
    rng = random.Random(21)
    texts = [(i, " ".join(f"w{int(400 * rng.random() ** 3)}" for _ in range(rng.randint(5, 80)))) for i in range(150)]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    g = lambda c: 0.0 if c == 0 else 1.5 * 2.0 ** (c.bit_length() - 1) - 0.5
    words, pairs = {}, {}
    framed = {i: ["<s>", *t.split(), "</s>"] for i, t in texts}
    for i, w in framed.items():
        if not lm_scoring.held_out(i):
            for a, b in zip(w, w[1:], strict=False):
                words[b] = words.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
    sums = {}
    for (a, _), c in pairs.items():
        sums[a] = sums.get(a, 0.0) + g(c)
    rounded = lambda x: 0.0 if x == 0 else lm_scoring.STEP ** round(math.log(x) / math.log(lm_scoring.STEP))
    norm = sum(map(g, words.values())) + len(words) + 1
    prob = lambda a, b, k: (g(pairs.get((a, b), 0)) + k * (g(words.get(b, 0)) + 1) / norm) / (rounded(sums.get(a, 0.0)) + k)
    score = lambda i, k: sum(math.log10(prob(a, b, k)) for a, b in zip(framed[i], framed[i][1:], strict=False))
    best = min(lm_scoring.PRIORS, key=lambda k: sum(abs(score(i, k) - got[i]) for i in got))
    near = [abs(score(i, best) - got[i]) < 1e-6 for i in got]
    assert sum(near) >= 0.97 * len(near)  # a false member may lift one


def test_model_is_a_distribution(filled):
    """The probabilities of all words of the vocabulary, and of an unknown one, sum to 1 behind any history."""
    lookup, keys, _, _, _, norm, _ = filled
    words = keys[keys & np.uint64(1) == 0]
    hashes, per = lm_scoring.tokens(pa.array([" ".join(f"w{i}" for i in range(60_000)) + " " + " ".join(f"w{i % 997}" for i in range(1000))]))
    of = {int(k): h for k, h in zip(lm_scoring.mixed(hashes) & ~np.uint64(1), hashes, strict=True)}
    vocabulary = np.array([of[int(w)] for w in words], "<u8")
    level = lookup.levels(words, lm_scoring.WORD_PROBES)
    sums, rng = [], np.random.default_rng(3)
    for before in [*hashes[:40], *rng.choice(hashes, 100), lm_scoring.START, np.uint64(12345)]:
        two = np.stack([np.full(len(words), before), vocabulary], 1).ravel()
        _, history, pair = lm_scoring.grams(two, np.full(len(words), 2))
        code = lookup.codes(history[1:2])[0]
        for prior in (lm_scoring.PRIORS[0], lm_scoring.PRIORS[2]):
            p = 10 ** lm_scoring.log_scores(level, lookup.levels(pair[1::2]), np.full(len(words), code), norm, (prior,))[0]
            unknown = 10 ** lm_scoring.log_scores(np.zeros(1, "i8"), np.zeros(1, "i8"), np.array([code]), norm, (prior,))[0]
            sums.append(p.sum() + unknown[0])
    sums = np.array(sums)
    assert (np.abs(sums - 1) < 0.01).mean() > 0.9 and (np.abs(sums - 1) < 0.3).all() and abs(sums.mean() - 1) < 0.01


def test_slices_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1 << 14)
    whole, parts = (lm_scoring.score_texts(docs, n).toPandas() for n in (1 << 28, 1 << 19))
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in df.itertuples())
    assert key(whole) == key(parts)


def test_chat(spark):
    rng = random.Random(6)
    turns, roles = [], ["user", "assistant", "system", None]
    for c in range(40):
        for k in range(rng.randint(0, 6)):
            turns.append((c, k, roles[rng.randrange(4)] if rng.random() < 0.3 else roles[k % 2], rng.choice(["a", "b\nc", "", None, "<|end|> <|x|>", "long text " * 3]), "x", 1))
    turns += [(None, 0, "assistant", "lost", "x", 1), (99, None, "user", "null turn", "x", 1), (99, 1, "assistant", "yes", "x", 1), (99, 1, "assistant", "yes", "x", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, turns string, said int")
    convs = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.conversations(df).collect()}
    assert None not in convs and convs[99] == [("user", "null turn"), ("assistant", "yes"), ("assistant", "yes")]
    ids = sorted(convs)
    pairs = [(k, convs[a], convs[b]) for k, (a, b) in enumerate(itertools.product(ids[:9], ids[:9]))]
    pairs += [(1000, convs[ids[0]], convs[ids[0]] + [("assistant", "more")]), (1001, [], [])]
    got = chat.format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}")).collect()
    assert len(got) == len(pairs)
    safe = lambda t: t.replace("<|", "< |")
    show = lambda ts: "".join(f"<|{safe(r)}|>\n{safe(t)}<|end|>\n" for r, t in ts)
    for r in got:
        _, a, b = next(p for p in pairs if p[0] == r.pair_id)
        n = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False))))
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for turns_, text, spans in ((a[n:], r.chosen, r.chosen_spans), (b[n:], r.rejected, r.rejected_spans)):
            assert [text[s.start : s.stop] for s in spans] == [safe(t) + "<|end|>" for role, t in turns_ if role == "assistant"]
    stale = {r.pair_id: r for r in chat.with_stale_replies(chat.conversations(df)).collect()}
    assert set(stale) == {c for c, ts in convs.items() if any(role == "assistant" for role, _ in ts)}
    for c, r in stale.items():
        assert [tuple(t) for t in r.chosen] == convs[c]
        last = max(i for i, t in enumerate(r.chosen) if t.role == "assistant")
        assert r.rejected[last].role == "assistant" and r.chosen[:last] == r.rejected[:last] and r.chosen[last + 1 :] == r.rejected[last + 1 :]
    for chat.SHARE in (256, 3):  # with 3, groups of a third are hot
        made = {r.pair_id: r for r in chat.preference_pairs(chat.conversations(df).cache()).collect()}
        openings = {}
        for c in ids:
            first = openings.setdefault(convs[c][0], c)
            if first != c:
                equal = convs[c] == convs[first]
                assert (c not in made) if equal else (made[c].rejected_id == first and [tuple(t) for t in made[c].rejected] == convs[first])
            elif c in made:
                assert made[c].rejected_id is None and made[c].rejected == stale[c].rejected
            else:
                assert c not in stale or stale[c].chosen == stale[c].rejected
    chat.SHARE = 256
    assert chat.preference_pairs(chat.conversations(df.limit(0))).count() == 0
    assert chat.format_preferences(chat.with_stale_replies(chat.conversations(df.limit(0)))).count() == 0


def graded(rng, n):
    """Texts of three grades: junk words mark the low ones, insults the toxic ones."""
    words = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        ws = rng.choices(words, k=rng.randint(20, 80))
        for _ in range(4):
            if grade == 0:
                ws.insert(rng.randrange(len(ws)), rng.choice(["vile", "nasty", "awful"]))
            if grade == 1:
                ws.insert(rng.randrange(len(ws)), rng.choice(["click", "subscribe", "$$$!!"]))
        out.append((i, " ".join(ws), grade))
    return out


def test_quality_on_held_out_rows(spark):
    rows = graded(random.Random(7), 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows if i < 600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [(g, got[i]) for i, _, g in rows if i >= 600]
    assert np.mean([(r.p_top >= 0.5) == (g == 2) for g, r in held]) > 0.95
    by = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert by[0] < by[1] < by[2]
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    kept = {r.doc_id for r in quality.select(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.p_top >= 0.5}


def test_gradient_of_the_fit():
    """A fit separates what can be separated, and its cuts stay in order."""
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 400)
    model = quality.fit(np.arange(400), grades + 10, grades, penalty=1e-5)
    assert (np.diff(model.cuts) > 0).all()
    p = model.probabilities(np.arange(3), np.array([10, 11, 12]), 3)
    assert p.argmax(1).tolist() == [0, 1, 2] and np.allclose(p.sum(1), 1)
    assert quality.fit(np.arange(3), np.arange(3), np.zeros(3, "i8")) is None


def test_quality_odd_rows(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([(i, i % 2, None if i == 4 else 0) for i in range(20)] + [(None, 1, 1), (3, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    known = {r.label_id: r.grade for r in quality.grades(labels).collect()}
    assert known[5] == 0 and 4 not in known and None not in known and known[3] == 2 and known[2] == 1
    out = quality.select(docs, labels)
    assert out.columns == [c for c in docs.columns if c not in quality.SCORES] + list(quality.SCORES)
    assert out.count() <= len(texts)
    unlabelled = quality.select(docs, labels.limit(0))
    assert unlabelled.count() == len(texts) and unlabelled.filter("p_top is not null").count() == 0
    assert quality.select(no_docs, labels).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(600)]
    rows += [(k, [0.0] * 12) for k in (600, 650)] + [(700, rows[50][1]), (701, rows[50][1]), (100, rows[3][1]), (750, [1.0, 2.0]), (800, [])]
    odd = [(801, None), (802, [None] * 12), (850, [float("nan")] * 12), (900, [float("inf")] + [0.0] * 11), (None, [4.0] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, block int")
    got = top_k.top_k(df.repartition(3), block_rows=64, query_rows=4)
    v = np.zeros((len(rows), 12), "i8")
    for k, (_, x) in enumerate(rows):
        v[k, : len(x)] = np.floor(256 * np.array(x, "f4").astype("f8"))
    want = []
    for k, (i, _) in enumerate(rows):
        if i % 50 == 0:
            best = [(-int(v[k] @ v[j]), rows[j][0]) for j in range(len(rows)) if j != k] + [(-int(v[k].sum()) * 1024, 10**9)]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(best)[:5])]
    # the row without vec_id is a candidate, found with null
    assert sorted((r.query_id, r.rank, 10**9 if r.vec_id is None else r.vec_id, r.score) for r in got.collect()) == sorted(want)
    assert any(j == 10**9 for _, _, j, _ in want)
    far = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**22, 4.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in top_k.top_k(far).collect()] == [2**60 + 1024 * 256, 2**60 + 768 * 256]
    assert top_k.top_k(df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k.top_k(two).collect()] == [(0, 1, 1, 128 * 256)]


def test_threshold_stops_early():
    """On lists with few high values reading ends long before the lists do."""
    rng = np.random.default_rng(10)
    m = (rng.exponential(size=(5000, 4)) ** 2 * 256).astype("i8")
    q = np.array([300, 20, 5, 1])
    places, scores, depth = top_k.SortedLists(m).top(q, np.arange(5000), 5)
    want = sorted((m @ q).tolist(), reverse=True)[:5]
    assert sorted(scores.tolist(), reverse=True) == want and depth < 2500


@pytest.mark.parametrize("text", ["", " ", "One two TWO", "É é x"])
def test_lm_tokens(text):
    _, n = lm_scoring.tokens(pa.array([text]))
    assert n.tolist() == [len(lm_tokens(text))]


def test_codes_are_kept_between_runs(monkeypatch):
    """A history of an earlier run is not probed again, and has the same code as without the store."""
    rng = np.random.default_rng(5)
    histories = np.unique(rng.integers(0, 2**32, 5000).astype("<u8"))
    code = rng.integers(0, 1 << 11, len(histories))
    keys = lm_scoring.code_key(histories)
    bits = lm_scoring.Bits(keys, 0, 4, 4)
    for d in range(lm_scoring.DIGITS):
        bits.fill(np.flatnonzero(code >> d & 1), d, lm_scoring.CODE_PROBES)
    lookup = lm_scoring.Filter(bits.blocks().ravel(), 0, 4, 20, 1)
    assert (lookup.codes(histories[:3000]) == code[:3000]).all()
    asked = []
    found = lookup.found
    monkeypatch.setattr(lookup, "found", lambda keys, *a: asked.append(len(keys)) or found(keys, *a))
    mixed_up = rng.permutation(np.concatenate([np.arange(len(histories)), np.arange(100)]))
    assert (lookup.codes(histories[mixed_up]) == code[mixed_up]).all()
    assert set(asked) == {len(histories) - 3000}
    monkeypatch.setattr(lm_scoring, "KEPT", 10)
    full = lm_scoring.Filter(bits.blocks().ravel(), 0, 4, 20, 1)
    assert (full.codes(histories) == code).all() and (full.codes(histories[::-1]) == code[::-1]).all() and not len(full.kept[0])


def test_slices_are_of_equal_size(monkeypatch, docs):
    """A filter of little more than a slice is not cut into a whole one and a small rest."""
    sizes = []

    broadcast = docs.sparkSession.sparkContext.broadcast
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1 << 14)
    monkeypatch.setattr(docs.sparkSession.sparkContext, "broadcast", lambda v: (sizes.append(len(v)) if isinstance(v, bytearray) else None) or broadcast(v))
    lm_scoring.score_texts(docs)
    block = lm_scoring.BLOCK_BITS // 8
    blocks, sizes = sizes[0] // block, []
    assert blocks > 3
    lm_scoring.score_texts(docs, (blocks - 1) * block)
    assert len(sizes) == 2 and max(sizes) - min(sizes) <= block


def test_spent_shuffle_files_go(docs):
    """Of all its shuffles only those that the result still reads are left on the disk."""
    tracker = docs.sparkSession.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = lm_scoring.score_texts(docs)
    assert tracker.shuffleStatuses().size() <= before
    assert out.count() == docs.count()


def test_spent_slices_go(monkeypatch, docs):
    """Each slice's broadcast ends with its pass."""
    live, most = [], []
    broadcast = docs.sparkSession.sparkContext.broadcast

    def sent(v):
        b = broadcast(v)
        if isinstance(v, bytearray):
            live.append(b)
            destroy = b.destroy
            monkeypatch.setattr(b, "destroy", lambda: (live.remove(b), destroy()))
            most.append(len(live))
        return b

    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1 << 14)
    monkeypatch.setattr(docs.sparkSession.sparkContext, "broadcast", sent)
    out = lm_scoring.score_texts(docs, 4 * lm_scoring.BLOCK_BITS // 8)
    assert len(most) > 1 and max(most) == 1 and not live
    assert out.count() == docs.count()
