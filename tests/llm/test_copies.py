"""Near-duplicates, line runs and benchmark passages, each against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from varisel.llm import components, decontamination, line_dedup, simhash

BLANK = "[\x20\x09-\x0d]+"
LOW = {i: i + 32 for i in range(65, 91)}


def tokens(t):
    return [w for w in re.split(BLANK, (t or "").translate(LOW)) if w]


def test_gray_rank():
    n = np.arange(1024, dtype="<u8")
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


def test_index_finds_every_pair():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 40, dtype="u8")
    fps = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype("u8")) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype("u8")) for _ in range(12)]]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    differing = np.bitwise_count(fps[:, None] ^ fps[None, :])
    near, got = differing <= 4, np.zeros((len(fps), len(fps)), bool)
    for most in (1 << 21, 64):
        simhash.MOST_PAIRS = most
        for q, m, bits in simhash.GrayIndex(fps).within(fps, simhash.allowance(4, False)):
            got[q, m] = True
            assert np.array_equal(bits, differing[q, m])
        assert np.array_equal(near, got)
    simhash.MOST_PAIRS = 1 << 21
    # blocks: roots with masks of few bits are leaves too
    starts = np.arange(0, len(fps), 16)
    mask, value = simhash.agreed(np.full(len(fps), simhash.ALL), fps, starts)
    reached = np.zeros((len(fps), len(starts)), bool)
    for q, leaf, _ in simhash.GrayIndex(value, mask).within(fps, simhash.allowance(4, False)):
        reached[q, leaf] = True
    assert (np.add.reduceat(near, starts, axis=1) > 0)[~reached].sum() == 0


def test_turns_find_most_pairs():
    """Of pairs as far apart as texts of similarity 0.8 are, most are met in one turn or another, and few others."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 20_000, dtype="u8")
    other = base[:2000].copy()
    for k in range(2000):
        for bit in rng.choice(64, 10, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(bit)
    found, read, allowed = np.zeros(2000, bool), 0, simhash.allowance(13, True)
    for t in (0, 16, 32, 48):
        fps = simhash.turned(base, t)
        order = np.argsort(simhash.gray_rank(fps))
        tree = simhash.GrayIndex(fps[order])
        for q, m, _ in tree.within(simhash.turned(other, t), allowed):
            found[q[order[m] == q]] = True
        mask, value = tree.levels[0]
        read += sum(len(q) for q, _, _ in simhash.GrayIndex(value, mask).within(simhash.turned(other, t), allowed))
    assert found.mean() > 0.93 and read / (4 * 2000 * len(mask)) < 0.1


def test_spanning():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = rng.integers(2, 40)
        a, b, bits = rng.integers(0, n, 120), rng.integers(0, n, 120), rng.integers(1, 9, 120)
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        want = 0
        for w, x, y in sorted(zip(bits, a, b, strict=True)):
            if find(x) != find(y):
                root[find(x)] = find(y)
                want += w
        roots = [find(i) for i in range(n)]
        chosen = simhash.spanning(a, b, bits)
        assert bits[chosen].sum() == want
        root = list(range(n))
        for i in chosen:
            assert find(a[i]) != find(b[i])
            root[find(a[i])] = find(b[i])
        assert len({(x, find(i)) for i, x in enumerate(roots)}) == len(set(roots))


def test_near_duplicates(docs, no_docs, texts):
    def fp(t):
        w = tokens(t)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = sorted((str(i), f"{fps[k]:016x}", str(least[find(k)])) for k, (i, _) in enumerate(texts))
    got = [(str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.first_of_each(docs).select("doc_id", "text", "fp").collect()
    # 24, 25 and 27 are copies of 0, 0 and 26; 31 and 32 are blank as 30 is; of the rows with id 5 one repeats another
    want = {(i, t) for i, t in texts if i is not None and i not in (24, 25, 27, 31, 32)}
    assert sorted(((r.doc_id, r.text or "") for r in kept if r.doc_id is not None)) == sorted((i, t or "") for i, t in want)
    assert sum(r.doc_id is None for r in kept) == 2 and simhash.first_of_each(no_docs).count() == 0


def test_first_of_each_of_similar_texts(spark):
    """Copies with a similarity of 0.8 to 0.98 go, texts of 0.7 and less stay, and no text goes for its id."""
    rng = random.Random(17)
    draw = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    sim = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, copies, others = [], {}, []
    for k in range(300):
        words = draw(rng.randint(80, 400))
        rows.append((k, " ".join(words)))
        new = list(words)
        goal = rng.choice([0.6, 0.7, 0.81, 0.85, 0.9, 0.95])
        while sim(grams(new), grams(words)) > goal + 0.03:
            new[rng.randrange(len(new))] = "edited"
        s = sim(grams(new), grams(words))
        rows.append((1000 + k, " ".join(new)))
        if s >= 0.8:
            copies[1000 + k] = s
        else:
            others.append(1000 + k)
    rows += [(5, " ".join(draw(100))), (1001, rows[2][1]), (None, rows[0][1])]
    left = [(r.doc_id, r.text) for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    ids = {i for i, _ in left}
    assert set(others) <= ids and set(range(300)) <= ids and (5, rows[600][1]) in left and (5, rows[10][1]) in left and (None, rows[0][1]) in left
    assert (1001, rows[2][1]) not in left
    gone = [s for i, s in copies.items() if i not in ids]
    assert len(gone) >= 0.96 * len(copies) and sum(s >= 0.85 for s in gone) >= 0.98 * sum(s >= 0.85 for s in copies.values())


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def expected_lines(texts, min_words):
    """By comparing every pair of places."""
    big = 2**63 - 1
    distinct = sorted({(big if i is None else i, int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype("<i8")), t) for i, t in texts if t is not None})
    split = [t.split("\n") for *_, t in distinct]
    places = [(a, p) for a, ls in enumerate(split) for p in range(len(ls))]

    def common(x, y):
        n = 0
        while x[1] + n < len(split[x[0]]) and y[1] + n < len(split[y[0]]) and split[x[0]][x[1] + n] == split[y[0]][y[1] + n]:
            n += 1
        return n

    gone = set()
    for k, x in enumerate(places):
        deepest = {}
        for y in places[:k]:
            for level in range(common(x, y).bit_length()):
                deepest.setdefault(level, y)
        if deepest:
            n = common(x, deepest[max(deepest)])
            if sum(len([w for w in re.split(BLANK, ln) if w]) for ln in split[x[0]][x[1] : x[1] + n]) >= min_words:
                gone.update((x[0], x[1] + j) for j in range(n))
    return {(d, h): [ln for p, ln in enumerate(split[a]) if (a, p) not in gone] for a, (d, h, _) in enumerate(distinct)}


def test_line_dedup(spark, docs, no_docs, texts):
    for min_words in (50, 5):
        want = expected_lines(texts, min_words)
        got = line_dedup.line_dedup(docs, min_words).select("doc_id", "text", "n_lines", "n_kept", "d", "h").collect()
        assert len(got) == len(texts)
        left = {}
        for r in got:
            left.setdefault(r.doc_id, []).append((r.text, r.n_kept))
        for i, t in texts:
            if t is None:
                assert (None, 0) in left[i]
            else:
                kept = want[2**63 - 1 if i is None else i, int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype("<i8"))]
                assert ("\n".join(kept), len(kept)) in left[i]
        assert {(r.d, r.h) for r in got} == {(1, "x")}
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_line_runs_within_and_nested(spark):
    rng = random.Random(4)
    ls = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(10)) for _ in range(40)]
    texts = [(1, "\n".join(ls[:16])), (2, "\n".join(ls[4:12])), (3, "\n".join([*ls[20:25], *ls[:16], *ls[25:27]])), (4, "\n".join([ls[30]] * 9)), (5, "\n".join(ls[2:5])), (6, "\n".join([*ls[20:25], *ls[2:5]]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = expected_lines(texts, 50)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == {d: "\n".join(v) for (d, _), v in want.items()}
    assert got[2] == "" and got[4] == ls[30] and got[5] == texts[4][1]


def longest_lines(texts, min_words):
    """What is left of each text if a line goes with the longest run from any place that any earlier place has."""
    h = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype("<i8"))
    distinct = sorted((i, h(t), t) for i, t in texts)
    split = [t.split("\n") for *_, t in distinct]
    places = [(a, p) for a, ls in enumerate(split) for p in range(len(ls))]

    def common(x, y):
        pairs = zip(split[x[0]][x[1] :], split[y[0]][y[1] :], strict=False)
        return next((n for n, (a, b) in enumerate(pairs) if a != b), min(len(split[x[0]]) - x[1], len(split[y[0]]) - y[1]))

    gone = set()
    for k, x in enumerate(places):
        n = max((common(x, y) for y in places[:k]), default=0)
        if n and sum(len(ln.split()) for ln in split[x[0]][x[1] : x[1] + n]) >= min_words:
            gone.update((x[0], x[1] + j) for j in range(n))
    return {d: "\n".join(ln for p, ln in enumerate(split[a]) if (a, p) not in gone) for a, (d, _, _) in enumerate(distinct)}


def test_line_runs_of_any_earlier_place(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = line("a", 15), line("b", 15), line("c", 25)
    texts = [(1, "\n".join([a, b, "x"])), (2, "\n".join([a, b, c, "y"])), (3, "\n".join([a, b, c, "z"]))]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: texts[0][1], 2: texts[1][1], 3: "z"}
    rng = random.Random(5)
    names = [line(x, n) for x, n in zip("abcd", (3, 5, 8, 13), strict=True)]
    texts = [(i, "\n".join(rng.choice(names) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for min_words in (20, 60):
        want = longest_lines(texts, min_words)
        assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_words).collect()} == want


def test_leaks(spark, docs, no_docs, texts):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(draw(n))) for k, n in enumerate((15, 22, 37, 57, 3, 5))] + [(9, "v1  v2 v1 v2 v1 v2 v1 v2 v1 v2"), (None, "no id"), (10, None), (11, " ")]
    items.append((12, items[1][1]))
    own = []
    for k, (_, t) in enumerate(items[:7]):
        w = t.split()
        own += [(100 + k, " ".join([*draw(30), *w, *draw(9)])), (120 + k, "  ".join(w)), (140 + k, " ".join([*draw(4), *w[:8], "new", *w[8:]])), (160 + k, " ".join([*draw(5), *w[: len(w) // 2], *draw(4)]))]
        half = list(w)
        half[len(w) // 3] = "changed"
        own.append((180 + k, " ".join([*half, *draw(50)])))
    own += [(200, None), (201, ""), (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(own, "doc_id long, text string")

    def best(text, item):
        w, it = [x for x in re.split(BLANK, (text or "").lower()) if x], [x for x in re.split(BLANK, item.lower()) if x]
        k, out = min(5, len(it)), (0.0, 0)
        grams = lambda ws: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
        b = grams(it)
        for s in range(max(1, len(w) - len(it) + 1)):
            a = grams(w[s : s + len(it)])
            shared = sum(min(a.count(g), b.count(g)) for g in set(a))
            total = len(a) + len(b) - shared
            if a and shared / total > out[0]:
                out = (shared / total, s)
        return out

    want = {}
    for i, t in own:
        for item, text in items[:7]:
            sim, start = best(t, text)
            if sim >= 0.8:
                want[i, item] = (round(sim, 9), start)
    found = decontamination.leaks(df, benchmark).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found}
    assert got == {k: v[0] for k, v in want.items()} and len(found) == len(got)
    left = {r.doc_id for r in decontamination.decontaminate(df, benchmark).collect()}
    assert left == {i for i, _ in own} - {i for i, _ in want}
    assert decontamination.leaks(docs, benchmark).count() == 0 and decontamination.decontaminate(docs, benchmark).count() == len(texts)
    assert decontamination.decontaminate(no_docs, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(texts)


def test_leaks_in_texts_that_end_in_blanks(spark):
    passage = " ".join(f"w{i}" for i in range(10))
    items = [(1, passage + "\n"), (2, "q1 q2 q3\t"), (3, "\r\x0bs1 s2 s3 s4 s5 s6\x0c\n")]
    own = [(1, f"some words {passage} and more"), (2, "x q1 q2 q3 y"), (3, "s1 s2 s3 s4 s5 s6\n"), (4, passage + " \t"), (5, "q1 q2\n")]
    found = decontamination.leaks(spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 1, 1.0)]
    words = [r.w for r in spark.createDataFrame([("\n\ta b\r\n",), ("\x0b",), (None,)], "t string").select(decontamination.plain_words(F.col("t")).alias("w")).collect()]
    assert words == [["a", "b"], [], []]


def test_multi_index(spark):
    """Every window finds all items of its size within the radius, and no others, whatever item it was made from."""
    rng = np.random.default_rng(4)
    items = [(k, 10 + k % 2, int(x)) for k, x in enumerate(rng.integers(-(2**63), 2**63, 20, dtype="i8"))]
    rows = []
    for r in range(3000):
        fp = int(np.int64(items[int(rng.integers(20))][2]).view("u8"))
        for b in rng.choice(64, int(rng.integers(0, 40)), replace=False):
            fp ^= 1 << int(b)
        rows.append((r, 10 + int(rng.integers(2)), int(np.uint64(fp).view("i8"))))
    prints = spark.createDataFrame(rows, "row int, n int, fp long")
    named = spark.createDataFrame(items, "item_id int, n int, item_fp long")
    for radius in (7, 15, 23):
        got = [(r.row, r.item_id, r.differing_bits) for r in decontamination.within(prints, named, radius).collect()]
        bits = {(r, i): int(np.bitwise_count(np.int64(fp).view("u8") ^ np.int64(x).view("u8"))) for r, n, fp in rows for i, size, x in items if n == size}
        assert len(got) == len(set(got)) and set(got) == {(r, i, b) for (r, i), b in bits.items() if b <= radius}


def test_pairs_that_meet_in_many_blocks_are_not_shuffled(spark):
    """Equal fingerprints agree in all blocks; their one row needs no grouping behind the join."""
    prints = spark.createDataFrame([(r, 10, 5) for r in range(50)], "row int, n int, fp long")
    found = decontamination.within(prints, spark.createDataFrame([(1, 10, 5), (2, 10, 7)], "item_id int, n int, item_fp long"), 23)
    assert sorted(map(tuple, found.select("row", "item_id", "differing_bits").collect())) == [(r, i, i - 1) for r in range(50) for i in (1, 2)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_index_alone_finds_the_same_leaks(spark):
    """Every window of every document, looked up in the index without any shared shingle, then compared exactly: the same leaks."""
    rng = random.Random(6)
    draw = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(k, draw(rng.randint(12, 40))) for k in range(12)]
    docs_ = []
    for d in range(40):
        body = draw(rng.randint(30, 120))
        if d % 3 == 0:
            own = list(items[d % 12][1])
            if d % 2:
                own[-1] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = own
        docs_.append((d, body))
    df = lambda rows, c: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.total) for r in decontamination.leaks(df(docs_, "doc_id"), df(items, "item_id")).collect()}

    def prints_of(rows):
        sized = spark.createDataFrame([(key, n, s) for key, n, w in rows for s in range(len(w) - 4) for s in [" ".join(w[s : s + 5])]], "key string, n int, s string")
        shingles = sized.select("key", "n", F.xxhash64("s").alias("shingle"))
        return shingles.groupBy("key", "n").agg(*decontamination.votes()).select("key", "n", decontamination.simhash().alias("fp"))

    windows = prints_of([(f"{d}/{p}", n, w[p : p + n]) for d, w in docs_ for n in sorted({len(w) for _, w in items}) for p in range(len(w) - n + 1)])
    named = prints_of([(str(i), len(w), w) for i, w in items]).select(F.col("key").cast("int").alias("item_id"), "n", F.col("fp").alias("item_fp"))
    met, best = decontamination.within(windows, named, 23).collect(), {}
    grams = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
    for r in met:
        d, p = map(int, r.key.split("/"))
        a, b = grams(docs_[d][1][p : p + r.n]), grams(items[r.item_id][1])
        shared, total = sum((a & b).values()), sum((a | b).values())
        if shared >= 0.8 * total:
            best[d, r.item_id] = max(best.get((d, r.item_id), (0, 0, 0)), (shared / total, shared, total))
    assert got == {(d, i, s, t) for (d, i), (_, s, t) in best.items()} and len(got) >= 10


def test_fingerprints_of_leaks_are_near():
    """Recall of the radius on windows with a similarity of 0.8 to 1 to their item, against exact search."""
    rng = random.Random(12)
    lost, n = 0, 0
    grams = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]

    def fp(w):
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams(w)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _ in range(400):
        item = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 80))]
        window = list(item)
        window[rng.choice([0, 1, len(item) // 2, len(item) - 1])] = "changed"
        a, b = grams(item), grams(window)
        if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8:
            n += 1
            lost += (fp(item) ^ fp(window)).bit_count() > 23
    assert n > 300 and lost == 0


def test_simhash_votes(spark):
    h = [xxhash.xxh64_intdigest(str(i).encode(), 1) for i in range(13)]
    df = spark.createDataFrame([(int(np.uint64(x).astype("<i8")),) for x in h], "shingle long")
    got = df.agg(*decontamination.votes()).select(decontamination.simhash().alias("fp")).first().fp
    assert np.int64(got).view("<u8") == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
