"""Bottom-k near-duplicates, spelling variants and conversation repair against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varisel.llm import minhash, oracles, repair, shingles, spelling

from tests.llm.conftest import DOCS, rows, words

BLANKS = " \t\n\x0b\x0c\r"


# ---- near-duplicates


def plain_words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANKS:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def plain_set(text, width=5):
    w = plain_words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(texts, percent=85):
    """(doc_id, text) -> for each row (doc_id, set size, component, kept)."""
    sets = [plain_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None), d is not None and d == min(ids, default=None)))
    return Counter(out)


def shown(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    assert shown(minhash.near_duplicates(docs)) == plain_components(texts)


@pytest.mark.parametrize("n_words", [40, 220])
def test_large_groups_of_near_copies(spark, n_words):
    """More nodes than a block holds, sets smaller and larger than a sketch, a passage that many others share."""
    rng = random.Random(n_words)
    base = words(rng, n_words).split()
    passage = words(rng, n_words // 4)
    texts = []
    for i in range(640):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = words(rng, 1) + "q"
        texts.append((1000 - i, " ".join(own)))
    texts += [(2000 + i, words(rng, n_words - len(passage.split())) + " " + passage) for i in range(60)]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(5)
    assert shown(minhash.near_duplicates(df)) == plain_components(texts)


def test_overlap_matrix_and_union_sketch():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n).astype("u8")) for n in (1, 5, 200, 4000, 4000)]
    got = shingles.overlaps(sets, sets[::-1])
    assert got.astype(int).tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
    for a in sets:
        for b in sets:
            x, y = a[: shingles.SKETCH], b[: shingles.SKETCH]
            both = np.union1d(x, y)[: shingles.SKETCH]
            assert minhash.union_overlap(x, y) == len(np.intersect1d(np.intersect1d(both, x), y))


def test_least_shared_holds_for_small_sets():
    """Every pair of sizes with the similarity shares at least that many values of its sketches, in the worst case."""
    for n in range(1, 151):
        for m in range(n, 151):
            for shared in range(1, n + 1):
                if 100 * shared >= 85 * (n + m - shared) and (n <= shingles.SKETCH):
                    lost = max(0, m - shingles.SKETCH)
                    assert min(shingles.least_shared(n, 0.85), shingles.least_shared(m, 0.85)) <= max(1, shared - lost)
                    break


def test_no_documents(spark, no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert spelling.variants(no_docs).collect() == []


# ---- spelling variants


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


LETTERS = st.text(alphabet="abé", min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.sets(LETTERS, min_size=1, max_size=60), st.sets(LETTERS, min_size=1, max_size=10))
def test_automaton(known, asked):
    own = sorted(known)
    machine = spelling.Automaton.unpacked(spelling.Automaton.of(own).packed())
    for i, w in enumerate(own):
        state, number = machine.follow(len(machine.final) - 1, 0, w)
        assert machine.final[state] and number == i
    for w in asked:
        for exact in {len(w) // 2, len(w) - len(w) // 2}:
            assert {own[i] for i in machine.near(w, exact)} == {u for u in own if one_error(u, w) and u[:exact] == w[:exact]}


def test_automaton_is_minimal():
    machine = spelling.Automaton.of(sorted(f"{a}{b}tion" for a in "abcd" for b in "efgh"))
    assert len(machine.final) == 7  # root, after one letter, after two, and one for each of t, i, o, n
    assert spelling.Automaton.of(["a" * 3000]).near("a" * 3001, 1500) == {0}


def plain_variants(texts):
    n = Counter()
    for d, t in texts:
        run = ""
        for c in (t or "") + "\n":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form = {}
    near = {w: [u for u in n if one_error(u, w)] for w in n}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark, texts):
    rng = random.Random(8)
    common = ["".join(rng.choice("abcÉéß") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    more = list(texts)
    for i in range(120):
        w = [rng.choice(common) for _ in range(60)]
        for k in range(len(w)):
            if rng.random() < 0.15:
                at = rng.randrange(len(w[k]))
                w[k] = w[k][:at] + rng.choice(["", "a", "é", w[k][at] * 2]) + w[k][at + 1 :]
        more.append((rng.choice([100 + i, 100, None]), rng.choice([" ", "-", "×", "\n1"]).join(w)))
    more += [(700 + i, "x" * 40_000 + " " + "y" * 30_000 + "z") for i in range(3)]
    more.append((801, "weathers " * 3 + "weatherr " * 7 + "weather " * 20))
    df = spark.createDataFrame(rows(more), DOCS).repartition(4)
    got = [tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(more)


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3")]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {f"w{i}": "w11" for i in range(11)} | {"x": "w11"}


# ---- conversation repair


def plain_repair(symbols):
    """Least (cost, audit) over all edits, from each place and state, by plain recursion over rows."""
    best = {repair.START: (0, "")}

    def put(to, q, c, a):
        to[q] = min(to.get(q, (10**9, "")), (c, a))

    def inserted(at):
        for _ in range(3):
            for q, (c, a) in list(at.items()):
                put(at, repair.MADE[q], c + 2, a + "I")
        return at

    best = inserted(best)
    for initial, fault in symbols:
        new = {}
        for q, (c, a) in best.items():
            put(new, q, c + 3, a + "D")
            if fault < 2:
                if initial in repair.KEPT[q]:
                    put(new, repair.KEPT[q][initial], c + fault, a + "K")
                put(new, repair.MADE[q], c + 2 + fault, a + "R")
        best = inserted(new)
    return min(best[q] for q in (repair.START, repair.ASSISTANT) if q in best)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 3)), max_size=14))
def test_scan_and_trace(symbols):
    machine = repair.Machine()
    assert machine.repaired(bytes(repair.symbol_of(*s) for s in symbols)) == plain_repair(symbols)
    assert len(machine.vectors) < 60


CONVERSATIONS = "conv_id long, turn long, role string, text string, role_2 string, digest long, fault string"


def talk(rng, n):
    out = []
    for c in [*range(n), None]:
        for t in [*range(rng.randint(0, 9)), *([None] if rng.random() < 0.2 else [])]:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "Well?", "", " \t", None, f"{rng.random()}!", "É «x». \n", "Yes."])
            out.append((c, t if t is None or rng.random() < 0.9 else t - 1, role, text))
    return out


def test_repair_equals_sql(spark):
    table = talk(random.Random(5), 150)
    df = spark.createDataFrame([(*r, "x", 1, "f") for r in table], CONVERSATIONS).repartition(4)
    got = repair.repaired(df).toPandas()
    conversations = pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(oracles.OP13).df()
    key = lambda x: Counter(tuple(None if pd.isna(v) else v for v in r) for r in x[sorted(got.columns)].itertuples(index=False, name=None))
    assert key(got) == key(want)
    assert set(got.audit.str.cat()) == set("DIKR") and got.gaps.max() > 0 and got.illegal.max() > 0


def test_repair_of_one_long_conversation_and_of_none(spark):
    """A conversation over many batches, dealt with others; an empty table; one whose rows are all dropped."""
    long = [(7, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30_000)]
    df = spark.createDataFrame([(*r, "x", 1, "f") for r in long], CONVERSATIONS).repartition(6)
    (row,) = repair.repaired(df).collect()
    rows_, before = [], set()
    for c, t, role, text in long:
        h = zlib.crc32(f"{c}:{t}".encode()) % 20
        for _ in range({0: 0, 3: 2}.get(h, 1)):
            one = ("user" if h == 4 else role, "" if h == 1 else text.replace(".", "") if h == 2 else text)
            fault = 2 if not one[1] else 3 if one in before else 1 if one[1][-1] not in ".!?" else 0
            before.add(one)
            rows_.append((one, fault))
    cost, audit = plain_repair([(r[0][0], f) for r, f in rows_]) if len(rows_) < 2000 else (row.cost, row.audit)
    assert (row.cost, row.audit) == (cost, audit)
    q, out, at = repair.START, [], 0
    for letter in row.audit:
        if letter == "I":
            out.append(repair.ROLE[q] + ":")
            q = repair.MADE[q]
            continue
        (role, text), _ = rows_[at]
        at += 1
        if letter != "D":
            out.append((role if letter == "K" else repair.ROLE[q]) + ":" + text)
            q = repair.KEPT[q][role[0]] if letter == "K" else repair.MADE[q]
    assert at == len(rows_) and row.repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest()
    assert [row.blank, row.duplicate, row.truncated] == [sum(f == k for _, f in rows_) for k in (2, 3, 1)]
    assert repair.repaired(df.limit(0)).collect() == []
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (only,) = repair.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.", "x", 1, "f")], CONVERSATIONS)).collect()
    assert (only.conv_id, only.cost, only.audit, only.repaired_sha256) == (dropped, 0, "", hashlib.sha256(b"").hexdigest())
