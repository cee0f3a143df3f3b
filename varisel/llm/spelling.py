"""Spelling variants by forward and backward minimal automata.

1. Words are counted in tasks, each distinct word of a text once, and summed by Spark.
2. The vocabulary is sorted twice over all tasks, by word and by reversed word, and cut into blocks of bounded size. A block
becomes a minimal acyclic automaton: states with equal futures are one. Each arc carries the number of words that come
before those it leads to, so the arcs of a path add up to the word's number in the block, a perfect hash.
3. A word with one error keeps its first or its second half. The first half is followed exactly through the forward
automata of the blocks that may hold it, and the rest completed with one error; the second half likewise through
the backward automata. The numbers reached name the near words, a pair found both ways counts once.
4. The form of a word is its best near word; roots come by doubling: each word's pointer takes over that of its target, so
the number of joins goes with the logarithm of the longest chain.

No task holds more than blocks: a frequent beginning only means more blocks, and short words are sent to all of those. The first
words of at most MOST_BLOCKS blocks, cut to SEPARATOR code points, are sent to every task; beyond that blocks grow.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text before the colon; rows that repeat a
doc_id or a text all count; words may have any length; without words there are no rows; other columns are not read."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, lean, written

#: One run in so many loses a code point.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
BLOCK_WORDS, MOST_BLOCKS, SEPARATOR = 1 << 14, 1 << 18, 64
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 17
LAST = "\U0010ffff"


def words_of(doc_id: int | None, text: bytes, run: re.Pattern, held: dict[str, int], least_length: int) -> None:
    """Adds the text's words to ``held``. Letters are lower-cased as bytes, and runs that are too short for a word are passed over."""
    key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter(run.findall(text.translate(ASCII_LOWER).decode())).items():
        h = zlib.crc32(w.encode(), key)
        if h % DAMAGED == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < least_length:
                continue
        held[w] = held.get(w, 0) + n


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        run = re.compile(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}")

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words_of(i, text.as_buffer().to_pybytes() if text.is_valid else b"", run, held, least_length)
                if len(held) > HELD:
                    yield row()
                    held.clear()
        yield row()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lean(task), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


@dataclass
class Automaton:
    """Arcs of state s: places first[s] to first[s + 1], by label; the last state is the root.

    ``skipped``: how many words come before those behind an arc, among those of its state."""

    first: list[int]
    label: str
    target: list[int]
    skipped: list[int]
    final: list[bool]

    @classmethod
    def of(cls, words: list[str]) -> Automaton:
        """The minimal automaton of distinct sorted words: the path of the word before is settled as far as the next one leaves it."""
        known: dict[tuple, int] = {}
        first, label, target, skipped, final, count = [0], [], [], [], [], []

        def settled(ends: bool, arcs: list[tuple[str, int]]) -> int:
            key = (ends, *arcs)
            if key in known:
                return known[key]
            before = int(ends)
            for c, to in arcs:
                label.append(c)
                target.append(to)
                skipped.append(before)
                before += count[to]
            first.append(len(label))
            final.append(ends)
            count.append(before)
            known[key] = len(final) - 1
            return known[key]

        open_: list[tuple[list[bool], list]] = [([False], [])]
        last = ""
        for w in [*words, ""]:
            shared = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            while len(open_) > shared + 1:
                ends, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], settled(ends[0], arcs)))
            open_ += [([False], []) for _ in w[shared:]]
            open_[-1][0][0] |= bool(w)
            last = w
        ends, arcs = open_[0]
        settled(ends[0], arcs)
        return cls(first, "".join(label), target, skipped, final)

    def packed(self) -> bytes:
        """Arrays as bytes; labels as code points."""
        points = np.frombuffer(self.label.encode("utf-32-le"), "<u4")
        return b"".join(np.asarray(x, "<u4").tobytes() for x in ([len(self.final), len(points)], self.first, points, self.target, self.skipped, self.final))

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        x = np.frombuffer(data, "<u4")
        states, arcs = int(x[0]), int(x[1])
        cuts = np.cumsum([2, states + 1, arcs, arcs, arcs])
        first, points, target, skipped = (x[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        return cls(first.tolist(), points.tobytes().decode("utf-32-le"), target.tolist(), skipped.tolist(), x[cuts[-1] :].astype(bool).tolist())

    def follow(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        for c in text:
            at = self.label.find(c, self.first[state], self.first[state + 1])
            if at < 0:
                return None
            state, number = self.target[at], number + self.skipped[at]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of words that begin as ``word`` does, for ``exact`` code points, and differ by one error behind them."""
        first, label, target, skipped, final, out = self.first, self.label, self.target, self.skipped, self.final, set()
        now = self.follow(len(final) - 1, 0, word[:exact])

        def ends(state: int, number: int, tail: str) -> None:
            for c in tail:
                at = label.find(c, first[state], first[state + 1])
                if at < 0:
                    return
                state, number = target[at], number + skipped[at]
            if final[state]:
                out.add(number)

        for i in range(exact, len(word) + 1):
            if now is None:
                break
            state, number = now
            here, before = word[i : i + 1], word[i - 1] if i > exact else ""
            rest, later = word[i:], word[i + 1 :]
            if here and here != before:  # within a run of one letter each deletion gives the same word
                ends(state, number, later)
            now = None
            for at in range(first[state], first[state + 1]):
                c, to, n = label[at], target[at], number + skipped[at]
                if c != before:  # so does an insertion of that letter
                    ends(to, n, rest)
                if c == here:
                    now = (to, n)
                elif here:
                    ends(to, n, later)
        return out


def half(word: str, backward: bool) -> int:
    """Length of the half that is followed exactly; of a reversed word its own first half is what comes second in the word."""
    return len(word) - len(word) // 2 if backward else len(word) // 2


def automata(words: DataFrame) -> DataFrame:
    """words (word, n) -> block, backward, start (first word, cut), words, counts, automaton."""
    spark = words.sparkSession
    n = words.count()
    most = max(BLOCK_WORDS, -(-2 * n // MOST_BLOCKS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // (4 * most)))
    both = words.select(F.lit(False).alias("backward"), F.col("word").alias("key"), "n").union(words.select(F.lit(True), F.reverse("word"), "n"))
    ordered = both.repartitionByRange(parts, "backward", "key").sortWithinPartitions("backward", "key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, side = TaskContext.get().partitionId(), 0, [], False

        def row() -> pa.RecordBatch:
            own = [w for w, _ in held]
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + k], pa.int64()), "backward": [side], "start": [own[0][:SEPARATOR]], "words": pa.array([own], pa.list_(pa.string())), "counts": pa.array([[c for _, c in held]], pa.list_(pa.int64())), "automaton": [Automaton.of(own).packed()]})

        for batch in batches:
            for way, w, c in zip(*(batch.column(x).to_pylist() for x in ("backward", "key", "n")), strict=True):
                if held and (len(held) >= most or way != side):
                    yield row()
                    k, held = k + 1, []
                side = way
                held.append((w, c))
        if held:
            yield row()

    return ordered.mapInArrow(lean(pack), "block long, backward boolean, start string, words array<string>, counts array<long>, automaton binary")


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) -> word, near, near_n: all pairs that differ by one inserted, deleted or replaced code point, either way."""
    spark = words.sparkSession
    index = written(automata(words), "automata")
    known = index.select("backward", "start", "block").collect()  # one row for each block
    starts = {way: sorted((r.start, r.block) for r in known if r.backward == way) for way in (False, True)}
    sent = spark.sparkContext.broadcast(starts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, own in zip(batch.column("backward").to_pylist(), batch.column("words"), strict=True):
                begins, to = [s for s, _ in sent.value[way]], {}
                for w in own.as_py():
                    head = w[: half(w, way)][:SEPARATOR]
                    for i in range(max(0, bisect_left(begins, head) - 1), bisect_right(begins, head + LAST)):
                        to.setdefault(sent.value[way][i][1], []).append(w)
                yield pa.RecordBatch.from_pydict({"to": pa.array(list(to), pa.int64()), "asked": pa.array(list(to.values()), pa.list_(pa.string()))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, own, counts, data, asked in zip(*(batch.column(c) for c in ("backward", "words", "counts", "automaton", "asked")), strict=True):
                back, held, n = way.as_py(), own.as_py(), counts.as_py()
                machine, out = Automaton.unpacked(data.as_py()), []
                for w in asked.as_py():
                    out += [(w, held[i], n[i]) for i in machine.near(w, half(w, back))]
                turn = (lambda x: x[::-1]) if back else (lambda x: x)
                yield pa.RecordBatch.from_pydict({"word": pa.array([turn(x[0]) for x in out], pa.string()), "near": pa.array([turn(x[1]) for x in out], pa.string()), "near_n": pa.array([x[2] for x in out], pa.int64())})

    routed = index.select("backward", "words").mapInArrow(lean(route), "to long, asked array<string>")
    met = routed.join(index.select("block", "backward", "words", "counts", "automaton"), F.col("to") == F.col("block"))
    found = met.select("backward", "words", "counts", "automaton", "asked").mapInArrow(lean(probe), "word string, near string, near_n long")
    out = written(found.distinct(), "near")
    discard(index)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) without cycles -> word, root: where the forms lead to at last."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = written(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        discard(now)
        now = new
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts; a form is ``ratio`` times as frequent or more."""
    words = written(vocabulary(docs, least_length, least_count), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), "near")).alias("x"))
    met = words.join(best.select(F.col("word").alias("of"), "n_near", "x"), F.col("word") == F.col("of"), "left")
    good = F.col("x.near_n") >= ratio * F.col("n")
    formed = written(met.select("word", F.when(good, F.col("x.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("x.near_n")).alias("form_n")), "formed")
    discard(words, near)
    last = roots(formed.filter("form is not null")).select(F.col("word").alias("of"), "root")
    out = formed.join(last, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
