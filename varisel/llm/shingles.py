"""Sets of shingle hashes: their hashing, and exact links of many sets at once, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, lean, written

#: Values of a bottom-k sketch.
SKETCH = 128
#: Sets of a block at most, and bytes, but for a single larger set.
BLOCK_NODES, BLOCK_BYTES = 512, 2 << 20
#: Keys of so many nodes, 24 bytes each, are broadcast to find their texts; more by a shuffle of the texts.
BROADCAST_NODES = 500_000
#: Columns of a matrix product that are held at once; values of so many pairs at most are counted by themselves.
COLUMNS, RARE = 4096, 64


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of fewer words the whole sequence; none without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").translate(ASCII_LOWER).split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), "i8", len(tokens)) + 1)
    starts = ends - np.diff(ends, prepend=0)
    width = min(width, len(tokens))
    a, b = starts[: len(tokens) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()
    return np.fromiter([xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], "<u8", len(a))


def least_shared(size: int, share: float) -> int:
    """Values that the sketch of a set of ``size`` shares with that of any linked set; ``share``: the similarity."""
    if size <= SKETCH:
        # of a partner of size / share values, some of the shared ones may lie outside its sketch
        beyond = max(0, math.floor(size / share) - SKETCH)
        return max(1, math.ceil(share * size - 1e-9) - beyond)
    low = math.log(1e10) / SKETCH
    # the largest count whose tail is under 1e-10
    for x in range(int(share * SKETCH), 0, -1):
        p = x / SKETCH
        if p < share and p * math.log(p / share) + (1 - p) * math.log((1 - p) / (1 - share)) >= low:
            return x
    return 1


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the links (a, b) that are the lightest spanning forest by ``bits``; ties fall at random, so no
    node draws all of them."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    weight = np.empty(len(a), "i8")
    weight[np.lexsort((np.random.default_rng(0).permutation(len(a)), bits))] = np.arange(len(a))
    left, root, chosen = np.arange(len(a)), np.arange(len(nodes)), []
    place = np.argsort(weight)
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return np.concatenate([np.zeros(0, "i8"), *chosen])
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, root[x[left]], weight[left])
        np.minimum.at(best, root[y[left]], weight[left])
        new = place[np.unique(best[best < len(a)])]
        chosen.append(new)
        while True:  # nodes that the new links join get the smallest root
            low = np.minimum(root[x[new]], root[y[new]])
            to = root.copy()
            np.minimum.at(to, root[x[new]], low)
            np.minimum.at(to, root[y[new]], low)
            while not np.array_equal(to, to[to]):
                to = to[to]
            to = to[root]
            if np.array_equal(to, root):
                break
            root = to


def blocks(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Long lists (value, df, node, n) -> block, nodes, sets, values: blocks of nodes that entered under like values.

    Nodes in that order are weighed by their sets, at least a BLOCK_NODES-th of a block each; a block is a range of the running sum, which is
    taken within tasks and over the tasks' sums, so blocks are the same however many tasks there are."""
    per = hot.groupBy("node").agg(F.max_by("value", F.struct("df", "value")).alias("top"), F.collect_set("value").alias("values"), F.greatest(8 * F.first("n"), F.lit(BLOCK_BYTES // BLOCK_NODES)).alias("weight"))
    tasks = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = per.repartitionByRange(tasks, "top", "node").sortWithinPartitions("top", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = before + np.cumsum(batch.column("weight").to_numpy())
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("values"), pa.array(np.full(len(upto), part)), pa.array(upto)], names=["node", "values", "part", "upto"])

    placed = written(ordered.select("node", "values", "weight").mapInArrow(lean(run), "node long, values array<long>, part long, upto long"), "placed")
    sums = placed.groupBy("part").agg(F.max("upto").alias("sum"))  # one row for each task
    earlier = sums.select(F.col("part").alias("of"), (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("earlier"))
    block = F.floor((F.col("earlier") + F.col("upto") - 1) / BLOCK_BYTES)
    rows = placed.join(F.broadcast(earlier), F.col("part") == F.col("of")).select(block.alias("block"), "node", "values").join(sets, "node")
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("node", "shingles"))).alias("x"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("values")).select("block", F.col("x.node").alias("nodes"), F.col("x.shingles").alias("sets"), "values")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0-1 matrices over the values that both sides hold."""
    out = np.zeros((len(left), len(right)), "f4")
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    rows = []
    if not len(both):
        return out
    for values, sets in ((x, left), (y, right)):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(both, values).clip(max=len(both) - 1)
        on = both[place] == values
        rows.append((of[on], place[on]))
    # values that few sets hold are counted pair by pair, others by products
    n_left, n_right = (np.bincount(place, minlength=len(both)) for _, place in rows)
    rare = n_left * n_right <= RARE
    order = np.argsort(rows[0][1], kind="stable")
    own, first = rows[0][0][order], np.cumsum(n_left) - n_left
    on = rare[rows[1][1]]
    of, place = rows[1][0][on], rows[1][1][on]
    times = n_left[place]
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    i, j = own[np.repeat(first[place], times) + inside], np.repeat(of, times)
    out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    dense = np.cumsum(~rare) - 1
    rows = [(of[~rare[place]], dense[place[~rare[place]]]) for of, place in rows]
    n = int((~rare).sum())
    for at in range(0, n, COLUMNS):
        width = min(COLUMNS, n - at)
        parts = []
        for (of, place), sets in zip(rows, (left, right), strict=True):
            m = np.zeros((len(sets), width), "f4")
            own = (place >= at) & (place < at + width)
            m[of[own], place[own] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked sets, those on the left and on the right; ``same``: both sides are one block."""
    share = percent / 100
    shared = overlaps([s[:SKETCH] for s in left], [s[:SKETCH] for s in right])
    need = [np.array([least_shared(len(s), share) for s in side]) for side in (left, right)]
    may = shared >= np.minimum(need[0][:, None], need[1][None, :])
    if same:
        may = np.triu(may, 1)
    i, j = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if not len(i):
        return i, j
    exact = overlaps([left[k] for k in i], [right[k] for k in j])
    size = [np.array([len(side[k]) for k in at], "f8") for side, at in ((left, i), (right, j))]
    on = may[np.ix_(i, j)] & (100 * exact >= percent * (size[0][:, None] + size[1][None, :] - exact))
    a, b = np.nonzero(on)
    return i[a], j[b]


def block_links(packed: DataFrame, percent: int) -> DataFrame:
    """Blocks that a value leads to -> a, b: a spanning forest of the verified links of each pair of blocks."""
    led = packed.select("block", F.explode("values").alias("value"))
    other = led.select(F.col("block").alias("to"), F.col("value").alias("v"))
    asked = led.join(other, (F.col("value") == F.col("v")) & (F.col("block") <= F.col("to"))).select("block", "to").distinct()
    side = lambda key, n, s: packed.select(F.col("block").alias(key), F.col("nodes").alias(n), F.col("sets").alias(s))
    met = asked.join(side("x", "left_nodes", "left_sets"), F.col("block") == F.col("x")).join(side("y", "right_nodes", "right_sets"), F.col("to") == F.col("y"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, ln, ls, rn, rs in zip(*(batch.column(c) for c in ("block", "to", "left_nodes", "left_sets", "right_nodes", "right_sets")), strict=True):
                left, right = ([np.frombuffer(b.as_buffer(), "<u8") for b in s.values] for s in (ls, rs))
                i, j = linked(left, right, percent, x.as_py() == y.as_py())
                a, b = np.asarray(ln.values)[i], np.asarray(rn.values)[j]
                tree = spanning(a, b, np.zeros(len(a), "i8"))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[tree], pa.int64()), "b": pa.array(b[tree], pa.int64())})

    return met.select("block", "to", "left_nodes", "left_sets", "right_nodes", "right_sets").mapInArrow(lean(task), "a long, b long")
