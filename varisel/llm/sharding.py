"""Best-fit-decreasing packing of indivisible groups into shards.

Groups in order of decreasing size enter the shard with the tightest capacity that still holds them, found
through a balanced tree of remaining capacities. The number of groups has no bound, so packing has two
levels. In tasks, each over its share of the groups (sorted by Spark), groups are packed best-fit-decreasing
into parcels of a fixed capacity, a small fraction of a shard; a group beyond it is a parcel of its own.
Then the parcels, at most twice the total over their capacity and one for each task, are packed
best-fit-decreasing into shards on the driver. With a number of shards given, a parcel larger than the mean of
what is left has a shard of its own; for the others the least capacity that needs no more than the shards
left is found by bisection, and moves from fuller to emptier shards even out the rest, so shard sizes are
near equal where the groups allow it.

Defined cases: rows with a null key are one group; groups of size 0 or less count as 0; ties in size follow
the key; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, gapless, text_hash, written

#: Parcels per shard, about; they are what the driver packs.
PARCELS = 256


class CapacityTree:
    """A balanced search tree (AA tree) of (remaining capacity, bin): the tightest that holds a size."""

    class Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _level(t):
        return t.level if t else 0

    def _skew(self, t):
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    def _split(self, t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def insert(self, key: tuple) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, t, key):
        if t is None:
            return self.Node(key)
        if key < t.key:
            t.left = self._insert(t.left, key)
        else:
            t.right = self._insert(t.right, key)
        return self._split(self._skew(t))

    def remove(self, key: tuple) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t, key):
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None and t.right is None:
            return None
        elif t.left is None:
            at = t.right
            while at.left:
                at = at.left
            t.key, t.right = at.key, self._remove(t.right, at.key)
        else:
            at = t.left
            while at.right:
                at = at.right
            t.key, t.left = at.key, self._remove(t.left, at.key)
        low = min(self._level(t.left), self._level(t.right)) + 1
        if low < t.level:
            t.level = low
            if t.right and t.right.level > low:
                t.right.level = low
        t = self._skew(t)
        if t.right:
            t.right = self._skew(t.right)
            if t.right.right:
                t.right.right = self._skew(t.right.right)
        t = self._split(t)
        if t.right:
            t.right = self._split(t.right)
        return t

    def tightest(self, size: int) -> tuple | None:
        """The smallest key whose capacity is ``size`` or more."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


class BestFit:
    """Bins of one capacity, for sizes that come in decreasing order."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.bins = capacity, CapacityTree(), 0

    def put(self, size: int) -> int:
        found = self.tree.tightest(size)
        if found is None:
            found = (max(self.capacity, size), self.bins)
            self.bins += 1
        else:
            self.tree.remove(found)
        if found[0] > size:
            self.tree.insert((found[0] - size, found[1]))
        return found[1]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size."""
    fit, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = fit.put(sizes[i])
    return out


def alone(sizes: Iterable[int], total: int, n: int) -> tuple[int, int, int]:
    """Of ``sizes`` in decreasing order, how many exceed the mean of what is left for the bins that are left,
    each with a bin of its own; then the total and the number of bins that are left."""
    own = 0
    for size in sizes:
        if size * (n - own) <= total:  # always so for the last bin
            break
        total, own = total - size, own + 1
    return own, total, n - own


def evened(sizes: list[int], bins: list[int], n: int) -> list[int]:
    """``bins`` after moves from fuller to emptier bins, as long as a move brings the two nearer to each other."""
    out, held, loads = list(bins), [[] for _ in range(n)], [0] * n
    for i, b in enumerate(out):
        held[b].append(i)
        loads[b] += sizes[i]

    def move() -> bool:
        to = min(range(n), key=lambda b: (loads[b], b))
        for b in sorted(range(n), key=lambda b: (-loads[b], b)):
            gap = loads[b] - loads[to]
            fits = [i for i in held[b] if 0 < sizes[i] < gap]
            if fits:
                i = min(fits, key=lambda i: (abs(gap - 2 * sizes[i]), i))
                held[b].remove(i)
                held[to].append(i)
                out[i], loads[b], loads[to] = to, loads[b] - sizes[i], loads[to] + sizes[i]
                return True
        return False

    while move():  # the sum of squares falls
        pass
    return out


def into_bins(sizes: list[int], n: int) -> list[int]:
    """Bins 0 to n - 1. Sizes over the mean of what is left have bins of their own; the others are packed by the
    least capacity (to 1 in 10,000 of their mean) at which best fit needs no more bins than are left, and evened."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    own, total, left = alone((sizes[i] for i in order), sum(sizes), n)
    bins = [0] * len(sizes)
    for b, i in enumerate(order[:own]):
        bins[i] = b
    rest = order[own:]
    for i, b in zip(rest, _least_capacity([sizes[i] for i in rest], total, left), strict=True):
        bins[i] = own + b
    return bins


def _least_capacity(sizes: list[int], total: int, n: int) -> list[int]:
    low = max(1, -(-total // n))
    out, high = best_fit_decreasing(sizes, low), low
    step = max(1, total // n // 10_000)
    while max(out, default=0) >= n:
        high += max(step, (high - low) or step)
        out = best_fit_decreasing(sizes, high)
    while high - low > step:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if max(tried) < n:
            high, out = middle, tried
        else:
            low = middle
    return evened(sizes, out, n)


def assign_shards(rows: DataFrame, key: str, size: str, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``rows`` with ``shard``. Either a number of shards, or the capacity of each, is given."""
    groups = written(rows.groupBy(key).agg(F.sum(F.greatest(F.col(size), F.lit(0))).alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    if n_shards:  # parcels are small beside what the largest groups leave for the other shards
        largest = [r["size"] for r in groups.select("size").orderBy(F.desc("size")).limit(n_shards).collect()]
        _, rest, left = alone(largest, total, n_shards)
        capacity = -(-rest // left)
    shard_size = max(1, capacity or total)
    parcel = max(1, shard_size // PARCELS)
    kinds = pa.schema([("key", groups.schema[key].dataType.typeName() == "binary" and pa.binary() or pa.string()), ("parcel", pa.int64()), ("size", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, part = BestFit(parcel), TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([part + fit.put(s) for s in sizes], pa.int64()), batch.column("size")], schema=kinds)

    kind = "binary" if kinds.field("key").type == pa.binary() else "string"
    placed = groups.select(F.col(key).cast(kind).alias("key"), F.col("size").cast("long")).sortWithinPartitions(F.desc("size"), "key")
    placed = written(placed.mapInArrow(task, f"key {kind}, parcel long, size long"), "parcels")
    parcels = placed.groupBy("parcel").agg(F.sum("size").alias("size")).orderBy("parcel").toPandas()  # bounded, see above
    sizes = [int(s) for s in parcels["size"]]
    shards = into_bins(sizes, n_shards) if n_shards else best_fit_decreasing(sizes, shard_size)
    names = rows.sparkSession.createDataFrame([(int(p), int(s)) for p, s in zip(parcels["parcel"], shards, strict=True)], "parcel long, shard int")
    (own,) = free_names(rows, "shard_key")
    of = placed.join(F.broadcast(names), "parcel").select(F.col("key").alias(own), "shard")
    return rows.drop("shard").join(of, F.col(key).cast(kind).eqNullSafe(F.col(own))).drop(own)


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; equal texts stay together."""
    text = F.col("text").cast("string")
    cols = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    sized = cols.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_hash(F.coalesce("text", F.lit(""))).alias("key"),
    )
    placed = written(assign_shards(written(sized, "sized"), "key", "size", n_shards), "sharded")
    return gapless(placed, ["shard"], ["doc_id", "key"], "slot").drop("key")
