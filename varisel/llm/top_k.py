"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates lie in blocks of bounded size. Over a block each dimension has a list of its vectors in order of
that component. A query reads its lists in parallel, each from the end that its sign prefers; a vector met
in any list is scored in full (random access); the bound is the score of a vector that would have, in every dimension,
the component that the list has reached. Reading stops when the bound cannot beat the k-th best score, ties
included. Lists are read a stretch at a time, and the k-th best that a query brings from its own block is
known before other blocks are read; a block whose lists' first components cannot reach it is not read at all.

A block is stored with its sorted lists, which are made once. Queries are dealt to full batches, and batches
meet candidate blocks in a join over the numbers of the blocks, so a task holds one of each. Each pair gives at most
k rows for a query, which a window ranks.

Components become floor(256 * x), integers, and scores are exact. Defined cases: vectors that are null or hold null
or non-finite components take no part; a row without vec_id is a candidate, found with null, and no query; a vector of
fewer dimensions than the longest has zeros there; rows that repeat a vec_id are vectors of their own, and only the
query's own row is not its candidate; ties go to the smaller vec_id (null last), then the row's order; an empty table
gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, written

PACKED = "block long, vec_ids array<long>, dims int, data binary, lists binary"
#: Stands for null while ids are numbers; sorts last.
NO_ID = 2**63 - 1


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def sorted_lists(m: np.ndarray) -> np.ndarray:
    """Per dimension, the places of a block's vectors in descending order of that component."""
    return np.argsort(-m, axis=0, kind="stable").astype("<u4")


def packed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of vectors (id, v array<long>), as rows of matrices."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        n = TaskContext.get().partitionId() << 33

        def block() -> pa.RecordBatch:
            nonlocal n, ids, rows
            dims = max(map(len, rows))
            m = np.zeros((len(rows), dims), "<i8")
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            n += 1
            out = pa.RecordBatch.from_pydict({"block": pa.array([n]), "vec_ids": pa.array([ids], pa.list_(pa.int64())), "dims": pa.array([dims], pa.int32()), "data": pa.array([m.tobytes()], pa.binary()), "lists": pa.array([sorted_lists(m).tobytes()], pa.binary())})
            ids, rows = [], []
            return out

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False) if len(v) else np.zeros(0, "<i8"))
                if len(rows) == block_rows:
                    yield block()
        if rows:
            yield block()

    return vectors.mapInArrow(lean(task), PACKED)


class SortedLists:
    """A block with its sorted lists."""

    def __init__(self, m: np.ndarray, order: np.ndarray | None = None):
        self.m, self.order = m, sorted_lists(m) if order is None else order
        self.values = np.take_along_axis(m, self.order, 0)
        self.largest = int(np.abs(m).max(initial=0))
        self.exact = m.astype("f8")  # whole numbers are exact where no sum passes 2**53

    def scores(self, places: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.largest * int(np.abs(q).max(initial=0)) * max(len(q), 1) < 2**53:
            return (self.exact[places] @ q.astype("f8")).astype("i8")
        return self.m[places] @ q

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score that any vector could have, for each query."""
        if not len(self.m):
            return np.zeros(len(queries), "i8")
        return np.maximum(queries, 0) @ self.values[0] + np.minimum(queries, 0) @ self.values[-1]

    def top(self, q: np.ndarray, vec_ids: np.ndarray, k: int, own: int = -1, floor: int | None = None, stretch: int = 128) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best, and how deep the lists were read. ``floor``: a score that k
        candidates elsewhere reach; lower ones need not be found."""
        n, dims = self.m.shape
        on = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        if own >= 0:
            seen[own] = True
        best, score = np.zeros(0, "i8"), np.zeros(0, "i8")
        depth = 0
        while depth < n:
            to = min(n, depth + stretch)
            met = np.zeros(n, bool)
            if len(on):
                up = q[on] > 0
                met[self.order[depth:to, on[up]].ravel()] = True
                met[self.order[n - to : n - depth, on[~up]].ravel()] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            best, score = np.concatenate([best, new]), np.concatenate([score, self.scores(new, q)])
            if len(best) > k:
                keep = np.lexsort((vec_ids[best], -score))[:k]
                best, score = best[keep], score[keep]
            depth = to
            if not len(on):
                break
            last = np.where(q[on] > 0, self.values[to - 1, on], self.values[n - to, on])
            bound = int(last @ q[on])
            kth = int(score.min()) if len(score) == k else None
            if (kth is not None and bound < kth) or (floor is not None and bound < floor):
                break
            stretch *= 2
        return best, score, depth


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    whole = vectors.filter(usable(vector)).select(F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    parts = max(1, -(-whole.count() // block_rows))
    whole = written(whole.repartition(parts), "vectors") if parts > 1 else written(whole.coalesce(1), "vectors")
    blocks = written(packed(whole, block_rows), "blocks")

    def lists_of(row: dict) -> tuple[np.ndarray, SortedLists]:
        ids = np.array(row["vec_ids"], "i8")
        shape = (len(ids), row["dims"])
        return ids, SortedLists(np.frombuffer(row["data"], "<i8").reshape(shape), np.frombuffer(row["lists"], "<u4").reshape(shape))

    # the queries, with their own block and place, so that no vector is its own candidate
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, lists = lists_of(row)
                own = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                floors = [lists.top(lists.m[i], ids, k, own=i)[1] for i in own]
                yield pa.RecordBatch.from_pydict({
                    "q_block": pa.array([row["block"]] * len(own), pa.int64()), "q_place": pa.array(own, pa.int64()), "q_id": pa.array(ids[own], pa.int64()),
                    "q_floor": pa.array([int(s.min()) if len(s) == k else None for s in floors], pa.int64()), "q_data": pa.array([lists.m[i].tobytes() for i in own], pa.binary()),
                })

    asked = written(blocks.mapInArrow(lean(ask), "q_block long, q_place long, q_id long, q_floor long, q_data binary"), "queries")
    n = asked.count()
    # full batches: each row holds up to query_rows queries
    batch = F.pmod(F.xxhash64("q_block", "q_place"), F.lit(max(1, -(-n // query_rows))))
    one = F.struct(*asked.columns)
    batched = written(asked.groupBy(batch.alias("batch")).agg(F.collect_list(one).alias("queries")), "batches")
    pairs = batched.crossJoin(blocks.select("block"))  # a stated query set against all rows, in blocks
    schema = "q_block long, q_place long, query_id long, vec_id long, score long"
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, lists = lists_of(r)
                vectors = [np.frombuffer(x["q_data"], "<i8") for x in r["queries"]]
                dims = max(r["dims"], *map(len, vectors))
                if dims > r["dims"]:
                    lists = SortedLists(np.pad(lists.m, ((0, 0), (0, dims - r["dims"]))))
                q = np.stack([np.pad(v, (0, dims - len(v))) for v in vectors])
                out = []
                for x, v, bound in zip(r["queries"], q, lists.bounds(q).tolist(), strict=True):
                    if x["q_floor"] is not None and bound < x["q_floor"]:
                        continue
                    own = x["q_place"] if x["q_block"] == r["block"] else -1
                    best, score, _ = lists.top(v, ids, k, own, x["q_floor"])
                    out += [(x["q_block"], x["q_place"], x["q_id"], int(ids[b]), int(s)) for b, s in zip(best, score, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, schema=kinds)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.repartition(tasks, "block", "batch").join(blocks, "block").mapInArrow(lean(search), schema)
    rank = F.row_number().over(Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "vec_id"))
    found = met.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
