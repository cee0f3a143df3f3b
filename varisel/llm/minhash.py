"""Near-duplicates through bottom-k sketches of one hash function.

1. A document's set holds the XXH64 of its distinct runs of ``width`` words; equal sets are one node from here on, so copies
cost nothing. A node's sketch is the SKETCH smallest values of its set.
2. Inverted lists of retained values generate overlaps. Of two linked sets the sketches share at least ``least_shared``
values, so with all values in one order, those that fewest sketches retain first, they share one among the first
size - least_shared + 1 of each: only these enter the lists. A sketch whose values are its own in all these places has no
partner and leaves here; values of passages that many documents hold come last and rarely enter.
3. Lists of up to COLD nodes give pairs. The union's sketch, the SKETCH smallest values of both sketches, estimates the
similarity; pairs under ``least_shared`` go. The exact similarity of the full sets verifies the others.
4. Longer lists give no pairs. Their nodes are packed, ordered by the most frequent value that they entered under, into
blocks of bounded size; two blocks meet if one value led into both. In a pair of blocks all sketch overlaps are one matrix
product, and what passes is verified by another one over the full sets. A pair of blocks returns a spanning forest
of its verified links, so neither lists nor links grow with the square of a group.
5. Connected components of the verified links.

Nothing is capped. With SKETCH = 128 and a similarity of 0.85, a linked pair whose sets are both larger than a sketch
shares 76 values but with a probability under 1e-10 (a hypergeometric tail, bounded by exp(-128 KL(76/128 || 0.85)));
for smaller sets the bound is exact. Python tasks hash and verify, Spark partitions and shuffles all the work.

Words are split at blanks, A-Z count as lower case. Defined cases: null, empty and blank texts have an empty set, are linked with
nothing and are components of their own; a text of fewer words than ``width`` has its whole sequence as its one shingle; rows that
repeat a doc_id are documents of their own; component_id is the smallest doc_id that is not null among the component's rows, null if there is
none; kept is false where doc_id is null; empty tables give no rows; other columns are not read; very long texts are whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, text_hash, written
from .components import components
from .shingles import BROADCAST_NODES, SKETCH, block_links, blocks, least_shared, shingle_hashes

#: Lists of so many nodes at most give pairs, longer ones are packed into blocks.
COLD = 32


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null: empty set), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, kept = [], [], []
            for t in batch.column("text"):
                own = np.unique(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else None, width))
                n.append(len(own))
                keys.append(hashlib.md5(own.tobytes(), usedforsecurity=False).digest() if len(own) else None)
                kept.append(own[:SKETCH].view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], schema=schema)

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cols = cols.select("doc_id", text_hash(F.col("text")).alias("text_key"), F.col("text").cast("binary"))
    return cols.mapInArrow(lean(task), "doc_id long, text_key binary, n_shingles long, set_key binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (node, text_key) -> node, shingles: the sorted set as binary."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], schema=schema)

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = docs.select(F.col("text").cast("string").alias("text")).select(text_hash(F.col("text")).alias("t_key"), "text")
    met = texts.join(few, F.col("t_key") == F.col("text_key")).dropDuplicates(["node"])
    return met.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(lean(task), "node long, shingles binary")


def _least(size: Column, share: float) -> Column:
    """``least_shared`` as an expression: a table up to SKETCH, one value above."""
    known = F.array(*[F.lit(least_shared(n, share)) for n in range(1, SKETCH + 1)])
    return F.when(size <= SKETCH, F.element_at(known, F.least(size, F.lit(SKETCH)).cast("int"))).otherwise(F.lit(least_shared(SKETCH + 1, share)))


def inverted(nodes: DataFrame, share: float) -> DataFrame:
    """nodes (node, n, sketch) -> value, df, node, n: the values under which a node may meet its partners."""
    each = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    several = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.col("value").alias("of"), "df")
    own = each.join(several, F.col("value") == F.col("of")).groupBy("node", "n", "m").agg(F.collect_list(F.struct("df", "value")).alias("xs"))
    # values of no other sketch are the rarest and fill the first places
    places = F.least(F.size("xs"), F.size("xs") - _least(F.col("n"), share) + 1)
    chosen = own.filter(places > 0).select("node", "n", F.explode(F.slice(F.array_sort("xs"), F.lit(1), places)).alias("x"))
    return chosen.select("x.value", "x.df", "node", "n")


def _pairs(lists: DataFrame, share: float) -> DataFrame:
    """Short lists (value, node, n) -> a, b: pairs whose sizes allow a link."""
    met = lists.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("xs"))
    one = met.select(F.posexplode("xs").alias("i", "x"), "xs")
    fits = lambda y: F.least(F.col("x.n"), y["n"]) >= F.lit(share) * F.greatest(F.col("x.n"), y["n"]) - 1e-6
    later = F.transform(F.filter(F.slice("xs", F.col("i") + 2, F.size("xs")), fits), lambda y: y["node"])
    return one.select(F.col("x.node").alias("a"), F.explode(later).alias("b")).distinct()


def union_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of the SKETCH smallest values of both sketches together, those that both hold."""
    both = np.sort(np.concatenate([x, y]))
    again = both[1:] == both[:-1]
    # place of each value among the distinct ones
    rank = np.cumsum(np.concatenate([[True], ~again])) - 1
    return int((again & (rank[1:] < SKETCH)).sum())


def estimated(pairs: DataFrame, share: float) -> DataFrame:
    """pairs (a, b, one, other: sketches, n_a, n_b) -> a, b of those whose union sketch leaves the similarity possible."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for one, other, n, m in zip(batch.column("one"), batch.column("other"), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True):
                x, y = (np.asarray(s.values).view("<u8") for s in (one, other))
                on.append(union_overlap(x, y) >= min(least_shared(n, share), least_shared(m, share)))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "one", "other", "n_a", "n_b").mapInArrow(lean(task), "a long, b long")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, one, other: full sets as binary) -> a, b of those with the exact similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for one, other in zip(batch.column("one"), batch.column("other"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(other.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                on.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "one", "other").mapInArrow(lean(task), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept. Documents are linked where
    100 * intersection >= ``percent`` * union."""
    share = percent / 100
    known = written(sketches(docs, width), "sketches")
    same = known.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = written(inverted(nodes, share), "lists")
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("value").alias("of"), "k")
    led = lists.join(sizes, F.col("value") == F.col("of")).drop("of")
    pairs = _pairs(led.filter(F.col("k") <= COLD), share)
    hot = written(led.filter(F.col("k") > COLD).select("value", "df", "node", "n"), "hot")
    of = lambda c, name: nodes.select(F.col("node").alias(f"node_{c}"), F.col("sketch").alias(name), F.col("n").alias(f"n_{c}"))
    met = pairs.join(of("a", "one"), F.col("a") == F.col("node_a")).join(of("b", "other"), F.col("b") == F.col("node_b"))
    asked = written(estimated(met, share), "asked")
    ends = asked.select(F.col("a").alias("end")).union(asked.select("b")).union(hot.select("node")).distinct()
    wanted = written(nodes.join(ends, F.col("node") == F.col("end"), "left_semi").select("node", "text_key"), "wanted")
    sets = written(full_sets(docs, wanted, width), "sets")
    full = lambda c, name: sets.select(F.col("node").alias(f"node_{c}"), F.col("shingles").alias(name))
    met = asked.join(full("a", "one"), F.col("a") == F.col("node_a")).join(full("b", "other"), F.col("b") == F.col("node_b"))
    found = verified(met, percent)
    spent = [lists, asked, sets, hot, wanted]
    if not hot.isEmpty():
        packed = written(blocks(hot, sets), "blocks")
        found = found.union(block_links(packed, percent))
        spent.append(packed)
    roots = components(found)
    discard(*spent)
    of_node = nodes.select("node", "least", "set_key").join(roots.select(F.col("node").alias("member"), "root"), F.col("node") == F.col("member"), "left")
    of_node = of_node.select("set_key", "least", F.coalesce("root", "node").alias("root"))
    # the smallest doc_id of a component: grouped before it is joined
    smallest = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_node.join(smallest, "root").select(F.col("set_key").alias("key"), "component_id")
    out = known.join(named, F.col("set_key") == F.col("key"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
