"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours differ in few bits, and cut into blocks. In a
block, runs of eight share an upper node: a mask of the bits on which all of them agree, with their values.
Eight nodes share a node above, and so on; each block's own mask and values are its root, and the roots have
nodes above them in the same way. A fingerprint descends: the differences within a node's mask are a lower bound
for all below it, and a node whose bound exceeds the radius is pruned as a whole.

Distribution: the roots (at most MOST_ROOTS, 24 bytes each) are sent to every task; a task sends a batch of
fingerprints to each block whose root survives, not after its own in Gray order, so each pair is met once.
Batches and blocks meet in a join by block, one row for each batch and block, so no task gathers a group.
A met pair of a batch and a block yields the lightest spanning forest of its links (by differing bits), not all
pairs: the forest joins what the links join, at every smaller radius too.

``near_duplicates`` is exact: all fingerprints within ``radius`` are linked. ``first_of_each`` asks for texts of
a similarity, which a small radius does not hold: at a similarity of 0.8 of shingle sets fingerprints differ in about
10 bits of 64, with a deviation of 3. There the index is built over several turns of the fingerprints, so that other bits come
first, and within a node only a share of the radius that goes with the bits of its mask is allowed. A pair that
differs evenly survives in one turn or another; how many do is measured in the tests and the README. A met pair of up to ``reach`` bits
is a candidate if the signatures, one bit of each of 64 minima, are near too; of unlike texts one pair in some ten thousand is. Candidates only
say which documents come together in a group: within a group every pair of shingle sets is compared exactly, in blocks, as in ``minhash``; a
pair of blocks returns a spanning forest of its links. So a forest's links never stand for a pair that was not compared.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; equal texts and
repeated rows share a fingerprint; component_id is the smallest doc_id that is not null, null if there is
none; rows that share a doc_id and not the text are documents of their own; empty tables give no rows; other columns
are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, lean, written
from .components import components
from .shingles import BROADCAST_NODES, block_links, blocks, shingle_hashes, spanning

#: Blocks: about so many at least, so that groups can be pruned; more where a block would exceed BLOCK fingerprints.
LEAST_BLOCKS, BLOCK, FANOUT = 64, 1 << 16, 8
#: Beyond so many blocks the blocks grow, so the roots that every task holds have a bounded size.
MOST_ROOTS = 1 << 20
#: Pairs of a fingerprint and a node that a task holds at once; more are followed one part after another.
MOST_PAIRS = 1 << 21
#: Turns of the fingerprints in a search that allows a share of the radius.
TURNS = 4
#: Bits in which the signatures of similar texts may differ, of 64: at a similarity of 0.8 they differ in 6.4 with a deviation of 2.4.
SIGNED = 15
LAST = 2**63 - 1
ALL = np.uint64(2**64 - 1)
#: Odd multipliers of the signature's minima, by a rule.
LANES = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ** 3 + 0x632BE59BD9B4E019 * i) % 2**64 | 1 for i in range(64)], "<u8")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, width)
    votes = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def signature(text: bytes | None, width: int) -> int:
    """One bit of each of 64 minima: two texts agree in a bit with probability (1 + similarity) / 2. Without words: zero."""
    hashes = shingle_hashes(text, width)
    least = np.full(64, ALL)
    for i in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[i : i + (1 << 11), None] * LANES).min(0))
    bits = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 4, signed: bool = False) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint's 64 bits as a long; with ``signed`` also sig, the ``signature``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())] + [("sig", pa.int64())] * signed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text")]
            made = [np.array([f(t, width) for t in texts], "<u8").view("<i8") for f in (fingerprint, signature)[: 1 + signed]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, made)], schema=schema)

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cols = cols.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return cols.mapInArrow(lean(task), "doc_id long, text_hash long, fp long" + ", sig long" * signed)


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = fps.astype("<u8")
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def agreed(mask: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of nodes that begin at ``starts``: the mask of bits on which all agree, and their values."""
    low, high = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
    out = np.bitwise_and.reduceat(mask, starts) & ~(low ^ high)
    return out, low & out


def turned(fps: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprints turned left by so many bits."""
    return fps if bits % 64 == 0 else (fps << np.uint64(bits % 64)) | (fps >> np.uint64(64 - bits % 64))


def allowance(radius: int, share: bool) -> np.ndarray:
    """Differences allowed within a mask, by its number of bits: the radius, or its share of it."""
    m = np.arange(65)
    return np.minimum(radius, np.floor(m * radius / 64 + 0.75)).astype("i8") if share else np.full(65, radius)


class GrayIndex:
    """The upper nodes over leaves (mask, value) in Gray order."""

    def __init__(self, value: np.ndarray, mask: np.ndarray | None = None):
        self.mask, self.value, self.levels = np.full(len(value), ALL) if mask is None else mask, value, []
        mask = self.mask
        while not self.levels or len(self.levels[-1][0]) > 1:  # up to one root
            mask, value = agreed(mask, value, np.arange(0, len(value), FANOUT))
            self.levels.append((mask, value))

    def within(self, queries: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries and of leaves that survive, and the bits in which they differ, part by part."""
        todo = [(len(self.levels) - 1, np.arange(len(queries)), np.zeros(len(queries), "i8"))] if len(self.value) else []
        while todo:
            k, q, node = todo.pop()
            mask, value = (self.mask, self.value) if k < 0 else self.levels[k]
            bits = np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            on = bits <= allowed[np.bitwise_count(mask[node])]
            q, node, bits = q[on], node[on], bits[on]
            if k < 0:
                yield q, node, bits
                continue
            below = len(self.levels[k - 1][0]) if k else len(self.value)
            for at in range(0, len(q), MOST_PAIRS // FANOUT):
                own = slice(at, at + MOST_PAIRS // FANOUT)
                child = (node[own, None] * FANOUT + np.arange(FANOUT)).ravel()
                on = child < below
                todo.append((k - 1, np.repeat(q[own], FANOUT)[on], child[on]))


def links(fps: DataFrame, radius: int = 4, share: bool = False) -> DataFrame:
    """``fps`` (fp, distinct) -> (a, b, bits): links, of at most ``radius`` bits, that join all fingerprints within the radius
    of each other; with ``share`` most of them, in far fewer steps. Where ``fps`` has sig, links also need signatures within SIGNED bits."""
    spark = fps.sparkSession
    n, turns = fps.count(), TURNS if share else 1
    # blocks of a turn: at least LEAST_BLOCKS, of at most BLOCK fingerprints; a task packs several
    most = max(1, min(max(BLOCK, -(-2 * n * turns // MOST_ROOTS)), -(-n // LEAST_BLOCKS)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * turns // (4 * BLOCK)))
    shifts = [64 // turns * t for t in range(turns)]
    turn = lambda t: F.col("fp") if t == 0 else F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", 64 - t))
    signed = ["sig"] if "sig" in fps.columns else []
    each = fps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), turn(t).alias("fp"), *signed) for t in shifts])).alias("x")).select("x.*")
    rank_of = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank_of = rank_of.bitwiseXOR(F.shiftrightunsigned(rank_of, shift))
    # signed order of the rank with its top bit flipped is unsigned order
    ranked = each.withColumn("rank", rank_of.bitwiseXOR(F.lit(-(2**63)).cast("long")))
    in_order = ranked.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank").select("turn", "fp", *signed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        of = np.concatenate([np.zeros(0, "i4"), *(b.column("turn").to_numpy() for b in held)])
        fps = np.concatenate([np.zeros(0, "<i8"), *(b.column("fp").to_numpy() for b in held)]).view("<u8")
        sigs = [np.concatenate([np.zeros(0, "<i8"), *(b.column("sig").to_numpy() for b in held)])] if signed else []
        part, k = TaskContext.get().partitionId(), 0
        for t in np.unique(of):
            same, marks = fps[of == t], [x[of == t] for x in sigs]
            for at in range(0, len(same), most):
                own = same[at : at + most]
                mask, value = agreed(np.full(len(own), ALL), own, np.zeros(1, "i8"))
                yield pa.RecordBatch.from_pydict({"block": [(part << 20) + k], "turn": pa.array([t], pa.int32()), "mask": mask.view("<i8"), "value": value.view("<i8"), "members": [own.tobytes()], "sigs": pa.array([x[at : at + most].tobytes() for x in marks] or [None], pa.binary())})
                k += 1

    index = written(in_order.mapInArrow(lean(pack), "block long, turn int, mask long, value long, members binary, sigs binary"), "gray")
    roots = index.select("block", "turn", "mask", "value").orderBy("block").toPandas()  # one row for each block
    roots = {t: (r.block.to_numpy(), r["mask"].to_numpy().view("<u8"), r.value.to_numpy().view("<u8")) for t, r in roots.groupby("turn")}
    sent = spark.sparkContext.broadcast(roots)
    allowed = allowance(radius, share)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {t: (ids, GrayIndex(value, mask)) for t, (ids, mask, value) in sent.value.items()}
        for batch in batches:
            for own, t, members, marks in zip(batch.column("block").to_pylist(), batch.column("turn").to_pylist(), batch.column("members"), batch.column("sigs"), strict=True):
                fps, (ids, tree) = np.frombuffer(members.as_py(), "<u8"), trees[t]
                sigs = np.frombuffer(marks.as_py(), "<u8") if signed else fps
                for at in range(0, len(fps), 4096):
                    part, sig = fps[at : at + 4096], sigs[at : at + 4096]
                    found = [(q[ids[leaf] <= own], leaf[ids[leaf] <= own]) for q, leaf, _ in tree.within(part, allowed)]
                    q, leaf = (np.concatenate([f[i] for f in found]) for i in range(2)) if found else (np.zeros(0, "i8"),) * 2
                    q, leaf = q[order := np.argsort(leaf, kind="stable")], leaf[order]
                    to = np.unique(leaf)
                    cuts = np.append(np.searchsorted(leaf, to), len(leaf))
                    yield pa.RecordBatch.from_pydict({"to": pa.array(ids[to], pa.int64()), "asked": pa.array([part[q[x:y]].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()), "marked": pa.array([sig[q[x:y]].tobytes() if signed else None for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, members, asked, sigs, marked in zip(batch.column("turn").to_pylist(), *(batch.column(c) for c in ("members", "asked", "sigs", "marked")), strict=True):
                own, queries = np.frombuffer(members.as_py(), "<u8"), np.frombuffer(asked.as_py(), "<u8")
                sig_m, sig_q = (np.frombuffer(x.as_py() or b"", "<u8") for x in (sigs, marked))
                kept = (np.zeros(0, "<u8"), np.zeros(0, "<u8"), np.zeros(0, "u1"))
                for q, m, bits in GrayIndex(own).within(queries, allowed):
                    a, b = queries[q], own[m]
                    on = bits > 0
                    if signed:
                        on &= np.bitwise_count(sig_q[q] ^ sig_m[m]) <= SIGNED
                    new = [np.concatenate([x, y]) for x, y in zip(kept, (a[on], b[on], bits[on]), strict=True)]
                    tree = spanning(*new)
                    kept = tuple(x[tree] for x in new)
                a, b = (turned(x, 64 - t).view("<i8") for x in kept[:2])
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64()), "bits": pa.array(kept[2].astype("i4"))})

    routed = index.select("block", "turn", "members", "sigs").mapInArrow(lean(route), "to long, asked binary, marked binary")
    met = routed.join(index.select("block", "turn", "members", "sigs"), F.col("to") == F.col("block"))
    return met.select("turn", "members", "asked", "sigs", "marked").mapInArrow(lean(probe), "a long, b long, bits int").distinct()


def _prints(docs: DataFrame, width: int, signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each row's fingerprint; each fingerprint's first document, by doc_id (null last) and text hash, as ``node``."""
    prints = written(fingerprints(docs, width, signed), "prints")
    name = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "text_hash")
    sig = [F.min_by("sig", name).alias("sig")] * signed
    first = prints.groupBy("fp").agg(F.min(name).alias("x"), F.min("doc_id").alias("least"), *sig)
    node = F.struct("x.d", F.coalesce("x.text_hash", F.lit(0).cast("long")).alias("h"), "fp")
    return prints, written(first.select("fp", "least", node.alias("node"), *["sig"] * signed), "distinct")


def _named(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links of fingerprints as links of nodes, so that a component's root is its first document."""
    of = lambda c: distinct.select(F.col("fp").alias(f"fp_{c}"), F.col("node").alias(f"node_{c}"))
    met = found.join(of("a"), F.col("a") == F.col("fp_a")).join(of("b"), F.col("b") == F.col("fp_b"))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _labelled(prints: DataFrame, distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """``prints`` with the root of each row's component."""
    roots = joined.select(F.col("node.fp").alias("node_fp"), "root")
    known = distinct.join(roots, F.col("fp") == F.col("node_fp"), "left").select(F.col("fp").alias("own"), F.coalesce("root", "node").alias("root"), "least")
    return prints.join(known, F.col("fp") == F.col("own")).drop("own")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, text_hash."""
    prints, distinct = _prints(docs, width)
    out = _labelled(prints, distinct, components(_named(links(distinct.select("fp"), radius), distinct)))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # a root without doc_id: no document of the component has one
    least = F.when(F.col("root.d") < LAST, F.col("root.d")).otherwise(F.col("least"))
    return out.select("doc_id", hexed.alias("fingerprint"), least.alias("component_id"), "text_hash")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts (fp, text) -> fp, shingles: sorted distinct hashes as binary."""
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], schema=schema)

    return texts.select("fp", F.col("text").cast("binary").alias("text")).mapInArrow(lean(task), "fp long, shingles binary")


def similar_groups(docs: DataFrame, width: int = 5, reach: int = 16, percent: int = 80) -> DataFrame:
    """``docs``' prints with the root of each row's group; see above."""
    prints, distinct = _prints(docs, width, signed=True)
    found = written(links(distinct.select("fp", "sig"), reach, share=True).select("a", "b"), "found")
    # the root itself is no node of its component's table
    joined = components(found)
    grouped = joined.select(F.col("root").alias("value"), F.col("node")).union(joined.select("root", "root").distinct())
    # the first document of a fingerprint stands for its texts
    wanted = written(grouped.join(distinct.select("fp", F.col("node").alias("first")), F.col("node") == F.col("fp")).select("fp", F.col("first.d").alias("d"), F.col("first.h").alias("h")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("t_d"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("t_h", F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")))
    sets = texts.join(few, (F.col("t_d") == F.col("d")) & (F.col("t_h") == F.col("h"))).dropDuplicates(["fp"])
    sets = written(_shingle_sets(sets, width).select(F.col("fp").alias("node"), "shingles"), "sets")
    sized = sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n")).filter("n > 0")
    lists = written(grouped.join(sized, "node").select("value", F.lit(1).cast("long").alias("df"), "node", "n"), "groups")
    packed = written(blocks(lists, sets), "blocks")
    held = components(_named(block_links(packed, percent), distinct))
    discard(found, wanted, sets, lists, packed)
    return _labelled(prints, distinct, held)


def first_of_each(docs: DataFrame, width: int = 5, reach: int = 16, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of similar texts, that of the smallest doc_id, then text hash. Rows
    without doc_id all stay; of rows equal in doc_id and text one stays."""
    known = similar_groups(docs.filter("doc_id is not null"), width, reach, percent)
    first_id, first_hash = free_names(docs, "first_id", "first_hash")
    hashed = F.coalesce(F.col("text_hash"), F.lit(0).cast("long"))
    first = written(known.filter((F.col("doc_id") == F.col("root.d")) & (hashed == F.col("root.h"))).select("doc_id", hashed.alias("h")), "first")
    repeated = first.groupBy("doc_id", "h").count().filter("count > 1")
    kept = first.select(F.col("doc_id").alias(first_id), F.col("h").alias(first_hash))
    same = (F.col("doc_id").cast("long") == F.col(first_id)) & (F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0).cast("long")) == F.col(first_hash))
    out = docs.join(kept, same, "left_semi")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.union(docs.filter("doc_id is null"))
