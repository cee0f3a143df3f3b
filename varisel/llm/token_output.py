"""Token ids in directly addressable codes.

A segment holds the ids of whole documents in one row of a Parquet table: the ids are split into chunks of
``bits`` bits, lowest first; level k holds the k-th chunk of every id that has one, a bitmap says which of
them go on, and a rank directory counts the set bits before each block of 512. So id i is read by one look
into each level, without decoding a block, and the whole codes cost no more than the chunks that ids need. The
files are neither compressed nor dictionary-encoded and a segment has its own pages, so ``token_at`` reads one
segment's codes as they lie.

Segments lie in ascending doc_id order, also across files: rows are range-partitioned and sorted by doc_id
(null last, equal doc_ids by their text's hash), each task writes segments of bounded size, and ``first``
of a segment counts all ids before it. Spark's writer commits the files, so a lost executor loses nothing.

Defined cases: null text is the empty text, an end id alone; rows that repeat a doc_id are documents of
their own; a document longer than a segment's bound has a segment to itself; an empty table gives an empty
file set; other columns of the input are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean
from .tokens import encoder

RANK_BITS = 512
#: The starts of so many segments, 20 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_SEGMENTS = 1_000_000
SEGMENT = "part int, segment long, n_ids long, doc_ids array<long>, doc_counts array<long>, codes array<binary>"


def pack_level(chunks: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return chunks.astype(np.uint8).tobytes()
    if bits == 16:
        return chunks.astype("<u2").tobytes()
    wide = np.unpackbits(chunks.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def level_slice(data: bytes, bits: int, a: int, b: int) -> np.ndarray:
    """Chunks a to b of a level; only their own bytes are touched."""
    if bits in (8, 16):
        return np.frombuffer(data, np.uint8 if bits == 8 else "<u2")[a:b].astype(np.uint32)
    lo = a * bits // 8
    raw = np.unpackbits(np.frombuffer(data, np.uint8)[lo : -(-b * bits // 8)], bitorder="little")
    cut = raw[a * bits - 8 * lo : b * bits - 8 * lo].reshape(-1, bits)
    return cut.astype(np.uint32) @ (1 << np.arange(bits, dtype=np.uint32))


def dac_encode(ids: np.ndarray, bits: int = 8) -> list[bytes]:
    """For each level: its chunks, its continuation bitmap and its rank directory."""
    out: list[bytes] = []
    rest = np.asarray(ids, np.uint32)
    while True:
        more = rest >> np.uint32(bits) > 0
        padded = np.zeros(-(-max(len(rest), 1) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(more)] = more
        per_block = padded.reshape(-1, RANK_BITS).sum(1)
        directory = (np.cumsum(per_block) - per_block).astype("<u4")
        out += [pack_level(rest & np.uint32((1 << bits) - 1), bits), np.packbits(padded, bitorder="little").tobytes(), directory.tobytes()]
        rest = rest[more] >> np.uint32(bits)
        if not len(rest):
            return out


def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
    """Set bits before i."""
    block = min(i // RANK_BITS, len(directory) - 1)
    lo = block * (RANK_BITS // 8)
    head = bitmap[lo : i // 8]
    tail = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
    return int(directory[block]) + int(np.bitwise_count(head).sum()) + tail.bit_count()


def dac_access(codes: list[bytes], i: int, bits: int = 8) -> int:
    """Id i, by one look into each of its levels."""
    value = 0
    for level in range(len(codes) // 3):
        data, bitmap, directory = codes[3 * level], np.frombuffer(codes[3 * level + 1], np.uint8), np.frombuffer(codes[3 * level + 2], "<u4")
        value |= int(level_slice(data, bits, i, i + 1)[0]) << (bits * level)
        if not bitmap[i // 8] >> (i % 8) & 1:
            return value
        i = _rank(bitmap, directory, i)
    raise ValueError("the codes end within an id")


def dac_slice(codes: list[bytes], a: int, b: int, bits: int = 8) -> np.ndarray:
    """Ids a to b; each level's part of them is one run."""
    out = np.zeros(b - a, np.uint32)
    where = np.arange(b - a)
    for level in range(len(codes) // 3):
        if a == b:
            break
        bitmap, directory = np.frombuffer(codes[3 * level + 1], np.uint8), np.frombuffer(codes[3 * level + 2], "<u4")
        out[where] |= level_slice(codes[3 * level], bits, a, b) << np.uint32(bits * level)
        on = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        where = where[on]
        a = _rank(bitmap, directory, a)
        b = a + len(where)
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, bits: int = 8, segment_ids: int = 1 << 20) -> None:
    """Encode ``docs`` and write their segments to ``path`` in ascending doc_id order."""
    kinds = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[int] = []
        n = 0

        def segment() -> pa.RecordBatch:
            nonlocal n, held, names, counts
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_pylist([{"part": part, "segment": n, "n_ids": len(ids), "doc_ids": names, "doc_counts": counts, "codes": dac_encode(ids, bits)}], schema=kinds)
            n, held, names, counts = n + 1, [], [], []
            return out

        size = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, lengths in encoder(tokenizer, end_id).parts(batch.column("text")):
                at = 0
                for doc_id, k in zip(doc_ids[first : first + len(lengths)], lengths.tolist(), strict=True):
                    if held and size + k > segment_ids:
                        yield segment()
                        size = 0
                    held.append(ids[at : at + k])
                    names.append(doc_id)
                    counts.append(k)
                    at += k
                    size += k
        if held:
            yield segment()

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cols.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    plain = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1"}
    ranged.mapInArrow(lean(task), SEGMENT).write.options(**plain).parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """_part, _segment, n_ids and ``first``, the ids of all segments before. Codes are not read; the window without
    a partition runs over one row for each part."""
    segments = spark.read.schema(SEGMENT).parquet(path).select("part", "segment", "n_ids")
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = parts.select(F.col("part").alias("_part"), (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    starts = segments.select("part", "segment", "n_ids", inside.alias("_inside")).join(before, F.col("part") == F.col("_part"))
    return starts.select("_part", F.col("segment").alias("_segment"), "n_ids", (F.col("_before") + F.col("_inside")).alias("first"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments, with ``first``: ids of all segments before."""
    starts = segment_starts(spark, path).drop("n_ids")
    small = starts.count() <= BROADCAST_SEGMENTS
    segments = spark.read.schema(SEGMENT).parquet(path)
    return segments.join(F.broadcast(starts) if small else starts, (F.col("part") == F.col("_part")) & (F.col("segment") == F.col("_segment"))).drop("_part", "_segment")


def token_at(spark: SparkSession, path: str, place: int, bits: int = 8) -> int:
    """The id at ``place`` of all ids in the files of ``path``; of the codes one segment is read."""
    at = segment_starts(spark, path).filter((F.col("first") <= place) & (F.col("first") + F.col("n_ids") > place)).first()
    if at is None:
        raise IndexError(place)
    own = spark.read.schema(SEGMENT).parquet(path).filter((F.col("part") == at["_part"]) & (F.col("segment") == at["_segment"]))
    return dac_access(list(map(bytes, own.select("codes").first().codes)), place - at["first"], bits)


def document_digests(segments: DataFrame, bits: int = 8) -> DataFrame:
    """Per document, from the codes: start, n_tokens and the crc32 of its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], 0
                ids = dac_slice(row["codes"], 0, sum(row["doc_counts"]), bits).astype("<u4", copy=False)  # a segment's ids are bounded
                for doc_id, k in zip(row["doc_ids"], row["doc_counts"], strict=True):
                    out.append((doc_id, row["first"] + at, k, zlib.crc32(ids[at : at + k])))
                    at += k
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kinds)

    return segments.select("first", "doc_ids", "doc_counts", "codes").mapInArrow(lean(task), schema)
