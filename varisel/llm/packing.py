"""Hierarchical multi-length packing.

Documents are encoded and cut at the longest window; whole windows are sequences of their own. What is left
of each document is routed to the tier of the smallest window that holds it. From the longest tier down, a
piece opens a sequence of its tier's window; the gap behind it takes the largest pieces of shorter tiers
that fit, and at last the front of one that does not. So a sequence is full. What a task has left at its end
goes into windows of ever shorter tiers and, under the shortest, into sequences of ever smaller powers of two, so
nothing is padded. Sequences of a tier are dealt to step groups back and
forth by their attention cost (the sum of squared piece lengths), so that groups cost about the same.

No shuffle: each task packs what it reads, in blocks of bounded size, and passes the open rest on.

Defined cases: null text is the empty text, an end id alone; rows that repeat a doc_id, also null, are
documents of their own; a text longer than any window is cut; empty tables give no rows; other columns of
the input, whatever their names, are not read."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import encoder

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"



class BlockPacker:
    """Packs pieces given block by block. A piece is (length, key, doc_id, start, doc_tokens, ids)."""

    def __init__(self, tiers: tuple[int, ...], group_size: int, first_id: int):
        self.tiers, self.group_size = tuple(sorted(tiers)), group_size
        self.top, self.next_sequence, self.next_group, self.key = self.tiers[-1], first_id, first_id, 0
        self.open: list[tuple] = []

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def piece(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> tuple:
        self.key += 1
        return (len(ids), self.key, doc_id, start, doc_tokens, ids)

    def front(self, p: tuple, n: int) -> tuple[tuple, tuple]:
        """The first n ids of a piece, and the rest."""
        return self.piece(p[2], p[3], p[4], p[5][:n]), self.piece(p[2], p[3] + n, p[4], p[5][n:])

    def pack(self, docs: list[tuple], last: bool = False) -> list[tuple[int, list[tuple]]]:
        """Full sequences as (tier, pieces); an unfilled one stays open, unless this is the last block."""
        full: list[tuple[int, list[tuple]]] = []
        pool: list[tuple] = []
        for p in [*self.open, *docs]:
            while p[0] >= self.top:
                head, p = self.front(p, self.top)
                full.append((self.top, [head]))
            if p[0]:
                pool.append(p)
        pool.sort(key=lambda p: p[:2])
        self.open = []
        while pool:
            seq = [pool.pop()]  # the longest left, so tiers come from the longest down
            tier = self.tier(seq[0][0])
            gap = tier - seq[0][0]
            while gap and pool:
                at = bisect_right(pool, (gap, np.inf), key=lambda p: p[:2])
                if at:
                    seq.append(pool.pop(at - 1))
                else:
                    head, rest = self.front(pool.pop(0), gap)
                    seq.append(head)
                    insort(pool, rest, key=lambda p: p[:2])
                gap -= seq[-1][0]
            if gap == 0:
                full.append((tier, seq))
            else:
                self.open = seq
        if last:
            full += self.rest()
        return full

    def rest(self) -> list[tuple[int, list[tuple]]]:
        """The open pieces in windows of ever shorter tiers, then in sequences of smaller powers of two."""
        out: list[tuple[int, list[tuple]]] = []
        left, self.open = self.open, []
        while (n := sum(p[0] for p in left)) > 0:
            want = max((t for t in self.tiers if t <= n), default=1 << (n.bit_length() - 1))
            seq: list[tuple] = []
            got = 0
            while got < want:
                p = left.pop(0)
                if p[0] > want - got:
                    p, rest = self.front(p, want - got)
                    left.insert(0, rest)
                seq.append(p)
                got += p[0]
            out.append((want, seq))
        return out

    def rows(self, full: list[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        cost = lambda s: sum(p[0] ** 2 for p in s[1])
        for tier in sorted({s[0] for s in full}):
            own = sorted((s for s in full if s[0] == tier), key=cost, reverse=True)
            groups = -(-len(own) // self.group_size)
            for n, (_, seq) in enumerate(own):
                lap, at = divmod(n, groups)
                group = self.next_group + (groups - 1 - at if lap % 2 else at)
                offset = 0
                for length, _, doc_id, start, doc_tokens, ids in seq:
                    yield doc_id, start, length, ids.tobytes(), doc_tokens, self.next_sequence, offset, tier, group
                    offset += length
                self.next_sequence += 1
            self.next_group += groups


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_size: int = 64, block_ids: int = 1 << 19, **bounds: int) -> DataFrame:
    """One row for each piece (SCHEMA): ids as little-endian unsigned 32-bit, sequence and step group; tier is the
    sequence's window. ``bounds``: of the encoder's memory; they change no row."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "), strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BlockPacker(tiers, group_size, TaskContext.get().partitionId() << 33)
        block: list[tuple] = []
        size = 0

        def out(full):
            cols = list(zip(*packer.rows(full), strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, counts in encoder(tokenizer, end_id, **bounds).parts(batch.column("text")):
                at = 0
                for doc_id, n in zip(doc_ids[first : first + len(counts)], counts.tolist(), strict=True):
                    block.append(packer.piece(doc_id, 0, n, ids[at : at + n]))
                    at += n
                    size += n
                    if size >= block_ids:
                        yield from out(packer.pack(block))
                        block, size = [], 0
        yield from out(packer.pack(block, last=True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(task), SCHEMA)
