"""Repair of the structure of conversations, by lazy weighted determinisation.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. The
machine that edits has four states: START, SYSTEM, USER and ASSISTANT, after the turn that was last put out. Its arcs keep,
rerole or delete a row, or insert a turn. What the rest of a conversation costs from each state is a vector; without its
least entry it is a state of the determinised machine. These are few, as entries differ by a few edits at most; they
and their transitions are made when first met and kept in a table, for all conversations of a task.

1. The scan reads a conversation's rows from the last to the first, one table entry each: the entries' shifts add up to the cost.
2. The trace runs against the scan, from the first row on. An arc is tight if it loses nothing of the least cost; of the tight arcs the
first letter in ASCII order is taken, so the audit is the least of all cheapest ones. Rows that are kept or reroled and insertions
have one target in each state, so a letter has one arc.

Distribution: rows are dealt by conversation and sorted within tasks. The scan gets 18 bytes a row, never texts: what a task holds
of a conversation is its symbols and the digests that tell repeated rows. The texts come in a second pass, each conversation's audit before
its rows, and are hashed as they stream by. The audit, one letter a row, and the hash, which is sequential, bound what a
single conversation may need; its texts are not gathered.

Defined cases: null roles and texts are one space, and so are null ids and turns in the key of the damage; rows of one turn go by role,
then by the digest of their text; a null conv_id is a conversation of its own; empty roles have no initial; a conversation whose rows are all dropped
has zeros, no audit and the hash of the empty text; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn leads that an edit makes, and its role.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Where a kept row leads, by state and initial.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
INITIALS = "sua"
#: Faults of a row, the first that holds: none, truncated, blank, duplicate.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
LEGAL = ("su", "ua", "au")


class Machine:
    """The determinised machine, as far as it was needed. State 0 is what the end of a conversation costs."""

    def __init__(self):
        self.vectors, self.ids = [], {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple, tuple[str, int]] = {}
        self.id_of(self.closed([0, None, None, 0]))

    def id_of(self, costs: list[int]) -> tuple[int, int]:
        """A vector's state, and what was taken off."""
        least = min(costs)
        own = tuple(c - least for c in costs)
        if own not in self.ids:
            self.ids[own] = len(self.vectors)
            self.vectors.append(own)
        return self.ids[own], least

    @staticmethod
    def closed(costs: list[int | None]) -> list[int]:
        """With insertions: each state may first go on by a turn of its own."""
        far = 1 << 30
        out = [far if c is None else c for c in costs]
        for _ in range(len(out)):
            out = [min(c, INSERT + out[MADE[q]]) for q, c in enumerate(out)]
        return out

    @staticmethod
    def edits(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Letter, cost and target of each edit of a row."""
        initial, fault = symbol // 4, symbol % 4
        yield "D", DELETE, q
        if fault in (BLANK, DUPLICATE):
            return
        more = UNFINISHED * (fault == TRUNCATED)
        if initial < len(INITIALS) and INITIALS[initial] in KEPT[q]:
            yield "K", more, KEPT[q][INITIALS[initial]]
        yield "R", REROLE + more, MADE[q]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        key = (state, symbol)
        if key not in self.table:
            after = self.vectors[state]
            self.table[key] = self.id_of(self.closed([min(c + after[to] for _, c, to in self.edits(symbol, q)) for q in range(4)]))
        return self.table[key]

    def tight(self, after: int, symbol: int | None, q: int) -> tuple[str, int]:
        """The first letter whose arc is tight, and its target: before a row, ``after`` being the state behind it, or at the end
        (symbol None, state 0). The letter is empty where the conversation may end."""
        key = (after, symbol, q)
        if key not in self.arcs:
            here, less = (after, 0) if symbol is None else self.step(after, symbol)
            own, rest = self.vectors[here], self.vectors[after]
            found = [("I", MADE[q])] if own[q] == INSERT + own[MADE[q]] else []
            if symbol is None:
                found += [("", q)] if q in (START, ASSISTANT) else []
            else:
                found += [(letter, to) for letter, c, to in self.edits(symbol, q) if own[q] + less == c + rest[to]]
            self.arcs[key] = min(found)
        return self.arcs[key]

    def repaired(self, symbols: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation's rows."""
        states, cost = np.zeros(len(symbols) + 1, "u4"), 0
        now = 0
        for i in range(len(symbols) - 1, -1, -1):
            now, less = self.step(now, symbols[i])
            states[i], cost = now, cost + less
        cost += self.vectors[now][START]
        q, out, i = START, bytearray(), 0
        while True:
            at_end = i == len(symbols)
            letter, to = self.tight(0, None, q) if at_end else self.tight(int(states[i + 1]), symbols[i], q)
            if not letter:
                return cost, out.decode()
            out += letter.encode()
            q, i = to, i + (letter != "I")


def symbol_of(initial: str, fault: int) -> int:
    """The letter that the scan reads for a row."""
    at = INITIALS.find(initial) if initial else -1
    return 4 * (at if at >= 0 else len(INITIALS)) + fault


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> the same columns, without nulls in role and text, after the damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    one = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), key.alias("key")).filter("key <> 0")
    text = F.when(F.col("key") == 1, "").when(F.col("key") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = one.select("conv_id", "turn", F.when(F.col("key") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("key") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def _in_order(df: DataFrame, *first: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows of one conversation, and whether a new one begins."""
    last = ()
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        at = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[at]:
                yield (ids[at],) != last, batch.slice(at, i - at)
                last, at = (ids[at],), i


def judged(rows: DataFrame) -> DataFrame:
    """Damaged rows with digest -> one row for each conversation that has rows: its counts, cost and audit."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    # a duplicate has the role and the text of an earlier row; texts are told by their digest
    plain = F.when(blank, BLANK).when(~ended, TRUNCATED).otherwise(FINE).cast("byte").alias("fault")
    cols = rows.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), plain, F.unhex(F.md5(F.concat(F.col("role").cast("binary"), F.lit("\x00").cast("binary"), F.col("digest")))).alias("same"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now = Machine(), None

        def row() -> pa.RecordBatch:
            cost, audit = machine.repaired(bytes(now["symbols"]))
            turns = now["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            n = now["faults"]
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([now["id"]], pa.int64()), **{k: pa.array([v], pa.int64()) for k, v in (("gaps", gaps), ("blank", n[BLANK]), ("duplicate", n[DUPLICATE]), ("truncated", n[TRUNCATED]), ("illegal", now["illegal"]), ("cost", cost))}, "audit": [audit]})

        for new, part in _conversations(batches):
            if new:
                if now:
                    yield row()
                now = {"id": part.column("conv_id")[0].as_py(), "symbols": bytearray(), "seen": set(), "turns": None, "faults": [0] * 4, "illegal": 0, "before": None}
            for turn, initial, fault, same in zip(*(part.column(c).to_pylist() for c in ("turn", "initial", "fault", "same")), strict=True):
                if fault != BLANK and same in now["seen"]:
                    fault = DUPLICATE
                now["seen"].add(same)
                now["faults"][fault] += 1
                now["symbols"].append(symbol_of(initial, fault))
                now["illegal"] += now["before"] is not None and now["before"] + initial not in LEGAL
                now["before"] = initial
                if turn is not None:  # turns come in order
                    low, high, n = now["turns"] or (turn, turn - 1, 0)
                    now["turns"] = (low, turn, n + (turn > high))
        if now:
            yield row()

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _in_order(cols).select("conv_id", "turn", "initial", "fault", "same").mapInArrow(lean(task), schema)


def hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: rows stream behind their conversation's audit."""
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("conv_id", F.lit(1).alias("side"), "turn", "role", "digest", "text").union(audits.select("conv_id", F.lit(0), none("long"), none("string"), none("binary"), "audit"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def put(role: str, text: str) -> None:
            now["hash"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode())
            now["any"] = True

        def made() -> None:
            put(ROLE[now["q"]], "")
            now["q"] = MADE[now["q"]]

        def inserted() -> None:
            while now["audit"][now["at"] : now["at"] + 1] == "I":
                made()
                now["at"] += 1

        def row() -> pa.RecordBatch:
            inserted()
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([now["id"]], pa.int64()), "repaired_sha256": [now["hash"].hexdigest()]})

        for new, part in _conversations(batches):
            if new:
                if now:
                    yield row()
                now = {"id": part.column("conv_id")[0].as_py(), "audit": part.column("text")[0].as_py(), "at": 0, "q": START, "hash": hashlib.sha256(), "any": False}
            for side, role, text in zip(*(part.column(c) for c in ("side", "role", "text")), strict=True):
                if side.as_py() == 0:
                    continue
                inserted()
                letter = now["audit"][now["at"]]
                now["at"] += 1
                if letter == "K":
                    put(role.as_py(), text.as_py())
                    now["q"] = KEPT[now["q"]][role.as_py()[0]]
                elif letter == "R":
                    put(ROLE[now["q"]], text.as_py())
                    now["q"] = MADE[now["q"]]
        if now:
            yield row()

    return _in_order(both, "side").select("conv_id", "side", "role", "text").mapInArrow(lean(task), "conv_id long, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of the table: what is wrong after the damage, the cheapest repair and its result's hash."""
    rows = damaged(conversations).withColumn("digest", F.unhex(F.md5("text")))
    found = written(judged(rows), "judged")
    hashed = hashes(rows, found.select("conv_id", "audit")).select(F.col("conv_id").alias("_id"), "repaired_sha256")
    whole = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id").withColumnRenamed("conv_id", "_id")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(whole, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
