"""Rules on an unbounded stream of segments.

``apply_stream``: a record is a whole segment and holds all that a decision needs, so application keeps no state between records:
restart and replay give the same output.

``cut_stream``: a segment arrives in pieces, cut anywhere, within units, tags and escapes too. Each stream (``key``) keeps what it
cannot pass on yet: the text of an unended unit, and as many units as the longest rule may still need. A unit is passed on as soon as
the units behind it show that no rule that covers it is alive any more, or when a NUL ends its segment. It leaves with its neighbours on
both sides, so the decision itself is the projection of ``apply_stream``. The state is bounded by the longest rule and the longest unit or
stretch of blank text, not by the segment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import lu
from ..operators.matching import apply_to_units
from ..operators.rules import Rules

#: A whole unit with the blank text before it.
WHOLE = re.compile(r"[^\\^]*(?:\\.[^\\^]*)*\^[^\\<$]*(?:(?:\\.|<[^>]*>)[^\\<$]*)*\$", re.DOTALL)
PIECES = "key string, seq long, before int, own int, at_start boolean, ends boolean, text string, rest string"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Files that come into a folder; a NUL ends a segment."""
    return spark.readStream.option("lineSep", "\0").text(path).withColumnRenamed("value", "text")


def apply_stream(segments: DataFrame, rules: Rules) -> DataFrame:
    """text in and out, as one projection."""
    return segments.withColumn("text", F.concat(lu.render_units(apply_to_units(lu.parse_units(F.col("text")), rules)), lu.trailing(F.col("text"))))


def run(segments: DataFrame, rules: Rules, out: str, checkpoint: str) -> StreamingQuery:
    return apply_stream(segments, rules).select("text").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()


class Cutter:
    """Cuts one stream's text into pieces of units with ``reach`` units before and behind them."""

    def __init__(self, reach: int, seq: int = 0, first: bool = True, before: int = 0, units: list[str] | None = None, open_: str = ""):
        self.reach, self.seq, self.first, self.before, self.units, self.open = reach, seq, first, before, units or [], open_

    def state(self) -> tuple:
        return self.seq, self.first, self.before, self.units, self.open

    def _piece(self, own: int, ends: bool, rest: str) -> tuple:
        """Units up to ``own`` behind the context leave; the last ``reach`` of them stay as context."""
        row = (self.seq, self.before, own, self.first, ends, "".join(self.units), rest)
        self.seq += 1
        gone = self.before + own
        kept = min(self.reach, gone)
        self.first = self.first and kept == gone
        self.units, self.before = self.units[gone - kept :], kept
        return row

    def feed(self, text: str) -> Iterator[tuple]:
        """(seq, before, own, at_start, ends, text, rest) of every piece that can leave."""
        parts = text.split("\0")
        for i, part in enumerate(parts):
            self.open += part
            at = 0
            while m := WHOLE.match(self.open, at):
                self.units.append(m[0])
                at = m.end()
            self.open = self.open[at:]
            if i < len(parts) - 1:  # a NUL: nothing behind it matters
                yield self._piece(len(self.units) - self.before, True, self.open)
                self.first, self.before, self.units, self.open = True, 0, [], ""
            else:
                own = len(self.units) - self.before - self.reach
                if own > 0:
                    yield self._piece(own, False, "")


class _Pieces(StatefulProcessor):
    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq long, first boolean, before int, units array<string>, open string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        held = self.held.get() if self.held.exists() else ()
        cutter = Cutter(self.reach, *(list(x) if isinstance(x, (list, tuple)) else x for x in held))
        chunk = pd.concat(list(rows)).sort_values("n", kind="stable")
        out = [(key[0], *piece) for text in chunk["text"] for piece in cutter.feed(text or "")]
        self.held.update(cutter.state())
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PIECES.split(", ")])

    def close(self) -> None:
        pass


def cut_stream(chunks: DataFrame, rules: Rules) -> DataFrame:
    """chunks (key, n, text: pieces of each key's text, in order of n within a batch) -> key, seq, ends, text: the same text after the rules, in
    pieces; those of a key joined by seq, with a NUL behind each that ``ends`` a segment, are the whole. Needs the RocksDB state store."""
    reach = max(rules.longest - 1, 0)
    rows = chunks.select(F.col("key").cast("string").alias("key"), "n", "text")
    cut = rows.groupBy("key").transformWithStateInPandas(_Pieces(reach), outputStructType=PIECES, outputMode="append", timeMode="none")
    units = apply_to_units(lu.parse_units(F.col("text")), rules, F.col("at_start"))
    own = F.slice(units, F.col("before") + 1, F.col("own"))
    return cut.select("key", "seq", "ends", F.concat(lu.render_units(own), "rest").alias("text"))
