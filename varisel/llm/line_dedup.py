"""Repeated line runs, by a suffix array over line ids.

A text is the sequence of its lines' ids. Lines whose id occurs once in the corpus end a run, as a
document's end does; the maximal stretches between them are the segments whose suffixes are sorted.

1. Prefix doubling: at level k a suffix has a rank that orders the first 2**k lines. The pair of ranks at
p and p + 2**k gives level k + 1: distinct pairs are sorted by range over all tasks, and a pair's place in
that order is its rank. A suffix alone with its rank shares 2**k lines with no other and is left out from there on;
suffixes that end within their 2**k lines and have one rank are equal as a whole, and settled. Doubling ends when none is
left.
2. The suffixes of one rank at level k are an interval of the suffix array whose common prefix is 2**k lines
or more. Each level keeps the first place (document, line) of every interval. A settled suffix that is not its
interval's first shares all its lines. For another suffix p, let k be the
deepest level whose interval holds an earlier place, and t the first place there.
3. No earlier place shares 2**(k + 1) lines with p. The greatest length that one shares is found by descending
the levels below k: the suffixes of an interval of m common lines, p and those like it and the interval's
first, fall apart by their ranks at level j behind these m lines. Where several agree, all but the
first of them have an earlier place with m + 2**j lines and go on in that smaller interval, the first is held
in both. A suffix left out shares no more with p than one that is held. That is the maximal
repeated run from p on, over all earlier places. It counts if its lines have ``min_words`` words or more.
4. The lines of runs that count are deleted: each stands earlier in the corpus too, in the same company. The
first copy stays.

DataFrame functions only. Hot lines: distinct pairs are aggregated before any shuffle, joins may split a
large key, windows run over one document's segment or one range of the suffix array.

Order of copies: doc_id (null last), then a hash of the text, then the line. Defined cases: null text stays null and
has no lines; the empty text has one empty line; rows equal in doc_id and text are one document and get
the same edit; within one document a repeated run goes as well; a document left without lines has the
empty text, n_kept 0; empty tables give no rows; other columns are passed on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, discard, free_names, written

LAST = 2**63 - 1


def _lines(docs: DataFrame) -> DataFrame:
    """d, h, p, id, w: each document's lines with their ids and numbers of words."""
    one = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("text").cast("string")).filter("text is not null")
    lines = one.select("d", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n_words = F.size(F.array_remove(F.split(F.translate("line", "\t\x0b\x0c\r", " " * 4), " "), ""))
    return lines.select("d", "h", "p", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), n_words.alias("w"))


def _place() -> Column:
    return F.struct("d", "h", "p")


def _ranked(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct ``by`` that two places or more have, with a rank that follows their global order, and the first place."""
    distinct = pairs.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).filter("first < last").drop("last")
    return written(distinct.orderBy(*[F.col(c).asc_nulls_first() for c in by]).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """d, h, p of every line to delete."""
    lines = written(_lines(docs), "lines")
    ids = _ranked(lines, ["id", "id2"], "ids")
    # rows equal in doc_id and text have their lines at the same places: one of them is left
    active = lines.join(ids.select("id", "id2", "rank", "first"), ["id", "id2"])
    active = active.repartition("d", "h").dropDuplicates(["d", "h", "p"])
    # consecutive active lines are a segment; left: lines up to its end, this one included
    whole = Window.partitionBy("d", "h")
    active = active.withColumn("s", F.col("p") - F.row_number().over(whole.orderBy("p")))
    segment = Window.partitionBy("d", "h", "s")
    upto = F.sum("w").over(segment.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    active = active.withColumn("left", F.count(F.lit(1)).over(segment) - (F.col("p") - F.min("p").over(segment))).withColumn("upto", upto.cast("long"))
    active = active.withColumn("words_left", F.sum("w").over(segment) - F.col("upto") + F.col("w"))
    base = written(active.select("d", "h", "p", "s", "left", "w", "upto", "words_left", "rank", "first"), "active")
    discard(lines, ids)
    now, length, levels, settled = base.select("d", "h", "p", "left", "rank", "first"), 1, [base.select("d", "h", "p", "left", "rank", "first")], []
    while True:
        behind = Window.partitionBy("d", "h").orderBy("p").rangeBetween(length, length)
        pairs = now.select("d", "h", "p", "left", F.col("rank").alias("r1"), F.when(F.col("left") > length, F.max("rank").over(behind)).alias("r2"))
        pairs = pairs.filter((F.col("left") <= length) | F.col("r2").isNotNull())  # else alone with its pair
        ranks = _ranked(pairs, ["r1", "r2"], "ranks")
        at = (pairs["r1"] == ranks["r1"]) & pairs["r2"].eqNullSafe(ranks["r2"])
        met = written(pairs.join(ranks, at).select("d", "h", "p", "left", "rank", "first"), "level")
        discard(ranks)
        ended = met.filter((F.col("left") <= length) & (_place() > F.col("first")))
        settled.append(ended.select("d", "h", "p", F.col("left").cast("long").alias("m")))
        now, length = met.filter(F.col("left") > length), 2 * length
        if now.isEmpty():
            break
        levels.append(now.filter(F.col("left") >= length))

    # for each other suffix the deepest interval with an earlier place, and its first place
    later = [x.filter(_place() > F.col("first")).select("d", "h", "p", F.lit(k).alias("k"), "first") for k, x in enumerate(levels)]
    whole = reduce(DataFrame.union, settled)
    deepest = reduce(DataFrame.union, later).groupBy("d", "h", "p").agg(F.max(F.struct("k", "first")).alias("x")).join(whole.select("d", "h", "p"), ["d", "h", "p"], "left_anti")
    # a run of too few words to its segment's end counts neither here nor for a suffix that shares it
    start = base.select("d", "h", "p", (F.col("upto") - F.col("w")).alias("words_before"), "words_left").filter(F.col("words_left") >= min_words).drop("words_left")
    met = deepest.join(start, ["d", "h", "p"]).select("d", "h", "p", "x.k", F.struct(*[F.col(f"x.first.{c}").alias(c) for c in "dhp"]).alias("t"), "words_before")
    met = written(met.withColumn("m", F.expr("shiftleft(1L, k)")), "met")
    cols = ["d", "h", "p", "words_before", "t", "m"]
    done = whole.join(start, ["d", "h", "p"]).select("d", "h", "p", "words_before", "m")
    runs = [done, met.filter(F.col("k") == 0).select("d", "h", "p", "words_before", "m")]
    state, old = None, []
    for j in range(len(levels) - 2, -1, -1):
        own = met.filter(F.col("k") == j + 1).select(*cols)
        firsts = own.select("t", "m").distinct().select("t.d", "t.h", "t.p", F.lit(None).cast("long").alias("words_before"), "t", "m")
        state = reduce(DataFrame.union, [own, firsts] if state is None else [state, own, firsts])
        ranks = levels[j].select(F.col("d").alias("x_d"), F.col("h").alias("x_h"), F.col("p").alias("x_p"), F.col("rank").alias("r"))
        on = (F.col("d") == F.col("x_d")) & (F.col("h") == F.col("x_h")) & (F.col("p") + F.col("m") == F.col("x_p"))
        asked = written(state.join(ranks, on, "left").drop("x_d", "x_h", "x_p"), "asked")
        groups = asked.filter("r is not null").groupBy("t", "m", "r").agg(F.min(_place()).alias("f"), F.max(_place()).alias("l")).filter("f < l").drop("l")
        stays, goes = F.struct("t", "m"), F.struct(F.col("f").alias("t"), (F.col("m") + 2**j).alias("m"))
        to = F.when(F.col("f").isNull(), F.array(stays)).when(_place() > F.col("f"), F.array(goes)).otherwise(F.array(stays, goes))
        moved = asked.filter("r is not null").join(groups, ["t", "m", "r"], "left").select("d", "h", "p", "words_before", F.explode(to).alias("x"))
        state = asked.filter("r is null").select(*cols).union(moved.select("d", "h", "p", "words_before", "x.t", "x.m"))
        state = written(state, "state")
        discard(asked, *old)
        old = [state]
    if state is not None:
        runs.append(state.filter(_place() > F.col("t")).select("d", "h", "p", "words_before", "m"))
    met = reduce(DataFrame.union, runs)

    # words of the run [p, p + m): running sums at its ends
    end = base.select("d", "h", F.col("p").alias("q"), "upto")
    runs = met.select("d", "h", "p", "words_before", (F.col("p") + F.col("m")).alias("stop")).withColumn("q", F.col("stop") - 1).join(end, ["d", "h", "q"])
    marks = runs.filter(F.col("upto") - F.col("words_before") >= min_words).select("d", "h", "p", "stop")
    # a line goes if a run that began at or before it ends behind it
    reach = F.max("stop").over(Window.partitionBy("d", "h").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    return base.select("d", "h", "p").join(marks, ["d", "h", "p"], "left").withColumn("reach", reach).filter("reach > p").select("d", "h", "p")


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut from ``text``; n_lines and n_kept count its
    lines, in place of columns of these names."""
    gone = repeated_lines(docs, min_words)
    island = F.col("p") - F.row_number().over(Window.partitionBy("d", "h").orderBy("p"))
    runs = gone.withColumn("g", island).groupBy("d", "h", "g").agg(F.min("p").alias("start"), F.max("p").alias("stop"))
    cuts = runs.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cut_d, cut_h, cut_at = free_names(docs, "cut_d", "cut_h", "cuts")
    cuts = cuts.select(F.col("d").alias(cut_d), F.col("h").alias(cut_h), F.col("cuts").alias(cut_at))
    names = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names])
    text = F.col("text").cast("string")
    d, h = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(text)
    out = keyed.join(cuts, (d == F.col(cut_d)) & (h == F.col(cut_h)) & text.isNotNull(), "left")
    cut = F.col(cut_at)

    def kept(lines: Column) -> Column:
        """The lines between one cut and the next."""
        before = F.transform(cut, lambda c, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(cut, i)["stop"] + 1).alias("a"), c["start"].alias("b")))
        last = F.struct((F.element_at(cut, -1)["stop"] + 1).alias("a"), F.size(lines).alias("b"))
        return F.array_join(F.flatten(F.transform(F.concat(before, F.array(last)), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"]))), "\n")

    n_cut = F.coalesce(F.aggregate(cut, F.lit(0), lambda acc, c: acc + c["stop"] - c["start"] + 1), F.lit(0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    new = F.when(cut.isNull(), text).otherwise(bind(F.split(text, "\n"), kept))
    return out.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], n_lines.alias("n_lines"), (n_lines - n_cut).alias("n_kept"))
