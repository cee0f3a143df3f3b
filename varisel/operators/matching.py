"""Application of compiled rules to LUs, as joins and groupings.

A rule is a graph of words. LUs meet words by index keys (lemma, end or part of the lemma, first tag) in one equi-join and the regex
decides; each hit stands for the arcs of its word, at their places in the rule. A group by (start, graph) then holds what may become a match:
where a rule is a plain sequence, all its places have to be there; else the arcs are followed from the start on, in the group's few rows. Weights of
a position's operations add up; the translations that an operation recognises are then selected or removed in order of weight.

LUs are dealt once, by segment and block of BLOCK positions, each block with as many neighbours on either side as the longest rule needs to decide its own
positions. All groups that follow are by segment, block and more and need no further shuffle, and a segment of any length is spread over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lu
from .rules import TAG_CLOSE, TAG_OPEN, Rules, op_text

#: Rule words and operations of so many rows are broadcast; larger sets are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Positions of a segment that are dealt together.
BLOCK = 4096
LUS = "segment_id long, pos int, blank string, sl string, tls array<string>"


def parse_segments(segments: DataFrame) -> DataFrame:
    """segments (segment_id, text) -> LUS."""
    parsed = segments.select("segment_id", F.explode(lu.parse_units(F.col("text"))).alias("u"))
    return parsed.select("segment_id", "u.pos", "u.blank", "u.sl", "u.tls")


def render_segments(segments: DataFrame, lus: DataFrame) -> DataFrame:
    """segment_id, text: LUs in order, and the trailing text."""
    unit = lu.render_unit(F.col("blank"), F.col("sl"), F.col("tls"))
    parts = lus.filter("sl <> ''").groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("pos", unit.alias("s")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x["s"]), "")
    last = segments.select("segment_id", lu.trailing(F.col("text")).alias("_last"))
    return last.join(parts, "segment_id", "left").select("segment_id", F.concat(F.coalesce(joined, F.lit("")), "_last").alias("text"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def blocks(lus: DataFrame, rules: Rules) -> DataFrame:
    """``lus`` with ``_block``, dealt: a row is in its own block and, near a block's edge, in the next one."""
    near = max(rules.longest - 1, 0)
    first, last = (F.floor(F.greatest(F.col("pos") + d, F.lit(0)) / BLOCK).cast("int") for d in (-near, near))
    return lus.withColumn("_block", F.explode(F.sequence(first, last))).repartition("segment_id", "_block")


def unit_keys(mt: Column, kinds: set[tuple[str, int]]) -> Column:
    """Index keys of a match text, of those kinds (letter, length) that the patterns have."""
    lemma, tag = F.replace(F.lower(lu.match_lemma(mt)), F.lit("ς"), F.lit("σ")), F.regexp_extract(mt, f"{TAG_OPEN}([^{TAG_CLOSE}]*)", 1)
    n = F.length(lemma)
    out = []
    for kind, size in sorted(kinds):
        if kind == "l":
            out.append(F.array(F.concat(F.lit("l"), lemma)))
        elif kind == "s":
            out.append(F.when(n >= size, F.array(F.concat(F.lit("s"), F.substring(lemma, -size, size)))))
        elif kind == "c":
            out.append(F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.concat(F.lit("c"), F.substr(lemma, i, F.lit(size)))))))  # noqa: B023
        elif kind == "t":
            out.append(F.array(F.concat(F.lit("t"), tag)))
        else:
            out.append(F.array(F.lit("*")))
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(x, none) for x in out])


def word_matches(lus: DataFrame, rules: Rules) -> DataFrame:
    """segment_id, _block, pos and the arcs of every word that an LU matches."""
    frames = rules.frames(lus.sparkSession)
    kinds = {(p[1][0], len(p[1]) - 1 if p[1][0] in "sc" else 0) for p in rules.patterns}
    seen = lus.select("segment_id", "_block", "pos", lu.match_text(F.col("sl")).alias("mt"))
    keyed = seen.select("segment_id", "_block", "pos", "mt", F.explode(unit_keys(F.col("mt"), kinds)).alias("key"))
    hit = keyed.join(_small(frames["patterns"], len(rules.patterns)), "key").filter(F.regexp_like("mt", "sl_regex")).select("segment_id", "_block", "pos", "word_id")
    # a word of several patterns may match more than once
    several = len({p[0] for p in rules.patterns}) < len(rules.patterns)
    return (hit.distinct() if several else hit).join(_small(frames["arcs"], len(rules.arcs)), "word_id").drop("word_id")


def followed(arcs: Column) -> Column:
    """Arcs (off, source, target, ends, op_text) of one start, sorted -> ways through the graph that end: array of (len, op_vector).

    Of several ways to one junction with as many words the first by operations stays."""
    way = "array<struct<off:int,at:int,ops:array<string>,ends:boolean>>"
    least = lambda xs: F.array_min(xs)

    def step(ways: Column, a: Column) -> Column:
        before = F.filter(ways, lambda w: (w["off"] == a["off"]) & (w["at"] == a["source"]))
        heads = F.when(a["off"] == 0, F.array(F.array().cast("array<string>"))).otherwise(F.transform(before, lambda w: w["ops"]))
        there = F.filter(ways, lambda w: (w["off"] == a["off"] + 1) & (w["at"] == a["target"]))
        new = F.transform(heads, lambda h: F.struct((a["off"] + 1).alias("off"), a["target"].alias("at"), F.array_append(h, a["op_text"]).alias("ops"), a["ends"].alias("ends")))
        rest = F.filter(ways, lambda w: ~((w["off"] == a["off"] + 1) & (w["at"] == a["target"])))
        return F.when(F.size(heads) == 0, ways).otherwise(F.concat(rest, F.array(least(F.concat(there, new)))))

    found = F.aggregate(arcs, F.array().cast(way), step)
    return F.transform(F.filter(found, lambda w: w["ends"]), lambda w: F.struct(w["off"].alias("len"), w["ops"].alias("op_vector")))


def rule_matches(lus: DataFrame, rules: Rules) -> DataFrame:
    """segment_id, start, end, rule_id, op_vector, of LUs with their blocks or without. A rule counts once at an end: of several ways the first by
    operations, then by length."""
    own = lus if "_block" in lus.columns else blocks(lus, rules)
    met = word_matches(own, rules).withColumn("start", F.col("pos") - F.col("off")).filter(~F.col("anchored") | (F.col("start") == 0))
    keys = ["segment_id", "_block", "start", "graph", "rule_id"]
    sizes: dict[int, int] = {}
    vectors: dict[int, list[str]] = {}
    for graph, _, _, plain, *_, text in rules.arcs:
        if plain:
            sizes[graph] = sizes.get(graph, 0) + 1
            vectors.setdefault(graph, []).append(text)
    parts = []
    if sizes:
        rows = lus.sparkSession.createDataFrame([(g, sizes[g], vectors[g]) for g in sizes], "graph int, len int, op_vector array<string>")
        counted = met.filter("plain").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(_small(rows, len(sizes)), "graph")
        parts.append(counted.filter("n = len").select(*keys[:3], "rule_id", "len", "op_vector"))
    if any(not a[3] for a in rules.arcs):
        arc = F.struct("off", "source", "target", "ends", "op_text")
        gathered = met.filter("not plain").groupBy(*keys).agg(F.array_sort(F.collect_list(arc)).alias("arcs"))
        ways = gathered.filter(F.col("arcs")[0]["off"] == 0).select(*keys[:3], "rule_id", F.explode(followed(F.col("arcs"))).alias("w"))
        parts.append(ways.select(*keys[:3], "rule_id", "w.len", "w.op_vector"))
    whole = reduce(DataFrame.union, parts).withColumn("end", F.col("start") + F.col("len") - 1)
    # ends of the block's own positions and of those that its decisions reach to; none is counted twice over blocks
    first = F.min(F.struct("op_vector", "len", "start")).alias("x")
    out = whole.groupBy("segment_id", "_block", "end", "rule_id").agg(first).select("segment_id", "_block", F.col("x.start").alias("start"), "end", "rule_id", "x.op_vector")
    return out if "_block" in lus.columns else out.filter(F.floor(F.col("end") / BLOCK) == F.col("_block")).drop("_block")


def _scores(own: DataFrame, rules: Rules) -> DataFrame:
    """segment_id, _block, pos, op_key, score, of the block's own positions."""
    frames = rules.frames(own.sparkSession)
    hit = rule_matches(own, rules).select("segment_id", "_block", "rule_id", "start", F.posexplode("op_vector").alias("off", "op_text")).filter("op_text <> ''")
    hit = hit.withColumn("pos", F.col("start") + F.col("off")).filter(F.floor(F.col("pos") / BLOCK) == F.col("_block"))
    keyed = hit.join(_small(frames["op_texts"], len(rules.op_texts)), "op_text").join(_small(frames["rules"].select("rule_id", "weight"), len(rules.rules)), "rule_id")
    return keyed.groupBy("segment_id", "_block", "pos", "op_key").agg(F.sum("weight").alias("score"))


def rule_scores(lus: DataFrame, rules: Rules) -> DataFrame:
    """segment_id, pos, op_key, score: weights summed over all matches."""
    return _scores(blocks(lus, rules), rules).drop("_block")


def keep_fold(matches: Column, n: Column) -> Column:
    """Matches (neg_weight, tl, op_key, op_type), sorted -> translations kept, as 0-based places, and the trace.

    The first select of a translation that was not removed keeps exactly it and ends; anything else drops
    its translation, unless it is the last one."""
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("keep"), F.array().cast("array<int>").alias("gone"), F.lit(False).alias("done"), F.array().cast("array<struct<op:string,weight:double,n_keep:int,tl:int>>").alias("trace"))

    def step(s: Column, m: Column) -> Column:
        select = (m["op_type"] == "select") & ~F.array_contains(s["gone"], m["tl"])
        drop = F.size(s["keep"]) > 1
        keep = F.when(select, F.array(m["tl"])).when(drop, F.array_remove(s["keep"], m["tl"])).otherwise(s["keep"])
        gone = F.when(~select & drop, F.array_append(s["gone"], m["tl"])).otherwise(s["gone"])
        line = F.array(F.struct(m["op_type"].alias("op"), (-m["neg_weight"]).alias("weight"), F.size(keep).alias("n_keep"), m["tl"].alias("tl")))
        new = F.struct(keep.alias("keep"), gone.alias("gone"), select.alias("done"), F.concat(s["trace"], line).alias("trace"))
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(matches, start, step)


def _decided(lus: DataFrame, rules: Rules) -> DataFrame:
    """``lus`` with _fold, null at positions without an operation that recognises one of their translations."""
    ops = rules.frames(lus.sparkSession)["ops"]
    dealt = blocks(lus, rules)
    scores = _scores(dealt, rules).join(_small(ops, len(rules.ops)), "op_key")
    row, op = F.struct(*[F.col(c) for c in lus.columns]), F.struct((-F.col("score")).alias("neg_weight"), "op_key", "op_type", "tl_regex")
    rows = dealt.filter(F.floor(F.col("pos") / BLOCK) == F.col("_block")).select("segment_id", "_block", "pos", row.alias("_row"))
    both = rows.unionByName(scores.select("segment_id", "_block", "pos", op.alias("_op")), allowMissingColumns=True)
    met = both.groupBy("segment_id", "_block", "pos").agg(F.collect_list("_row").alias("_rows"), F.collect_list("_op").alias("_ops")).select(F.explode("_rows").alias("_row"), "_ops")
    mts = F.transform("_row.tls", lu.match_text)
    places = F.when(F.size("_row.tls") > 1, F.sequence(F.lit(0), F.size("_row.tls") - 1)).otherwise(F.array().cast("array<int>"))
    hit = lambda o: F.filter(places, lambda i: F.regexp_like(F.element_at(mts, i + 1), o["tl_regex"]))
    each = lambda o: F.transform(hit(o), lambda i: F.struct(o["neg_weight"].alias("neg_weight"), i.alias("tl"), o["op_key"].alias("op_key"), o["op_type"].alias("op_type")))
    m = F.when(F.size("_ops") > 0, F.array_sort(F.flatten(F.transform("_ops", each))))
    fold = F.when(F.size("_m") > 0, keep_fold(F.col("_m"), F.size("_row.tls")))
    return met.withColumn("_m", m).select("_row.*", fold.alias("_fold"))


def apply_rules(lus: DataFrame, rules: Rules) -> DataFrame:
    """``lus`` with the translations that the rules leave; ties of weight go to the earlier translation,
    then to the operation's text."""
    if not rules.ops:
        return lus
    chosen = F.filter("tls", lambda t, i: F.array_contains("_fold.keep", i))
    return _decided(lus, rules).select(*[F.when(F.col("_fold").isNull(), F.col("tls")).otherwise(chosen).alias(c) if c == "tls" else F.col(c) for c in lus.columns])


def trace_rules(lus: DataFrame, rules: Rules) -> DataFrame:
    """segment_id, pos, step, op, weight, sl, n_keep, tl: each step of each decision."""
    steps = _decided(lus, rules).select("segment_id", "pos", "sl", "tls", F.posexplode("_fold.trace").alias("step", "t"))
    return steps.select("segment_id", "pos", "step", "t.op", "t.weight", "sl", "t.n_keep", F.element_at("tls", F.col("t.tl") + 1).alias("tl"))


def apply_to_text(segments: DataFrame, rules: Rules) -> DataFrame:
    """segments (segment_id, text) in and out."""
    return render_segments(segments, apply_rules(parse_segments(segments), rules))


def apply_to_units(units: Column, rules: Rules, at_start: Column | None = None) -> Column:
    """Rules on one array of LUs, as one expression: for streams of segments, with rule sets of modest size (RuleError beyond).

    Same decisions as ``apply_rules``; no join, so nothing is kept between records. ``at_start``: whether the array begins its segment."""
    begins = F.lit(True) if at_start is None else at_start
    weights = {r[0]: r[1] for r in rules.rules}
    paths = rules.paths()
    # a way without operations may be the one that counts for its rule
    acting = {r for r, words, _ in paths if any(w.ops for w in words)}
    paths = [p for p in paths if p[0] in acting]
    if not paths:
        return units
    # each pattern is tested once on a unit
    numbers: dict[tuple, int] = {}
    for _, words, _ in paths:
        for w in words:
            numbers.setdefault(tuple(sorted({x for _, x in w.patterns})), len(numbers))
    tests = lambda mt: F.array(*[F.coalesce(mt.rlike("|".join(f"(?:{x})" for x in own)), F.lit(False)) for own in numbers])
    struct = F.struct(F.transform(units, lambda u: F.element_at(F.transform(F.array(lu.match_text(u["sl"])), tests), 1)).alias("h"), units.alias("u"), begins.alias("b"))

    def decided(x: Column) -> Column:
        hit = lambda i, words: reduce(lambda a, b: a & b, [F.try_element_at(x["h"], i + k + 1)[numbers[tuple(sorted({p for _, p in w.patterns}))]] for k, w in enumerate(words)])
        matches = []
        for rule_id, words, anchored in paths:
            n, vector = len(words), F.array(*[F.lit(op_text(w)) for w in words])
            last = F.size(x["h"]) - n if not anchored else F.when(x["b"], F.least(F.size(x["h"]) - n, F.lit(0))).otherwise(-1)
            places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            found = F.filter(places, lambda i: F.coalesce(hit(i, words), F.lit(False)))  # noqa: B023
            matches.append(F.transform(found, lambda i: F.struct((i + (n - 1)).alias("end"), F.lit(rule_id).alias("rule_id"), vector.alias("op_vector"), F.lit(n).alias("len"), i.alias("start"))))  # noqa: B023
        # a rule counts once at an end
        ordered = F.array_sort(F.concat(*matches))
        once = F.filter(ordered, lambda m, i: (i == 0) | ~F.coalesce((F.try_element_at(ordered, F.when(i > 0, i))["end"] == m["end"]) & (F.try_element_at(ordered, F.when(i > 0, i))["rule_id"] == m["rule_id"]), F.lit(False)))
        return F.element_at(F.transform(F.array(F.struct(once.alias("m"), x["u"].alias("u"))), chosen), 1)

    weight_of = F.create_map(*[F.lit(x) for r, w in weights.items() for x in (r, w)])

    def chosen(x: Column) -> Column:
        def unit(u: Column, pos: Column) -> Column:
            here = F.filter(x["m"], lambda m: (m["start"] <= pos) & (m["end"] >= pos))
            texts = F.transform(here, lambda m: F.struct(m["op_vector"][pos - m["start"]].alias("t"), weight_of[m["rule_id"]].alias("w")))
            found = []
            for key, (_, kind, regex) in rules.ops.items():
                of = [t for t, keys in rules.op_texts.items() if key in keys]
                mine = F.filter(texts, lambda t: t["t"].isin(*of))  # noqa: B023
                score = F.aggregate(mine, F.lit(0.0), lambda a, t: a + t["w"])
                places = F.filter(F.transform(u["tls"], lambda t, i: F.when(lu.match_text(t).rlike(regex), i)), lambda i: i.isNotNull())  # noqa: B023
                found.append(F.transform(F.when(F.size(mine) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.struct((-score).alias("neg_weight"), i.alias("tl"), F.lit(key).alias("op_key"), F.lit(kind).alias("op_type"))))  # noqa: B023
            kept = keep_fold(F.array_sort(F.concat(*found)), F.size(u["tls"]))["keep"]
            tls = F.when((F.size(u["tls"]) > 1) & (F.size(here) > 0), F.filter(u["tls"], lambda t, i: F.array_contains(kept, i))).otherwise(u["tls"])
            return F.struct(u["pos"].alias("pos"), u["blank"].alias("blank"), u["sl"].alias("sl"), tls.alias("tls"))

        return F.transform(x["u"], unit)

    return F.element_at(F.transform(F.array(struct), decided), 1)
