"""The older rule table, and choice by target frequency.

A rule is a line: s or r (select, remove), the centre word, the target, and contexts (offset "lemma" tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lu

WORD = r'\("([^"]*)"\s*([^)]*)\)'
CONTEXT = r'\((-?\d+)\s+"([^"]*)"\s*([^)]*)\)'


def parse_rules(lines: DataFrame) -> DataFrame:
    """lines (rule_id, value) -> rule_id, op, centre, target: struct<lemma, tags>, contexts."""
    word = lambda c: F.struct(F.regexp_extract(c, WORD, 1).alias("lemma"), F.regexp_extract(c, WORD, 2).alias("tags"))
    part = F.split("value", "\t")
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    rest = at(4)
    offsets, lemmas, tags = (F.regexp_extract_all(rest, F.lit(CONTEXT), F.lit(k)) for k in (1, 2, 3))
    contexts = F.transform(F.arrays_zip(offsets.alias("o"), lemmas.alias("l"), tags.alias("t")), lambda x: F.struct(x["o"].cast("int").alias("off"), x["l"].alias("lemma"), x["t"].alias("tags")))
    return lines.select("rule_id", F.when(at(1) == "r", "remove").otherwise("select").alias("op"), word(at(2)).alias("centre"), word(at(3)).alias("target"), contexts.alias("contexts"))


def apply(units: DataFrame, rules: DataFrame) -> DataFrame:
    """units (sent_id, pos, sl, tls) after rules: at each centre the rule with most contexts (then the first)
    of those whose contexts all match, selects or removes the translations that begin with the target's lemma and tags;
    nothing is emptied."""
    closed = lambda tags: F.when(tags == "", "").otherwise(F.concat(F.lit("<"), F.replace(tags, F.lit(" "), F.lit("><")), F.lit(">")))
    of_tags = lambda token: F.regexp_extract(token, r"^[^\\<]*(?:\\.[^\\<]*)*(<.*)?$", 1)
    fits = lambda lemma, tags, sl: ((lemma == "") | (F.lower(lu.lemma(sl)) == F.lower(lemma))) & of_tags(sl).startswith(closed(tags))
    flat = rules.withColumn("need", F.size("contexts"))
    centres = units.join(flat, F.lower(lu.lemma(F.col("sl"))) == F.lower(F.col("centre.lemma"))).filter(fits(F.col("centre.lemma"), F.col("centre.tags"), F.col("sl")))
    wanted = centres.select("sent_id", "pos", "rule_id", F.explode("contexts").alias("c")).withColumn("at", F.col("pos") + F.col("c.off"))
    around = units.select(F.col("sent_id").alias("n_sent"), F.col("pos").alias("n_pos"), F.col("sl").alias("n_sl"))
    met = wanted.join(around, (F.col("sent_id") == F.col("n_sent")) & (F.col("at") == F.col("n_pos"))).filter(fits(F.col("c.lemma"), F.col("c.tags"), F.col("n_sl")))
    count = met.groupBy("sent_id", "pos", "rule_id").agg(F.count(F.lit(1)).alias("met"))
    full = centres.join(count, ["sent_id", "pos", "rule_id"], "left").filter(F.coalesce("met", F.lit(0)) == F.col("need"))
    best = full.groupBy("sent_id", "pos").agg(F.min_by(F.struct("op", "target"), F.struct((-F.col("need")).alias("n"), "rule_id")).alias("x"))
    out = units.join(best, ["sent_id", "pos"], "left")
    hit = lambda t: t.startswith(F.concat(F.col("x.target.lemma"), closed(F.col("x.target.tags"))))
    kept = F.filter("tls", lambda t: F.when(F.col("x.op") == "select", hit(t)).otherwise(~hit(t)))
    return out.withColumn("tls", F.when(F.col("x").isNull() | (F.size(kept) == 0), F.col("tls")).otherwise(kept)).drop("x")


def frequency_choice(units: DataFrame, freq: DataFrame, mark: bool = False) -> DataFrame:
    """units (sent_id, pos, sl, tls), freq (tl, freq): the most frequent translation, else the one whose lemma is
    most frequent, else all. ``mark`` keeps all and puts = before the chosen and § before the others."""
    each = units.filter(F.size("tls") > 1).select("sent_id", "pos", F.posexplode("tls").alias("i", "tl"))
    by_lemma = freq.groupBy(lu.lemma(F.col("tl")).alias("lemma")).agg(F.sum("freq").alias("lemma_freq"))
    met = each.join(freq, "tl", "left").withColumn("lemma", lu.lemma(F.col("tl"))).join(by_lemma, "lemma", "left")
    rank = F.struct(F.coalesce("freq", F.lit(0)).alias("a"), F.coalesce("lemma_freq", F.lit(0)).alias("b"), (-F.col("i")).alias("c"))
    best = met.groupBy("sent_id", "pos").agg(F.max_by("tl", rank).alias("best"), F.max(F.coalesce("lemma_freq", F.lit(0))).alias("any"))
    out = units.join(best.filter("any > 0"), ["sent_id", "pos"], "left")
    marked = F.transform("tls", lambda t: F.concat(F.when(t == F.col("best"), "=").otherwise("§"), t))
    return out.withColumn("tls", F.when(F.col("best").isNull(), F.col("tls")).otherwise(marked if mark else F.array("best"))).drop("best", "any")


def longest_first(rules: DataFrame) -> DataFrame:
    w = Window.partitionBy("centre").orderBy(F.desc(F.size("contexts")), "rule_id")
    return rules.withColumn("priority", F.row_number().over(w))
