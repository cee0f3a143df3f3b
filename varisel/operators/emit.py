"""Patterns, lexicons and dictionaries as rule files, and rules as constraint-grammar text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lu
from ..sources import readers

# Fixed values of the tag set: open word classes, marks that no pattern may hold, classes that a translation shares with its word.
PUNCTUATION = ("<guio>", "<sent>", "<cm>")
OPEN_KINDS = ("n", "vblex", "adj")
SHARED_KINDS = ("adj", "vbmod")
#: Signs of pattern rows that stand for a word's default.
DEFAULT_SIGNS = ("-", "~")


def word_xml(word: Column, inner: Column | None = None) -> Column:
    """A match element for a word, around a select or empty."""
    lemma, path = lu.rule_escape(F.lower(lu.lemma(word))), lu.tag_path(lu.tags(word))
    head = F.concat(F.lit("<match"), F.when(lemma != "", F.concat(F.lit(' lemma="'), lemma, F.lit('"'))).otherwise(""), F.lit(' tags="'), path, F.lit('"'))
    return F.concat(head, F.lit("/>")) if inner is None else F.concat(head, F.lit(">"), inner, F.lit("</match>"))


def select_xml(tl: Column) -> Column:
    return F.concat(F.lit('<select lemma="'), lu.rule_escape(lu.lemma(tl)), F.lit('" tags="'), lu.tag_path(lu.tags(tl)), F.lit('"/>'))


def pattern_words(ngram: Column) -> Column:
    return F.filter(F.split(ngram, " (?=[^ ]*<|[*])"), lambda w: w != "")


def admissible(patterns: DataFrame, threshold: float = 3.0, learned: bool = False, least_words: int = 2, kinds: tuple[str, ...] = OPEN_KINDS) -> DataFrame:
    """patterns (sl, ngram, tl, weight, optionally crisp and sign) with the first reason why one gives no rule.

    Counted patterns need a strength, the crispiness where there is one, above ``threshold``, and no unknown word. ``learned``
    ones (weights of maximum entropy) need ``least_words`` words unless they have none, and may not stand for a default. A word stands in a
    pattern if one of the pattern's words contains it, as a word with fewer tags does."""
    words, tags = pattern_words(F.col("ngram")), lu.tags(F.col("tl"))
    marks = reduce(lambda a, b: a | b, [F.col("ngram").contains(p) for p in PUNCTUATION])
    here = F.exists(words, lambda w: F.contains(F.lower(w) if learned else w, F.col("sl")))
    # text of tags and words, as a class may be part of a longer name
    differs = reduce(lambda a, b: a | b, [lu.tag_path(tags).contains(k) & ~F.col("sl").contains(k) for k in SHARED_KINDS])
    closed = ~F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit("")).isin(*kinds)
    reason = F.when(marks, "punctuation")
    if learned:
        if "sign" in patterns.columns:
            reason = reason.when(F.col("sign").isin(*DEFAULT_SIGNS), "default")
        reason = reason.when(F.size(words).between(1, least_words - 1), "too short").when((F.size(words) > 0) & ~here, "word not in pattern")
    else:
        reason = reason.when(~here, "word not in pattern")
    reason = reason.when(differs, "class differs").when(closed, "part of speech")
    if not learned:
        strength = F.col("crisp") if "crisp" in patterns.columns else F.col("weight")
        reason = reason.when(strength <= threshold, "weight").when(F.exists(words, lambda w: w.startswith("*")), "unknown word")
    return patterns.withColumn("reason", reason)


def judged_rules(patterns: DataFrame, **options) -> DataFrame:
    """sl, ngram, tl, reason, rule: a rule element for each admissible pattern, of the pattern's strength; an empty pattern is its word alone."""
    strength = F.col("crisp") if "crisp" in patterns.columns else F.col("weight")
    words = pattern_words(F.when(F.col("ngram") == "", F.col("sl")).otherwise(F.col("ngram")))
    body = F.array_join(F.transform(words, lambda w: F.when(F.contains(F.lower(w), F.col("sl")), word_xml(w, select_xml(F.col("tl")))).otherwise(word_xml(w))), "")
    rule = F.concat(F.format_string('<rule weight="%.10f">', strength.cast("double")), body, F.lit("</rule>"))
    return admissible(patterns, **options).select("sl", "ngram", "tl", "reason", F.when(F.col("reason").isNull(), rule).alias("rule"))


def pattern_rules(patterns: DataFrame, **options) -> DataFrame:
    """sl, ngram, tl, rule of the admissible patterns."""
    return judged_rules(patterns, **options).filter("reason is null").drop("reason")


def default_rules(lexicon: DataFrame, weight: float = 0.8) -> DataFrame:
    """One rule for each default of the lexicon; rules of closed word classes are comments."""
    first = lexicon.filter("is_default")
    rule = F.concat(F.lit(f'<rule weight="{weight}">'), word_xml(F.col("sl"), F.concat(F.lit('<select lemma="'), lu.rule_escape(lu.lemma(F.col("tl"))), F.lit('"/>'))), F.lit("</rule>"))
    return first.select("sl", "tl", F.when(lu.first_tag(F.col("sl")).isin(*OPEN_KINDS), rule).otherwise(F.concat(F.lit("<!-- "), rule, F.lit(" -->"))).alias("rule"))


def bidix_entries(lines: DataFrame) -> DataFrame:
    """Dictionary lines (line_no, value) -> line_no, l, r, restriction, rank (c), slr."""
    attr = lambda name: F.regexp_extract("value", f'<e[^>]*\\b{name}="([^"]*)"', 1)
    got = lines.withColumns({"l": F.regexp_extract("value", r"<l>(.*?)</l>", 1), "r": F.regexp_extract("value", r"<r>(.*?)</r>", 1)})
    got = got.filter(F.col("value").contains("<l>"))
    return got.select("line_no", "l", "r", attr("r").alias("restriction"), F.regexp_extract(attr("c"), r"(\d+)\s*$", 1).alias("rank"), attr("slr").alias("slr"))


def ranked_defaults(lines: DataFrame) -> DataFrame:
    """lines (line_no, s, t, rank, slr) -> s, t: an entry of rank 0 is the default of the lines behind it, up to the next one; a
    line of slr 1 with the same source names it."""
    # the default's line: the last one of rank 0 up to here, in two steps as in a running count
    runs = readers.blocks(lines, F.col("rank") == "0")
    first = runs.filter("rank = '0'").select(F.col("block").alias("_block"), F.col("s").alias("_s"), F.col("t").alias("_t"))
    met = runs.filter("slr = '1'").join(first, (F.col("block") == F.col("_block")) & (F.col("s") == F.col("_s")))
    return met.select("s", F.col("_t").alias("t")).distinct()


def bidix_default_rules(entries: DataFrame, direction: str = "lr", slr: bool = False) -> DataFrame:
    """Default rules from dictionary entries: source, target, rule. Without ``slr``: words of several entries of which exactly
    one holds in this direction, being unrestricted or restricted to it. With ``slr``: those of ``ranked_defaults``."""
    a, b = ("l", "r") if direction == "lr" else ("r", "l")
    one = entries.select("line_no", F.col(a).alias("s"), F.col(b).alias("t"), "restriction", "rank", "slr")
    if slr:
        best = ranked_defaults(one)
    else:
        holds = F.col("restriction").isin("", direction.upper())
        best = one.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if(holds).alias("own"), F.min(F.when(holds, F.col("t"))).alias("t"))
        best = best.filter("n > 1 and own = 1").select("s", "t")
    part = lambda c, e: F.concat(F.lit(f'<{e} lemma="'), lu.rule_escape(lu.clean_side(F.col(c))), F.lit('" tags="'), lu.side_path(F.col(c)), F.lit('"'))
    rule = F.concat(F.lit("<rule>"), part("s", "match"), F.lit(">"), part("t", "select"), F.lit("/></match></rule>"))
    return best.select(F.col("s").alias("source"), F.col("t").alias("target"), rule.alias("rule"))


def bidix_default_entries(entries: DataFrame, direction: str = "lr") -> DataFrame:
    """A default dictionary: l, r of the ``ranked_defaults``."""
    a, b = ("l", "r") if direction == "lr" else ("r", "l")
    best = ranked_defaults(entries.select("line_no", F.col(a).alias("s"), F.col(b).alias("t"), "rank", "slr"))
    return best.select(F.col("s").alias(a), F.col("t").alias(b)).select("l", "r")


def expansion_rules(units: DataFrame) -> DataFrame:
    """A rule for each distinct word and translation."""
    each = units.filter(F.size("tls") > 1).select("sl", F.explode("tls").alias("tl")).distinct()
    return each.select("sl", "tl", F.concat(F.lit("<rule>"), word_xml(F.col("sl"), select_xml(F.col("tl"))), F.lit("</rule>")).alias("rule"))


def dictionary_entries(missing: DataFrame) -> DataFrame:
    """missing (sl, tl) as dictionary lines."""
    side = lambda c: F.concat(F.replace(lu.lemma(F.col(c)), F.lit(" "), F.lit("<b/>")), F.array_join(F.transform(lu.tags(F.col(c)), lambda t: F.concat(F.lit('<s n="'), t, F.lit('"/>'))), ""))
    return missing.select("sl", "tl", F.concat(F.lit("<e><p><l>"), side("sl"), F.lit("</l><r>"), side("tl"), F.lit("</r></p></e>")).alias("value"))


def rule_file(rules: DataFrame, path: str) -> None:
    """Write rule elements as text, one file for each task; ``<rules>`` is put around them where they are compiled."""
    rules.select("rule").write.text(path)


def constraint_grammar(xml: str) -> list[str]:
    """A rule file as constraint-grammar lines; rules with several operations are left out. Rule files are small."""
    out = []
    for rule in ET.fromstring(xml).iter("rule"):
        words = list(rule.iter("match"))
        ops = [(i, o) for i, w in enumerate(words) for o in w if o.tag in ("select", "remove")]
        if len(ops) != 1:
            continue
        at, op = ops[0]
        show = lambda n: "(" + " ".join([*(['"%s"' % n.get("lemma")] if n.get("lemma") else []), *[t for t in n.get("tags", "").split(".") if t not in ("", "*")]]) + ")"
        around = [f"({i - at} {show(w)})" for i, w in enumerate(words) if i != at]
        out.append(" ".join([op.tag.upper(), show(op), "IF", f"(0 {show(words[at])})", *around]) + " ;")
    return out
