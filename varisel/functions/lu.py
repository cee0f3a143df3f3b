"""Column expressions over annotated, ambiguous tokens.

A lexical unit (LU) is ``^source/target1/target2…$``; source and targets are a lemma with tags, ``lemma<t1><t2>``.
``\\`` escapes a character, an LU whose source begins with ``*`` is unknown to the dictionary. Text between
LUs is blank text, kept with the LU behind it; what follows the last LU is the segment's trailing text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: blank text, then an LU's body; unrolled, so long texts do not nest
UNIT = r"(?s)([^\\^]*(?:\\.[^\\^]*)*)\^([^\\<$]*(?:(?:\\.|<[^>]*>)[^\\<$]*)*)\$"
#: tags within match text stand between these, so an escaped < is never read as a tag
TAG_OPEN, TAG_CLOSE = "\x02", "\x03"

LU_TYPE = "array<struct<pos:int,blank:string,sl:string,tls:array<string>>>"


def wrap(c: Column) -> Column:
    return F.concat(F.lit("^"), c, F.lit("$"))


def unwrap(c: Column) -> Column:
    return F.regexp_replace(c, r"^\^|\$$", "")


def alternatives(body: Column) -> Column:
    """An LU's parts, split at / that is neither escaped nor within a tag."""
    part = r"(?s)/([^\\/<]*+(?:(?:\\.|<[^>]*+>|[\\<])[^\\/<]*+)*+)"
    return F.regexp_extract_all(F.concat(F.lit("/"), body), F.lit(part), F.lit(1))


def parse_units(text: Column) -> Column:
    """Text -> array of LUs (LU_TYPE)."""
    blanks, bodies = F.regexp_extract_all(text, F.lit(UNIT), F.lit(1)), F.regexp_extract_all(text, F.lit(UNIT), F.lit(2))

    def unit(x: Column, i: Column) -> Column:
        parts = alternatives(x["b"])
        return F.struct(i.alias("pos"), x["a"].alias("blank"), F.element_at(parts, 1).alias("sl"), F.slice(parts, 2, F.size(parts)).alias("tls"))

    return F.transform(F.arrays_zip(blanks.alias("a"), bodies.alias("b")), unit)


def trailing(text: Column) -> Column:
    """What follows the last LU."""
    return F.regexp_replace(text, UNIT, "")


def render_unit(blank: Column, sl: Column, tls: Column) -> Column:
    """Blank text and LU; a / always stands behind the source."""
    return F.concat(blank, F.lit("^"), sl, F.lit("/"), F.array_join(tls, "/"), F.lit("$"))


def render_units(units: Column) -> Column:
    """Units without source, and their blank text, are left out."""
    return F.array_join(F.transform(F.filter(units, lambda u: u["sl"] != ""), lambda u: render_unit(u["blank"], u["sl"], u["tls"])), "")


def lemma(token: Column) -> Column:
    return F.regexp_extract(token, r"^([^\\<]*(?:\\.[^\\<]*)*)", 1)


def tags(token: Column) -> Column:
    return F.regexp_extract_all(token, F.lit(r"<([^>]*)>"), F.lit(1))


def first_tag(token: Column) -> Column:
    return F.regexp_extract(token, r"<([^>]*)>", 1)


def token(lemma_: Column, tags_: Column) -> Column:
    return F.concat(lemma_, F.array_join(F.transform(tags_, lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))


def unknown(token_: Column) -> Column:
    return token_.startswith("*")


def match_text(token_: Column) -> Column:
    """What patterns see: no escapes, no leading *, tags between TAG_OPEN and TAG_CLOSE."""
    tagged = F.regexp_replace(F.regexp_replace(token_, r"^\*", ""), r"(?<!\\)<([^>]*)>", f"{TAG_OPEN}$1{TAG_CLOSE}")
    return F.regexp_replace(tagged, r"(?s)\\(.)", "$1")


def match_lemma(text: Column) -> Column:
    return F.substring_index(text, TAG_OPEN, 1)


def tag_path(tags_: Column) -> Column:
    return F.array_join(tags_, ".")


def side_path(side: Column) -> Column:
    """Tags of a dictionary side, with a final wildcard."""
    return F.concat_ws(".", F.regexp_extract_all(side, F.lit(r'<s n="([^"]*)"/>'), F.lit(1)), F.array(F.lit("*")))


def clean_side(side: Column) -> Column:
    """Dictionary markup as text: <b/> is a space, <g> an invariable part."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(side, "<b/>", " "), "<g>", "#"), "<[^>]*>", "")


def strip_tags(pair: Column, side: int) -> Column:
    """One side of source/target: spaces as ~, lemma and first tag only."""
    part = F.element_at(F.split(pair, "/"), side + 1)
    return F.regexp_replace(F.translate(part, " ", "~"), r"^([^>]*>).*", "$1")


def tilde_words(text: Column) -> Column:
    """Words of a line for aligners: blanks in brackets dropped, spaces within units as ~."""
    return F.transform(parse_units(F.regexp_replace(text, r"\[[^\]]*\]", "")), lambda u: F.replace(u["sl"], F.lit(" "), F.lit("~")))


def rule_escape(c: Column) -> Column:
    """Text for rule attributes: - ( ) escaped, & as an entity, ~ as a space."""
    return F.replace(F.replace(F.regexp_replace(c, r"([-()])", r"\\$1"), F.lit("&"), F.lit("&amp;")), F.lit("~"), F.lit(" "))


def trimmed_word(c: Column) -> Column:
    """Without the white space and the mark of unknown words at either end."""
    return F.regexp_replace(c, r"^[\s*]+|[\s*]+$", "")


def safe_double(c: Column) -> Column:
    """A number, or 0 for text that is none and for NaN."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def truncated_percent(part: Column, whole: Column) -> Column:
    """One decimal, cut off."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 1000 / whole) / 10)


def fertility(units: Column) -> Column:
    """Number of paths through a sentence; null where it passes the range of a long."""
    return F.aggregate(units, F.lit(1).cast("long"), lambda a, u: F.try_multiply(a, F.greatest(F.size(u["tls"]), F.lit(1)).cast("long")))


def ambiguous(units: Column) -> Column:
    return F.exists(units, lambda u: F.size(u["tls"]) > 1)


def pos_ambiguous(units: Column, kinds: tuple[str, ...] = ("n", "vblex", "adj")) -> Column:
    return F.exists(units, lambda u: first_tag(u["sl"]).isin(*kinds) & (F.size(u["tls"]) > 1))


def coverage(units: Column) -> Column:
    """Per cent of units that the dictionary knows."""
    n = F.size(units)
    return F.when(n == 0, 100.0).otherwise(100.0 - F.size(F.filter(units, lambda u: unknown(u["sl"]))) * 100.0 / n)
