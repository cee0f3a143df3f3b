"""Preference pairs as prompt and masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (role and text equal)
is rendered once as the prompt; the turns behind it are the two completions. The mask of a completion is
a list of spans, in characters, that count in training: what the assistant says, with its end mark. Turns of
other roles in a completion are rendered but not counted.

A turn is rendered as <|role|>, a line break, the text, <|end|> and a line break. <| in a text or role is written
"< |", so that no text reads as a mark.

``preference_pairs`` makes pairs of conversations: one that begins with the same turn as an earlier one (by conv_id) is chosen
against the earliest of these; of others the last assistant's turn is set against a stale reply. Groups of conversations
that begin alike may be as large as the table: the earliest is a grouped minimum, and groups of at least a SHARE of
all conversations, at most SHARE of them, meet it by broadcast.

DataFrame functions only; one grouping by conversation, which is gathered as a list, and a pair is one row.

Defined cases: rows without conv_id take no part; a null role or text is the empty string; turns are ordered
by turn (null first), then role and text, so repeated rows are turns of their own; if one conversation is a
prefix of the other, its completion is empty, and if both are equal both are; ``preference_pairs`` leaves out pairs of
equal conversations, and a conversation that begins like no earlier one and has no assistant's turn; an empty table
gives no rows; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

HEAD, MIDDLE, END, GAP = "<|", "|>\n", "<|end|>", "\n"
#: A group with one in so many conversations or more is hot.
SHARE = 256
TURNS = "array<struct<role:string,text:string>>"


def plain(c: Column) -> Column:
    return F.replace(c, F.lit(HEAD), F.lit("< |"))


def render_turn(t: Column) -> Column:
    return F.concat(F.lit(HEAD), plain(t["role"]), F.lit(MIDDLE), plain(t["text"]), F.lit(END + GAP))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def spans(turns: Column, role: str = "assistant") -> Column:
    """Spans of ``role``'s text and end mark within the rendered turns."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(plain(t["role"])) + len(HEAD + MIDDLE)
        stop = start + F.length(plain(t["text"])) + len(END)
        here = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct((stop + len(GAP)).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row for each conversation."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: TURNS, other columns) -> other columns, pair_id, n_common, prompt and, for either
    side, completion and spans."""
    others = [c for c in pairs.columns if c not in ("pair_id", "chosen", "rejected", "n_common", "prompt", "chosen_spans", "rejected_spans", "shared")]
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    unequal = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at("chosen", i) != F.element_at("rejected", i))
    common = F.when(shorter == 0, 0).otherwise(F.when(F.size(unequal) > 0, F.element_at(F.concat(unequal, F.array(F.lit(0))), 1) - 1).otherwise(shorter))
    cut = pairs.withColumn("n_common", common.cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    cut = cut.select(*others, "pair_id", "n_common", F.slice("chosen", 1, F.col("n_common")).alias("shared"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(
        *others, "pair_id", "n_common", render(F.col("shared")).alias("prompt"),
        render(F.col("chosen")).alias("chosen"), spans(F.col("chosen")).alias("chosen_spans"),
        render(F.col("rejected")).alias("rejected"), spans(F.col("rejected")).alias("rejected_spans"),
    )


def with_stale_replies(convs: DataFrame) -> DataFrame:
    """Pairs from single conversations: in rejected the last assistant's turn repeats the assistant's reply before it,
    or else the turn before it, or else is empty."""
    said = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    at = convs.withColumn("said", said).filter(F.size("said") > 0).withColumn("last", F.try_element_at("said", F.lit(-1)))
    earlier = F.try_element_at("turns", F.try_element_at("said", F.when(F.size("said") > 1, -2).otherwise(-1)))["text"]
    before = F.try_element_at("turns", F.greatest(F.col("last") - 1, F.lit(1)))["text"]
    stale = F.when(F.size("said") > 1, earlier).when(F.col("last") > 1, before).otherwise("")
    reply = F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text")))
    rejected = F.concat(F.slice("turns", 1, F.col("last") - 1), reply, F.slice("turns", F.col("last") + 1, F.size("turns")))
    return at.select(F.col("conv_id").alias("pair_id"), F.col("turns").cast(TURNS).alias("chosen"), rejected.cast(TURNS).alias("rejected"))


def preference_pairs(convs: DataFrame) -> DataFrame:
    """convs (conv_id, turns), as a table that can be read twice -> pair_id, rejected_id, chosen, rejected."""
    keyed = convs.withColumn("opening", F.xxhash64(F.element_at("turns", 1)))
    groups = keyed.groupBy("opening").agg(F.min("conv_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = groups.join(keyed.select("conv_id", F.col("turns").alias("first_turns")), F.col("first_id") == F.col("conv_id"))
    firsts = written(firsts.select(F.col("opening").alias("of"), "first_id", "first_turns", "n"), "firsts")
    hot = F.col("n") * SHARE >= convs.count()
    many = F.broadcast(firsts.filter(hot).drop("n"))
    rest = keyed.join(many, F.col("opening") == F.col("of"), "left_anti").join(firsts.filter(~hot).drop("n"), F.col("opening") == F.col("of"), "left")
    met = keyed.join(many, F.col("opening") == F.col("of")).unionByName(rest)
    # equal hashes of unlike turns are no pair
    alike = F.coalesce((F.element_at("turns", 1) == F.element_at("first_turns", 1)) & (F.col("conv_id") > F.col("first_id")), F.lit(False))
    two = met.filter(alike).select(F.col("conv_id").alias("pair_id"), F.col("first_id").alias("rejected_id"), F.col("turns").cast(TURNS).alias("chosen"), F.col("first_turns").cast(TURNS).alias("rejected"))
    one = with_stale_replies(met.filter(~alike).select("conv_id", "turns")).withColumn("rejected_id", F.lit(None).cast("long"))
    return two.unionByName(one).filter("chosen <> rejected")
