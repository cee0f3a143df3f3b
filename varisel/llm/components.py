"""Connected components of a link table, by alternating large-star and small-star steps.

Each step joins links to the smallest neighbour of one end, a grouped minimum, so a node with very many
links is pre-aggregated before the shuffle. Steps tend to stars, whose centre has as many links as its component has
nodes: nodes with at least a SHARE of all rows, so at most SHARE of them, are broadcast, and their rows are joined where
they lie. Steps end when a step changes nothing, after a number of rounds that grows with the logarithm of the
longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: A node with one in so many rows or more is hot.
SHARE = 256


def _star(links: DataFrame, large: bool) -> DataFrame:
    """The next table of links, in place of ``links``. large: larger neighbours go to the smallest of all; else smaller ones, and the node, to the smallest."""
    if large:
        sides = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(sides.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"), "k"), "least")
    hot = F.col("k") * SHARE >= 2 * links.count()
    many = F.broadcast(least.filter(hot).select("n", "m"))
    met = sides.join(many, F.col("a") == F.col("n"))
    rest = sides.join(many, F.col("a") == F.col("n"), "left_anti")
    met = met.union(rest.join(least.filter(~hot).select("n", "m"), F.col("a") == F.col("n")))
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    new = written(out.filter("a <> b").distinct(), "links")
    discard(links, least)
    return new


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of one ordered type -> (node, root): root is the smallest node reachable."""
    now = written(links.filter("a <> b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = _star(_star(now, True), False)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
