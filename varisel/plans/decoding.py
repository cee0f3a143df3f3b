"""Queries of lattice decoding over the driver's tables, and their SQL, which lists the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lattice, lexicon
from . import fixtures
from .queries import _LM_SQL, _bigrams
from .registry import query

#: All paths with their arcs: the weights of ``lm_rank``'s model, as whole billionths, and the places chosen.
_PATHS = _LM_SQL[: _LM_SQL.index("p AS (")] + """
p AS (
  SELECT sent_id, -1 AS pos, '<s>' AS prev, 0::BIGINT AS score, 0::DOUBLE AS raw, []::INT[] AS path FROM ok0
  UNION ALL
  SELECT p.sent_id, s.pos, x.t, p.score + round(coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)) * 1e9)::BIGINT, p.raw + coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)), list_append(p.path, x.j::INT)
  FROM p JOIN s ON s.sent_id = p.sent_id AND s.pos = p.pos + 1, LATERAL (SELECT unnest(s.opts) AS t, generate_subscripts(s.opts, 1) - 1 AS j) x
  LEFT JOIN g ON g.before = p.prev AND g.t = x.t LEFT JOIN k ON k.before = p.prev LEFT JOIN u ON u.t = x.t),
e AS (
  SELECT p.sent_id, p.path, p.score + round(coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)) * 1e9)::BIGINT AS score, p.raw + coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)) AS raw
  FROM p JOIN ok0 ON p.sent_id = ok0.sent_id AND p.pos = ok0.last LEFT JOIN g ON g.before = p.prev AND g.t = '</s>' LEFT JOIN k ON k.before = p.prev JOIN u ON u.t = '</s>'),
n AS (SELECT *, pow(10, raw) / sum(pow(10, raw)) OVER (PARTITION BY sent_id) AS prob, pow(10, score / 1e9) / sum(pow(10, raw)) OVER (PARTITION BY sent_id) AS best FROM e)"""
_PATHS = _PATHS.replace("ok AS (SELECT sent_id, max(pos) AS last FROM units GROUP BY sent_id HAVING product(len(tls)) BETWEEN 2 AND 10000)", "ok0 AS (SELECT sent_id, max(pos) AS last FROM units GROUP BY sent_id)")


def _lattices(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All sentences, the observed word standing for the first translation, and a bigram model of the observed words."""
    return fixtures.translated(spark, sf_dir).select("sent_id", F.col("options").alias("lus")), _bigrams(fixtures.observed(spark, sf_dir))


@query("WITH RECURSIVE " + fixtures.SQL + _PATHS + """
SELECT n.sent_id, i::INT AS pos, s.opts[path[i + 1] + 1] AS tl, round(sum(prob), 6) AS share
FROM n, LATERAL (SELECT unnest(range(len(path))) AS i) JOIN s ON s.sent_id = n.sent_id AND s.pos = i GROUP BY ALL""")
def lattice_fractions(spark, sf_dir):
    """Each translation's share of all paths' probability, by forward and backward sums."""
    found = lattice.shares(lattice.lattices(*_lattices(spark, sf_dir)))
    return found.select("sent_id", "pos", "tl", F.round("share", 6).alias("share"))


@query("WITH RECURSIVE " + fixtures.SQL + _PATHS + """
SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, path)::INT AS rank, score AS billionths, round(best, 6) AS prob, array_to_string(path, ' ') AS path
FROM n QUALIFY rank <= 4""")
def lattice_best(spark, sf_dir):
    """The four best paths of each sentence, from the lattice."""
    found = lattice.best_paths(lattice.lattices(*_lattices(spark, sf_dir)), 4)
    return found.select("sent_id", "rank", F.round(F.col("score") * lattice.UNITS).cast("long").alias("billionths"), F.round("prob", 6).alias("prob"), F.array_join(F.transform("path", lambda i: i.cast("string")), " ").alias("path"))


@query("WITH RECURSIVE " + fixtures.SQL + _PATHS + """,
l AS (SELECT u.sl, s.opts[path[i + 1] + 1] AS tl, prob FROM n, LATERAL (SELECT unnest(range(len(path))) AS i) JOIN s ON s.sent_id = n.sent_id AND s.pos = i JOIN units u ON u.sent_id = n.sent_id AND u.pos = i WHERE len(s.opts) > 1)
SELECT sl, tl, round(sum(prob), 5) AS freq FROM l GROUP BY ALL""")
def lattice_lexicon(spark, sf_dir):
    """The fractional lexicon from shares, without paths."""
    pairs = lattice.fractional_pairs(*_lattices(spark, sf_dir))
    return lexicon.frequencies(pairs, F.col("frac")).withColumn("freq", F.round("freq", 5))
