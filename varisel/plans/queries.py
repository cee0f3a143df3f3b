"""Queries of the selection engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lu
from ..operators import dictionary, emit, evaluate, filters, language_model, lattice, legacy, lexicon, matching, maxent, ngrams
from ..operators.rules import compile_rules
from ..sources import readers
from ..sources.intermediate import spent_shuffles_go, written
from . import fixtures
from .registry import query

#: Rules over the derived sentences: context on either side, alternation, repetition, removal, an anchor.
RULES = compile_rules(
    """<rules>
  <rule weight="1.0"><match lemma="promo"><select contains=".t1"/></match></rule>
  <rule weight="2.5"><match lemma="promo"><select contains=".t2"/></match><or><match lemma="large"/><match lemma="small"/></or></rule>
  <rule weight="0.7"><match tags="adj"/><match lemma="economy"><select contains=".t0"/></match></rule>
  <rule weight="1.5"><match lemma="economy"><remove contains=".t0"/></match><repeat from="0" upto="1"><match lemma="medium"/></repeat><match lemma="standard"/></rule>
  <rule weight="3.0"><begin/><match lemma="standard"><select contains=".t1"/></match></rule>
  <rule weight="0.5"><match lemma="standard"><remove contains=".t1"/></match></rule>
</rules>"""
)

_RULE_SQL = """,
w AS (SELECT *, split_part(sl, '<', 1) AS lemma, tag AS g FROM units),
c AS (SELECT *, lead(lemma) OVER o AS n1, lead(lemma, 2) OVER o AS n2, lag(tag) OVER o AS before FROM w WINDOW o AS (PARTITION BY sent_id ORDER BY pos)),
m AS (
  SELECT sent_id, pos, 1 AS rule_id, 1 AS len, pos AS start, 1.0 AS weight, 'select' AS op, '.t1' AS part FROM c WHERE lemma = 'promo'
  UNION ALL SELECT sent_id, pos, 2, 2, pos, 2.5, 'select', '.t2' FROM c WHERE lemma = 'promo' AND n1 IN ('large', 'small')
  UNION ALL SELECT sent_id, pos, 3, 2, pos - 1, 0.7, 'select', '.t0' FROM c WHERE lemma = 'economy' AND before = '<adj>'
  UNION ALL SELECT sent_id, pos, 4, 2, pos, 1.5, 'remove', '.t0' FROM c WHERE lemma = 'economy' AND n1 = 'standard'
  UNION ALL SELECT sent_id, pos, 4, 3, pos, 1.5, 'remove', '.t0' FROM c WHERE lemma = 'economy' AND n1 = 'medium' AND n2 = 'standard'
  UNION ALL SELECT sent_id, pos, 5, 1, pos, 3.0, 'select', '.t1' FROM c WHERE lemma = 'standard' AND pos = 0
  UNION ALL SELECT sent_id, pos, 6, 1, pos, 0.5, 'remove', '.t1' FROM c WHERE lemma = 'standard'),
s AS (SELECT sent_id, pos, op, part, sum(weight)::DOUBLE AS score FROM m GROUP BY ALL)"""

#: Per word: which operations can meet, by falling weight. promo: t2 2.5, t1 1.0; economy: remove t0 1.5, select
#: t0 0.7; standard: select t1 3.0, remove t1 0.5.
_FOLD_SQL = _RULE_SQL + """,
f AS (
  SELECT sent_id, pos, max(CASE WHEN op = 'select' AND part = '.t0' THEN 1 ELSE 0 END) AS s0, max(CASE WHEN op = 'select' AND part = '.t1' THEN 1 ELSE 0 END) AS s1,
    max(CASE WHEN op = 'select' AND part = '.t2' THEN 1 ELSE 0 END) AS s2, max(CASE WHEN op = 'remove' AND part = '.t0' THEN 1 ELSE 0 END) AS r0, max(CASE WHEN op = 'remove' AND part = '.t1' THEN 1 ELSE 0 END) AS r1
  FROM s GROUP BY ALL),
d AS (
  SELECT u.sent_id, u.pos, u.sl, len(u.tls) AS n, u.tls,
    CASE WHEN len(u.tls) = 1 THEN u.tls
      WHEN f.s2 = 1 AND len(u.tls) = 3 THEN u.tls[3:3]
      WHEN f.r0 = 1 THEN u.tls[2:]
      WHEN f.s1 = 1 THEN u.tls[2:2]
      WHEN f.s0 = 1 THEN u.tls[1:1]
      WHEN f.r1 = 1 THEN list_concat(u.tls[1:1], u.tls[3:])
      ELSE u.tls END AS kept
  FROM units u LEFT JOIN f ON u.sent_id = f.sent_id AND u.pos = f.pos)"""


def _lus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.units(spark, sf_dir).withColumnRenamed("sent_id", "segment_id")


@query(""" SELECT sent_id, pos, sl, len(tls)::INT AS n_tl, tls[1] AS first_tl FROM units""")
def lu_parse(spark, sf_dir):
    """Streams of LUs, written as text and parsed again."""
    text = fixtures.sentences(spark, sf_dir).select(F.col("sent_id").alias("segment_id"), lu.render_units(F.col("lus")).alias("text"))
    parsed = matching.parse_segments(text)
    return parsed.select(F.col("segment_id").alias("sent_id"), "pos", "sl", F.size("tls").alias("n_tl"), F.element_at("tls", 1).alias("first_tl"))


@query(""" SELECT sent_id, string_agg(' ^' || sl || '/' || array_to_string(tls, '/') || '$', '' ORDER BY pos) AS text FROM units GROUP BY sent_id""")
def lu_render(spark, sf_dir):
    s = fixtures.sentences(spark, sf_dir)
    return s.select("sent_id", lu.render_units(F.col("lus")).alias("text"))


@query(""" SELECT sent_id, count(*)::INT AS n_units, count(*) FILTER (len(tls) > 1) AS n_ambiguous FROM units GROUP BY sent_id HAVING n_ambiguous > 0""")
def ambiguous_filter(spark, sf_dir):
    kept = filters.ambiguous_sentences(fixtures.sentences(spark, sf_dir))
    return kept.select("sent_id", F.size("lus").alias("n_units"), F.size(F.filter("lus", lambda u: F.size(u["tls"]) > 1)).cast("long").alias("n_ambiguous"))


@query(""" SELECT sent_id, count(*)::INT AS n_units FROM units GROUP BY sent_id HAVING bool_or(len(tls) > 1 AND tag IN ('<n>', '<vblex>', '<adj>'))""")
def pos_ambig(spark, sf_dir):
    s = fixtures.sentences(spark, sf_dir)
    return s.filter(lu.pos_ambiguous(F.col("lus"))).select("sent_id", F.size("lus").alias("n_units"))


@query("""WITH """ + fixtures.TOKENS_SQL + """ SELECT doc_id, count(*)::INT AS n, round(100 - count(*) FILTER (length(lemma) > 12) * 100.0 / count(*), 6) AS coverage FROM tok GROUP BY doc_id HAVING 100 - count(*) FILTER (length(lemma) > 12) * 100.0 / count(*) >= 90""")
def coverage_filter(spark, sf_dir):
    """Documents as sentences; words of over 12 letters count as unknown."""
    word = F.when(F.length("lemma") > 12, F.concat(F.lit("*"), "lemma")).otherwise(F.col("lemma"))
    one = F.struct("pos", F.lit(" ").alias("blank"), word.alias("sl"), F.array(word).alias("tls"))
    sents = fixtures.tokens(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(one).alias("lus"))
    return filters.covered(sents).select("doc_id", F.size("lus").alias("n"), F.round(lu.coverage(F.col("lus")), 6).alias("coverage"))


@query(""" SELECT sent_id, product(len(tls))::BIGINT AS fertility FROM units GROUP BY sent_id HAVING product(len(tls)) >= 2 AND product(len(tls)) < 10000""")
def fertility(spark, sf_dir):
    return filters.fertile(fixtures.sentences(spark, sf_dir)).select("sent_id", "fertility")


@query("""WITH RECURSIVE """ + fixtures.SQL + """,
ok AS (SELECT sent_id, max(pos) AS last FROM units GROUP BY sent_id HAVING product(len(tls)) BETWEEN 2 AND 10000 AND bool_or(len(tls) > 1 AND tag IN ('<n>', '<vblex>', '<adj>'))),
p AS (
  SELECT sent_id, -1 AS pos, '' AS path, 0::BIGINT AS path_id FROM ok
  UNION ALL
  SELECT p.sent_id, u.pos, p.path || ' ' || x.t, p.path_id * len(u.tls) + x.i
  FROM p JOIN units u ON u.sent_id = p.sent_id AND u.pos = p.pos + 1, LATERAL (SELECT unnest(u.tls) AS t, generate_subscripts(u.tls, 1) - 1 AS i) x)
SELECT p.sent_id, path_id::INT AS path_id, trim(path) AS path FROM p JOIN ok ON p.sent_id = ok.sent_id AND p.pos = ok.last""")
def path_enumeration(spark, sf_dir):
    good = filters.enumerable(fixtures.sentences(spark, sf_dir))
    return dictionary.paths(good).select("sent_id", "path_id", F.array_join("tls", " ").alias("path"))


@query(""" SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs WHERE n_tl > 1 GROUP BY sl, tl""")
def freq_lexicon(spark, sf_dir):
    return lexicon.frequencies(fixtures.observed(spark, sf_dir).filter("n_tl > 1"))


@query(""" SELECT sl, tl, round(sum(frac), 6) AS freq FROM obs GROUP BY sl, tl""")
def frac_freq(spark, sf_dir):
    f = lexicon.frequencies(fixtures.observed(spark, sf_dir), F.col("frac"))
    return f.withColumn("freq", F.round("freq", 6))


@query(""", f AS (SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs GROUP BY sl, tl)
SELECT sl, tl, freq, (row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) - 1)::INT AS tl_idx FROM f""")
def ranked_lexicon(spark, sf_dir):
    return lexicon.ranked(lexicon.frequencies(fixtures.observed(spark, sf_dir))).select("sl", "tl", "freq", "tl_idx")


@query(""", f AS (SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs GROUP BY sl, tl)
SELECT sl, tl AS default_tl, freq AS default_freq FROM f QUALIFY row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) = 1""")
def default_tl(spark, sf_dir):
    return lexicon.defaults(lexicon.frequencies(fixtures.observed(spark, sf_dir)))


@query(""", f AS (SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs GROUP BY sl, tl),
r AS (SELECT *, row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) AS n FROM f)
SELECT printf('%.10f', freq) || ' ^' || sl || '$ ^' || tl || '$' || CASE WHEN n = 1 THEN ' @' ELSE '' END AS value FROM r""")
def lexicon_text(spark, sf_dir):
    return lexicon.lexicon_lines(lexicon.ranked(lexicon.frequencies(fixtures.observed(spark, sf_dir)))).select("value")


_GRAMS = """, s AS (SELECT sent_id, list(sl ORDER BY pos) AS w FROM obs GROUP BY sent_id),
x AS (SELECT o.sl, o.tl, o.frac, o.pos, s.w, len(s.w) AS n, j FROM obs o JOIN s USING (sent_id), (VALUES (1), (2)) v(j)),
g AS (
  SELECT sl, tl, frac, array_to_string(w[pos - j + 1:pos + 1], ' ') AS ngram FROM x WHERE pos - j >= 0
  UNION ALL SELECT sl, tl, frac, array_to_string(w[pos + 1:pos + j + 1], ' ') FROM x WHERE pos + j + 1 <= n
  UNION ALL SELECT sl, tl, frac, array_to_string(w[pos - j + 1:pos + j + 1], ' ') FROM x WHERE pos - j >= 0 AND pos + j + 1 <= n),
k AS (SELECT sl, ngram, tl, sum(frac) AS cnt, count(*)::DOUBLE AS n FROM g GROUP BY ALL)"""


def _ngrams(spark, sf_dir, weight: str) -> DataFrame:
    o = fixtures.observed(spark, sf_dir)
    s = o.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sl"))), lambda x: x["sl"]).alias("words"))
    return ngrams.ngram_counts(o.select("sent_id", "pos", "sl", "tl", (F.col("frac") if weight == "frac" else F.lit(1.0)).alias("w")), s)


@query(_GRAMS + " SELECT sl, ngram, tl, round(cnt, 6) AS cnt FROM k")
def ngram_counts(spark, sf_dir):
    return _ngrams(spark, sf_dir, "frac").withColumn("cnt", F.round("cnt", 6))


_CRISP = _GRAMS + """,
f AS (SELECT sl, tl, count(*) AS freq FROM obs GROUP BY sl, tl),
d AS (SELECT sl, tl AS default_tl FROM f QUALIFY row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) = 1),
t AS (SELECT sl, ngram, sum(n) AS total, max(n) AS max_freq FROM k GROUP BY ALL),
c AS (SELECT k.sl, k.ngram, k.tl, k.n AS tl_freq, t.total, t.max_freq, k.n / t.total AS weight, k.n / t.total / coalesce(e.n / t.total, 1.0) AS crisp
  FROM k JOIN t USING (sl, ngram) JOIN d USING (sl) LEFT JOIN k e ON e.sl = k.sl AND e.ngram = k.ngram AND e.tl = d.default_tl)"""


@query(_CRISP + " SELECT CASE WHEN crisp >= 3 THEN '+' ELSE '-' END AS sign, round(crisp, 6) AS crisp, round(weight, 6) AS weight, total, max_freq, tl_freq, sl, ngram, tl FROM c")
def crispiness(spark, sf_dir):
    d = lexicon.defaults(lexicon.frequencies(fixtures.observed(spark, sf_dir)))
    c = ngrams.crispiness(_ngrams(spark, sf_dir, "1"), d)
    return c.withColumns({"crisp": F.round("crisp", 6), "weight": F.round("weight", 6)})


@query(_CRISP + " SELECT sl, ngram, tl, round(crisp, 6) AS crisp FROM c QUALIFY row_number() OVER (PARTITION BY sl, ngram ORDER BY tl_freq DESC, tl) = 1")
def ngram_pruning(spark, sf_dir):
    d = lexicon.defaults(lexicon.frequencies(fixtures.observed(spark, sf_dir)))
    return ngrams.prune_ngrams(_ngrams(spark, sf_dir, "1"), d).select("sl", "ngram", "tl", F.round("crisp", 6).alias("crisp"))


@query(_GRAMS + " SELECT sl, ngram, tl, n AS cnt, row_number() OVER (PARTITION BY sl, ngram ORDER BY n DESC, tl)::INT AS rank FROM k QUALIFY rank <= 2")
def topk_tl(spark, sf_dir):
    return ngrams.top_translations(_ngrams(spark, sf_dir, "1"), 2).select("sl", "ngram", "tl", "cnt", "rank")


@query(_GRAMS + """,
v AS (SELECT sl, ngram, tl, n AS w FROM k),
tls AS (SELECT DISTINCT sl, tl FROM v), grams AS (SELECT DISTINCT sl, ngram FROM v),
full_ AS (SELECT tls.sl, tls.tl, grams.ngram, coalesce(v.w, 0) AS w FROM tls JOIN grams USING (sl) LEFT JOIN v ON v.sl = tls.sl AND v.tl = tls.tl AND v.ngram = grams.ngram),
dom AS (SELECT b.sl, b.tl FROM full_ a JOIN full_ b ON a.sl = b.sl AND a.ngram = b.ngram AND a.tl <> b.tl GROUP BY b.sl, b.tl, a.tl HAVING bool_and(a.w >= b.w) AND bool_or(a.w > b.w))
SELECT sl, tl, sum(w) AS mass FROM v WHERE NOT EXISTS (SELECT 1 FROM dom WHERE dom.sl = v.sl AND dom.tl = v.tl) GROUP BY sl, tl""")
def pareto(spark, sf_dir):
    return ngrams.pareto(_ngrams(spark, sf_dir, "1").withColumnRenamed("cnt", "weight"))


@query(_RULE_SQL + " SELECT DISTINCT sent_id, start::INT AS start, (start + len - 1)::INT AS \"end\", rule_id::INT AS rule_id FROM m")
def rule_match(spark, sf_dir):
    m = matching.rule_matches(_lus(spark, sf_dir), RULES)
    return m.select(F.col("segment_id").alias("sent_id"), "start", "end", "rule_id")


@query(_RULE_SQL + " SELECT sent_id, pos, op, round(sum(score), 6) AS score FROM s GROUP BY ALL")
def rule_scores(spark, sf_dir):
    s = matching.rule_scores(_lus(spark, sf_dir), RULES)
    op = F.regexp_extract("op_key", "^<(select|remove)>", 1).alias("op")
    return s.groupBy(F.col("segment_id").alias("sent_id"), "pos", op).agg(F.round(F.sum("score"), 6).alias("score"))


@query(_FOLD_SQL + " SELECT sent_id, pos, sl, array_to_string(kept, '/') AS kept FROM d")
def rule_select(spark, sf_dir):
    """Rules applied to every unit: the translations that are left."""
    out = matching.apply_rules(_lus(spark, sf_dir), RULES)
    return out.select(F.col("segment_id").alias("sent_id"), "pos", "sl", F.array_join("tls", "/").alias("kept"))


@query(_FOLD_SQL + " SELECT sl, n::INT AS n, count(*) AS units, sum(n - len(kept))::BIGINT AS removed FROM d WHERE len(kept) < n GROUP BY sl, n")
def rule_remove(spark, sf_dir):
    """How many translations the rules take away, by word."""
    lus = _lus(spark, sf_dir)
    out = matching.apply_rules(lus.withColumn("n", F.size("tls")), RULES)
    return out.filter(F.size("tls") < F.col("n")).groupBy("sl", "n").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("n") - F.size("tls")).cast("long").alias("removed"))


@query(_FOLD_SQL + " SELECT sent_id, string_agg(' ^' || sl || '/' || array_to_string(kept, '/') || '$', '' ORDER BY pos) AS text FROM d GROUP BY sent_id")
def rule_stream(spark, sf_dir):
    """The streaming form of application, one expression for each sentence, on the same sentences."""
    s = fixtures.sentences(spark, sf_dir)
    return s.select("sent_id", lu.render_units(matching.apply_to_units(F.col("lus"), RULES)).alias("text"))


@query(""" SELECT sent_id, count(*) AS n FROM units WHERE sent_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY sent_id""")
def retained_semi(spark, sf_dir):
    lines = fixtures.units(spark, sf_dir).withColumnRenamed("sent_id", "line_no")
    wanted = fixtures.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("line_no"))
    return filters.retained(lines, wanted).groupBy(F.col("line_no").alias("sent_id")).agg(F.count(F.lit(1)).alias("n"))


@query(""" SELECT sent_id, count(*) AS n FROM units WHERE sent_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY sent_id""")
def discarded_anti(spark, sf_dir):
    lines = fixtures.units(spark, sf_dir).withColumnRenamed("sent_id", "line_no")
    wanted = fixtures.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("line_no"))
    return filters.discarded(lines, wanted).groupBy(F.col("line_no").alias("sent_id")).agg(F.count(F.lit(1)).alias("n"))


_OPTIONS = """, u2 AS (SELECT sent_id, pos, sl, tag, unnest(['af', 'no', 'rf']) || tag AS tl FROM units WHERE len(tls) > 1)"""


def _options(spark, sf_dir) -> DataFrame:
    u = fixtures.units(spark, sf_dir)
    tag = F.regexp_extract("sl", "(<.*>)", 1)
    return u.withColumn("tls", F.when(F.size("tls") > 1, F.transform(F.array(F.lit("af"), F.lit("no"), F.lit("rf")), lambda x: F.concat(x, tag))).otherwise(F.slice("tls", 1, 1)))


@query(_OPTIONS + " SELECT sl, tl, count(*) AS n FROM u2 WHERE EXISTS (SELECT 1 FROM obs o WHERE o.sent_id = u2.sent_id AND o.tl = u2.tl) GROUP BY sl, tl")
def poorman_semi(spark, sf_dir):
    """Options that occur anywhere in the observed sentence."""
    met = ngrams.translations_present(_options(spark, sf_dir), fixtures.observed(spark, sf_dir).select("sent_id", "tl"))
    return met.groupBy("sl", "tl").agg(F.count(F.lit(1)).alias("n"))


@query(_OPTIONS + " SELECT u2.sl, u2.tl, count(*)::DOUBLE AS freq FROM u2 JOIN obs o ON o.sent_id = u2.sent_id AND o.tl = u2.tl GROUP BY u2.sl, u2.tl")
def poorman_freq(spark, sf_dir):
    return lexicon.frequencies(lexicon.bag_pairs(_options(spark, sf_dir), fixtures.observed(spark, sf_dir).select("sent_id", "tl")))


@query(""" SELECT a.sl, b.tl, count(*)::DOUBLE AS freq FROM obs a JOIN obs b ON a.sent_id = b.sent_id AND (b.pos = a.pos OR (a.pos > 0 AND b.pos = a.pos - 1)) WHERE a.n_tl > 1 AND a.tag = b.tag GROUP BY a.sl, b.tl""")
def alignment_count(spark, sf_dir):
    """Every word is linked to the target at its place and the one before."""
    o = fixtures.observed(spark, sf_dir)
    bt = F.struct("pos", F.lit(" ").alias("blank"), "sl", F.array_repeat("tl", F.col("n_tl")).alias("tls"))
    rows = o.groupBy(F.col("sent_id").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "sl", "tl"))).alias("x"), F.array_sort(F.collect_list(bt)).alias("bt"))
    here = F.transform("x", lambda x: F.struct(x["pos"].alias("t"), x["pos"].alias("s")))
    before = F.transform(F.filter("x", lambda x: x["pos"] > 0), lambda x: F.struct((x["pos"] - 1).alias("t"), x["pos"].alias("s")))
    cands = rows.select("line_no", F.transform("x", lambda x: x["sl"]).alias("sl"), "bt", F.transform("x", lambda x: x["tl"]).alias("tl"), F.concat(here, before).alias("align"))
    return lexicon.frequencies(lexicon.agreeing(lexicon.aligned_pairs(cands)))


@query(""", r AS (SELECT sent_id, pos, frac + 0.01 AS p FROM obs),
n AS (SELECT sent_id, pos, round(p / sum(p) OVER (PARTITION BY sent_id), 9) AS prob FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY prob DESC, pos) AS rank FROM n),
z AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY sent_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT sent_id, pos AS path_id, round(prob, 6) AS prob, rank::INT AS rank, CASE WHEN rank = 1 THEN '|@|' WHEN round(before, 7) < 0.5 THEN '|+|' ELSE '|-|' END AS mark FROM z""")
def cumulative_mass(spark, sf_dir):
    o = fixtures.observed(spark, sf_dir).select("sent_id", F.col("pos").alias("path_id"), F.log10(F.col("frac") + 0.01).alias("score"))
    p = language_model.normalised(o).withColumn("prob", F.round("prob", 9))
    r = language_model.ranked(p)
    mark = F.when(F.col("rank") == 1, "|@|").when(F.round(F.col("cumulative") - F.col("prob"), 7) < 0.5, "|+|").otherwise("|-|")
    return r.select("sent_id", "path_id", F.round("prob", 6).alias("prob"), "rank", mark.alias("mark"))


@query(_FOLD_SQL + """, e AS (
  SELECT (n > 1)::INT AS counts, (n > 1 AND kept[1] <> tls[1 + pos % n])::INT AS failed FROM d)
SELECT sum(failed)::BIGINT AS fails, sum(counts)::BIGINT AS total, floor(sum(failed) * 1000 / sum(counts)) / 10 AS percent FROM e""")
def eval_error_rate(spark, sf_dir):
    """What the rules choose, against a reference that has one translation for each unit."""
    lus = _lus(spark, sf_dir)
    line = lambda df: df.groupBy(F.col("segment_id").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "sl", "tls"))).alias("lus"))
    ref = lus.withColumn("tls", F.array(F.element_at("tls", F.col("pos") % F.size("tls") + 1)))
    return evaluate.error_rate(line(lus), line(ref), line(matching.apply_rules(lus, RULES)))


@query(""", t AS (SELECT DISTINCT sl, split_part(sl, '<', 1) AS lemma, tag FROM units)
SELECT sl, CASE WHEN tag IN ('<n>', '<adj>') THEN replace(replace(tag, '<', ''), '>', '') ELSE '' END AS tags, CASE tag WHEN '<n>' THEN 'NOUN' WHEN '<adj>' THEN 'ADJ' ELSE 'OTHER' END AS value FROM t""")
def tag_prefix_backoff(spark, sf_dir):
    named = spark.createDataFrame([("n", "NOUN"), ("adj", "ADJ"), ("", "OTHER")], "tags string, value string")
    return dictionary.tag_backoff(fixtures.units(spark, sf_dir), named)


@query(_OPTIONS + """, f AS (SELECT tl, count(*) AS freq FROM obs GROUP BY tl),
g AS (SELECT split_part(tl, '<', 1) AS lemma, sum(freq) AS lemma_freq FROM f GROUP BY 1),
r AS (SELECT u2.sent_id, u2.pos, u2.sl, u2.tl FROM u2 LEFT JOIN f ON f.tl = u2.tl LEFT JOIN g ON g.lemma = split_part(u2.tl, '<', 1)
  QUALIFY row_number() OVER (PARTITION BY u2.sent_id, u2.pos ORDER BY coalesce(freq, 0) DESC, coalesce(lemma_freq, 0) DESC, u2.tl) = 1)
SELECT sl, tl, count(*) AS n FROM r GROUP BY sl, tl""")
def legacy_freq_choice(spark, sf_dir):
    freq = fixtures.observed(spark, sf_dir).groupBy("tl").agg(F.count(F.lit(1)).alias("freq"))
    out = legacy.frequency_choice(_options(spark, sf_dir).filter(F.size("tls") > 1), freq)
    return out.groupBy("sl", F.element_at("tls", 1).alias("tl")).agg(F.count(F.lit(1)).alias("n"))


@query(""", t AS (SELECT DISTINCT sl, unnest(tls) AS tl FROM units), b AS (SELECT lower(p_type) AS lemma, min(p_partkey) AS k FROM part GROUP BY 1)
SELECT DISTINCT u.sl, (b.lemma || '_x' || u.tag) AS tl FROM units u JOIN b ON split_part(u.sl, '<', 1) = b.lemma""")
def dictionary_lookup(spark, sf_dir):
    part = fixtures.table(spark, sf_dir, "part").select(F.lower("p_type").alias("sl_lemma")).distinct()
    bidix = part.select("sl_lemma", F.array().cast("array<string>").alias("sl_tags"), F.concat("sl_lemma", F.lit("_x")).alias("tl_lemma"), F.array().cast("array<string>").alias("tl_tags"))
    found = dictionary.lookup(fixtures.units(spark, sf_dir), bidix)
    return found.select("sl", F.element_at("entries", 1)["tl"].alias("tl"))


@query(""", f AS (SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs GROUP BY sl, tl),
r AS (SELECT *, row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) AS n FROM f),
x AS (SELECT sl, tl, '<rule weight="0.8"><match lemma="' || split_part(sl, '<', 1) || '" tags="' || replace(split_part(sl, '<', 2), '>', '') || '"><select lemma="' || split_part(tl, '<', 1) || '"/></match></rule>' AS rule FROM r WHERE n = 1)
SELECT sl, tl, CASE WHEN sl LIKE '%<n>' OR sl LIKE '%<vblex>' OR sl LIKE '%<adj>' THEN rule ELSE '<!-- ' || rule || ' -->' END AS rule FROM x""")
def emit_default_rules(spark, sf_dir):
    return emit.default_rules(lexicon.ranked(lexicon.frequencies(fixtures.observed(spark, sf_dir))))


@query(""", t AS (SELECT DISTINCT sl, unnest(tls) AS tl FROM units WHERE len(tls) > 1)
SELECT sl, tl, '<rule><match lemma="' || split_part(sl, '<', 1) || '" tags="' || replace(split_part(sl, '<', 2), '>', '') || '"><select lemma="' || split_part(tl, '<', 1) || '" tags="' || replace(split_part(tl, '<', 2), '>', '') || '"/></match></rule>' AS rule FROM t""")
def emit_expansion_rules(spark, sf_dir):
    return emit.expansion_rules(fixtures.units(spark, sf_dir))


@query()
def maxent_weights(spark, sf_dir):
    """Context weights by iterative scaling; tested against an independent solver."""
    o = fixtures.observed(spark, sf_dir)
    words = o.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sl"))), lambda x: x["sl"]).alias("words"))
    of = o.select("sent_id", "pos").join(words, "sent_id").select("sent_id", "pos", F.explode(ngrams.contexts(F.col("words"), F.col("pos"), 2)).alias("ngram"))
    lex = lexicon.ranked(lexicon.frequencies(o))
    ev = maxent.select_features(maxent.events(o.select("sent_id", "pos", "sl", "tl", F.lit(1.0).alias("w")), of, lex))
    return maxent.join_lambdas(maxent.train(ev), lex)


_LM_SQL = """,
w AS (SELECT sent_id, pos + 1 AS i, tl AS t FROM obs),
f AS (SELECT sent_id, i, t FROM w UNION ALL SELECT sent_id, max(i) + 1, '</s>' FROM w GROUP BY sent_id),
h AS (SELECT sent_id, i, t, coalesce(lag(t) OVER (PARTITION BY sent_id ORDER BY i), '<s>') AS before FROM f),
u AS (SELECT t, log10(count(*) / (SELECT count(*) FROM f)) AS lp FROM f GROUP BY t),
b AS (SELECT before, t, count(*) AS n FROM h GROUP BY ALL),
g AS (SELECT before, t, n, log10((n - 0.5) / sum(n) OVER (PARTITION BY before)) AS lp FROM b),
k AS (SELECT before, log10(0.5 * count(*) / sum(n)) AS bo FROM g GROUP BY before),
ok AS (SELECT sent_id, max(pos) AS last FROM units GROUP BY sent_id HAVING product(len(tls)) BETWEEN 2 AND 10000),
c AS (SELECT u.sent_id, u.pos, list_distinct(list_concat([o.tl], u.tls[2:])) AS opts FROM units u JOIN obs o USING (sent_id, pos)),
s AS (SELECT sent_id, pos, list_sort(opts) AS opts FROM c),
p AS (
  SELECT sent_id, -1 AS pos, '<s>' AS prev, 0.0::DOUBLE AS score, 0::BIGINT AS path_id FROM ok
  UNION ALL
  SELECT p.sent_id, s.pos, x.t, p.score + coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)), p.path_id * len(s.opts) + x.j
  FROM p JOIN s ON s.sent_id = p.sent_id AND s.pos = p.pos + 1, LATERAL (SELECT unnest(s.opts) AS t, generate_subscripts(s.opts, 1) - 1 AS j) x
  LEFT JOIN g ON g.before = p.prev AND g.t = x.t LEFT JOIN k ON k.before = p.prev LEFT JOIN u ON u.t = x.t),
e AS (
  SELECT p.sent_id, p.path_id, p.score + coalesce(g.lp, coalesce(k.bo, 0) + coalesce(u.lp, -7)) AS score
  FROM p JOIN ok ON p.sent_id = ok.sent_id AND p.pos = ok.last LEFT JOIN g ON g.before = p.prev AND g.t = '</s>' LEFT JOIN k ON k.before = p.prev JOIN u ON u.t = '</s>'),
r AS (SELECT sent_id, path_id, round(score, 6) AS score FROM e),
t AS (SELECT *, pow(10, score - max(score) OVER (PARTITION BY sent_id)) AS mass FROM r),
n AS (SELECT *, mass / sum(mass) OVER (PARTITION BY sent_id) AS prob FROM t)
SELECT sent_id, path_id::INT AS path_id, score, round(prob, 6) AS prob, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, path_id)::INT AS rank FROM n"""


@spent_shuffles_go
def _bigrams(o: DataFrame) -> DataFrame:
    """A back-off model of the observed translations, with half a count taken from each pair: ord, ngram, logp, backoff."""
    framed = o.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tl"))), lambda x: x["tl"]).alias("w"))
    framed = framed.select(F.concat(F.array(F.lit("<s>")), "w", F.array(F.lit("</s>"))).alias("w"))
    pairs = framed.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.struct(F.element_at("w", i - 1).alias("h"), F.element_at("w", i).alias("t")))).alias("x")).select("x.*")
    n = pairs.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("h").agg(F.sum("n").alias("c"), F.log10(F.lit(0.5) * F.count(F.lit(1)) / F.sum("n")).alias("backoff"))
    words = n.groupBy("t").agg(F.sum("n").alias("c"))
    total = words.agg(F.sum("c").alias("all"))  # one row
    ones = words.crossJoin(F.broadcast(total)).select(F.col("t").alias("ngram"), F.log10(F.col("c") / F.col("all")).alias("logp"))
    ones = ones.join(per.select(F.col("h").alias("ngram"), "backoff"), "ngram", "full").select(F.lit(1).alias("ord"), "ngram", F.coalesce("logp", F.lit(-99.0)).alias("logp"), F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
    twos = n.join(per.select("h", F.col("c").alias("all")), "h").select(F.lit(2).alias("ord"), F.concat_ws(" ", "h", "t").alias("ngram"), F.log10((F.col("n") - 0.5) / F.col("all")).alias("logp"), F.lit(0.0).alias("backoff"))
    return written(ones.union(twos), "bigrams")


@query("WITH RECURSIVE " + fixtures.SQL + _LM_SQL)
def lm_rank(spark, sf_dir):
    """All paths of sentences (up to the operator's 10,000), the observed word standing for the first translation, scored
    by a bigram model with back-off counted from the observed words, normalised and ranked."""
    few = filters.fertile(fixtures.translated(spark, sf_dir), 2, 10_001).select("sent_id", F.col("options").alias("lus"))
    paths = lattice.ranked_paths(lattice.lattices(few, _bigrams(fixtures.observed(spark, sf_dir))), 6)
    return paths.select("sent_id", "path_id", "score", F.round("prob", 6).alias("prob"), "rank")


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS t FROM part)
SELECT k AS segment_id, t || '\\\\' AS sl, 2 AS n_tl, 'a<p/' || k || '>' AS tl_1, t || '\\/y' AS tl_2 FROM p""")
def lu_split(spark, sf_dir):
    """Parts with a slash within a tag, an escaped one, and an escaped backslash before a separator."""
    t = F.lower("p_type")
    body = F.concat(t, F.lit("\\\\"), F.lit("/a<p/"), F.col("p_partkey").cast("string"), F.lit(">/"), t, F.lit("\\/y"))
    text = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment_id"), F.concat(F.lit("x "), lu.wrap(body), F.lit(" y")).alias("text"))
    return matching.parse_segments(text).select("segment_id", "sl", F.size("tls").alias("n_tl"), F.element_at("tls", 1).alias("tl_1"), F.element_at("tls", 2).alias("tl_2"))


_BIDIX = """, x AS (SELECT DISTINCT sl, split_part(sl, '<', 1) AS lemma, replace(replace(tag, '<', ''), '>', '') AS t, length(sl) % 3 AS m FROM units),
w AS (SELECT lemma || '<' || t || '><sg>' AS sl, lemma, t, m FROM x)"""


@query(_BIDIX + """
SELECT sl, CASE m WHEN 0 THEN ['@' || sl] WHEN 1 THEN [lemma || '_a<' || t || '><sg>', lemma || '_b<' || t || '><sg>'] ELSE [lemma || '_c<' || t || '><pl>'] END AS full_,
  CASE m WHEN 0 THEN ['@' || sl] WHEN 1 THEN [lemma || '_a<' || t || '><*>', lemma || '_b<' || t || '><*>'] ELSE [lemma || '_c<' || t || '><pl>'] END AS short,
  CASE m WHEN 1 THEN sl WHEN 2 THEN lemma || '<' || t || '><*>' ELSE sl END AS short_sl
FROM w""")
def bidix_lookup(spark, sf_dir):
    """Translations by the longest prefix of a word's tags, with the tags passed on, and trimmed to what the entries hold."""
    u = fixtures.units(spark, sf_dir).select("sl").distinct()
    lemma, t, m = lu.lemma(F.col("sl")), lu.first_tag(F.col("sl")), F.length("sl") % 3
    words = u.select(lemma.alias("lemma"), t.alias("t"), m.alias("m"))
    row = lambda tags, tl, out: F.struct(tags.alias("sl_tags"), F.concat("lemma", F.lit(tl)).alias("tl_lemma"), out.alias("tl_tags"))
    one, both = F.array("t"), F.array("t", F.lit("sg"))
    # an entry without tags holds for all words of its lemma and loses against longer ones
    entries = F.when(F.col("m") == 1, F.array(row(one, "_a", one), row(one, "_b", one), row(F.array().cast("array<string>"), "_d", one))).when(F.col("m") == 2, F.array(row(one, "_a", one), row(both, "_c", F.array("t", F.lit("pl")))))
    bidix = words.filter("m > 0").select(F.col("lemma").alias("sl_lemma"), F.explode(entries).alias("e")).select("sl_lemma", "e.*").distinct()
    tokens = words.select(F.lit(1).alias("sent_id"), lu.token(F.col("lemma"), F.array("t", F.lit("sg"))).alias("sl"))
    full = dictionary.expand(tokens, bidix).select("sl", F.col("tls").alias("full_"))
    short = dictionary.expand(tokens.withColumn("own", F.col("sl")), bidix, trim=True)
    return full.join(short.select(F.col("own").alias("sl"), F.col("tls").alias("short"), F.col("sl").alias("short_sl")), "sl")


@query(""", n AS (SELECT sent_id FROM units GROUP BY sent_id HAVING product(len(tls)) BETWEEN 2 AND 10000),
m AS (SELECT *, len(tls) AS k, product(len(tls)) OVER (PARTITION BY sent_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / len(tls) AS below, product(len(tls)) OVER (PARTITION BY sent_id) AS total FROM units JOIN n USING (sent_id))
SELECT sl, tls[1 + floor(p / below)::BIGINT % k] AS tl, round(sum((p % 7 + 1) / 10.0), 6) AS freq
FROM m, LATERAL (SELECT unnest(range(0, total::BIGINT)) AS p) WHERE k > 1 GROUP BY ALL""")
def fractional_lexicon(spark, sf_dir):
    """Ambiguous sentences and their weighted paths: each path adds its share to the translations that it chose."""
    few = filters.fertile(fixtures.sentences(spark, sf_dir), 2, 10_001).select("sent_id", "lus")
    paths = dictionary.paths(few)
    pairs = lexicon.chosen_sums(few, paths.select("sent_id", "tls", ((F.col("path_id") % 7 + 1) / 10).alias("frac")))
    return lexicon.frequencies(pairs, F.col("frac")).withColumn("freq", F.round("freq", 6))


@query(""", f AS (SELECT sl, tl, count(*)::DOUBLE AS freq FROM obs GROUP BY sl, tl),
r AS (SELECT *, row_number() OVER (PARTITION BY sl ORDER BY freq DESC, tl) AS n FROM f WHERE freq >= 3)
SELECT lower(sl) AS sl, lower(tl) AS tl, freq, n = 1 AS is_default, (n - 1)::INT AS tl_idx FROM r""")
def lexicon_round_trip(spark, sf_dir):
    """A lexicon written as lines and read again, with a least frequency."""
    rows = lexicon.lexicon_lines(lexicon.ranked(lexicon.frequencies(fixtures.observed(spark, sf_dir))))
    lines = rows.select((F.xxhash64("sl").bitwiseAND(F.lit(0xFFFFFFFF)) * 1000 + F.col("tl_idx")).alias("line_no"), "value")
    return readers.frequency_lexicon(lines, min_freq=3, lower=True)


@query(""" SELECT u.sent_id, u.sent_id || chr(9) || string_agg('^' || u.sl || '/' || array_to_string(u.tls, '/') || '$', ' ' ORDER BY u.pos) AS biltrans, string_agg('^' || u.sl || '$', ' ' ORDER BY u.pos) AS tagger FROM units u GROUP BY u.sent_id""")
def unit_lines(spark, sf_dir):
    """Sentences as numbered lines of LUs, and as plain lines of their sources."""
    s = fixtures.sentences(spark, sf_dir)
    full, short = readers.unit_lines(s, numbered=True), readers.unit_lines(s, source_only=True)
    return full.withColumnRenamed("value", "biltrans").join(short.withColumnRenamed("value", "tagger"), "sent_id")


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS a, lower(p_name) AS b FROM part)
SELECT k AS line_no, k || chr(9) || '^' || replace(replace(b, ' ', '$ ^') || '$ ^' || replace(a, ' ', '~') || '$', '~', ' ') AS value, (len(string_split(a, ' ')))::INT AS n_sl FROM p""")
def candidate_lines(spark, sf_dir):
    """Candidate blocks with stray lines between them: LUs of the second line, and the parsed blocks' sources."""
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lower("p_type").alias("a"), F.lower("p_name").alias("b"))
    tilde = F.translate("a", " ", "~")
    head = F.concat(F.col("k").cast("string"), F.lit("\t"))
    as_units = lambda c: F.concat(F.lit("^"), F.replace(c, F.lit(" "), F.lit("<n>$ ^")), F.lit("<n>$"))
    block = F.array(F.concat(head, as_units(F.col("a"))), F.concat(head, "b", F.lit(" "), tilde), F.concat(head, as_units(F.col("b"))), F.concat(head, F.lit("0-0")), F.when(F.col("k") % 5 == 0, F.lit("stray")), F.lit("-" * 20))
    lines = part.select("k", F.posexplode(F.array_compact(block)).alias("i", "value")).select((F.col("k").cast("long") * 10 + F.col("i")).alias("line_no"), "value")
    blocks = readers.candidate_blocks(lines).select("line_no", F.size("sl").alias("n_sl"))
    return readers.candidate_biltrans(lines).join(blocks, "line_no")


@query("""WITH p AS (SELECT p_partkey AS k, replace(lower(p_type), ' ', '<b/>') AS a FROM part),
d AS (SELECT *, k // 3 AS g FROM p), z AS (SELECT g, a AS da, k AS dk FROM d WHERE k % 3 = 0),
r AS (SELECT DISTINCT da AS a, dk FROM d JOIN z USING (g) WHERE k % 3 > 0)
SELECT a || '<s n="n"/>' AS source, 't' || dk || '<s n="adj"/>' AS target, '<rule><match lemma="' || replace(a, '<b/>', ' ') || '" tags="n.*"><select lemma="t' || dk || '" tags="adj.*"/></match></rule>' AS rule FROM r""")
def bidix_slr_rules(spark, sf_dir):
    """Every third entry is a default; the two behind it repeat its source, with slr 1, beside entries of other sources."""
    part = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("<b/>")).alias("a"))
    g = part.select(F.floor(F.col("k") / 3).alias("g"), (F.col("k") % 3).alias("m"), "k", "a")
    first = g.filter("m = 0").select("g", F.col("a").alias("da"))
    met = g.join(first, "g", "left").withColumn("s", F.coalesce("da", F.concat(F.lit("none"), "a")))
    entry = lambda attrs, s, t: F.concat(F.lit("<e "), attrs, F.lit("><p><l>"), s, F.lit('<s n="n"/></l><r>'), t, F.lit('<s n="adj"/></r></p></e>'))
    name = F.concat(F.lit("t"), F.col("k").cast("string"))
    own = entry(F.when(F.col("m") == 0, F.lit('c="0"')).otherwise(F.lit('slr="1"')), F.col("s"), name)
    other = entry(F.lit('slr="1"'), F.concat(F.lit("other"), "s"), name)
    lines = met.select(F.posexplode(F.array(own, other)).alias("i", "value"), "k").select((F.col("k") * 2 + F.col("i")).alias("line_no"), "value")
    return emit.bidix_default_rules(emit.bidix_entries(lines), slr=True)


@query("""WITH u AS (SELECT lower(p_type) AS t, p_partkey AS k FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN t || '<n><sg><x>' WHEN 1 THEN 'W' || k || '<n><sg>' WHEN 2 THEN '*' || t ELSE t || k || '<np><b>' END AS cand, CASE k % 4 WHEN 0 THEN 2 WHEN 3 THEN 1 END AS shared FROM u""")
def tag_overlap(spark, sf_dir):
    """Of a lemma's dictionary entries the one that shares most tags; names keep their case, unknown words stay."""
    part = fixtures.table(spark, sf_dir, "part").select(F.lower("p_type").alias("t"), F.col("p_partkey").alias("k"))
    k = F.col("k").cast("string")
    sl = F.when(F.col("k") % 4 == 0, F.concat(F.upper("t"), F.lit("<n><sg>"))).when(F.col("k") % 4 == 1, F.concat(F.lit("W"), k, F.lit("<n><sg>"))).when(F.col("k") % 4 == 2, F.concat(F.lit("*"), "t")).otherwise(F.concat("t", k, F.lit("<np><a><b>")))
    tails = F.array(F.lit("<n><pl>"), F.lit("<n><sg><x>"), F.lit("<vblex><sg>"))
    common = part.filter("k % 4 = 0").select(F.col("t").alias("lemma"), F.explode(F.transform(tails, lambda x: F.concat("t", x))).alias("cand"))
    names = part.filter("k % 4 = 3").select(F.concat("t", k).alias("lemma"), F.concat("t", k, F.lit("<np><b>")).alias("cand"))
    words = part.withColumn("sl", sl)
    found = dictionary.most_overlap(words, common.union(names).distinct())
    # a name shares np and b
    return words.join(found, "sl").select("k", "cand", (F.col("shared") - F.when(F.col("k") % 4 == 3, 1).otherwise(0)).alias("shared"))


@query(""", a AS (SELECT sent_id, pos, list_filter(tls, lambda t: split_part(t, '<', 1) = stem || (pos % 4)) AS hit, tls, sl FROM units JOIN (SELECT sent_id, pos, stem FROM obs) USING (sent_id, pos))
SELECT sent_id, pos, sl, array_to_string(CASE WHEN len(hit) > 0 THEN hit ELSE tls END, '/') AS kept FROM a""")
def aligned_choice(spark, sf_dir):
    """Translations whose lemma is that of an aligned target word; all where none is."""
    o = fixtures.observed(spark, sf_dir)
    aligned = o.select("sent_id", "pos", F.concat(F.upper("stem"), (F.col("pos") % 4).cast("string"), F.lit("<x>")).alias("tl"))
    out = filters.aligned_choice(fixtures.units(spark, sf_dir), aligned)
    return out.select("sent_id", "pos", "sl", F.array_join("tls", "/").alias("kept"))


@query(""", e AS (SELECT sl, tls, CASE WHEN pos % 3 = 0 THEN tls[1] WHEN pos % 3 = 1 THEN split_part(sl, '<', 1) || '_new' || tag WHEN sent_id % 2 = 0 THEN split_part(sl, '<', 1) || '.t2' || tag ELSE 'y<zz>' END AS tl, tag FROM units)
SELECT DISTINCT sl, tl, '<e><p><l>' || replace(split_part(sl, '<', 1), ' ', '<b/>') || '<s n="' || replace(replace(tag, '<', ''), '>', '') || '"/></l><r>' || replace(split_part(tl, '<', 1), ' ', '<b/>') || '<s n="' || replace(replace(tag, '<', ''), '>', '') || '"/></r></p></e>' AS value
FROM e WHERE len(tls) > 1 AND NOT list_contains(tls, tl) AND tl <> 'y<zz>'""")
def missing_entries(spark, sf_dir):
    """Aligned translations of ambiguous units that agree in their first tag and that the unit itself does not offer, as dictionary lines."""
    u = fixtures.units(spark, sf_dir)
    tag = F.regexp_extract("sl", "(<.*>)", 1)
    third = F.when(F.col("sent_id") % 2 == 0, F.concat(lu.lemma(F.col("sl")), F.lit(".t2"), tag)).otherwise(F.lit("y<zz>"))
    tl = F.when(F.col("pos") % 3 == 0, F.element_at("tls", 1)).when(F.col("pos") % 3 == 1, F.concat(lu.lemma(F.col("sl")), F.lit("_new"), tag)).otherwise(third)
    return emit.dictionary_entries(filters.missing_entries(u.select("sent_id", "pos", tl.alias("tl")), u, same_class=True))


#: Wildcards: any lemma with tags, one tag, any tags; several operations in one word.
WILD = compile_rules(
    """<rules>
  <rule weight="2.0"><match lemma="*" tags="n.?"/><match tags="adj.+"><select suffix=".t1" tags="adj.*"/></match></rule>
  <rule weight="1.0"><match lemma="promo" tags="*"><remove lemma="*" contains=".t0" tags="*"/><remove contains=".t2"/></match></rule>
</rules>""".replace('lemma="*" contains=', "contains=")
)


@query(""", v AS (SELECT sent_id, pos, split_part(sl, '<', 1) AS lemma, tag, tls, lag(tag) OVER (PARTITION BY sent_id ORDER BY pos) AS before FROM units),
d AS (SELECT *, CASE WHEN len(tls) = 1 THEN tls
    WHEN tag = '<adj>' AND before = '<n>' AND len(tls) > 1 THEN tls[2:2]
    WHEN lemma = 'promo' AND len(tls) = 2 THEN tls[2:2] WHEN lemma = 'promo' AND len(tls) = 3 THEN tls[2:2] ELSE tls END AS kept FROM v)
SELECT sent_id, pos, array_to_string(kept, '/') AS kept FROM d""")
def rule_wildcards(spark, sf_dir):
    """Words get a second tag, so that ?, + and * in tags have something to match."""
    lus = _lus(spark, sf_dir)
    more = lus.withColumns({"sl": F.concat("sl", F.lit("<sg>")), "tls": F.transform("tls", lambda t: F.concat(t, F.lit("<sg>")))})
    out = matching.apply_rules(more, WILD)
    return out.select(F.col("segment_id").alias("sent_id"), "pos", F.regexp_replace(F.array_join("tls", "/"), "<sg>", "").alias("kept"))


@query(_RULE_SQL + """,
t AS (SELECT u.sent_id, u.pos, u.sl, u.tls, x.* FROM units u JOIN (
    SELECT sent_id, pos, 0 AS step, 'select' AS op, 3.0::DOUBLE AS weight, 1 AS n_keep FROM s WHERE part = '.t1' AND op = 'select' AND score = 3.0) x USING (sent_id, pos) WHERE len(u.tls) > 1)
SELECT sent_id, pos, step, op, weight, sl, n_keep, tls[2] AS tl FROM t
UNION ALL SELECT u.sent_id, u.pos, 0, 'remove', 0.5::DOUBLE, u.sl, (len(u.tls) - 1)::INT, u.tls[2] FROM units u JOIN s USING (sent_id, pos)
WHERE s.op = 'remove' AND s.part = '.t1' AND u.pos > 0 AND len(u.tls) > 1""")
def rule_trace(spark, sf_dir):
    """The steps of the decisions for one word, of which one rule ends at the first step."""
    out = matching.trace_rules(_lus(spark, sf_dir), RULES).filter(lu.lemma(F.col("sl")) == "standard")
    return out.withColumnRenamed("segment_id", "sent_id").filter("step = 0")


@query(r"""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS t, p_name AS n FROM part)
SELECT k, replace(t, ' ', '~') || '<n>' AS stripped, replace(n, ' ', '') AS joined, 'a\-b\(' || n || '\) &amp; c' AS escaped, t || '#x y' AS cleaned, t AS trimmed, 'n.m.*' AS path, CASE WHEN k % 2 = 0 THEN k * 1.5 ELSE 0 END::DOUBLE AS number FROM p""")
def text_functions(spark, sf_dir):
    """Small text functions: stripping, escaping, markup, trimming, numbers."""
    k, t, n = F.col("p_partkey"), F.lower("p_type"), F.col("p_name")
    part = fixtures.table(spark, sf_dir, "part")
    pair = F.concat(F.lit("x<adj>/"), t, F.lit("<n><sg>"))
    line = F.concat(F.lit("[b] "), F.concat(F.lit("^"), n, F.lit("$")))
    return part.select(
        k.alias("k"), lu.strip_tags(pair, 1).alias("stripped"), F.replace(F.array_join(lu.tilde_words(line), " "), F.lit("~"), F.lit("")).alias("joined"),
        lu.rule_escape(F.concat(F.lit("a-b("), n, F.lit(")~&~c"))).alias("escaped"), lu.clean_side(F.concat(F.replace(t, F.lit(" "), F.lit("<b/>")), F.lit('<g>x<b/>y</g><s n="n"/>'))).alias("cleaned"),
        lu.trimmed_word(F.concat(F.lit(" *"), t, F.lit("\t"))).alias("trimmed"), lu.side_path(F.concat(t, F.lit('<s n="n"/><s n="m"/>'))).alias("path"),
        lu.safe_double(F.when(k % 2 == 0, (k * 1.5).cast("string")).when(k % 3 == 0, "NaN").otherwise("no number")).alias("number"),
    )


@query(_GRAMS + """ SELECT printf('%.10f', n) || chr(9) || ngram || chr(9) || sl || chr(9) || tl AS value FROM k""")
def ngram_text(spark, sf_dir):
    return ngrams.ngram_lines(_ngrams(spark, sf_dir, "1"))


@query(""", s AS (SELECT sent_id, list(sl ORDER BY pos) AS w FROM obs GROUP BY sent_id)
SELECT o.sent_id, o.pos, CASE WHEN o.pos >= 1 THEN array_to_string(w[o.pos:o.pos + 1], ' ') ELSE CASE WHEN len(w) = 1 THEN w[1] ELSE '' END END AS before_,
  array_to_string(w[o.pos + 1:o.pos + 2], ' ') AS after_, CASE WHEN o.pos >= 1 THEN array_to_string(w[o.pos:o.pos + 2], ' ') ELSE CASE WHEN len(w) <= 2 THEN w[len(w)] ELSE '' END END AS around
FROM obs o JOIN s USING (sent_id)""")
def edge_contexts(spark, sf_dir):
    """Contexts as list slices give them at the edges of a sentence: wrapped or empty on the left, shortened on the right."""
    o = fixtures.observed(spark, sf_dir)
    s = o.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sl"))), lambda x: x["sl"]).alias("words"))
    c = ngrams.contexts(F.col("words"), F.col("pos"), 2, parity=True)
    met = o.join(s, "sent_id").withColumn("c", c)
    return met.select("sent_id", "pos", F.col("c")[0].alias("before_"), F.col("c")[1].alias("after_"), F.col("c")[2].alias("around"))


@query(""", t AS (SELECT DISTINCT unnest(tls) AS tl FROM units WHERE len(tls) > 1), c AS (SELECT lower(p_type) || '.t' || (p_partkey % 4) || '<' || (['n', 'vblex', 'adj', 'pr'])[length(p_type) % 4 + 1] || '>' AS tl FROM part)
SELECT tl, count(*) AS freq FROM c WHERE tl IN (SELECT tl FROM t) GROUP BY tl""")
def target_counts(spark, sf_dir):
    """Counts, in a target corpus, of the translations of ambiguous words only."""
    lemma = F.lower("p_type")
    tag = F.element_at(F.array(F.lit("n"), F.lit("vblex"), F.lit("adj"), F.lit("pr")), (F.length(lemma) % 4 + 1).cast("int"))
    corpus = fixtures.table(spark, sf_dir, "part").select(F.concat(lemma, F.lit(".t"), (F.col("p_partkey") % 4).cast("string"), F.lit("<"), tag, F.lit(">")).alias("tl"))
    return lexicon.target_analysis_counts(fixtures.units(spark, sf_dir), corpus)
