"""Queries of readers and corpus filters over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lu
from ..operators import dictionary, filters, legacy, lexicon, matching, ngrams
from ..sources import readers
from ..sources.intermediate import written
from . import fixtures
from .queries import _OPTIONS, _options
from .registry import query


def _part(spark, sf_dir) -> tuple[DataFrame, object, object, object]:
    return fixtures.table(spark, sf_dir, "part"), F.col("p_partkey").cast("long"), F.lower("p_type"), F.lower("p_name")


@query(""", g AS (SELECT sent_id, count(*) AS n, bool_or(n_tl > 1) AS amb FROM obs GROUP BY sent_id),
r AS (SELECT CASE WHEN NOT amb THEN 'a' WHEN n - (sent_id % 5 = 0)::INT < 2 AND n < 2 THEN 's' WHEN sent_id % 5 = 0 THEN 'd' WHEN sent_id % 7 = 0 THEN 'l' END AS reason FROM g)
SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason = 'a') AS not_ambiguous, count(*) FILTER (reason = 's') AS too_short, count(*) FILTER (reason = 'd') AS lengths_differ,
  count(*) FILTER (reason = 'l') AS no_alignment, floor(count(*) FILTER (reason IS NULL) * 1000 / count(*)) / 10 AS percent FROM r""")
def rejection_stats(spark, sf_dir):
    """How many candidates are fit for counting, told by the job that writes the fit ones."""
    o = fixtures.observed(spark, sf_dir)
    bt = F.struct("pos", F.lit(" ").alias("blank"), "sl", F.array_repeat("tl", F.col("n_tl")).alias("tls"))
    rows = o.groupBy(F.col("sent_id").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "sl", "tl"))).alias("x"), F.array_sort(F.collect_list(bt)).alias("bt"))
    sl = F.transform("x", lambda x: x["sl"])
    sl = F.when(F.col("line_no") % 5 == 0, F.slice(sl, F.lit(1), F.size("x") - 1)).otherwise(sl)
    links = F.when(F.col("line_no") % 7 == 0, F.slice("x", 1, 0)).otherwise(F.col("x"))
    cands = rows.select("line_no", sl.alias("sl"), "bt", F.transform("x", lambda x: x["tl"]).alias("tl"), F.transform(links, lambda x: F.struct(x["pos"].alias("t"), x["pos"].alias("s"))).alias("align"))
    judged, watch = filters.observed_usable(cands)
    written(judged.filter("reason is null").select("line_no"), "usable")
    got = filters.rejections(watch)
    row = tuple(got[c] for c in ("total", "valid", *filters.REASONS, "percent"))
    return spark.createDataFrame([row], "total long, valid long, not_ambiguous long, too_short long, lengths_differ long, no_alignment long, percent double")


@query(""" SELECT sent_id AS line_no FROM units GROUP BY sent_id HAVING bool_or(len(tls) > 1) AND bool_or(tag IN ('<n>', '<vblex>', '<adj>'))""")
def pos_ambiguous_lines(spark, sf_dir):
    """Lines with an ambiguous unit and an open word class anywhere."""
    s = fixtures.sentences(spark, sf_dir)
    lines = s.select(F.col("sent_id").alias("line_no"), lu.render_units(F.col("lus")).alias("value"))
    return filters.pos_ambiguous_lines(lines).select("line_no")


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN lower(p_name) ELSE '^' || lower(p_type) || '<n>$' END AS a, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE lower(p_type) || '<n>' END AS b, len(string_split(p_name, ' ')) AS n FROM part)
SELECT k AS line_no, 'full' AS kept FROM p WHERE trim(a) <> '' AND trim(b) <> '' UNION ALL SELECT k, 'analysed' FROM p WHERE contains(a, '<') AND contains(b, '<') UNION ALL SELECT k, 'length' FROM p WHERE n BETWEEN 2 AND 4""")
def pair_filters(spark, sf_dir):
    """Line pairs without a blank side, with analyses on both, and lines of two to four words."""
    part, k, t, n = _part(spark, sf_dir)
    a = F.when(k % 4 == 0, "  ").when(k % 4 == 1, n).otherwise(lu.wrap(F.concat(t, F.lit("<n>"))))
    b = F.when(k % 5 == 0, "").when(k % 5 == 1, "x").otherwise(F.concat(t, F.lit("<n>")))
    left, right = (part.select(k.alias("line_no"), c.alias("value")) for c in (a, b))
    pairs = readers.parallel(left, right)
    short = filters.length_between(part.select(k.alias("line_no"), "p_name"), F.split("p_name", " "), 2, 4)
    kept = lambda df, name: df.select("line_no", F.lit(name).alias("kept"))
    return kept(filters.full_pairs(pairs, "a", "b"), "full").union(kept(filters.analysed_pairs(pairs, "a", "b"), "analysed")).union(kept(short, "length"))


@query(""", d AS (SELECT DISTINCT sl, split_part(sl, '<', 1) || CASE WHEN length(sl) % 2 = 0 THEN '.t1' ELSE '.none' END || tag AS dt FROM units WHERE length(sl) % 3 > 0)
SELECT u.sent_id, u.pos, array_to_string(CASE WHEN d.dt IS NOT NULL AND list_contains(u.tls, d.dt) THEN [d.dt] ELSE list_sort(u.tls) END, '/') AS kept FROM units u LEFT JOIN d USING (sl)""")
def default_pick(spark, sf_dir):
    """The dictionary's default translation where a unit offers it, else all of them, sorted."""
    u = fixtures.units(spark, sf_dir)
    tail = F.when(F.length("sl") % 2 == 0, F.lit(".t1")).otherwise(F.lit(".none"))
    defaults = u.select("sl").distinct().filter(F.length("sl") % 3 > 0).select("sl", F.concat(lu.lemma(F.col("sl")), tail, F.lit("<"), lu.first_tag(F.col("sl")), F.lit(">")).alias("default_tl"))
    return dictionary.pick_default(u, defaults).select("sent_id", "pos", F.array_join("tls", "/").alias("kept"))


@query(_OPTIONS + """, s AS (SELECT sent_id, list(sl ORDER BY pos) AS w FROM obs GROUP BY sent_id),
x AS (SELECT u2.sl, u2.tl, u2.pos, s.w FROM u2 JOIN s USING (sent_id) WHERE EXISTS (SELECT 1 FROM obs o WHERE o.sent_id = u2.sent_id AND o.tl = u2.tl)),
g AS (SELECT sl, tl, array_to_string(w[pos:pos + 1], ' ') AS ngram FROM x WHERE pos >= 1 UNION ALL SELECT sl, tl, array_to_string(w[pos + 1:pos + 2], ' ') FROM x WHERE pos + 2 <= len(w)
  UNION ALL SELECT sl, tl, array_to_string(w[pos:pos + 2], ' ') FROM x WHERE pos >= 1 AND pos + 2 <= len(w))
SELECT sl, ngram, tl, count(*)::DOUBLE AS cnt FROM g GROUP BY ALL""")
def poorman_ngrams(spark, sf_dir):
    """Context counts of options that occur anywhere in the observed sentence."""
    o = fixtures.observed(spark, sf_dir)
    words = o.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sl"))), lambda x: x["sl"]).alias("words"))
    return ngrams.ngram_counts(ngrams.translations_present(_options(spark, sf_dir), o.select("sent_id", "tl")), words, 2)


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS t, p_partkey % 3 AS n FROM part)
SELECT k AS rule_id, t AS lemma, n AS contexts, row_number() OVER (PARTITION BY t ORDER BY n DESC, k)::INT AS priority FROM p""")
def legacy_priorities(spark, sf_dir):
    """Older rules in order of their contexts, for each centre word."""
    part, k, t, _ = _part(spark, sf_dir)
    contexts = F.array_join(F.slice(F.array(F.lit('(-1 "a" n)'), F.lit('(1 "b" n)')), F.lit(1), (k % 3).cast("int")), " ")
    value = F.concat(F.lit('s\t("'), t, F.lit('" n)\t("y" n)\t'), contexts)
    rules = legacy.longest_first(legacy.parse_rules(part.select(k.alias("rule_id"), value.alias("value"))))
    return rules.select("rule_id", F.col("centre.lemma").alias("lemma"), F.size("contexts").cast("long").alias("contexts"), "priority")


@query(""" SELECT sent_id AS line_no, pos, CASE WHEN pos % 3 = 2 THEN '*' || split_part(sl, '<', 1) ELSE split_part(sl, '<', 1) END AS lemma, CASE WHEN pos % 3 = 2 THEN '' ELSE replace(replace(tag, '<', ''), '>', '') || '.sg' END AS tags, pos % 3 = 2 AS unknown FROM units""")
def tagger_tokens(spark, sf_dir):
    """Tagged lines read as tokens; every third word is unknown, and a line ends without its newline."""
    u = fixtures.units(spark, sf_dir)
    word = lu.wrap(F.when(F.col("pos") % 3 == 2, F.concat(F.lit("*"), lu.lemma(F.col("sl")))).otherwise(F.concat("sl", F.lit("<sg>"))))
    lines = u.groupBy(F.col("sent_id").alias("line_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]), " ").alias("value"))
    tokens = readers.tagger_lines(lines).select("line_no", F.posexplode("tokens").alias("pos", "t"))
    return tokens.select("line_no", "pos", "t.lemma", lu.tag_path(F.col("t.tags")).alias("tags"), "t.unknown")


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS t FROM part) SELECT t || ':x' AS feature, (k % 4)::INT AS cls, CASE WHEN k % 6 = 0 THEN 0 ELSE k / 8.0 END::DOUBLE AS value FROM p WHERE k % 5 > 0""")
def weight_lines(spark, sf_dir):
    """Lines of feature, class and weight, with others between them and weights that are no numbers."""
    part, k, t, _ = _part(spark, sf_dir)
    number = F.when(k % 6 == 0, "nan").otherwise((k / 8).cast("string"))
    value = F.when(k % 5 == 0, F.concat(t, F.lit(" "), number)).otherwise(F.concat(t, F.lit(":x:"), (k % 4).cast("string"), F.lit(" "), number))
    return readers.weights(part.select(k.alias("line_no"), value.alias("value")))


@query(""" SELECT sent_id, count(*)::INT AS n, sum(len(tls))::INT AS tls, min(sl) FILTER (pos = 0) AS first_sl FROM units GROUP BY sent_id""")
def numbered_sentences(spark, sf_dir):
    """Numbered lines of units, written and read back."""
    back = readers.sentences(readers.unit_lines(fixtures.sentences(spark, sf_dir), numbered=True).select(F.lit(-1).cast("long").alias("line_no"), "value"))
    tls = F.aggregate("lus", F.lit(0), lambda a, u: a + F.size(u["tls"]))
    return back.select("sent_id", F.size("lus").alias("n"), tls.alias("tls"), F.col("lus")[0]["sl"].alias("first_sl"))


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS a, lower(p_type) AS b FROM part), w AS (SELECT k, string_split(a, ' ') AS tl, string_split(b, ' ') AS sl FROM p WHERE k % 7 > 0)
SELECT k AS line_no, i::INT AS pos, sl[i + 1] AS sl, tl[1] AS tl FROM (SELECT *, unnest(range(len(sl))) AS i FROM w)""")
def phrase_pairs(spark, sf_dir):
    """A phrase table whose source words are all linked to the first target word, with broken lines between."""
    part, k, t, n = _part(spark, sf_dir)
    links = F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split(t, " ")) - 1), lambda i: F.concat(F.lit("0-"), i.cast("string"))), " ")
    value = F.when(k % 7 == 0, F.concat(n, F.lit(" ||| "), t)).otherwise(F.concat_ws(" ||| ", n, t, links))
    table = readers.phrase_table(part.select(k.alias("line_no"), value.alias("value")))
    units = F.transform("sl", lambda s, i: F.struct(i.alias("pos"), F.lit(" ").alias("blank"), s.alias("sl"), F.array(s).alias("tls")))
    pairs = lexicon.aligned_pairs(readers.candidates(table, table.select(F.col("line_no").alias("sent_id"), units.alias("lus"))), ambiguous_only=False)
    return pairs.select("line_no", "pos", "sl", "tl")


@query("""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS a, lower(p_type) AS b FROM part)
SELECT row_number() OVER (ORDER BY k) - 1 AS line_no, len(string_split(b, ' '))::INT AS src, len(string_split(a, ' '))::INT AS tgt, (len(string_split(b, ' ')) + 1)::INT AS links FROM p""")
def aligner_records(spark, sf_dir):
    """Records of an aligner in three lines each: every source word is linked to the first target, the first one to a second place too."""
    part, k, t, n = _part(spark, sf_dir)
    word = lambda w, i: F.concat(w, F.when(i == 0, F.lit(" ({ 1 2 })")).otherwise(F.lit(" ({ 1 })")))
    source = F.concat(F.lit("NULL ({ 3 }) "), F.array_join(F.transform(F.split(t, " "), word), " "))
    lines = part.select(F.posexplode(F.array(F.concat(F.lit("# Sentence pair ("), k.cast("string"), F.lit(")")), n, source)).alias("i", "value"), k.alias("k")).select((F.col("k") * 3 + F.col("i")).alias("line_no"), "value")
    found = readers.word_alignments(lines)
    return found.select("line_no", F.size("src").alias("src"), F.size("tgt").alias("tgt"), F.size("align").alias("links"))


@query(""" SELECT sent_id, string_agg(' ^' || sl || '/' || array_to_string(tls, '/') || '$', '' ORDER BY pos) || '.' AS text FROM units GROUP BY sent_id""")
def text_round_trip(spark, sf_dir):
    """Segments parsed to units and put together again, with the text behind the last unit."""
    s = fixtures.sentences(spark, sf_dir)
    text = s.select(F.col("sent_id").alias("segment_id"), F.concat(lu.render_units(F.col("lus")), F.lit(".")).alias("text"))
    return matching.render_segments(text, matching.parse_segments(text)).withColumnRenamed("segment_id", "sent_id")


@query(""" SELECT sent_id AS line_no, count(*)::INT AS n, min(sl) FILTER (pos = 0) AS first_sl, max_by(array_to_string(tls, '/'), pos) AS last_tls FROM units GROUP BY sent_id""")
def prefixed_units(spark, sf_dir):
    """Lines of units behind other text, the last unit at the line's very end."""
    s = fixtures.sentences(spark, sf_dir)
    lines = s.select(F.col("sent_id").alias("line_no"), F.concat(F.lit("noise "), F.col("sent_id").cast("string"), F.lit("]\t"), lu.render_units(F.col("lus"))).alias("value"))
    back = readers.prefixed_units(lines)
    return back.select("line_no", F.size("lus").alias("n"), F.col("lus")[0]["sl"].alias("first_sl"), F.array_join(F.element_at("lus", -1)["tls"], "/").alias("last_tls"))
