"""DuckDB SQL for the results that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The prefix is searched turn by turn, for every pair.
OP4 = r"""
WITH a AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
g AS (SELECT *, min(conv_id) OVER (PARTITION BY turns[1]) AS first_id FROM a),
two AS (
  SELECT g.conv_id, f.conv_id AS rejected_id, g.turns AS c, f.turns AS r FROM g JOIN a f ON f.conv_id = g.first_id AND f.conv_id < g.conv_id),
s AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS said FROM g WHERE conv_id = first_id),
one AS (
  SELECT conv_id, NULL::BIGINT AS rejected_id, turns AS c,
    list_concat(list_concat(turns[:said[-1] - 1], [{'role': 'assistant', 'text': coalesce(CASE WHEN len(said) > 1 THEN turns[said[-2]].text END, CASE WHEN said[-1] > 1 THEN turns[said[-1] - 1].text END, '')}]), turns[said[-1] + 1:]) AS r
  FROM s WHERE len(said) > 0),
p AS (SELECT * FROM two UNION ALL SELECT * FROM one),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, least(len(c), len(r)))::INT AS n_common
  FROM p WHERE len(c) <> len(r) OR len(list_filter(range(1, len(c) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) > 0),
e AS (
  SELECT conv_id, rejected_id, n_common, list_transform(c[1:n_common], lambda t: {'role': replace(t.role, '<|', '< |'), 'text': replace(t.text, '<|', '< |'), 'on': t.role = 'assistant'}) AS p,
    list_transform(c[n_common + 1:], lambda t: {'role': replace(t.role, '<|', '< |'), 'text': replace(t.text, '<|', '< |'), 'on': t.role = 'assistant'}) AS c,
    list_transform(r[n_common + 1:], lambda t: {'role': replace(t.role, '<|', '< |'), 'text': replace(t.text, '<|', '< |'), 'on': t.role = 'assistant'}) AS r FROM n),
x AS (
  SELECT *, list_transform(c, lambda t: length(t.role) + length(t.text) + 13) AS cl, list_transform(r, lambda t: length(t.role) + length(t.text) + 13) AS rl FROM e)
SELECT conv_id, rejected_id, n_common,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].on), lambda i: (coalesce(list_sum(cl[:i - 1]), 0) + 5 + length(c[i].role))::BIGINT || '-' || (coalesce(list_sum(cl[:i - 1]), 0) + 12 + length(c[i].role) + length(c[i].text))::BIGINT), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].on), lambda i: (coalesce(list_sum(rl[:i - 1]), 0) + 5 + length(r[i].role))::BIGINT || '-' || (coalesce(list_sum(rl[:i - 1]), 0) + 12 + length(r[i].role) + length(r[i].text))::BIGINT), ','), '') AS rejected_spans
FROM x
"""

OP9 = rf"""
WITH b AS (
  SELECT min(item_id) AS item_id, w, len(w) AS n, least(len(w), 5) AS k
  FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0 GROUP BY w),
bs AS (
  SELECT item_id, n, k, n - k + 1 AS m, s, count(*) AS t
  FROM (SELECT item_id, n, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM b))
  GROUP BY ALL),
d AS (
  SELECT DISTINCT doc_id, md5(text) AS h, {WORDS.format("text")} AS w FROM documents),
ds AS (
  SELECT doc_id, h, size, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, h, len(w) AS size, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs))),
hits AS (
  SELECT doc_id, h, size, p, s, item_id, n, bs.k, m, t FROM ds JOIN bs USING (s, k)),
wins AS (
  SELECT DISTINCT doc_id, h, item_id, m, greatest(least(p, size - n), 0) AS start,
    greatest(least(p, size - n), 0) + least(n, size) - k AS stop FROM hits),
mins AS (
  SELECT w.doc_id, w.h, w.item_id, w.m, w.start, w.stop, x.s, least(count(*), x.t) AS c
  FROM wins w JOIN hits x ON w.doc_id IS NOT DISTINCT FROM x.doc_id AND w.h = x.h AND w.item_id = x.item_id AND x.p BETWEEN w.start AND w.stop
  GROUP BY w.doc_id, w.h, w.item_id, w.m, w.start, w.stop, x.s, x.t),
sums AS (
  SELECT doc_id, h, item_id, start, stop - start + 1 AS n_shingles, sum(c)::BIGINT AS shared,
    (m + stop - start + 1 - sum(c))::BIGINT AS total FROM mins GROUP BY doc_id, h, item_id, m, start, stop)
SELECT doc_id, item_id, start, n_shingles, shared, total, shared / total AS similarity FROM sums WHERE shared / total >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, h, item_id ORDER BY shared / total DESC, start) = 1
"""

OP8 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT row_no, vec_id, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM v),
s AS (
  SELECT q.row_no AS q_row, q.vec_id AS query_id, c.row_no AS row_no, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM (SELECT * FROM c WHERE vec_id % 50 = 0) q JOIN c ON q.d = c.d AND q.row_no <> c.row_no GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

#: Links are found through shared shingles of distinct sets, components by what each can reach.
OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT s, min(doc_id) AS node, len(s) AS k FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT node, k, unnest(s) AS x FROM n),
l AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.k, b.k) >= 85 * greatest(a.k, b.k)
  GROUP BY a.node, b.node, a.k, b.k HAVING 100 * count(*) >= 85 * (a.k + b.k - count(*))),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.root, doc_id) AS component_id, doc_id = coalesce(c.root, doc_id) AS kept
FROM s LEFT JOIN n ON s.s = n.s LEFT JOIN c ON c.node = n.node
"""

#: CRC-32 of a text's bytes: the table by its rule, then one step a byte.
CRC = r"""
crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i))"""


def crc_of(text: str) -> str:
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


#: Near words: one is the other without a code point, or both lose one at the same place and are equal.
OP12 = rf"""
WITH RECURSIVE {CRC},
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, c, {crc_of("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM r, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.cut
  UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.cut),
b AS (SELECT p.word, near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v ON v.word = p.near QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near) = 1),
f AS (SELECT v.word, v.n, CASE WHEN near_n >= 2 * v.n THEN near END AS form, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT t.word, f.form, depth + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
l AS (SELECT word, max_by(root, depth) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""


def _edit(state: str, cost: str, letter: str, put: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {put}}} END"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN k = '{initial}' AND f < 2 THEN {_edit(state, 'f', 'K', 'chr(10) || role || chr(58) || text')} END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN f < 2 THEN {_edit(state, '2 + f', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"


def _insert(state: str, role: str) -> str:
    return _edit(state, "2", "I", f"chr(10) || '{role}:'")


#: The cheapest way to each of four states, row by row; of equal costs the least audit.
OP13 = rf"""
WITH RECURSIVE {CRC},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_of("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations, crc),
g AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM o WHERE h <> 0)),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM g),
x AS (
  SELECT *, left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
      WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 1 END AS f FROM i),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate,
    count(*) FILTER (f = 1) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM x GROUP BY conv_id),
z AS (SELECT {{'c': 0, 'a': '', 't': ''}} AS none),
s AS (
  SELECT conv_id, 0::BIGINT AS i, none AS s0, CASE WHEN false THEN none END AS s1, {_insert("none", "user")} AS s2, {_insert(_insert("none", "user"), "assistant")} AS s3 FROM c, z
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, {_insert("s2", "assistant")}]) FROM (
    SELECT conv_id, i, s0, s1, s3, list_min([s2, {_insert("s0", "user")}, {_insert("s1", "user")}, {_insert("s3", "user")}]) AS s2 FROM (
      SELECT s.conv_id, x.i, {_edit("s0", "3", "D", "''")} AS s0,
        list_min([{_edit("s1", "3", "D", "''")}, {_kept("s0", "s")}]) AS s1,
        list_min([{_edit("s2", "3", "D", "''")}, {_kept("s0", "u")}, {_kept("s1", "u")}, {_kept("s3", "u")}, {_rerole("s0", "user")}, {_rerole("s1", "user")}, {_rerole("s3", "user")}]) AS s2,
        list_min([{_edit("s3", "3", "D", "''")}, {_kept("s2", "a")}, {_rerole("s2", "assistant")}]) AS s3
      FROM s JOIN x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.i = s.i + 1))),
e AS (SELECT c.*, list_min([s0, s3]) AS best FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.last)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN e ON q.conv_id IS NOT DISTINCT FROM e.conv_id
"""
