"""The SQL twins of the training-data queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _classes(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``classes``: the smallest node that each node of ``nodes`` (id) reaches."""
    return f"""edges AS (SELECT x AS a, y AS b FROM {links} UNION SELECT y, x FROM {links}),
reach(id, r) AS (SELECT id, id FROM {nodes} UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.id),
classes AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""


OP2 = f"""WITH RECURSIVE
good AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS x, q.id AS y FROM good p JOIN good q ON p.label = q.label AND p.id < q.id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_classes("nodes", "links")},
degree AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM classes LEFT JOIN degree USING (id)"""

OP5 = """WITH RECURSIVE
turns AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
lines AS (SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\\x09-\\x0D\\x20]+', ' ', 'g'))) AS norm FROM turns),
own AS (SELECT * FROM lines WHERE norm <> ''),
origins AS (SELECT conv_id, norm, min(turn) AS origin FROM own GROUP BY ALL),
quoted AS (SELECT m.conv_id, m.turn, m.turn - l.turn AS level, norm FROM turns m JOIN own l
  ON l.conv_id = m.conv_id AND l.turn IN (m.turn - 1, m.turn - 2)),
found AS (SELECT q.conv_id, q.turn, level, origin, count(*) AS n FROM quoted q JOIN origins USING (conv_id, norm) GROUP BY ALL),
best AS (SELECT conv_id, turn, origin AS parent FROM found
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
totals AS (SELECT conv_id, turn, max(level) AS levels, sum(n)::BIGINT AS quoted FROM found GROUP BY ALL),
walk(conv_id, turn, here, depth) AS (SELECT conv_id, turn, turn, 0 FROM turns
  UNION ALL SELECT w.conv_id, w.turn, b.parent, w.depth + 1 FROM walk w JOIN best b ON b.conv_id = w.conv_id AND b.turn = w.here),
roots AS (SELECT conv_id, turn, arg_max(here, depth) AS root, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(levels, 0)::INTEGER AS levels, coalesce(quoted, 0) AS quoted, coalesce(quoted, 0) AS linked,
  parent, root, depth::INTEGER AS depth, sha256(text) AS clean_sha256
FROM turns t JOIN roots USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn) LEFT JOIN totals USING (conv_id, turn)"""

OP7 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM later, range(20) t(o)),
words AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s GROUP BY source),
caps AS (SELECT *, [3, 1, 2][r % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
steps AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM src)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM caps),
level AS (SELECT rest / open AS v FROM steps WHERE cap / weight >= rest / open ORDER BY cap / weight, r LIMIT 1),
goals AS (SELECT source, source_size, least(cap, weight * v) AS target FROM caps, level),
placed AS (SELECT s.*, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(budget // source_size * size
  + greatest(0, least(size, budget - budget // source_size * source_size - ahead)) AS BIGINT) END AS taken FROM placed"""

OP10 = f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, md5(array_to_string(ws, ' ')) FROM w WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS i FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * i >= 75 * (m.n + n.n - i)),
nodes AS (SELECT doc_id AS id FROM documents),
{_classes("nodes", "links")}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM classes LEFT JOIN sizes ON doc_id = id"""



def _assigned(rows: str, books: str) -> str:
    """Each part's nearest entry, ties to the lower index."""
    return f"""SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(v) AS v
  FROM (SELECT r.vec_id, label, p, e, r.v, list_sum(list_transform(list_zip(r.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM {rows} r JOIN {books} b USING (p)) GROUP BY vec_id, label, p"""


def _op12(rounds: int = 6) -> str:
    books = "".join(
        f""",
sums{i} AS (SELECT p, e, i, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS x FROM
  (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM ({_assigned("parts", f"book{i}")})) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM book{i} b
  LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM sums{i} GROUP BY p, e) s USING (p, e))"""
        for i in range(rounds)
    )
    return f"""WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM good, range(8) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM good ORDER BY vec_id LIMIT 16)),
book0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN firsts USING (vec_id)){books},
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM book{rounds})),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM ({_assigned("parts", f"book{rounds}")}) GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""


OP13 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
fails AS (SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > first_id AS e
  FROM d JOIN firsts USING (t)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
masks AS (SELECT part, concat(if(f.A, 'A', ''), if(f.B, 'B', ''), if(f.C, 'C', ''), if(f.D, 'D', ''), if(f.E, 'E', '')) AS failed, n, good, toxic FROM cells),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
ranks AS (SELECT part, failed, n, good, toxic, o, list_min(list_transform(string_split(failed || 'z', ''), lambda x: if(x = 'z', 6, strpos(o, x)))) AS gone FROM masks, orders),
steps AS (SELECT part, o AS filter_order, step, sum(if(gone > step, n, 0)) AS kept, sum(if(gone = step, n, 0)) AS removed,
    sum(if(gone < step AND contains(failed, o[step]), n, 0)) AS redundant, sum(if(failed = o[step], n, 0)) AS unique_fails,
    sum(if(gone = step, good, 0)) AS good_lost, sum(if(gone = step, toxic, 0)) AS toxic_lost FROM ranks, range(1, 6) s(step) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM steps"""

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": OP2,
    "op5_quotation_linking": OP5,
    "op7_substring_dedup": OP7,
    "op9_source_mixing": OP9,
    "op10_ngram_jaccard_join": OP10,
    "op12_vector_code_compression": _op12(),
    "op13_filter_interaction_audit": OP13,
}
