"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f"coalesce({column}, '')")}, '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP8 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
spots AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)),
hits AS (SELECT rid, size, i, item FROM spots JOIN wins USING (size, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, size, i FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN named m USING (rid)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' short' ELSE '' END AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(e.doc_id) FROM reach r JOIN d e ON e.rid = r.b WHERE r.a = d.rid) AS component_id FROM d LEFT JOIN n USING (rid)"""

OP11 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM r a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("text", _TERM)} AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_words("text", _TERM)} AS w FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
asked AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n),
scored AS (SELECT item, item_id, doc_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (t) JOIN df USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""
