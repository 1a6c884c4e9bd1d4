"""SQL for DuckDB of what the operators compute, where SQL expresses it on whole tables."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"

#: The least number that each node reaches over links (x, y), for nodes (id); both as CTEs.
_REACH = """e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(id, far) AS (SELECT id, id FROM nodes UNION SELECT reach.id, e.y FROM reach JOIN e ON reach.far = e.x),
comp AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)"""

MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
wd AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
two AS (SELECT doc_id, n, x || coalesce(' ' || lead(x) OVER (PARTITION BY doc_id ORDER BY i), '') AS g, i FROM wd),
sh AS (SELECT DISTINCT doc_id, g FROM two WHERE i < n OR n = 1),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN size p ON x = p.doc_id JOIN size q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, coalesce(size.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN size USING (doc_id) JOIN comp ON comp.id = doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON x = vec_id JOIN comp ON comp.id = vec_id"""

BASE_COUNTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
wd AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
chars AS (SELECT doc_id, sum(length(x)) AS n FROM wd GROUP BY 1),
five AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v || ' ' || lead(x, 3) OVER v || ' ' || lead(x, 4) OVER v AS g FROM wd WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, g FROM five WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM five JOIN twice USING (doc_id, g), range(0, 5) t(o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(chars.n, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN chars USING (doc_id) LEFT JOIN rep USING (doc_id)"""

TARGETS = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
a AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
f AS (SELECT arg_min(room / weights, source_size / weight) AS level FROM a WHERE weight * room / weights <= 2 * source_size)
SELECT doc_id, size, source_size, round(least(2.0::DOUBLE * source_size, coalesce(weight * level, 2.0::DOUBLE * source_size)), 4) AS target FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source, f"""
