"""DuckDB SQL for the queries that SQL can express on whole tables.

The other queries rest on tokenizers, models, alignment, differencing or
approximate search; tests/llm holds them against their libraries, brute force
or held-out labels.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op6_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS first FROM sets
  UNION
  SELECT l.y, r.first FROM reached r JOIN links l ON l.x = r.doc_id WHERE r.first < l.y)
SELECT s.doc_id, len(s.s)::INTEGER AS n_shingles, min(r.first) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s"""


SQL["op13_phrases"] = r"""
WITH words AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, range(1, 5) AS sizes(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, size), lambda s: list_transform(range(1, size - s + 2),
    lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase
  FROM (SELECT lang, size, f, string_split(phrase, ' ') AS w FROM f WHERE size > 2)),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
