"""SQL for DuckDB that gives the rows of those operators that SQL can express."""

from __future__ import annotations

from .quality import CHAR_LIMIT, COMMON, LEAST_CHARS, LEAST_WORDS, WORD_LIMIT

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

MINHASH = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUBSTRING = f"""
WITH words AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE f < doc_id),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""

NORMAL = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAM = f"""
WITH words AS (SELECT doc_id, {NORMAL} AS w FROM documents),
items AS (SELECT item_id, {NORMAL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def without(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"


TERM = "(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
base AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {without('[#*$%&|<>]')}::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, length(t) AS n_chars,
    {without('[a-z]')} AS lower, {without('[A-Z]')} AS upper, {without('[0-9]')} AS digit, {without(r'[\x20\x09-\x0D]')} AS space, {without(r'[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')} AS sign
  FROM docs
),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (doc_id, s)) GROUP BY doc_id),
keyed AS (SELECT *, unnest(list_distinct([lang, ''])) AS ref FROM base),
sums AS (
  SELECT ref, sum(lower) AS lower, sum(upper) AS upper, sum(digit) AS digit, sum(space) AS space, sum(sign) AS sign, sum(n_chars) AS total FROM keyed GROUP BY ref
),
each AS (SELECT doc_id, lang, unnest(w) AS word FROM docs),
counted AS (SELECT unnest(list_distinct([lang, ''])) AS ref, word FROM each),
top AS (SELECT ref, word, count(*) AS n FROM counted GROUP BY ref, word HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) <= {COMMON}),
refs AS (SELECT ref, word, n::DOUBLE / sum(n) OVER (PARTITION BY ref) AS q FROM top),
vocabulary AS (SELECT DISTINCT l.lang, r.word FROM (SELECT DISTINCT lang FROM docs) l JOIN refs r ON r.ref IN (l.lang, '')),
own AS (SELECT doc_id, lang, word, count(*) AS c FROM each JOIN vocabulary USING (lang, word) GROUP BY ALL),
shares AS (SELECT doc_id, o.word, c::DOUBLE / sum(c) OVER (PARTITION BY doc_id) AS p, coalesce(q, 0) AS q FROM own o LEFT JOIN refs r ON r.ref = o.lang AND r.word = o.word),
by_words AS (SELECT doc_id, sqrt(greatest(0, least(1, (1 - sum(q) + sum({TERM})) / 2))) AS far FROM shares GROUP BY doc_id),
bins AS (
  SELECT doc_id, unnest([b.lower, b.upper, b.digit, b.space, b.sign, b.n_chars - b.lower - b.upper - b.digit - b.space - b.sign]) / b.n_chars::DOUBLE AS p,
    unnest([s.lower, s.upper, s.digit, s.space, s.sign, s.total - s.lower - s.upper - s.digit - s.space - s.sign]) / s.total::DOUBLE AS q
  FROM base b JOIN sums s ON s.ref = b.lang WHERE b.n_chars > 0
),
by_chars AS (SELECT doc_id, sqrt(greatest(0, least(1, sum({TERM}) / 2))) AS far FROM bins GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words)
    AND NOT (n_chars >= {LEAST_CHARS} AND coalesce(c.far, 0) > {CHAR_LIMIT}::DOUBLE) AND NOT (n_words >= {LEAST_WORDS} AND b.lang IN (SELECT ref FROM refs) AND coalesce(x.far, 1) > {WORD_LIMIT}::DOUBLE) AS kept
FROM base b LEFT JOIN repeated r USING (doc_id) LEFT JOIN by_chars c USING (doc_id) LEFT JOIN by_words x USING (doc_id)
"""
