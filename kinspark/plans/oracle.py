"""SQL for DuckDB that gives the rows of the registered queries, as one chain of common tables over documents."""

from __future__ import annotations

from ..config import SMALL, THRESHOLDS
from ..functions.wordlists import ADDRESS_FORMS, LEGAL, NAME_FORMS

P = SMALL


def values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


KEPT = r"0-9a-z\x{0900}-\x{0D7F}"


def punct(c: str) -> str:
    return f"trim(regexp_replace({fold(c)}, '[^{KEPT}]+', ' ', 'g'))"


def alnum(c: str) -> str:
    return f"regexp_replace({fold(c)}, '[^{KEPT}]+', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def ratio_of(a: str, b: str) -> str:
    """A name for the pair of strings; ``LCS`` gives its common length."""
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * lcs.n / (length({a}) + length({b})) END"


CHAIN = rf"""
WITH RECURSIVE name_forms(k, v) AS (VALUES {values(NAME_FORMS.items())}),
address_forms(k, v) AS (VALUES {values(ADDRESS_FORMS.items())}),
forms AS MATERIALIZED (SELECT (SELECT map(list(k), list(v)) FROM name_forms) AS nf, (SELECT map(list(k), list(v)) FROM address_forms) AS af),
words AS MATERIALIZED (SELECT doc_id AS entity_id, doc_id % 20 AS part, lang AS country, string_split({punct("coalesce(text, '')")}, ' ') AS w FROM documents),
records AS MATERIALIZED (
  SELECT entity_id, (CASE WHEN part < 8 THEN 1 WHEN part < 14 THEN 2 ELSE 3 END)::BIGINT AS src, country,
    array_to_string(w[1:6], ' ') AS name, array_to_string(w[7:24], ' ') AS address,
    CASE WHEN len(w) >= 34 THEN array_to_string(w[25:34], ' ') END AS evidence
  FROM words
),
normal AS (SELECT entity_id, src, country, name, address, {punct("name")} AS nm, {punct("address")} AS ad FROM records),
mapped AS (
  SELECT n.*, list_transform({words("nm")}, lambda t: coalesce(nf[t], t)) AS names, list_transform({words("ad")}, lambda t: coalesce(af[t], t)) AS addresses
  FROM normal n, forms
),
cored AS (SELECT *, list_filter(names, lambda t: NOT list_contains([{", ".join("'" + x + "'" for x in LEGAL)}], t)) AS core FROM mapped),
listed AS (
  SELECT *, CASE WHEN len(core) > 0 THEN core ELSE names END AS kept,
    list_sort(list_distinct(regexp_extract_all(array_to_string(addresses, ' '), '[0-9]+'))) AS digits
  FROM cored
),
views AS MATERIALIZED (
  SELECT entity_id, src, country, name, address, nm, ad, array_to_string(kept, ' ') AS nmc, array_to_string(addresses, ' ') AS adn,
    array_to_string(list_sort(list_distinct(kept)), ' ') AS nms, array_to_string(list_sort(list_distinct(addresses)), ' ') AS ads,
    array_to_string(digits, ' ') AS num, array_to_string(list_filter(digits, lambda x: length(x) >= 5), ' ') AS zip,
    length(nm)::BIGINT AS nlen, length(ad)::BIGINT AS alen, len(kept)::BIGINT AS ntn, len(addresses)::BIGINT AS nta,
    regexp_matches(name, '[\x{{0900}}-\x{{097F}}]')::BIGINT AS indic
  FROM listed
),
truth AS MATERIALIZED (
  SELECT a.entity_id AS s1_id, b.src AS tgt_src, b.entity_id AS tgt_id
  FROM records a JOIN records b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.evidence = b.evidence
),
tokens AS MATERIALIZED (
  SELECT src, country, entity_id, 0 AS field, unnest(list_distinct({words("nmc")})) AS token FROM views
  UNION ALL SELECT src, country, entity_id, 1, unnest(list_distinct({words("adn")})) FROM views
),
sizes AS (SELECT src, country, count(*) AS n FROM views WHERE src > 1 GROUP BY ALL),
freq AS MATERIALIZED (SELECT src, country, token, count(*) AS df FROM tokens WHERE src > 1 GROUP BY ALL),
idfs AS MATERIALIZED (SELECT src, country, token, df, n, ln(1 + n::DOUBLE / df) AS idf FROM freq JOIN sizes USING (src, country)),
lengths AS (SELECT src, country, entity_id, sqrt(sum(idf)) AS norm FROM tokens JOIN idfs USING (src, country, token) GROUP BY ALL),
postings AS MATERIALIZED (
  SELECT src, country, token, entity_id AS tgt_id, sum(idf / greatest(norm, 1e-9)) AS w
  FROM tokens JOIN idfs USING (src, country, token) JOIN lengths USING (src, country, entity_id) GROUP BY ALL
),
rarest AS MATERIALIZED (
  SELECT v.src, v.country, v.entity_id, coalesce(min(df), 0)::BIGINT AS mindf,
    coalesce(sum((field = 0)::INT), 0)::BIGINT AS n_name, coalesce(sum((field = 1)::INT), 0)::BIGINT AS n_addr
  FROM views v LEFT JOIN (tokens t JOIN freq f USING (src, country, token)) ON v.entity_id = t.entity_id AND v.src = t.src
  WHERE v.src > 1 GROUP BY ALL
),
ranked AS MATERIALIZED (
  SELECT t.entity_id AS s1_id, i.src, i.country, t.field, t.token, i.df, i.n, CASE WHEN t.field = 0 THEN 1.0 ELSE {P.w_addr} END::DOUBLE AS fw,
    row_number() OVER o - 1 AS pos, (sum(i.df) OVER o - i.df)::BIGINT AS before
  FROM tokens t JOIN idfs i ON t.src = 1 AND t.country = i.country AND t.token = i.token
  WINDOW o AS (PARTITION BY t.entity_id, i.src ORDER BY i.df, t.field, t.token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
prefix AS (SELECT * FROM ranked WHERE pos < {P.kq} AND (pos = 0 OR (df <= {P.dfmax} AND before < {P.budget}))),
raws AS (SELECT *, fw * ln(1 + n::DOUBLE / df) AS raw FROM prefix),
queries AS MATERIALIZED (SELECT * EXCLUDE (raw), raw / greatest(sqrt(sum(raw) OVER (PARTITION BY s1_id, src)), 1e-9) AS v FROM raws),
scores AS MATERIALIZED (
  SELECT q.s1_id, q.src, q.country, p.tgt_id, round(sum(q.v * p.w), 6) AS score
  FROM queries q JOIN postings p USING (src, country, token) GROUP BY ALL
),
candidates AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, tgt_id) - 1 AS rank FROM scores
  QUALIFY row_number() OVER (PARTITION BY s1_id, src ORDER BY score DESC, tgt_id) <= {P.topk}
),
context AS (
  SELECT s1_id, src, country, tgt_id, score, rank, rank::DOUBLE / {P.topk} AS rank_n,
    score / greatest(max(score) OVER o, 1e-9) AS score_ratio, max(score) OVER o - score AS score_margin,
    (count(*) OVER o)::DOUBLE / {2 * P.topk} AS ncand_n, (src = 3)::BIGINT AS is_s3
  FROM candidates WINDOW o AS (PARTITION BY s1_id, src)
),
pairs AS MATERIALIZED (
  SELECT c.*, a.nm AS a_nm, b.nm AS b_nm, a.ad AS a_ad, b.ad AS b_ad, a.nmc AS a_nmc, b.nmc AS b_nmc, a.adn AS a_adn, b.adn AS b_adn,
    a.nms AS a_nms, b.nms AS b_nms, a.ads AS a_ads, b.ads AS b_ads, a.num AS a_num, b.num AS b_num, a.zip AS a_zip, b.zip AS b_zip,
    a.nlen AS a_nlen, b.nlen AS b_nlen, a.alen AS a_alen, b.alen AS b_alen, a.ntn AS a_ntn, b.ntn AS b_ntn, a.nta AS a_nta, b.nta AS b_nta,
    a.indic AS a_indic, b.indic AS b_indic,
    CASE WHEN greatest(a.nlen, b.nlen) > 0 THEN least(a.nlen, b.nlen)::DOUBLE / greatest(a.nlen, b.nlen) ELSE 1 END AS nm_len_ratio,
    CASE WHEN greatest(a.alen, b.alen) > 0 THEN least(a.alen, b.alen)::DOUBLE / greatest(a.alen, b.alen) ELSE 1 END AS ad_len_ratio,
    CASE WHEN greatest(a.ntn, b.ntn) > 0 THEN least(a.ntn, b.ntn)::DOUBLE / greatest(a.ntn, b.ntn) ELSE 1 END AS nm_tok_ratio,
    CASE WHEN greatest(a.nta, b.nta) > 0 THEN least(a.nta, b.nta)::DOUBLE / greatest(a.nta, b.nta) ELSE 1 END AS ad_tok_ratio,
    r.mindf AS b_mindf,
    EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = c.s1_id AND t.tgt_id = c.tgt_id)::BIGINT AS label
  FROM context c JOIN views a ON a.entity_id = c.s1_id JOIN views b ON b.entity_id = c.tgt_id
    JOIN rarest r ON r.src = c.src AND r.entity_id = c.tgt_id
),
closed AS MATERIALIZED (SELECT *, round(0.5::DOUBLE * score_ratio + 0.25::DOUBLE * nm_len_ratio + 0.25::DOUBLE * ad_tok_ratio, 6) AS p FROM pairs),
entities AS (SELECT entity_id AS s1_id, country FROM views WHERE src = 1),
owners AS (SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY p DESC, s1_id) = 1)
"""


def counts(pairs: str, name: str = "counts") -> str:
    """A common table (s1_id, npred, tp, ntrue) of the pairs of a subquery."""
    return f"""{name} AS (
  SELECT e.s1_id, (SELECT count(DISTINCT tgt_id) FROM ({pairs}) x WHERE x.s1_id = e.s1_id) AS npred,
    (SELECT count(DISTINCT x.tgt_id) FROM ({pairs}) x JOIN truth t ON t.s1_id = x.s1_id AND t.tgt_id = x.tgt_id WHERE x.s1_id = e.s1_id) AS tp,
    (SELECT count(DISTINCT tgt_id) FROM truth t WHERE t.s1_id = e.s1_id) AS ntrue
  FROM entities e
)"""


F_HALF = "CASE WHEN npred = 0 AND ntrue = 0 THEN 1.0 WHEN npred = 0 OR ntrue = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp::DOUBLE / npred) * (tp::DOUBLE / ntrue) / (0.25 * (tp::DOUBLE / npred) + tp::DOUBLE / ntrue) END::DOUBLE"
SUMMARY = f"""round(avg({F_HALF}), 6) AS f05_macro, round(sum(tp)::DOUBLE / greatest(sum(npred), 1), 6) AS precision_micro,
  round(sum(tp)::DOUBLE / greatest(sum(ntrue), 1), 6) AS recall_micro,
  round(count(*) FILTER (npred = 0 AND ntrue = 0)::DOUBLE / greatest(count(*) FILTER (ntrue = 0), 1), 6) AS singleton_recall,
  round(count(*) FILTER (npred = 0 AND ntrue = 0)::DOUBLE / greatest(count(*) FILTER (npred = 0), 1), 6) AS singleton_precision,
  round(sum(npred)::DOUBLE / count(*), 6) AS pred_per_entity, round(count(*) FILTER (npred = 0)::DOUBLE / count(*), 6) AS empty_rate, count(*) AS n_entities"""


def levels() -> str:
    return ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)


def lcs(kind: str) -> str:
    """Common tables ``strings`` (a, b) of all pairs of a view and ``lcs`` (a, b, n): the row of the subsequence table, letter by letter."""
    return f"""strings AS (SELECT DISTINCT {kind.format("a")} AS a, {kind.format("b")} AS b FROM pairs),
steps AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS line FROM strings
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN substr(a, i + 1, 1) = substr(b, j::BIGINT, 1) THEN line[j] + 1 ELSE line[j + 1] END]),
    lambda acc, x: list_append(acc, greatest(acc[-1], x[1])), [0::BIGINT])
  FROM steps WHERE i < length(a)
),
lcs AS (SELECT a, b, line[-1] AS n FROM steps WHERE i = length(a))"""
