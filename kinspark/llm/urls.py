"""URL filter: allow and block rules, and a character language-model ratio for the rest.

Two variable-order Markov models over characters, of URLs that the rules accept
and of those they reject, give each character a probability from its two
predecessors, smoothed towards one predecessor, none, and the alphabet. A URL no
rule fits is blocked where its mean log-likelihood difference falls below a
threshold: the score bin with the least sum of
both error rates, the lowest on ties. The models are counted from three quarters of the rule-judged URLs, by a hash of the URL,
and the threshold is calibrated on the last.

URLs are mapped to ``ALPHABET`` (digits become 0, anything else *), so there are at
most 39 ** 3 = 59,319 trigrams whatever the input: that bounds what the driver holds, and the
array literal by which every URL is scored in its own row, without a join. Only DataFrame functions are used.

A null url has empty host and path, no rule and verdict block. An empty url has
nothing to score and is allowed, as is every url no rule fits while either model or the calibration lacks examples.
Repeated rows get equal verdicts, each row its own; urls of any length are scored whole. An empty table gives no rows. Only page_id and
url are read, so other columns of any name don't matter. Of rules of
equal length the smaller string wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: The rules, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./?#=&_:-^$*"
#: Weight of the shorter context, as a count; width of the bins of scores.
SMOOTH, BIN = 4.0, 0.02
#: Differences are rounded to nine places, and summed as whole numbers of this many to one.
UNIT = 10**9


def parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, start = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null. Rules are few and become one expression."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    found = [F.when(fits(r, host, path), F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))) for v, r in order]
    return F.coalesce(*found, F.lit(None).cast("struct<verdict:string,rule:string>"))


def mapped(url: Column) -> Column:
    """The URL in the models' alphabet, with two starts and an end."""
    s = F.regexp_replace(lower_ascii(url), "[0-9]", "0")
    return F.concat(F.lit("^^"), F.regexp_replace(s, "[^a-z0./?#=&_:-]", "*"), F.lit("$"))


def trigrams(df: DataFrame, *keep: str) -> DataFrame:
    # Letters first: a place in a string is counted from its beginning, one in an array is not.
    letters = df.select(*keep, F.split("s", "").alias("letters"))
    grams = F.transform(F.sequence(F.lit(0), F.size("letters") - 3), lambda i: F.concat(F.get("letters", i), F.get("letters", i + 1), F.get("letters", i + 2)))
    return letters.select(*keep, F.explode(grams).alias("g"))


def held_back(url: Column) -> Column:
    """Whether a rule-judged URL calibrates rather than teaches: a quarter of them."""
    return F.substring(F.md5(url.cast("binary")), 1, 1) < "4"


def model(judged: DataFrame) -> DataFrame:
    """g -> d, the difference of the two log-probabilities, for every trigram of any URL; at most len(ALPHABET) ** 3 rows.

    ``judged`` has s (mapped) and verdict (null where no rule fits, or the URL does not teach).
    """
    one = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    counts = trigrams(judged, "verdict").groupBy("g").agg(F.coalesce(one("allow"), F.lit(0)).alias("a"), F.coalesce(one("block"), F.lit(0)).alias("b"))
    c = F.col("g")
    counts = counts.select("*", c.substr(1, 2).alias("g12"), c.substr(2, 2).alias("g23"), c.substr(2, 1).alias("g2"), c.substr(3, 1).alias("g3"))
    # What follows "^^" starts a URL; as a character, "^" is never predicted.
    total = counts.agg(F.sum("a").alias("a_all"), F.sum("b").alias("b_all"))
    for key in ("g12", "g23", "g2", "g3"):
        w = W.partitionBy(key)
        counts = counts.select("*", F.sum("a").over(w).alias(f"a_{key}"), F.sum("b").over(w).alias(f"b_{key}"))
    counts = counts.join(F.broadcast(total))

    def log_p(x: str) -> Column:
        n = lambda k: F.col(f"{x}_{k}")
        p0 = (n("g3") + SMOOTH / len(ALPHABET)) / (n("all") + SMOOTH)
        p1 = (n("g23") + SMOOTH * p0) / (n("g2") + SMOOTH)
        return F.log((F.col(x) + SMOOTH * p1) / (n("g12") + SMOOTH))

    return counts.select("g", F.round(log_p("a") - log_p("b"), 9).alias("d"))


def scored(rows: DataFrame, differences: dict[str, float]) -> DataFrame:
    """With ``score``, the mean difference over the trigrams of s, from an array with a place for every possible one."""
    size, table = len(ALPHABET), [0] * len(ALPHABET) ** 3
    for g, d in differences.items():
        i, j, k = map(ALPHABET.index, g)
        table[(i * size + j) * size + k] = round(d * UNIT)
    array = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    codes = F.transform(F.split("s", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    places = F.transform(F.sequence(F.lit(0), F.size("codes") - 3), lambda i: (F.get("codes", i) * size + F.get("codes", i + 1)) * size + F.get("codes", i + 2))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda a, i: a + F.get(array, i))
    mean = F.round(total.cast("double") / UNIT / F.size("places"), 9)
    return rows.withColumn("codes", codes).withColumn("places", places).withColumn("score", mean).drop("codes", "places")


def calibrated(rows: DataFrame) -> DataFrame:
    """One row: the threshold. ``rows`` has rule_verdict (null where no rule fits, or the URL does not calibrate) and bin (an integer)."""
    known = rows.where(F.col("rule_verdict").isNotNull())
    one = lambda v: F.sum((F.col("rule_verdict") == v).cast("long"))
    bins = known.groupBy("bin").agg(one("allow").alias("a"), one("block").alias("b"))  # a few hundred bins
    before, all_ = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    lost = F.coalesce(F.sum("a").over(before), F.lit(0)) / F.sum("a").over(all_)
    let = F.sum("b").over(W.orderBy("bin").rowsBetween(0, W.unboundedFollowing)) / F.sum("b").over(all_)
    rates = bins.select("bin", lost.alias("lost"), let.alias("let"), F.sum("a").over(all_).alias("n_a"), F.sum("b").over(all_).alias("n_b"))
    rates = rates.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return rates.agg(F.min_by("bin", F.struct(F.round(F.col("lost") + F.col("let"), 9), "bin")).alias("threshold"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, with the score and the threshold."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    s = F.coalesce(mapped(F.col("url")), F.lit("^^$"))
    rows = rows.select("page_id", "url", "host", "path", by_rules(F.col("host"), F.col("path"), rules).alias("r"), s.alias("s"), held_back(F.col("url")).alias("held"))
    rows = rows.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"), "held", "s")
    grams = model(rows.select("s", F.when(~F.col("held"), F.col("rule_verdict")).alias("verdict")))
    differences = {r["g"]: r["d"] for r in grams.collect()}  # bounded by the alphabet
    each = scored(rows, differences).withColumn("bin", F.floor(F.col("score") / BIN)).drop("s")
    each = stored(each.withColumn("calibrates", F.when(F.col("held"), F.col("rule_verdict"))), "url-scores")
    out = each.join(F.broadcast(calibrated(each.select("bin", F.col("calibrates").alias("rule_verdict")))))
    method = F.when(F.col("url").isNull(), "block").when((F.col("url") != "") & (F.col("bin") < F.col("threshold")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score", (F.col("threshold") * BIN).alias("threshold"))


def verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages).drop("score", "threshold")


#: The same rows from DuckDB: the rules, both models, the calibration and the verdicts.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT row_number() OVER () AS rid, page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(kind, rule) AS (
  VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), fitting AS (
  SELECT rid, arg_max(struct_pack(kind := kind, rule := rule), length(rule)) AS r FROM split, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY rid
), judged AS (
  SELECT s.*, f.r.rule AS rule, f.r.kind AS kind, substr(md5(url), 1, 1) < '4' AS held,
    '^^' || coalesce(regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0./?#=&_:-]', '*', 'g'), '') || '$' AS s
  FROM split s LEFT JOIN fitting f USING (rid)
), grams AS (
  SELECT rid, CASE WHEN NOT held THEN kind END AS kind, substr(s, i, 3) AS g FROM (SELECT rid, kind, held, s, unnest(range(1, length(s) - 1)) AS i FROM judged)
), counts AS (
  SELECT g, count(*) FILTER (WHERE kind = 'allow')::DOUBLE AS a, count(*) FILTER (WHERE kind = 'block')::DOUBLE AS b FROM grams GROUP BY g
), sums AS (
  SELECT g, a, b,
    sum(a) OVER (PARTITION BY substr(g, 1, 2)) AS a12, sum(b) OVER (PARTITION BY substr(g, 1, 2)) AS b12,
    sum(a) OVER (PARTITION BY substr(g, 2, 2)) AS a23, sum(b) OVER (PARTITION BY substr(g, 2, 2)) AS b23,
    sum(a) OVER (PARTITION BY substr(g, 2, 1)) AS a2, sum(b) OVER (PARTITION BY substr(g, 2, 1)) AS b2,
    sum(a) OVER (PARTITION BY substr(g, 3, 1)) AS a3, sum(b) OVER (PARTITION BY substr(g, 3, 1)) AS b3,
    sum(a) OVER () AS an, sum(b) OVER () AS bn
  FROM counts
), model AS (
  SELECT g, round(
    ln((a + 4 * ((a23 + 4 * ((a3 + 4.0::DOUBLE / 39) / (an + 4))) / (a2 + 4))) / (a12 + 4))
    - ln((b + 4 * ((b23 + 4 * ((b3 + 4.0::DOUBLE / 39) / (bn + 4))) / (b2 + 4))) / (b12 + 4)), 9) AS d
  FROM sums
), scored AS (
  SELECT rid, floor(round((sum(d::DECIMAL(20, 9))::DOUBLE / count(*)), 9) / 0.02::DOUBLE) AS bin FROM grams JOIN model USING (g) GROUP BY rid
), bins AS (
  SELECT bin, count(*) FILTER (WHERE kind = 'allow') AS a, count(*) FILTER (WHERE kind = 'block') AS b
  FROM scored JOIN judged USING (rid) WHERE kind IS NOT NULL AND held GROUP BY bin
), rates AS (
  SELECT bin, round(coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(a) OVER ()
    + sum(b) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE / sum(b) OVER (), 9) AS wrong,
    sum(a) OVER () AS na, sum(b) OVER () AS nb
  FROM bins
), threshold AS (
  SELECT (SELECT bin FROM rates WHERE na > 0 AND nb > 0 ORDER BY wrong, bin LIMIT 1) AS t
)
SELECT page_id, host, path, rule,
  coalesce(kind, CASE WHEN url IS NULL OR (url <> '' AND bin < t) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN scored USING (rid), threshold
"""
