"""Profiles of records, of the truth, and of true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def field_stats(records: DataFrame) -> DataFrame:
    """One row: sizes, empty fields, lengths, repeated ids."""
    n = F.count(F.lit(1))
    part = lambda c: X.percent(F.sum((F.length(c) == 0).cast("long")), n)
    q = lambda c, p: F.floor(F.percentile(F.length(c), F.lit(p))).cast("long")
    return records.agg(
        n.alias("n"), part("name").alias("empty_name"), part("address").alias("empty_addr"),
        F.round(F.avg(F.length("name")), 1).alias("name_len_mean"), q("name", 0.5).alias("name_len_p50"), q("name", 0.95).alias("name_len_p95"),
        F.round(F.avg(F.length("address")), 1).alias("addr_len_mean"), q("address", 0.5).alias("addr_len_p50"), q("address", 0.95).alias("addr_len_p95"),
        (n - F.countDistinct("entity_id")).alias("dup_entity_id"),
    )


def country_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country")


def script_mix(records: DataFrame) -> DataFrame:
    """Share of each script by country, of all records."""
    total = records.agg(F.count(F.lit(1)).alias("total"))
    n = records.groupBy("country", X.script_of(F.col("name")).alias("script")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(total).select("country", "script", "n", X.percent(F.col("n"), F.col("total")).alias("pct"))


def duplicate_rates(records: DataFrame) -> DataFrame:
    """Exact duplicates of name, address and country, and collisions of names alone."""
    key, name = X.duplicate_key(F.col("name"), F.col("address"), F.col("country")), X.alnum(F.col("name"))
    rows = records.select(key.alias("k"), name.alias("m"))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), X.percent(n - F.countDistinct("k"), n).alias("exact_dup_pct"), X.percent(n - F.countDistinct("m"), n).alias("name_collision_pct"))


def truth_coverage(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Whether the truth covers exactly the entities (both have s1_id)."""
    t, e = truth.select("s1_id").distinct(), entities.select("s1_id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = count(t, "unique").crossJoin(count(t.join(e, "s1_id", "left_anti"), "unknown")).crossJoin(count(e.join(t, "s1_id", "left_anti"), "uncovered"))
    return both.withColumn("covers_all", (F.col("unknown") == 0) & (F.col("uncovered") == 0))


def match_counts(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, country, n, n2, n3) of every entity."""
    per = truth.where("tgt_id IS NOT NULL").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("tgt_src") == s).cast("long")).alias(f"n{s}") for s in (2, 3)))
    return entities.join(per, "s1_id", "left").na.fill(0, ["n", "n2", "n3"])


def match_histogram(counts: DataFrame, first: int = 15) -> DataFrame:
    return counts.groupBy(F.col("n").alias("matches")).agg(F.count(F.lit(1)).alias("entities")).orderBy("matches").limit(first)


def match_stats(counts: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    part = lambda c: X.percent(F.sum(c.cast("long")), n)
    some = lambda c: F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 3)
    c = F.col
    return counts.agg(
        n.alias("n_s1"), part(c("n") == 0).alias("zero_pct"), part(c("n") == 1).alias("one_pct"), part(c("n") > 1).alias("multi_pct"),
        F.round(F.avg("n"), 3).alias("mean"), some("n").alias("mean_nonzero"), F.floor(F.percentile("n", F.lit(0.95))).cast("long").alias("p95"), F.max("n").alias("max"),
        F.sum("n").alias("pairs"), F.sum("n2").alias("s2_pairs"), F.sum("n3").alias("s3_pairs"), part(c("n2") > 0).alias("has_s2_pct"), part(c("n3") > 0).alias("has_s3_pct"),
        some("n2").alias("s2_nonzero"), some("n3").alias("s3_nonzero"),
    )


def match_by_country(counts: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return counts.groupBy("country").agg(
        n.alias("n_s1"), X.percent(F.sum((F.col("n") == 0).cast("long")), n).alias("zero_pct"), F.round(F.sum("n2") / n, 3).alias("s2_per_s1"), F.round(F.sum("n3") / n, 3).alias("s3_per_s1")
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def true_pairs(records: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs with the token overlap of name and address and what else they share. Records have name, address and views."""
    cols = ("name", "address", "country", "nmc", "adn")
    a = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = records.where("src > 1").select(F.col("entity_id").alias("tgt_id"), *(F.col(c).alias(f"b_{c}") for c in cols))
    pairs = truth.join(a, "s1_id").join(b, "tgt_id")
    t = lambda c: X.tokens(F.col(c))
    return pairs.select(
        "s1_id", "tgt_id", "tgt_src",
        jaccard(t("a_nmc"), t("b_nmc")).alias("name_jaccard"),
        jaccard(t("a_adn"), t("b_adn")).alias("addr_jaccard"),
        (X.alnum(F.col("a_name")) == X.alnum(F.col("b_name"))).alias("name_equal"),
        (F.col("a_country") == F.col("b_country")).alias("country_equal"),
        F.concat(X.script_of(F.col("a_name")), F.lit("->"), X.script_of(F.col("b_name"))).alias("scripts"),
        ((F.col("a_address") == "") | (F.col("b_address") == "")).alias("addr_empty"),
        F.arrays_overlap(t("a_nmc"), t("b_nmc")).alias("name_share"),
        F.arrays_overlap(t("a_adn"), t("b_adn")).alias("addr_share"),
    )


def pair_overlap(pairs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 3)
    return pairs.agg(
        n.alias("pairs"),
        F.round(F.avg("name_jaccard"), 3).alias("name_mean"), q("name_jaccard", 0.1).alias("name_p10"), q("name_jaccard", 0.5).alias("name_p50"),
        X.percent(F.sum((F.col("name_jaccard") == 0).cast("long")), n).alias("name_zero_pct"),
        F.round(F.avg("addr_jaccard"), 3).alias("addr_mean"), q("addr_jaccard", 0.5).alias("addr_p50"),
        X.percent(F.sum((F.col("addr_jaccard") == 0).cast("long")), n).alias("addr_zero_pct"),
        X.percent(F.sum(F.col("name_equal").cast("long")), n).alias("name_equal_pct"),
        X.percent(F.sum(F.col("addr_empty").cast("long")), n).alias("addr_empty_pct"),
    )


def pair_flags(pairs: DataFrame) -> DataFrame:
    keys = ["tgt_src", "scripts", "country_equal", "name_equal", "name_share", "addr_share"]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def matched_ids(truth: DataFrame) -> DataFrame:
    """One row: matched ids, and how many different ones."""
    return truth.where("tgt_id IS NOT NULL").agg(F.count(F.lit(1)).alias("matched_ids_total"), F.countDistinct("tgt_id").alias("matched_ids_unique"))


def hard_examples(pairs: DataFrame, n: int = 25, below: float = 0.5) -> DataFrame:
    """True pairs whose names share few words."""
    return pairs.where(F.col("name_jaccard") < below).orderBy("s1_id", "tgt_id").limit(n)
