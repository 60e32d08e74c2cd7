"""Scores of matches and of retrieval. Every entity counts, also those without matches or truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of the recall curve and half-open buckets of ranks.
RANKS = (3, 5, 10, 20, 30)
BUCKETS = ((0, 1), (1, 2), (2, 3), (3, 5), (5, 10), (10, 20), (20, 31))


def entity_counts(entities: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, npred, tp, ntrue) of every entity."""
    t = truth.where("tgt_id IS NOT NULL").select("s1_id", "tgt_id").distinct()
    p = pairs.select("s1_id", "tgt_id").distinct()
    hits = p.join(t.withColumn("hit", F.lit(1)), ["s1_id", "tgt_id"], "left")
    pred = hits.groupBy("s1_id").agg(F.count(F.lit(1)).alias("npred"), F.count("hit").alias("tp"))
    true = t.groupBy("s1_id").agg(F.count(F.lit(1)).alias("ntrue"))
    out = entities.select("s1_id").join(pred, "s1_id", "left").join(true, "s1_id", "left")
    return out.na.fill(0, ["npred", "tp", "ntrue"])


#: The features whose means tell false from true positives, and those shown with an example.
TOLD = ("rank_n", "score", "score_ratio", "nm_ratio", "nm_tset", "nm_partial", "ad_ratio", "ad_tset", "num_ratio", "house_eq", "zip_eq", "mindf_min")
SHOWN = ("nm_ratio", "ad_ratio", "nm_tset", "ad_tset", "zip_eq", "mindf_b")


def f_half() -> Column:
    """Both lists empty: 1. One empty, or nothing in common: 0."""
    c = F.col
    p, r = F.try_divide(c("tp"), c("npred")), F.try_divide(c("tp"), c("ntrue"))
    both = F.when(c("tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return F.when((c("npred") == 0) & (c("ntrue") == 0), 1.0).when((c("npred") == 0) | (c("ntrue") == 0), 0.0).otherwise(both)


def safe(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def summary(counts: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, micro precision and recall, singletons, and sizes, of (npred, tp, ntrue)."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    no_pred, no_true = F.col("npred") == 0, F.col("ntrue") == 0
    return counts.groupBy(*by).agg(
        F.round(F.avg(f_half()), 6).alias("f05_macro"),
        F.round(safe(F.sum("tp"), F.sum("npred")), 6).alias("precision_micro"),
        F.round(safe(F.sum("tp"), F.sum("ntrue")), 6).alias("recall_micro"),
        F.round(safe(n(no_pred & no_true), n(no_true)), 6).alias("singleton_recall"),
        F.round(safe(n(no_pred & no_true), n(no_pred)), 6).alias("singleton_precision"),
        F.round(F.sum("npred") / F.count(F.lit(1)), 6).alias("pred_per_entity"),
        F.round(safe(n(no_pred), F.count(F.lit(1))), 6).alias("empty_rate"),
        F.count(F.lit(1)).alias("n_entities"),
    )


def recall(counts: DataFrame) -> DataFrame:
    """Of candidates: micro, and macro over entities with truth."""
    return counts.agg(
        F.round(safe(F.sum("tp"), F.sum("ntrue")), 6).alias("recall_micro"),
        F.round(F.avg(F.when(F.col("ntrue") > 0, F.col("tp") / F.col("ntrue"))), 6).alias("recall_macro"),
        F.sum("ntrue").alias("n_true"),
    )


def list_sizes(counts: DataFrame) -> DataFrame:
    """Of candidates per entity; percentiles are interpolated, then cut to whole numbers."""
    q = lambda p: F.floor(F.percentile("npred", F.lit(p))).cast("long")
    return counts.agg(
        F.round(F.avg("npred"), 6).alias("avg"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"), F.max("npred").alias("max"),
        F.round(100 * F.sum((F.col("npred") == 0).cast("long")) / F.count(F.lit(1)), 2).alias("zero_pct"),
    )


def reduction(counts: DataFrame, pool: DataFrame) -> DataFrame:
    """Share of the pool that is not compared, by pool per country and by the whole pool."""
    size = pool.agg(F.count(F.lit(1)).alias("pool"), F.countDistinct("country").alias("countries"))
    mean = counts.agg(F.avg("npred").alias("m"))
    both = mean.crossJoin(size)  # one row each
    return both.select(F.round(1 - F.col("m") / (F.col("pool") / F.col("countries")), 8).alias("by_country"), F.round(1 - F.col("m") / F.col("pool"), 8).alias("by_pool"))


def true_ranks(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Every true pair with its rank, null if it was not retrieved."""
    return truth.select("s1_id", "tgt_id").distinct().join(candidates.select("s1_id", "tgt_id", "rank"), ["s1_id", "tgt_id"], "left")


def recall_curve(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each k."""
    found = true_ranks(candidates, truth).agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("rank") < k, 1)).alias(f"c{k}") for k in RANKS))
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.round(safe(F.col(f"c{k}"), F.col("n")), 6).alias("recall")) for k in RANKS)))
    return found.select(rows.alias("r")).select("r.*")


def absent_rate(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return true_ranks(candidates, truth).agg(F.count(F.when(F.col("rank").isNull(), 1)).alias("absent"), F.round(safe(F.count(F.when(F.col("rank").isNull(), 1)), F.count(F.lit(1))), 6).alias("rate"))


def confusion(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Of labelled pairs."""
    yes, true = F.col(p) >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    out = pairs.agg(n(yes & true).alias("tp"), n(yes & ~true).alias("fp"), n(~yes & true).alias("fn"))
    c = F.col
    return out.select("tp", "fp", "fn", F.round(safe(c("tp"), c("tp") + c("fp")), 6).alias("precision"), F.round(safe(c("tp"), c("tp") + c("fn")), 6).alias("recall"))


def rank_buckets(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Recall of true candidates by bucket of rank."""
    low = F.lit(None).cast("long")
    for a, b in reversed(BUCKETS):
        low = F.when((F.col("rank") >= a) & (F.col("rank") < b), F.lit(a).cast("long")).otherwise(low)
    rows = pairs.where("label = 1").withColumn("rank_from", low).where("rank_from IS NOT NULL")
    return rows.groupBy("rank_from").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_ratio"), 6).alias("mean_score_ratio"), F.round(F.avg((F.col(p) >= threshold).cast("double")), 6).alias("recall"))


def entities_ok(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Entities all of whose true candidates pass, and those that miss one."""
    per = pairs.where("label = 1").groupBy("s1_id").agg(F.min((F.col(p) >= threshold).cast("long")).alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("ok"), F.lit(0)).alias("all_ok"), F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("missed"))


def false_positives(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """By pool: pairs, entities, and pairs per entity."""
    bad = pairs.where((F.col(p) >= threshold) & (F.col("label") == 0))
    per = bad.groupBy("src", "s1_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("src").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("entities"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("max"))


def feature_means(pairs: DataFrame, threshold: float, columns: list[str], p: str = "p") -> DataFrame:
    """Means of the accepted pairs, false and true ones apart."""
    kind = F.when(F.col("label") == 1, "TP").otherwise("FP")
    return pairs.where(F.col(p) >= threshold).groupBy(kind.alias("kind")).agg(*(F.round(F.avg(c), 6).alias(c) for c in columns))


def false_negatives(pairs: DataFrame, truth: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """True pairs that are absent, and those retrieved below the threshold, with the entities that lose any."""
    all_ = truth.select("s1_id", "tgt_id").distinct().join(pairs.select("s1_id", "tgt_id", F.col(p).alias("p")), ["s1_id", "tgt_id"], "left")
    absent, below = F.col("p").isNull(), F.col("p") < threshold
    return all_.agg(
        F.count(F.lit(1)).alias("true_pairs"), F.count(F.when(absent, 1)).alias("absent"), F.count(F.when(below, 1)).alias("below"),
        F.countDistinct(F.when(below, F.col("s1_id"))).alias("entities_below"),
    )


def chosen(pairs: DataFrame, threshold: float, n: int, false_positive: bool, p: str = "p") -> DataFrame:
    """The n likeliest false positives, or the n unlikeliest missed pairs."""
    yes = F.col(p) >= threshold
    rows = pairs.where(yes & (F.col("label") == 0)) if false_positive else pairs.where(~yes & (F.col("label") == 1))
    return rows.orderBy(F.desc(p) if false_positive else F.asc(p), "s1_id", "tgt_id").limit(n)


def examples(pairs: DataFrame, threshold: float, n: int, false_positive: bool, p: str = "p", more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of ``chosen`` with their strings and the columns ``more``."""
    return chosen(pairs, threshold, n, false_positive, p).select("s1_id", "tgt_id", "src", p, "score", "rank", "a_nm", "a_ad", "b_nm", "b_ad", *more)
