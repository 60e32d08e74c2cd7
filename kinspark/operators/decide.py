"""From pair probabilities to matches. Pairs have s1_id, src, tgt_id and the probability column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import summary


def decide(pairs: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= threshold)


def decide_by(pairs: DataFrame, keep: Callable[[Column, Column], Column], p: str = "p", score: str = "score") -> DataFrame:
    """Any rule on probability and score, as a function of two columns."""
    return pairs.where(keep(F.col(p), F.col(score)))


def best_per_entity(pairs: DataFrame, p: str = "p") -> DataFrame:
    return pairs.groupBy("s1_id").agg(F.max(p).alias("best_p"))


def one_to_one(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Of the entities that claim a target the likeliest keeps it; ties go to the smaller entity. Before or after
    the threshold is the same."""
    order = Window.partitionBy("tgt_id").orderBy(F.desc(p), "s1_id")
    return pairs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def sweep(entities: DataFrame, pairs: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], p: str = "p") -> DataFrame:
    """A row of metrics for each threshold.

    A pair counts once, at the highest threshold it passes; running sums over the few thresholds, per
    entity, replace a copy of all pairs for each.
    """
    levels = F.array(*(F.lit(t) for t in sorted(thresholds)))
    passed = F.size(F.filter(levels, lambda t: F.col(p) >= t))
    hits = pairs.join(truth.select("s1_id", "tgt_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "tgt_id"], "left")
    per = hits.select("s1_id", passed.alias("n"), "hit").where("n > 0").groupBy("s1_id", "n").agg(F.count(F.lit(1)).alias("c"), F.count("hit").alias("t"))
    lists = per.groupBy("s1_id").agg(F.collect_list(F.struct("n", "c", "t")).alias("l"))
    true = truth.groupBy("s1_id").agg(F.count("tgt_id").alias("ntrue"))
    each = entities.select("s1_id").join(true, "s1_id", "left").join(lists, "s1_id", "left")
    at = F.explode(F.transform(levels, lambda t, i: F.struct(t.alias("threshold"), (i + 1).alias("n"))))
    each = each.select("s1_id", F.coalesce("ntrue", F.lit(0)).alias("ntrue"), "l", at.alias("at"))
    total = lambda k: F.coalesce(F.aggregate(F.filter("l", lambda x: x["n"] >= F.col("at.n")), F.lit(0).cast("long"), lambda a, x: a + x[k]), F.lit(0))
    counts = each.select(F.col("at.threshold").alias("threshold"), "ntrue", total("c").alias("npred"), total("t").alias("tp"))
    return summary(counts, "threshold")


def best_config(rows: DataFrame, by: str = "f05_macro") -> DataFrame:
    """The row with the largest score; the first variant and threshold on ties."""
    return rows.orderBy(F.desc(by), "variant", "threshold").limit(1)
