"""Splits, samples and pair classifiers.

Random choices are by hash of the id, so a rerun, or a lost executor, chooses the same.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(c: str, seed: int) -> Column:
    """A fraction in [0, 1) from the MD5 of seed and id, the same in any engine."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary"))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / 4294967296.0


def split(entities: DataFrame, val: float, fit: float, seed: int = 7) -> DataFrame:
    """With part: val, fit or rest."""
    h = hashed("s1_id", seed)
    return entities.withColumn("part", F.when(h < val, "val").when(h < val + fit, "fit").otherwise("rest"))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows; each partition sends its own n at most."""
    return df.orderBy(hashed(key, seed), key).limit(n)


def stratified(entities: DataFrame, limit: int, by: str = "country") -> DataFrame:
    """The first of each group by id, in proportion, one at least."""
    sizes = entities.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    total = entities.agg(F.count(F.lit(1)).alias("__all"))
    quota = F.greatest(F.lit(1), F.rint(limit * F.col("__n") / F.col("__all")))
    order = Window.partitionBy(by).orderBy("s1_id")
    ranked = entities.withColumn("__r", F.row_number().over(order))
    rows = ranked.join(sizes.crossJoin(total), by)
    return rows.where(F.col("__r") <= quota).drop("__r", "__n", "__all")


def label_counts(pairs: DataFrame) -> tuple[int, int]:
    """Positives and negatives, in one pass."""
    pos, neg = pairs.agg(F.sum(F.col("label")), F.sum(1 - F.col("label"))).first()
    return int(pos or 0), int(neg or 0)


def downsample(pairs: DataFrame, per_positive: int = 3, least: int = 500_000, seed: int = 0) -> DataFrame:
    """All positives, and negatives up to the larger of ``per_positive`` for each and ``least``.

    The share of negatives comes from counts, and a hash decides each row by itself: no sort, no
    shuffle of the rows. The number is met in expectation.
    """
    pos, neg = label_counts(pairs)
    share = min(1.0, max(per_positive * pos, least) / max(neg, 1))
    key = pairs.withColumn("__k", F.concat_ws(":", "s1_id", "tgt_id"))
    return key.where((F.col("label") == 1) | (hashed("__k", seed) < share)).drop("__k")


def class_weight(pos: int, neg: int) -> Column:
    """Square root of negatives to positives on the positives."""
    return F.when(F.col("label") == 1, float((neg / max(pos, 1)) ** 0.5)).otherwise(1.0)


def balanced(pos: int, neg: int) -> tuple[Column, float]:
    """Weights that make both classes count alike, and their sum."""
    each = [(pos + neg) / (2.0 * max(n, 1)) for n in (pos, neg)]
    return F.when(F.col("label") == 1, each[0]).otherwise(each[1]), each[0] * pos + each[1] * neg


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def fit_logistic(pairs: DataFrame, features: list[str], c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """Standardised, balanced, with a ridge of 1 / (C times the weight of all rows)."""
    weight, total = balanced(*label_counts(pairs))
    rows = pairs.withColumn("weight", weight).withColumn("label", F.col("label").cast("double"))
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * (total or 1.0)), standardization=False)
    return Pipeline(stages=[assembler(features), scale, model]).fit(rows)


def fit_trees(pairs: DataFrame, features: list[str], rounds: int = 800, depth: int = 8, seed: int = 0) -> PipelineModel:
    """Boosted trees; a tenth of the pairs, by hash, says when to stop."""
    rows = pairs.withColumn("weight", class_weight(*label_counts(pairs))).withColumn("label", F.col("label").cast("double"))
    rows = rows.withColumn("__k", F.concat_ws(":", "s1_id", "tgt_id")).withColumn("held", hashed("__k", seed + 1) >= 0.9).drop("__k")
    model = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=0.07, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3,
        weightCol="weight", validationIndicatorCol="held", seed=seed,
    )
    return Pipeline(stages=[assembler(features), model]).fit(rows)


def probability(pairs: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    out = model.transform(pairs).withColumn(name, vector_to_array("probability")[1])
    return out.select(*pairs.columns, name)


def blend(trees: Column, logistic: Column, w: float = 0.35) -> Column:
    return (1 - w) * trees + w * logistic


def importance(model: PipelineModel, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, gains.tolist()), key=lambda x: (-x[1], x[0]))[:n]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
