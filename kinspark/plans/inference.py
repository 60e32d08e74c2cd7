"""Training and inference end to end, as stages in the shared folder: each is keyed by a digest of all it depends on, and skipped where it is there in full.

``train`` goes from records and truth to two models, the pairs of the validation part with their
probabilities, the sweep of all variants, and the best configuration. ``predict`` goes from records and a
model to lists for every entity: blocks (country, pool) that have results under the same digest are kept, all
others are scored in one plan, and the lists are put together once every block is there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import THRESHOLDS, Params
from ..operators import decide as D
from ..operators import learn as L
from ..operators import pairs as PR
from ..operators import retrieve as R
from ..sources import tables as T

#: Adds a column ``p`` to pairs that have all features.
Scorer = Callable[[DataFrame], DataFrame]
POOLS = (2, 3)
WEIGHT = 0.35  # of the logistic model in the blend


def index(spark: SparkSession, records: DataFrame, root: str, key: str, params: Params) -> R.Index:
    """The index of the pools, its tables written once for each digest."""
    own = R.Index(records.where(F.col("src") > 1), params)
    own.weights = T.stage(spark, root, f"index-weights-{key}", lambda: own.weights)
    own.postings = T.stage(spark, root, f"index-postings-{key}", lambda: own.postings)
    own.rarest = T.stage(spark, root, f"index-rarest-{key}", lambda: own.rarest)
    return own


def expected(entities: DataFrame) -> DataFrame:
    """(country, src) of all blocks."""
    return entities.select("country").distinct().select("country", F.explode(F.array(*(F.lit(s).cast("long") for s in POOLS))).alias("src"))


def block_rows(entities: DataFrame, blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """A row for each entity of each block, with its candidates and its matches in order of rank, possibly none."""
    # Null countries are a block of their own.
    rows = entities.select("s1_id", "country").join(blocks, entities["country"].eqNullSafe(blocks["country"])).select("s1_id", entities["country"], "src")
    own = F.struct("rank", F.col("tgt_id").cast("string").alias("id"))
    lists = pairs.groupBy("s1_id", "src").agg(F.array_sort(F.collect_list(own)).alias("c"), F.array_sort(F.collect_list(F.when(F.col("p") >= threshold, own))).alias("m"))
    ids = lambda c: F.coalesce(F.col(f"{c}.id"), F.array().cast("array<string>"))
    return rows.join(lists, ["s1_id", "src"], "left").select("s1_id", "country", "src", ids("c").alias("candidates"), ids("m").alias("matches"))


def predict(spark: SparkSession, records: DataFrame, scorer: Scorer, threshold: float, params: Params, root: str, key: str) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids, matched_entity_ids) of every entity. ``key`` stands for the records and the model."""
    digest = params.key(key, threshold)
    entities = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country")
    path, kind = f"{root}/blocks-{digest}", entities.schema["s1_id"].dataType.simpleString()
    want, todo = expected(entities), expected(entities)
    if T.exists(spark, path):
        todo = T.missing_blocks(want, T.read_blocks(spark, path, kind))
    todo = T.kept(todo, T.scratch(spark))
    if not todo.isEmpty():
        open_ = records.join(todo.select("country").distinct(), records["country"].eqNullSafe(todo["country"]), "left_semi")
        pairs = PR.featured(open_, index(spark, records, root, params.key(key), params), params)
        T.write_blocks(block_rows(entities, todo, scorer(pairs), threshold), path)
    return assembled(entities, T.read_blocks(spark, path, kind))


def assembled(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lists of every entity, pool by pool; raises where a block is missing."""
    T.require_complete(expected(entities), blocks)
    lists = blocks.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("src", "candidates", "matches"))).alias("b"))
    both = entities.select("s1_id").join(lists, "s1_id", "left")
    joined = lambda c: F.coalesce(F.array_join(F.flatten(F.col(f"b.{c}")), ","), F.lit(""))
    return both.select(F.col("s1_id").alias("source1_entity_id"), joined("candidates").alias("candidate_entity_ids"), joined("matches").alias("matched_entity_ids"))


def write_lists(lists: DataFrame, root: str) -> None:
    """The two result files, as folders of delimited parts."""
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        T.write_tsv(lists.select(F.col("source1_entity_id").cast("string").alias("source1_entity_id"), column), f"{root}/{name}")


def variants(entities: DataFrame, pairs: DataFrame, truth: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The sweep of every probability column, as it is and one to one: variant, threshold and the metrics."""
    out = None
    for name, column in columns.items():
        own = pairs.select("s1_id", "tgt_id", F.col(column).alias("p"))
        for kind, rows in ((0, own), (1, D.one_to_one(own))):
            swept = D.sweep(entities, rows, truth, THRESHOLDS).withColumn("variant", F.lit(f"{name}|bij={kind}"))
            out = swept if out is None else out.unionByName(swept)
    return out


def train(spark: SparkSession, records: DataFrame, truth: DataFrame, params: Params, root: str, key: str, val: float = 0.2, fit: float = 0.6, max_iter: int = 2000, rounds: int = 800, depth: int = 8) -> dict:
    """Models, validation pairs, sweep and best configuration under ``root``; the configuration is returned."""
    digest = params.key(key, val, fit, max_iter, rounds, depth)
    features = list(PR.FEATURES)
    entities = L.split(records.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country"), val, fit)

    def pairs() -> DataFrame:
        rows = PR.labelled(PR.featured(records, index(spark, records, root, params.key(key), params), params), truth)
        return rows.join(entities.select("s1_id", "part"), "s1_id").select("s1_id", "src", "tgt_id", "rank", "label", "part", *(F.col(f).cast("double").alias(f) for f in features))

    known = T.stage(spark, root, f"pairs-{digest}", pairs)
    places = {name: f"{root}/{name}-{digest}" for name in ("logistic", "trees")}
    rows = lambda: L.downsample(known.where("part = 'fit'"))
    T.once(spark, places["logistic"], lambda: L.save(L.fit_logistic(rows(), features, max_iter=max_iter), places["logistic"]))
    T.once(spark, places["trees"], lambda: L.save(L.fit_trees(rows(), features, rounds, depth), places["trees"]))
    judged = lambda: blended(known.where("part = 'val'").drop("part"), places)
    validation = T.stage(spark, root, f"validation-{digest}", judged)
    held = entities.where("part = 'val'").select("s1_id")
    own = truth.join(held, "s1_id", "left_semi")
    swept = T.stage(spark, root, f"sweep-{digest}", lambda: variants(held, validation, own, {"lr": "p_lr", "xgb": "p_gbt", "blend": "p"}))
    best = D.best_config(swept).first()
    config = {"variant": best["variant"], "threshold": best["threshold"], "f05_macro": best["f05_macro"], "blocking": asdict(params), "models": places}
    T.write_report(spark.createDataFrame([(json.dumps(config),)], "config string"), f"{root}/config-{digest}")
    return config


def blended(pairs: DataFrame, places: dict[str, str]) -> DataFrame:
    """With p_lr, p_gbt and their blend p, of saved models."""
    both = L.probability(L.probability(pairs, L.load(places["logistic"]), "p_lr"), L.load(places["trees"]), "p_gbt")
    return both.withColumn("p", L.blend(F.col("p_gbt"), F.col("p_lr"), WEIGHT))


def scorer_of(config: dict) -> Scorer:
    """What ``train`` chose, as a scorer for ``predict``."""
    column = {"lr": "p_lr", "xgb": "p_gbt", "blend": "p"}[config["variant"].split("|")[0]]

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.withColumns({f: F.col(f).cast("double") for f in PR.FEATURES})
        return blended(rows, config["models"]).withColumn("p", F.col(column))

    return score
