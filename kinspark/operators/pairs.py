"""Candidate pairs with their 45 features.

Scores are computed on ids; the strings of the records are joined only to the pairs that were kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from ..functions import similarity as S
from .retrieve import Index

#: Names and order of the features.
FEATURES = (
    "nm_ratio", "nm_jw", "nm_tset", "nm_tsort", "nm_partial", "nm_sorted", "nm_wratio",
    "ad_ratio", "ad_tset", "ad_tsort", "ad_partial", "ad_sorted", "ad_wratio",
    "num_ratio", "zip_ratio", "ad_jw",
    "nm_len_ratio", "nm_len_diff", "ad_len_ratio", "ad_len_diff", "nm_tok_ratio", "ad_tok_ratio",
    "mindf_a", "mindf_b", "mindf_min", "zip_eq", "zip_both", "house_eq",
    "score", "rank_n", "score_ratio", "score_margin", "ncand_n",
    "a_indic", "b_indic", "script_match", "ntok_nm_a", "ntok_nm_b", "ntok_ad_a", "ntok_ad_b", "is_s3",
    "a_name_empty", "b_name_empty", "a_addr_empty", "b_addr_empty",
)
VIEWS = ("nm", "ad", "nmc", "adn", "nms", "ads", "num", "zip", "nlen", "alen", "ntn", "nta", "indic")


def context(candidates: DataFrame, params: Params) -> DataFrame:
    """What a pair's place in its list says, per entity and pool."""
    own = Window.partitionBy("s1_id", "src")
    best, n = F.max("score").over(own), F.count(F.lit(1)).over(own)
    return candidates.select(
        "s1_id", "src", "country", "tgt_id", "score", "rank",
        (F.col("rank") / params.topk).alias("rank_n"),
        (F.col("score") / F.greatest(best, F.lit(1e-9))).alias("score_ratio"),
        (best - F.col("score")).alias("score_margin"),
        (n / (2 * params.topk)).alias("ncand_n"),
        (F.col("src") == 3).cast("int").alias("is_s3"),
    )


def decorated(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """With the views of both records, as a_* and b_*."""
    side = lambda p: [F.col(v).alias(f"{p}_{v}") for v in VIEWS]
    a = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), *side("a"))
    b = records.where("src > 1").select(F.col("entity_id").alias("tgt_id"), "src", *side("b"))
    return pairs.join(a, "s1_id").join(b, ["tgt_id", "src"])


def share(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def flag(c: Column) -> Column:
    return c.cast("int")


def structural() -> dict[str, Column]:
    c = F.col
    return {
        "nm_len_ratio": share(c("a_nlen"), c("b_nlen")),
        "nm_len_diff": F.abs(c("a_nlen") - c("b_nlen")),
        "ad_len_ratio": share(c("a_alen"), c("b_alen")),
        "ad_len_diff": F.abs(c("a_alen") - c("b_alen")),
        "nm_tok_ratio": share(c("a_ntn"), c("b_ntn")),
        "ad_tok_ratio": share(c("a_nta"), c("b_nta")),
        "a_indic": c("a_indic"),
        "b_indic": c("b_indic"),
        "script_match": flag(c("a_indic") == c("b_indic")),
        "ntok_nm_a": c("a_ntn"),
        "ntok_nm_b": c("b_ntn"),
        "ntok_ad_a": c("a_nta"),
        "ntok_ad_b": c("b_nta"),
        "a_name_empty": flag(c("a_nm") == ""),
        "b_name_empty": flag(c("b_nm") == ""),
        "a_addr_empty": flag(c("a_ad") == ""),
        "b_addr_empty": flag(c("b_ad") == ""),
    }


def numeric() -> dict[str, Column]:
    """Whole lists of digit runs are compared, and two empty ones are equal."""
    c = F.col
    return {
        "zip_eq": flag(c("a_zip") == c("b_zip")),
        "zip_both": flag((c("a_zip") != "") & (c("b_zip") != "")),
        "house_eq": flag(c("a_num") == c("b_num")),
    }


def with_rarity(pairs: DataFrame, index: Index, params: Params) -> DataFrame:
    """With mindf_a, mindf_b and mindf_min. The query side is in no index: 0 unless ``params.mindf`` is "live",
    when it is the least df, in the pair's pool, of the tokens the entity was searched by."""
    own = index.rarest.select("src", F.col("entity_id").alias("tgt_id"), F.col("mindf").alias("b_mindf"))
    pairs = pairs.join(own, ["src", "tgt_id"], "left").na.fill(0, ["b_mindf"])
    a = F.coalesce("a_mindf", F.lit(0)) if "a_mindf" in pairs.columns and params.mindf == "live" else F.lit(0)
    return pairs.select("*", F.log1p(a.cast("double")).alias("mindf_a"), F.log1p("b_mindf").alias("mindf_b"), F.log1p(F.least(a, F.col("b_mindf")).cast("double")).alias("mindf_min"))


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """With label 1 where the truth (s1_id, tgt_id) has the pair."""
    t = truth.select("s1_id", "tgt_id").distinct().withColumn("__t", F.lit(1))
    return pairs.join(t, ["s1_id", "tgt_id"], "left").withColumn("label", F.coalesce("__t", F.lit(0))).drop("__t")


def list_lengths(pairs: DataFrame) -> DataFrame:
    """(s1_id, ncand): the longer of an entity's lists."""
    return pairs.groupBy("s1_id", "src").agg(F.count(F.lit(1)).alias("n")).groupBy("s1_id").agg(F.max("n").alias("ncand"))


def featured(records: DataFrame, index: Index, params: Params, scorers: list[str] | None = None) -> DataFrame:
    """All candidate pairs of the entities of ``records`` (src 1) in an index, with features."""
    entities = records.where("src = 1")
    pairs = context(index.candidates(entities), params)
    if params.mindf == "live":
        least = index.queries(entities).groupBy("s1_id", "src").agg(F.min("df").alias("a_mindf"))
        pairs = pairs.join(least, ["s1_id", "src"], "left")
    pairs = with_rarity(decorated(pairs, records), index, params)
    pairs = pairs.select("*", *(c.alias(n) for n, c in (structural() | numeric()).items() if n not in ("a_indic", "b_indic")))
    return S.with_scores(pairs, scorers)


def build(records: DataFrame, truth: DataFrame, params: Params, scorers: list[str] | None = None) -> DataFrame:
    """All pairs of a record table (src 1 against 2 and 3), with features and label."""
    return labelled(featured(records, Index(records.where("src > 1"), params), params, scorers), truth)
