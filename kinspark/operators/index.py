"""The inverted index of a pool of records, as tables keyed by (src, country).

All blocks are built in one plan. Records have entity_id, src, country, nmc and adn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params

BLOCK = ["src", "country"]


def exploded(records: DataFrame) -> DataFrame:
    """(src, country, entity_id, field, token): distinct within a field; field 0 is the name, 1 the address."""
    own = lambda c, f: F.transform(F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")), lambda t: F.struct(F.lit(f).alias("field"), t.alias("token")))
    both = F.concat(own("nmc", 0), own("adn", 1))
    return records.select(*BLOCK, "entity_id", F.inline(both))


def block_sizes(records: DataFrame) -> DataFrame:
    """(src, country, n), records without tokens included."""
    return records.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """(src, country, token, df); a token in both fields of a record counts twice."""
    return tokens.groupBy(*BLOCK, "token").agg(F.count(F.lit(1)).alias("df"))


def idf(frequency: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each block is little: the sizes are joined as Spark sees fit."""
    return frequency.join(sizes, BLOCK).withColumn("idf", F.log(1 + F.col("n") / F.greatest("df", F.lit(1))))


def weighed(tokens: DataFrame, weights: DataFrame, *columns: str) -> DataFrame:
    """``tokens`` with columns of ``weights``. A token that makes up a thousandth of all occurrences gets them by broadcast, so that it
    fills no task: there are a thousand such tokens at most. All others meet their weights in a shuffle."""
    key = [*BLOCK, "token"]
    total = weights.agg(F.sum("df").alias("occurrences"))
    own = weights.select(*key, *columns)
    hot = weights.crossJoin(F.broadcast(total)).where(1000 * F.col("df") > F.col("occurrences")).select(*key)
    some = tokens.join(F.broadcast(own.join(F.broadcast(hot), key, "left_semi")), key)
    return some.unionByName(tokens.join(F.broadcast(hot), key, "left_anti").join(own, key))


def postings(tokens: DataFrame, weights: DataFrame, params: Params) -> DataFrame:
    """(src, country, token, tgt_id, w), a token of both fields summed."""
    record = Window.partitionBy(*BLOCK, "entity_id")
    part = F.col("idf") * F.col("idf") if params.norm == "l2" else F.col("idf")
    rows = weighed(tokens, weights, "idf")
    rows = rows.withColumn("length", F.sqrt(F.sum(part).over(record)))
    rows = rows.withColumn("w", F.col("idf") / F.greatest("length", F.lit(1e-9)))
    return rows.groupBy(*BLOCK, "token", F.col("entity_id").alias("tgt_id")).agg(F.sum("w").alias("w"))


def rarest(records: DataFrame, tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """(src, country, entity_id, mindf, n_name, n_addr): least df among a record's tokens, 0 without any, and distinct tokens of each field."""
    rows = weighed(tokens, frequency, "df")
    count = lambda f: F.sum(F.when(F.col("field") == f, 1).otherwise(0))
    least = rows.groupBy(*BLOCK, "entity_id").agg(F.min("df").alias("mindf"), count(0).alias("n_name"), count(1).alias("n_addr"))
    out = records.select(*BLOCK, "entity_id").join(least, [*BLOCK, "entity_id"], "left")
    return out.na.fill(0, ["mindf", "n_name", "n_addr"])
