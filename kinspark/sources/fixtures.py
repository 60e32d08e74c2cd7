"""Records, and a stand-in for the truth, from the driver's documents table.

The records are normalised once and kept as a stage in the shared folder, as a production run keeps its
views; every query reads the columns it needs of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import tables as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, spread over all cores where its files have fewer row groups than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of ``records`` and of the normalised views, from a stage keyed by the table's files."""
    return T.stage(spark, T.shared_folder(spark), "records-" + T.fingerprint(spark, f"{sf_dir}/documents.parquet"), lambda: X.views(made(spark, sf_dir)))


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, src (1 to 3), country, name (words 1 to 6), address (words 7 to 24), evidence (words 25 to 34)."""
    words = F.split(X.punct_norm(X.blank(F.col("text"))), " ")
    part = F.col("doc_id") % 20
    df = documents(spark, sf_dir).select(
        F.col("doc_id").alias("entity_id"),
        F.when(part < 8, 1).when(part < 14, 2).otherwise(3).cast("long").alias("src"),
        F.col("lang").alias("country"),
        words.alias("w"),
    )
    cut = lambda a, n: X.joined(F.slice("w", a, n))
    return df.select("entity_id", "src", "country", cut(1, 6).alias("name"), cut(7, 18).alias("address"), F.when(F.size("w") >= 34, cut(25, 10)).alias("evidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).select("entity_id", "src", "country", "name", "address", "evidence")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).drop("evidence")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, tgt_src, tgt_id): equal evidence within a country."""
    r = records(spark, sf_dir).where("evidence IS NOT NULL").select("entity_id", "src", "country", "evidence")
    a = r.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country", "evidence")
    b = r.where("src > 1").select(F.col("entity_id").alias("tgt_id"), F.col("src").alias("tgt_src"), "country", "evidence")
    return a.join(b, ["country", "evidence"]).select("s1_id", "tgt_src", "tgt_id")
