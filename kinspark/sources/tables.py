"""Readers and writers: delimited record files, Parquet views, match lists, reports, and stages that can be resumed."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


_OWN: list[str] = []
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where that may be unset, one of our own, removed at the end;
    a cluster without it raises, for executors could not read what others wrote to a folder of one machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="kinspark-"))
            atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), True)
        there = _OWN[0]
    return there.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, path: str, *more: object) -> str:
    """A digest of a table's files (names, sizes, times) and of whatever else a stage made from it depends on."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.getFileStatus(own)
    files = [root] if root.isFile() else list(fs.listStatus(own))
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join([*told, *map(str, more)]).encode()).hexdigest()[:24]


def source_path(root: str, split: str, source: int) -> str:
    return f"{root}/{split}/{split}_source{source}.tsv"


def truth_path(root: str) -> str:
    return f"{root}/train/train_ground_truth.tsv"


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], only: list[str] | None = None) -> DataFrame:
    """All columns as strings, no quoting, an empty field is the empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", encoding="UTF-8").csv(path)
    return df.na.fill("").select(*(only or columns))


def write_tsv(df: DataFrame, path: str) -> None:
    """Bytes as they are: no quotes, no escapes, no trimming; null is empty."""
    df.na.fill("").write.mode("overwrite").options(
        sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def truth_pairs(truth: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(s1_id, tgt_id); an entity without matches stays, with a null tgt_id. ``subset`` has a column s1_id."""
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    long = truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode_outer(ids).alias("tgt_id"))
    return long if subset is None else long.join(subset.select("s1_id").distinct(), "s1_id", "left_semi")


def write_views(df: DataFrame, path: str) -> None:
    """Normalised views, by split, source and country, so that a filter on these reads only its folders."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("split", "src", "country").parquet(path)


def read_views(spark: SparkSession, path: str, split: str, src: int, country: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).where((F.col("split") == split) & (F.col("src") == src))
    return df if country is None else df.where(F.col("country") == country)


def countries(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).select("country").distinct()


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def once(spark: SparkSession, path: str, make) -> None:
    """Calls ``make`` unless it has come to its end for this ``path`` before; an empty file beside it tells."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.done")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        make()
        fs.createNewFile(done)


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df``, written under ``path`` and read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """The table under ``path``/``key``, made and written first unless it is there in full. ``key`` digests all it depends on."""
    own = f"{path.rstrip('/')}/{key}"
    # The committer leaves this file only after the last task. A stage of this process is not made again under a plan that reads it.
    if not exists(spark, f"{own}/_SUCCESS") and not (own in _MADE and exists(spark, own)):
        make().write.mode("overwrite").option("compression", "zstd").parquet(own)
        _MADE.add(own)
    return spark.read.parquet(own)


def write_blocks(df: DataFrame, path: str) -> None:
    """Results by (country, src); a second run replaces only the blocks it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "src").parquet(path)


def read_blocks(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"s1_id {id_type}, candidates array<string>, matches array<string>, country string, src long").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def in_order(ids: Column) -> Column:
    """Ids of an array of (src, rank, id), joined by commas: pool by pool, each in rank order."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x["id"]), ",")


def match_lists(entities: DataFrame, matches: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row for every entity of ``entities`` (s1_id), its matches (s1_id, src, rank, tgt_id) as one string, possibly empty."""
    ids = F.collect_list(F.struct("src", "rank", F.col("tgt_id").cast("string").alias("id")))
    lists = matches.groupBy("s1_id").agg(in_order(ids).alias(name))
    out = entities.select("s1_id").join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def missing_blocks(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks (country, src) that should be there and are not; a null country is one, too."""
    want = expected.select("country", "src").distinct()
    there = done.select(F.col("country").alias("__c"), F.col("src").alias("__s")).distinct()
    return want.join(there, F.col("country").eqNullSafe(F.col("__c")) & (F.col("src") == F.col("__s")), "left_anti")


def require_complete(expected: DataFrame, done: DataFrame) -> None:
    gone = missing_blocks(expected, done).limit(5).collect()
    if gone:
        raise RuntimeError(f"blocks without results: {[tuple(r) for r in gone]}")
