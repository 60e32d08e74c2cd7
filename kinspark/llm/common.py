"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space (space, and tab to carriage return) parts words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where the setting may be unset, one of our own;
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


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs only a reread."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def smallest(df: DataFrame, by: str, n: int, *order: str, salts: int = 16) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, whose first column is a hash: salted first, so that a group with most of the rows is ranked in many tasks."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = df.withColumn("__n", rank(by, F.pmod(order[0], F.lit(salts)))).where(F.col("__n") <= n)
    return some.withColumn("__n", rank(by)).where(F.col("__n") <= n).drop("__n")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, unless the session has a bound below its default: long texts come many to a batch,
    and a batch is held on both sides of the pipe to Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns of any name cannot clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
