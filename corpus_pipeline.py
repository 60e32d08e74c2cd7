"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. Between stages the table is
written to the shared folder as Parquet and read again, so a lost executor
costs at most the stage it was in.

Every stage takes an empty table, nulls in any column, texts of any length, and columns beside those of documents, which all but the
last carry along whatever their names. A null or empty text fails the base rules of the first stage; the others by themselves
keep it as it is. A null doc_id is never linked with, or covered by, another row, and its row is kept. Rows that repeat are
judged alike; rows that share a doc_id are one document to the near-duplicate stage (all of them stay or go), and judged each by its
own text elsewhere. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import bpe, decontam, minhash, quality, substring
from kinspark.llm.common import stored, table

#: Near duplicates: five-word shingles. Substring dedup: passages of 50 words.
SHINGLE, PASSAGE, GRAM = 5, 50, 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return minhash.one_of_each(docs, SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document of smaller doc_id go from the text; n_chars follows it."""
    return substring.dedup(docs, PASSAGE, GRAM).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian uint32), their number and digest, and the digest of the text they decode to."""
    both = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return both.select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: BPE merges are beyond SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None
