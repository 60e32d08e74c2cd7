"""Queries of the training-data operators, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, minhash, oracles, quality, substring, tokenbin, tokencount, toxicity, urls
from .common import table

#: Paths of vocabulary files; parameters of the operators, and installed on every machine.
BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_two_words(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_minhash, op3_substring, op4_bpe, op5_toxicity, op6_decontamination, op7_quality, op8_token_files, op9_language_id, op10_token_counts)}
#: The others are beyond SQL: tokenizers, trained models, a trie. They are tested against brute force and held-out rows.
ORACLES: dict[str, str] = {
    "op1_url_filter": urls.ORACLE,
    "op2_minhash": oracles.MINHASH,
    "op3_substring": oracles.SUBSTRING,
    "op6_decontamination": oracles.DECONTAM,
    "op7_quality": oracles.QUALITY,
}
