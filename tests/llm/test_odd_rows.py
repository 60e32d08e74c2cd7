"""Every operator and stage on nulls, empty and very long texts, repeated rows and doc_ids, empty tables, and extra columns with clashing names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinspark.llm import bpe, decontam, langid, minhash, quality, substring, tokenbin, tokencount, toxicity, urls
from tests.llm.test_operators import plain_components, plain_substring

BYTE_BPE, WORD_BPE, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
CLASH = ["key", "rep", "comp", "n", "h", "word", "words", "w", "start", "starts", "hot", "anchor", "segment", "bands", "own_id", "own_text", "held_out", "score", "ids", "row_key", "ref_lang", "toxic", "__n", "__row"]


def long_text():
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    return " ".join(rng.choices(words, k=150_000)) + " " + "xy" * 150_000 + " " + " ".join(words[:200])


def texts():
    rng = random.Random(32)
    own = [" ".join(f"t{rng.randrange(300)}" for _ in range(90)) for _ in range(4)]
    return [None, "", " \n\t ", "one", own[0], own[0], own[1], own[2] + "\n" + own[3], own[3], "the " * 70, long_text()]


def table(spark, rows, clash=True):
    """(doc_id, text) rows as documents with nulls in all other columns, and with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


BENCH = [("q1", "t1 t2 t3"), ("q2", "the the the the the the the the the the the"), (None, None), ("q3", "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


#: Operators whose rows depend on the row's own text only: repeated doc_ids must change nothing.
BY_TEXT = {
    "op4": (lambda spark, df: bpe.digests(df, BYTE_BPE), ["n_tokens", "ids_sha256", "decoded_sha256"]),
    "op5": (lambda spark, df: toxicity.score(df, toxicity.Model({"the": 1.0, "one": -2.0}, 0.3)), ["score"]),
    "op6": (lambda spark, df: decontam.digests(df, bench(spark)), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    "op7": (lambda spark, df: quality.rules(df), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op8": (lambda spark, df: tokenbin.digests(df, WORD_BPE), ["n_tokens", "ids_crc32"]),
    "op9": (lambda spark, df: langid.predict(df, {"en": b"the one two " * 99, "de": b"der die das " * 99}), ["lang_pred", "score", "rejected"]),
    "op10": (lambda spark, df: tokencount.count_tokens(df, PIECES), ["n_pretokens", "n_tokens", "n_bytes"]),
}


@pytest.mark.parametrize("name", BY_TEXT)
def test_rows_by_their_own_text(spark, name):
    run, cols = BY_TEXT[name]
    values = texts()
    apart = run(spark, table(spark, list(enumerate(values)), clash=False)).select(*cols).collect()
    assert len(apart) == len(values)
    # One doc_id for all, and one null.
    same = run(spark, table(spark, [(None if k == 4 else 7, t) for k, t in enumerate(values)])).select(*cols).collect()
    assert sorted(map(str, same)) == sorted(map(str, apart))
    assert run(spark, table(spark, [])).count() == 0


def test_training_on_odd_rows(spark):
    values = list(enumerate(texts()))
    df = table(spark, [*values, (7, "another text"), (None, "the")])
    for got in (toxicity.scores(df, labels(spark)), toxicity.scores(df, labels(spark).limit(0)), langid.predictions(df), langid.predictions(df.withColumn("lang", F.lit("en")))):
        rows = got.collect()
        assert len(rows) == len(values) + 2 and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(df.limit(0), labels(spark)).count() == langid.predictions(df.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    values = texts()
    values[9:10] = ["the " * 70, "THE " * 99]  # one shingle, twice
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.with_two_words(table(spark, list(enumerate(values)))).collect()}
    assert got == plain_components(values, 2)
    df = table(spark, [(1, values[4]), (1, values[6]), (2, values[6]), (None, values[6])])
    kept = minhash.one_of_each(df, 5)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert minhash.one_of_each(df.limit(0)).count() == 0


def test_substring_of_odd_rows(spark):
    values = texts() + [long_text()[-900:]]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(table(spark, list(enumerate(values)))).collect()}
    assert got == plain_substring(values, 13)
    df = table(spark, [(1, values[4]), (1, values[6]), (2, values[6]), (2, values[4]), (None, values[6]), (3, None)])
    rows = sorted((str(r.doc_id), r.text or "") for r in substring.dedup(df, 13, 5).collect())
    assert rows == sorted([("1", values[4]), ("1", values[6]), ("2", ""), ("2", ""), ("None", values[6]), ("3", "")])


def test_urls_of_odd_rows(spark):
    long_ = "http://a.com/" + "x/" * 60_000
    rows = [(1, None), (1, ""), (None, "http://a.org/"), (2, long_), (2, "http://b.com/de/"), (2, "http://b.com/de/"), (3, "no url")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in [*CLASH, "s", "codes", "places", "host", "path", "rule", "bin", "held"]})
    got = sorted((str(r.page_id), r.host, len(r.path), str(r.rule), r.verdict) for r in urls.verdicts(df).collect())
    assert got == sorted([
        ("1", "", 0, "None", "block"), ("1", "", 0, "None", "allow"), ("None", "a.org", 1, "org/", "allow"), ("2", "a.com", 120_001, "None", "allow"),
        ("2", "b.com", 4, "com/de/", "block"), ("2", "b.com", 4, "com/de/", "block"), ("3", "", 0, "None", "allow"),
    ])
    assert urls.verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    values = [*enumerate(texts()), (4, texts()[6]), (None, texts()[4])]
    docs = table(spark, values)
    out = stage(spark, docs, str(tmp_path))
    assert name == "bpe_encoding" or out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= len(values) and (name != "bpe_encoding" or len(rows) == len(values))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == out.columns and empty.count() == 0
