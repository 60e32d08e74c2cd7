"""The pipeline: each stage against a brute-force version on its own input."""

import hashlib
import importlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinspark.llm.common import stored

from .test_operators import plain_components, plain_decontam, plain_substring

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with clean prose, junk, copies, near copies, a repeated passage and a leaked item."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(rng.choice(("the", "of", "and", word(), word(), word())) for _ in range(n))
    clean = [prose(rng.randint(120, 300)) for _ in range(30)]
    passage, item = prose(60), prose(20)
    texts = clean + ["short one", "a b c " * 90, clean[0], clean[1] + " tail", None, "", passage + " " + prose(150), prose(150) + "\n" + passage, prose(100) + " " + item + " " + prose(100)]
    path = str(tmp_path_factory.mktemp("data"))
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, len(clean)


def listed(df):
    rows = df.orderBy("doc_id").collect()
    return [r["doc_id"] for r in rows], [r["text"] for r in rows]


def test_stages(spark, folder):
    path, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    made = []
    for name, f in pipeline.STAGES:
        out = stored(f(spark, docs, path), name)
        made.append((listed(docs), out))
        if name != "bpe_encoding":
            assert out.columns == columns
        docs = out
    (_, kept), (before2, dedup), (before3, cut), (before4, free), (before5, ids) = made
    assert {r.doc_id for r in kept.collect()} >= set(range(clean)) and not {r.doc_id for r in kept.collect()} & {clean, clean + 1, clean + 4, clean + 5}
    numbers, texts = before2
    assert listed(dedup)[0] == [i for i, (_, _, k) in zip(numbers, (v for _, v in sorted(plain_components(texts, 5).items()))) if k]
    assert not {clean + 2, clean + 3} & set(listed(dedup)[0])
    numbers, texts = before3
    want = plain_substring(texts, 50)
    for n, (i, old, new) in enumerate(zip(numbers, texts, listed(cut)[1])):
        assert hashlib.sha256(" ".join(new.split()).encode()).hexdigest() == want[n][2]
        assert want[n][1] or new == old
    assert sum(w[1] > 0 for w in want.values()) == 1 and cut.where(F.col("n_chars") != F.length("text")).count() == 0
    numbers, texts = before4
    hit = plain_decontam(texts, [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()], 10)
    assert listed(free)[0] == [i for n, i in enumerate(numbers) if not hit[n][4]] and any(x[4] for x in hit.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (bytes(r.ids), r.n_tokens, r.decoded_sha256) for r in ids.collect()}
    for i, t in zip(*before5):
        own = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (np.array(own, "<u4").tobytes(), len(own), hashlib.sha256(t.encode()).hexdigest())
    rows = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert rows(pipeline.run(spark, path)) == rows(ids)


def test_registered(folder):
    assert importlib.import_module("__spark_entry__").queries()["pipeline"].__wrapped__ is pipeline.run
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES][0] == "quality_rules"
