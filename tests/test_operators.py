"""Index, retrieval, decisions and metrics on hand-made records."""

import math
import os
import shutil

import pytest
from pyspark.sql import functions as F

from kinspark.config import Params
from kinspark.functions import text as X
from kinspark.operators import decide as D
from kinspark.operators import index as I
from kinspark.operators import learn as L
from kinspark.operators import metrics as M
from kinspark.operators import pairs as PR
from kinspark.operators import retrieve as R
from kinspark.plans import inference as INF
from kinspark.sources import tables as T

RECORDS = [
    (1, 1, "US", "acme foods", "1 main street"),
    (2, 1, "US", "zzz", ""),
    (3, 1, "FR", "acme foods", "1 main street"),
    (11, 2, "US", "acme foods", "1 main street"),
    (12, 2, "US", "acme tools", "2 main street"),
    (13, 3, "US", "acme acme", "acme road"),
    (14, 3, "US", "", ""),
    (15, 2, "FR", "other", "main street"),
]


@pytest.fixture(scope="module")
def views(spark):
    df = spark.createDataFrame(RECORDS, "entity_id long, src long, country string, name string, address string")
    return X.views(df).cache()


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_index(views):
    i = R.Index(views.where("src > 1"), Params())
    df = {(r.src, r.country, r.token): r.df for r in i.frequency.collect()}
    assert df[2, "US", "acme"] == 2 and df[3, "US", "acme"] == 2  # name and address count apart
    assert {(r.src, r.country): r.n for r in i.sizes.collect()} == {(2, "US"): 2, (3, "US"): 2, (2, "FR"): 1}
    least = {r.entity_id: r.mindf for r in i.rarest.collect()}
    assert least == {11: 1, 12: 1, 13: 1, 14: 0, 15: 1}
    w = {(r.tgt_id, r.token): r.w for r in i.postings.collect()}
    common, rare = math.log(1 + 2 / 2), math.log(1 + 2 / 1)
    assert w[13, "acme"] == pytest.approx(2 * common / math.sqrt(2 * common + rare))


def test_prefix_rules(views):
    p = Params(kq=2, budget=1, dfmax=1)
    i = R.Index(views.where("src > 1"), p)
    ranked = R.ranked_tokens(views.where("src = 1"), i.weights, p)
    kept = R.prefix(ranked, p)
    own = [(r.pos, r.token, r.df) for r in kept.where("s1_id = 1 AND src = 2").orderBy("pos").collect()]
    # Rarest first; ties by field and token. The second would start with the budget used up.
    assert own == [(0, "foods", 1)]
    wide = R.prefix(ranked, p.with_(budget=2))
    assert [r.token for r in wide.where("s1_id = 1 AND src = 2").orderBy("pos").collect()] == ["foods", "1"]
    # The first token stays even above dfmax, and the last to start within the budget may cross it.
    only = R.prefix(ranked, p.with_(dfmax=0, budget=10))
    assert {r.pos for r in only.collect()} == {0}
    assert kept.where("s1_id = 2").count() == 0  # unknown tokens are dropped before ranking


def test_prefix_is_monotone_in_budget(views):
    i = R.Index(views.where("src > 1"), Params())
    ranked = R.ranked_tokens(views.where("src = 1"), i.weights, Params())
    sizes = [rows(R.prefix(ranked, Params(budget=b)).select("s1_id", "src", "token")) for b in (0, 1, 3, 100)]
    assert all(a <= b for a, b in zip(sizes, sizes[1:]))


def test_candidates(views):
    i = R.Index(views.where("src > 1"), Params(topk=1))
    got = rows(i.candidates(views.where("src = 1")).select("s1_id", "src", "tgt_id", "rank"))
    assert got == {(1, 2, 11, 0), (1, 3, 13, 0), (3, 2, 15, 0)}  # countries never mix
    assert R.Index(views.where("src > 1"), Params(norm="l2")).candidates(views.where("src = 1")).count() == 4


def test_limits_reach_the_plan(views):
    i = R.Index(views.where("src > 1"), Params())
    plan = R.Index(views.where("src > 1"), Params(topk=3)).candidates(views.where("src = 1"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    kept = R.prefix(R.ranked_tokens(views.where("src = 1"), i.weights, Params()), Params())
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_features(spark, views):
    truth = spark.createDataFrame([(1, 11)], "s1_id long, tgt_id long")
    pairs = PR.build(views, truth, Params(topk=2))
    assert not set(PR.FEATURES) - set(pairs.columns) and len(PR.FEATURES) == 45
    best = pairs.where("s1_id = 1 AND tgt_id = 11").first()
    assert (best.label, best.nm_ratio, best.score_ratio, best.score_margin, best.rank_n, best.house_eq, best.zip_eq, best.zip_both) == (1, 1.0, 1.0, 0.0, 0.0, 1, 1, 0)
    assert (best.mindf_a, best.mindf_min, best.is_s3) == (0.0, 0.0, 0) and best.ncand_n == 0.5
    live = PR.build(views, truth, Params(topk=2, mindf="live")).where("s1_id = 1 AND tgt_id = 11").first()
    assert live.mindf_a == pytest.approx(math.log1p(1)) and live.mindf_min == pytest.approx(math.log1p(1))


def test_scores_of_matches(spark):
    entities = spark.createDataFrame([(i,) for i in range(1, 6)], "s1_id long")
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (5, 13)], "s1_id long, tgt_id long")
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 99, 0.8), (3, 98, 0.7), (5, 13, 0.4)], "s1_id long, tgt_id long, p double")
    counts = M.entity_counts(entities, pairs.where("p >= 0.5"), truth)
    got = {r.s1_id: r.f for r in counts.select("s1_id", M.f_half().alias("f")).collect()}
    assert got == {1: pytest.approx(1.25 * 1 * 0.5 / (0.25 + 0.5)), 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}
    s = M.summary(counts).first()
    assert (s.n_entities, s.precision_micro, s.recall_micro, s.singleton_recall, s.empty_rate) == (5, pytest.approx(1 / 3, abs=1e-6), 0.25, 0.5, 0.4)
    swept = {r.threshold: r.f05_macro for r in D.sweep(entities, pairs, truth, (0.3, 0.5, 0.95)).collect()}
    for t, f in swept.items():
        assert f == pytest.approx(M.summary(M.entity_counts(entities, pairs.where(F.col("p") >= t), truth)).first().f05_macro)


def test_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.95), (3, 11, 0.5), (4, 11, 0.5)], "s1_id long, tgt_id long, p double")
    assert rows(D.one_to_one(pairs).select("s1_id", "tgt_id")) == {(2, 10), (3, 11)}


def test_files(spark, tmp_path):
    data = [("S1_1", 'a "b", c', " x\\y ", "US"), ("S1_2", "", "", "")]
    df = spark.createDataFrame(data, list(T.RECORD))
    T.write_tsv(df, f"{tmp_path}/r")
    assert rows(T.read_tsv(spark, f"{tmp_path}/r", T.RECORD)) == set(data)
    entities = spark.createDataFrame([("S1_1",), ("S1_2",)], "s1_id string")
    found = spark.createDataFrame([("S1_1", 3, 0, "S3_9"), ("S1_1", 2, 1, "S2_7"), ("S1_1", 2, 0, "S2_8")], "s1_id string, src int, rank int, tgt_id string")
    lists = T.match_lists(entities, found)
    assert rows(lists) == {("S1_1", "S2_8,S2_7,S3_9"), ("S1_2", "")}
    assert rows(T.truth_pairs(lists)) == {("S1_1", "S2_8"), ("S1_1", "S2_7"), ("S1_1", "S3_9"), ("S1_2", None)}
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert T.stage(spark, f"file://{tmp_path}/cache", Params().key("v1"), make).count() == 2
    assert len(made) == 1 and Params().key("v1") != Params(kq=3).key("v1")
    blocks = spark.createDataFrame([("US", 2), ("US", 3)], "country string, src int")
    with pytest.raises(RuntimeError):
        T.require_complete(blocks, blocks.limit(1))


def test_models(spark, tmp_path):
    rows_ = [(i, 100 + i, i % 2, float(i % 2) + (i % 7) / 10, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows_, "s1_id long, tgt_id long, label int, x double, y double").cache()
    lr = L.fit_logistic(df, ["x", "y"], max_iter=20)
    L.save(lr, f"{tmp_path}/lr")
    scored = L.probability(df, L.load(f"{tmp_path}/lr"), "p_lr")
    trees = L.fit_trees(df, ["x", "y"], rounds=3, depth=2)
    scored = L.probability(scored, trees, "p_gbt").withColumn("p", L.blend(F.col("p_gbt"), F.col("p_lr")))
    wrong = scored.where((F.col("p") >= 0.5).cast("int") != F.col("label")).count()
    assert wrong < 20 and L.importance(trees, ["x", "y"])[0][0] == "x"
    assert L.downsample(df, 1, 0).where("label = 1").count() == 200


def test_training_and_inference(spark, tmp_path, small):
    """Train, choose, save, score by blocks, assemble; a second run finds every stage, and a lost block is scored again."""
    from kinspark.sources import fixtures as FX

    params, root = Params(kq=10, budget=60, dfmax=150, topk=5), f"file://{tmp_path}"
    views, truth = FX.views(spark, small), FX.truth(spark, small)
    train = lambda: INF.train(spark, views, truth, params, root, "k", val=0.3, fit=0.6, max_iter=20, rounds=2, depth=2)
    config = train()
    assert train() == config and config["variant"].split("|")[0] in ("lr", "xgb", "blend")
    kept = {p.split("-")[0] for p in os.listdir(tmp_path)}
    assert {"pairs", "validation", "sweep", "config", "logistic", "trees", "index"} <= kept
    swept = spark.read.parquet(*[f"{root}/{p}" for p in os.listdir(tmp_path) if p.startswith("sweep")])
    assert swept.count() == 6 * 13 and {r.variant for r in swept.select("variant").distinct().collect()} == {f"{m}|bij={k}" for m in ("lr", "xgb", "blend") for k in (0, 1)}
    validation = spark.read.parquet(*[f"{root}/{p}" for p in os.listdir(tmp_path) if p.startswith("validation")])
    assert {*PR.FEATURES, "label", "p_lr", "p_gbt", "p"} <= set(validation.columns) and "fit" not in validation.columns
    run = lambda: sorted(tuple(r) for r in INF.predict(spark, views, INF.scorer_of(config), config["threshold"], params, root, "m").collect())
    first = run()
    assert len(first) == views.where("src = 1").count()
    blocks = next(p for p in os.listdir(tmp_path) if p.startswith("blocks"))
    shutil.rmtree(f"{tmp_path}/{blocks}/country=de/src=3")
    before = os.stat(f"{tmp_path}/{blocks}/country=en/src=2").st_mtime_ns
    with pytest.raises(RuntimeError):
        INF.assembled(views.where("src = 1").select(F.col("entity_id").alias("s1_id"), "country"), T.read_blocks(spark, f"{root}/{blocks}"))
    assert run() == first and os.stat(f"{tmp_path}/{blocks}/country=en/src=2").st_mtime_ns == before
    # What inference scores is what the pair tables hold.
    lists = {r[0]: r[1] for r in first}
    pairs = PR.build(views, truth, params).select("s1_id", "src", "rank", "tgt_id").collect()
    for s1 in {r.s1_id for r in pairs}:
        own = sorted((r.src, r["rank"], r.tgt_id) for r in pairs if r.s1_id == s1)
        assert lists[s1] == ",".join(str(x) for _, _, x in own)
