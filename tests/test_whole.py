"""Queries under the limits of production."""

import importlib
import importlib.util

import duckdb
import pytest

from kinspark import config
from kinspark.operators import learn
from kinspark.operators import pairs as PR
from kinspark.plans import oracle
from kinspark.sources import tables


@pytest.fixture(scope="module")
def entry_module():
    return importlib.import_module("__spark_entry__")


def cell(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["query_prefix", "retrieve_topk", "pair_context", "recall_at_k"])
def test_whole(spark, small, entry_module, monkeypatch, name):
    """The rows of the same SQL with the limits of production in it."""
    monkeypatch.setattr(config, "SMALL", config.PRODUCTION)
    spec = importlib.util.spec_from_file_location("kinspark.plans.oracle_whole", oracle.__file__)
    production = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(production)
    assert oracle.CHAIN != production.CHAIN
    sql = entry_module.oracle_sql()[name].replace(oracle.CHAIN, production.CHAIN)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    a, b = entry_module.queries()[f"{name}_whole"](spark, small), con.sql(sql)
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(tuple(map(cell, r)) for r in a.select(*cols).collect())
    assert left == sorted(tuple(map(cell, r)) for r in b.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()) and left


def test_entry_is_whole(spark, entry_module):
    assert entry_module.entry(spark).agg({"rank": "max"}).first()[0] >= 5


def test_grid(spark, small, entry_module):
    """No budget of the published grid bites on a small table, so only the list length counts."""
    rows = entry_module.queries()["budget_grid_whole"](spark, small).collect()
    assert {(r.budget, r.topk) for r in rows} == {(b, k) for b in (40_000, 80_000, 200_000) for k in (20, 30, 45)}
    by_length = {}
    for r in rows:
        by_length.setdefault(r.topk, set()).add((r.candidates, r.found))
    assert all(len(v) == 1 for v in by_length.values())
    assert next(iter(by_length[30]))[0] == entry_module.queries()["retrieve_topk_whole"](spark, small).count()


@pytest.mark.parametrize("name", ["model_lr", "model_gbt", "model_blend", "neg_downsample_whole"])
def test_learning_is_whole(spark, small, entry_module, monkeypatch, tmp_path, name):
    """All 45 features and the operators' own settings; the fits themselves are left out."""
    asked = []
    # Models are kept between queries: these belong in a folder of their own.
    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(learn, "save", lambda model, path: None)
    monkeypatch.setattr(learn, "load", lambda path: None)
    for f in ("fit_logistic", "fit_trees", "downsample"):
        monkeypatch.setattr(learn, f, lambda pairs, *a, f=f, **k: asked.append((f, a, k)) or pairs)
    monkeypatch.setattr(learn, "probability", lambda pairs, model, n: pairs.selectExpr("*", f"0D AS {n}"))
    entry_module.queries()[name](spark, small)
    every = (list(PR.FEATURES),)
    lr, gbt = ("fit_logistic", every, {}), ("fit_trees", every, {})
    assert len(PR.FEATURES) == 45
    assert asked == {"model_lr": [lr], "model_gbt": [gbt], "model_blend": [lr, gbt], "neg_downsample_whole": [("downsample", (), {})]}[name]


@pytest.mark.parametrize("params", [config.SMALL, config.PRODUCTION, config.PRODUCTION.with_(w_addr=0.0, topk=3)])
def test_best(spark, small, params):
    """Shards and chunks give the rows of the join of all pairs, which no plan of candidates has any more."""
    from kinspark.plans import registry
    from kinspark.operators import retrieve as R

    views = registry.views(spark, small)
    own, entities = R.Index(views.where("src > 1"), params), views.where("src = 1")
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "src", "country", "tgt_id", "score", "rank").collect()))
    joined = rows(R.top(own.scores(entities), params.topk))
    assert joined and joined == rows(own.candidates(entities))
    assert joined == rows(R.best(own.queries(entities), own.postings, own.sizes, params.topk, shard=9, chunks=3))
    plan = own.candidates(entities)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum((v" not in plan and "sum((v" in own.scores(entities)._jdf.queryExecution().optimizedPlan().toString()


def test_best_of_ties():
    import numpy as np

    from kinspark.operators import shards

    scores = np.zeros(10_000)
    scores[5_000:9_000], scores[7], scores[9_999] = 0.5 + 1e-9, 0.5, 0.7
    places, rounded = shards.best(scores, 30)
    assert places.tolist() == [9_999, 7, *range(5_000, 5_028)] and set(rounded.tolist()) == {0.7, 0.5}
    assert shards.best(np.zeros(10_000), 30)[0].tolist() == []


def test_examples_are_chosen_first(spark, small, entry_module):
    """The same rows as from all pairs with all scores, with strings and scores of the chosen ones alone."""
    from kinspark.operators import metrics
    from kinspark.plans import registry

    run = lambda df: [tuple(map(cell, r)) for r in df.collect()]
    every = registry.whole(lambda s, d: metrics.examples(registry.featured(s, d), registry.TH, 20, True, more=metrics.SHOWN))
    chosen = entry_module.queries()["err_examples_scored"](spark, small)
    assert run(chosen) == run(every(spark, small)) and chosen.count() == 20
    for name in ("err_examples_scored", "err_examples_fp_whole", "err_examples_fn_whole"):
        plan = entry_module.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan[: plan.rindex("GlobalLimit")], name


@pytest.mark.parametrize("shard, chunks", [(1 << 18, 4), (9, 3)])
def test_lists_of_widening_limits(spark, small, shard, chunks):
    """One pass gives for each limits the rows of a join of its own; limits that do not widen are refused."""
    from pyspark.sql import functions as F

    from kinspark.operators import retrieve as R
    from kinspark.plans import registry

    views = registry.views(spark, small)
    pool, entities = views.where("src > 1"), views.where("src = 1")
    chain = [config.SMALL.with_(kq=k, budget=b, w_addr=0.5) for k, b in ((4, 20), (10, 60), (10, 60), (30, 20_000))]
    own = R.Index(pool, chain[0])
    queries = R.leveled(R.ranked_tokens(entities, own.weights, chain[-1]), chain)
    found = R.lists(queries, own.postings, own.sizes, 5, shard, chunks)
    pairs = found.select("s1_id", "src", "country", F.explode(F.sequence("first", "last")).alias("level"), F.arrays_zip("ids", "scores").alias("l"))
    pairs = pairs.select("s1_id", "src", "country", "level", F.inline("l")).withColumnsRenamed({"ids": "tgt_id", "scores": "score"})
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "src", "country", "tgt_id", "score", "rank").collect()))
    best = R.top(pairs, 5, "level").cache()
    each = [rows(R.top(R.Index(pool, p).scores(entities), 5)) for p in chain]
    assert each == [rows(best.where(f"level = {i}")) for i in range(len(chain))] and each[0] != each[1] != each[3]
    with pytest.raises(ValueError):
        R.leveled(own.tokens, chain[::-1])


def test_grid_is_one_pass(spark, small, entry_module):
    """The grid meets the postings once for all its limits, and its pairs are not dealt out again to meet the truth."""
    plan = entry_module.queries()["budget_grid_whole"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan[: plan.index("Window")]
