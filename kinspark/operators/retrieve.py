"""Retrieval: the rarest tokens of a query within a budget, matched with the postings, the best k kept per pool.

The prefix is cut before the postings are met. ``scores`` joins them and has every pair that shares a token;
``candidates`` needs a query's best alone, and sums and cuts its pairs inside a task (``shards``): a block's records
go into shards of at most some ``SHARD``, its queries into ``CHUNKS`` parts, and each part meets each shard once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Params
from . import index as I
from . import shards as SH

#: Records of a block in one shard, and parts of a block's queries.
SHARD = 1 << 18
CHUNKS = 4


def ranked_tokens(queries: DataFrame, weights: DataFrame, params: Params) -> DataFrame:
    """(s1_id, src, country, field, token, df, n, fw, pos, before) of the tokens that a pool knows, rarest first, kq at most.

    ``before`` is the sum of df of the tokens ahead. Ties go by field, then token.
    """
    own = I.exploded(queries).drop("src").withColumnRenamed("entity_id", "s1_id")
    known = own.join(weights.select("src", "country", "token", "df", "n"), ["country", "token"])
    order = Window.partitionBy("s1_id", "src").orderBy("df", "field", "token")
    # The running sum includes the row and df is taken off again: so Spark limits the rows below the window.
    running = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = known.select(
        "s1_id", "src", "country", "field", "token", "df", "n",
        F.when(F.col("field") == 0, 1.0).otherwise(params.w_addr).alias("fw"),
        F.row_number().over(order).alias("rn"),
        running.alias("running"),
    )
    rows = rows.where(F.col("rn") <= params.kq)
    return rows.select("*", (F.col("rn") - 1).alias("pos"), (F.col("running") - F.col("df")).alias("before")).drop("rn", "running")


def kept(params: Params) -> Column:
    """The first token always; others while within kq, dfmax, and a budget that the tokens ahead have not used up."""
    free = (F.col("df") <= params.dfmax) & (F.col("before") < params.budget)
    return (F.col("pos") < params.kq) & ((F.col("pos") == 0) | free)


def prefix(tokens: DataFrame, params: Params) -> DataFrame:
    return tokens.where(kept(params))


def weighted(tokens: DataFrame, params: Params) -> DataFrame:
    """With ``v``, the normalised query weight."""
    own = Window.partitionBy("s1_id", "src")
    rows = tokens.withColumn("raw", F.col("fw") * F.log(1 + F.col("n") / F.greatest("df", F.lit(1))))
    part = F.col("raw") * F.col("raw") if params.norm == "l2" else F.col("raw")
    return rows.withColumn("v", F.col("raw") / F.greatest(F.sqrt(F.sum(part).over(own)), F.lit(1e-9))).drop("raw")


def scores(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(s1_id, src, country, tgt_id, score) of all pairs that share a kept token; rounded so that ranking is the same anywhere."""
    q = queries.select("s1_id", "src", "country", "token", "v")
    both = q.join(postings, ["src", "country", "token"])
    return both.groupBy("s1_id", "src", "country", "tgt_id").agg(F.round(F.sum(F.col("v") * F.col("w")), 6).alias("score"))


def top(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """With ``rank`` from 0, the best k of each query and pool (and ``by``); ties go to the smaller id."""
    order = Window.partitionBy("s1_id", "src", *by).orderBy(F.desc("score"), "tgt_id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).withColumn("rank", F.col("rn") - 1).drop("rn")


def gathered(rows: DataFrame, record: str, weight: str, level: str | None = None, norms: Column | None = None) -> DataFrame:
    """(id, src, country, tokens, weights, levels, norms): a row for each record or query, its tokens joined by spaces, which none contains.
    ``levels`` and ``norms`` (a sum of ``rows``) are null unless given."""
    fields = ["token", F.col(weight).alias("w"), *([F.col(level).alias("level")] if level else [])]
    lists = rows.groupBy(F.col(record).alias("id"), "src", "country").agg(F.collect_list(F.struct(*fields)).alias("l"), (F.lit(None) if norms is None else norms).cast("array<double>").alias("norms"))
    levels = F.col("l.level") if level else F.lit(None).cast("array<int>")
    return lists.select("id", "src", "country", F.array_join("l.token", " ").alias("tokens"), F.col("l.w").alias("weights"), levels.alias("levels"), "norms")


def leveled(tokens: DataFrame, chain: list[Params]) -> DataFrame:
    """Gathered queries that ask for a list under each limits of ``chain``. Each of these keeps all tokens that the one before
    keeps, so that a token has the level of the first that keeps it."""
    for a, b in zip(chain, chain[1:]):
        if not (a.kq <= b.kq and a.budget <= b.budget and a.dfmax <= b.dfmax) or (a.w_addr, a.norm) != (b.w_addr, b.norm):
            raise ValueError(f"{b} does not keep all that {a} keeps")
    level = F.coalesce(*(F.when(kept(p), i) for i, p in enumerate(chain)))
    rows = tokens.select("*", level.cast("int").alias("level"), (F.col("fw") * F.log(1 + F.col("n") / F.greatest("df", F.lit(1)))).alias("raw")).where("level IS NOT NULL")
    part = F.col("raw") * F.col("raw") if chain[0].norm == "l2" else F.col("raw")
    norm = lambda i: F.greatest(F.sqrt(F.sum(F.when(F.col("level") <= i, part))), F.lit(1e-9))
    return gathered(rows, "s1_id", "raw", "level", F.array(*(norm(i) for i in range(len(chain)))))


def lists(own: DataFrame, postings: DataFrame, sizes: DataFrame, k: int, shard: int = SHARD, chunks: int = CHUNKS) -> DataFrame:
    """(s1_id, src, country, first, last, ids, scores) by shard, for the gathered queries ``own``: the best k of the lists ``first`` to ``last``.
    Rows of a query are in one partition."""
    # One row: the number of shards, by the largest block.
    many = sizes.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.max("n"), F.lit(0)) / shard)).cast("int").alias("many"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    records = gathered(postings, "tgt_id", "w").crossJoin(F.broadcast(many))
    records = records.select("*", part(F.col("many")).alias("shard"), each(F.lit(chunks)).alias("chunk"), F.lit(0).alias("side"))
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    shape = f"s1_id {kind['id']}, src {kind['src']}, country {kind['country']}, first int, last int, ids array<{dict(postings.dtypes)['tgt_id']}>, scores array<double>"
    own = own.crossJoin(F.broadcast(many))
    own = own.select("*", each(F.col("many")).alias("shard"), part(F.lit(chunks)).alias("chunk"), F.lit(1).alias("side"))
    both = records.unionByName(own).drop("many").repartition(*SH.KEY).sortWithinPartitions(*SH.KEY, "side")
    return both.mapInArrow(lambda batches: SH.scored(batches, k), shape).repartition("s1_id")


def best(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k: int, shard: int = SHARD, chunks: int = CHUNKS) -> DataFrame:
    """The rows of ``top(scores(queries, postings), k)``; pairs beyond a query's best k in a shard leave no task."""
    found = lists(gathered(queries, "s1_id", "v"), postings, sizes, k, shard, chunks)
    pairs = found.select("s1_id", "src", "country", F.explode(F.arrays_zip("ids", "scores")).alias("p"))
    return top(pairs.select("s1_id", "src", "country", F.col("p.ids").alias("tgt_id"), F.col("p.scores").alias("score")), k)


class Index:
    """The tables of a pool, lazily defined; nothing runs until a query does."""

    def __init__(self, pool: DataFrame, params: Params):
        self.pool, self.params = pool, params
        self.tokens = I.exploded(pool)
        self.sizes = I.block_sizes(pool)
        self.frequency = I.frequencies(self.tokens)
        self.weights = I.idf(self.frequency, self.sizes)
        self.postings = I.postings(self.tokens, self.weights, params)
        self.rarest = I.rarest(pool, self.tokens, self.frequency)

    def queries(self, entities: DataFrame) -> DataFrame:
        return weighted(prefix(ranked_tokens(entities, self.weights, self.params), self.params), self.params)

    def scores(self, entities: DataFrame) -> DataFrame:
        return scores(self.queries(entities), self.postings)

    def candidates(self, entities: DataFrame) -> DataFrame:
        return best(self.queries(entities), self.postings, self.sizes, self.params.topk)

    def lists(self, entities: DataFrame, chain: list[Params]) -> DataFrame:
        """Best topk under each limits of ``chain``, from the narrowest on, by one pass over the postings."""
        tokens = ranked_tokens(entities, self.weights, chain[-1])
        return lists(leveled(tokens, chain), self.postings, self.sizes, self.params.topk)
