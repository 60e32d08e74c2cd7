"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct word shingles. Each permutation yields two
signature values, the minimum and the maximum over the set, so ``PERMUTATIONS`` hash
evaluations a shingle give twice as many values. Bands of ``ROWS`` values key the candidate
buckets; every candidate is confirmed on the full sets.

A pair at the threshold 0.8 shares no band with probability
(1 - 0.8 ** 4) ** 32 < 5e-8, which is what the search may miss.

Buckets are not expanded into pairs. Documents with equal sets are one node from the
start. In the first round each member is compared with the smallest of its bucket. The
second takes the buckets whose members are still in several components:
* one of at most ``BLOCK`` members is a task's work: those outside its largest component are compared with all,
  and a spanning forest of the confirmed links between components is reported;
* the members of larger ones meet by prefix instead. Sets of similarity 0.8 share one of the first fifth of their
  shingles in any one order of all shingles; in order of rarity that fifth is shared by few. This is exact;
* where more than ``BLOCK`` members share even such a shingle, blocks of those outside its largest component meet
  blocks of all.
So a group of near copies costs links in proportion to its size, a template that many different documents share costs
their sets, and no link between different components is lost.

Null texts and texts without words have the empty set and are linked with nothing; a
text with fewer words than a shingle is one shingle. Texts of any length are taken whole. Rows that repeat a doc_id are one
document with several sets, and link all that any of them links; each row is returned. Rows without doc_id are never
linked and keep themselves. An empty table gives no rows. Only doc_id and text are read, so other columns of any name don't matter.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import id_and_text, stored
from .components import components
from .wordhash import PRIME, mix, rolled, word_hashes

PERMUTATIONS, ROWS = 64, 4
#: Bounds of a block in the second round, and of the matrix that compares two of them.
BLOCK, BLOCK_SHINGLES, MATRIX_BYTES = 1024, 1 << 20, 64 << 20
#: Counters that tell how rare a shingle is: the bound of a broadcast of 8 MB. Shingles that share one are taken for equally rare.
COUNTERS = 1 << 20
#: Similarity as a ratio of whole numbers.
SIMILAR = (80, 100)
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    return np.unique(rolled(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each non-empty set."""
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    low = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    high = np.empty_like(low)
    for p in range(PERMUTATIONS):
        y = x * MULTIPLY[p] + ADD[p]
        low[p], high[p] = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    values = np.concatenate((low, high)).reshape(-1, ROWS, len(sets))
    keys = np.repeat(np.arange(len(values), dtype=np.uint64)[:, None], len(sets), 1)
    for r in range(ROWS):
        keys = mix(keys * PRIME + values[:, r])
    return keys.T


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set) and bands (empty for an empty set)."""
    source = id_and_text(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [shingle_set(x, shingle) for x in word_hashes(batch.column("text"), lower=True)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full).view(np.int64) if full else [])
                bands = [next(keys) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        "bands": pa.array(bands, pa.list_(pa.int64())),
                    }
                )

    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its shingles, as sorted signed hashes."""
    source = id_and_text(docs)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = [np.sort(shingle_set(x, shingle).view(np.int64)) for x in word_hashes(batch.column("text"), lower=True)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "shingles": lists})

    return source.mapInArrow(run, f"doc_id {kind}, shingles array<long>")


def sizes_fit(a: Column, b: Column) -> Column:
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; exact in whole numbers."""
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(SIMILAR[1] * F.col("n") >= SIMILAR[0] * (F.col("total") - F.col("n"))).select("a", "b")


def cross_links(table: pa.Table) -> pa.Table:
    """Confirmed links between different components, of the members that ask (role 1 or 2) with those that are asked (0 or 2): a spanning forest of them.

    One row of a byte matrix for each shingle tells which members have it. The rows of a
    member's shingles add up to its intersections with all others at once.
    """
    ids, comp = table.column("rep").to_pylist(), table.column("comp").to_pylist()
    role = table.column("role").to_numpy()
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sets = [values[i:j] for i, j in zip(edges, edges[1:])]
    size = np.array([len(x) for x in sets], np.int64)
    _, row, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), size)
    # A shingle that only one member has adds to no intersection.
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[row]
    shared = number >= 0
    ends = np.concatenate(([0], np.cumsum(np.bincount(member[shared], minlength=len(sets)))))
    number, member = number[shared], member[shared]
    root = {c: c for c in comp}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    asking, pool = np.flatnonzero(role > 0).tolist(), np.flatnonzero(role != 1)
    place = np.full(len(sets), -1)
    height = int((times > 1).sum())
    columns = max(1, MATRIX_BYTES // max(1, height))
    out = []
    for start in range(0, len(pool), columns):
        some = pool[start : start + columns]
        place[:] = -1
        place[some] = np.arange(len(some))
        matrix = np.zeros((height, len(some)), np.uint8)
        here = place[member] >= 0
        matrix[number[here], place[member[here]]] = 1
        for i in asking:
            both = matrix[number[ends[i] : ends[i + 1]]].sum(0, dtype=np.int64)
            near = SIMILAR[1] * both >= SIMILAR[0] * (size[i] + size[some] - both)
            for j in some[near].tolist():
                if top(comp[i]) != top(comp[j]):
                    out.append((ids[i], ids[j]))
                    root[top(comp[i])] = top(comp[j])
    kind = table.schema.field("rep").type
    return pa.table({"a": pa.array([x for x, _ in out], kind), "b": pa.array([y for _, y in out], kind)})


def crossing(rows: DataFrame) -> DataFrame:
    """The rows (key, rep, n, comp) of keys that several components share, with the key's largest component and the numbers of blocks of its members and of those outside it."""
    groups = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"))
    most = F.max(F.struct("members", "size", "comp"))
    keys = groups.groupBy("key").agg(most.alias("main"), F.sum("members").alias("members"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda members, size: F.ceil(F.greatest(members / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    keys = keys.where("comps > 1").select(
        "key", F.col("main.comp").alias("main"), blocks(F.col("members"), F.col("size")).alias("pools"),
        blocks(F.col("members") - F.col("main.members"), F.col("size") - F.col("main.size")).alias("asks"),
    )
    # Written, so that a key with many rows can be split in the join.
    return rows.join(stored(keys, "keys"), "key")


def compared(rows: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Links within the keys of ``crossing`` rows: blocks of the members outside the largest component against blocks of all."""
    asks, one = F.col("comp") != F.col("main"), F.col("pools") == 1
    number = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda role, i, j: F.struct(F.lit(role).alias("role"), i.alias("i"), j.alias("j"))
    zero, none = F.lit(0), F.array().cast("array<struct<role:int,i:int,j:int>>")
    alone = F.when(asks, F.array(place(2, zero, zero))).otherwise(F.array(place(0, zero, zero)))
    asking = F.when(asks, F.transform(every("pools"), lambda j: place(1, number("asks"), j))).otherwise(none)
    spread = F.concat(F.transform(every("asks"), lambda i: place(0, i, number("pools"))), asking)
    dealt = rows.select("key", "rep", "comp", F.inline(F.when(one, alone).otherwise(spread)))
    return dealt.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(cross_links, f"a {kind}, b {kind}")


def prefixes(members: DataFrame, kind: str) -> DataFrame:
    """(key, rep, n, comp): each member under the rarest fifth of its shingles, as ``key``."""
    counters = members.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    count = np.zeros(COUNTERS, np.int64)
    for r in counters.toLocalIterator():
        count[r["c"]] = r["n"]
    shipped = members.sparkSession.sparkContext.broadcast(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ends = [np.empty(0, np.int64)], [0]
            lists = batch.column("shingles")
            for k in range(len(lists)):
                own = lists[k].values.to_numpy()
                # Similar sets have (100 - 80) / 100 of either set's size less in common at most.
                first = len(own) - -(-SIMILAR[0] * len(own) // SIMILAR[1]) + 1
                keys.append(own[np.lexsort((own, shipped.value[own % COUNTERS]))[:first]])
                ends.append(ends[-1] + len(keys[-1]))
            out = {"rep": batch.column("rep"), "n": batch.column("n"), "comp": batch.column("comp")}
            yield pa.RecordBatch.from_pydict(out | {"keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))})

    found = members.mapInArrow(run, f"rep {kind}, n int, comp {kind}, keys array<long>")
    return found.select(F.explode("keys").alias("key"), "rep", F.col("n").cast("long").alias("n"), "comp")


def second_round(buckets: DataFrame, roots: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Links that the first round left: between members of a bucket that are in different components."""
    own = buckets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    # The bucket's first member has met all others already.
    others = own.where("rep != first").select("key", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    rows = stored(crossing(others), "crossing")
    links = compared(rows.where("pools = 1"), sets, kind)
    large = rows.where("pools > 1").select("rep", "comp").distinct()
    if large.isEmpty():
        return links
    members = stored(large.join(sets.withColumn("n", F.size("shingles")), "rep"), "members")
    return links.unionByName(compared(stored(crossing(prefixes(members, kind)), "crossing"), sets, kind))


def shared_ids(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): a doc_id whose rows have several sets, with the smallest doc_id of each of these."""
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo != hi").select("doc_id")
    own = full.join(several, "doc_id").select("doc_id", "set_key").join(reps.select("set_key", "rep"), "set_key")
    return own.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row for each of ``docs``."""
    sigs = stored(signatures(docs, shingle), "signatures")
    kind = sigs.schema["doc_id"].dataType.simpleString()
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    each = reps.select(F.explode("bands").alias("key"), "rep", "n")
    firsts = each.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("f"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # Written first: a bucket with many members can then be split in the join.
    firsts = stored(firsts.select("key", F.col("f.rep").alias("first"), F.col("f.n").alias("first_n")), "firsts")
    buckets = stored(each.join(firsts, "key"), "buckets")
    needed = buckets.select("rep").distinct()
    # One row for each class: a doc_id that several rows share may stand for several sets.
    texts = id_and_text(docs).join(needed.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(shingle_sets(texts, shingle).select(F.col("doc_id").alias("rep"), "shingles").distinct(), "sets")
    stars = buckets.where(F.col("rep") != F.col("first")).where(sizes_fit(F.col("n"), F.col("first_n")))
    pairs = stars.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(confirmed(pairs, sets).unionByName(shared_ids(full, reps)), "links")
    roots = components(links)
    more = stored(second_round(buckets, roots, sets, kind), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    classes = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    classes = classes.select("set_key", F.coalesce("root", "rep").alias("root"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def with_two_words(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2)


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs``, with all columns, without the documents that are near duplicates of a smaller doc_id's component."""
    dropped = near_duplicates(docs, shingle).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
