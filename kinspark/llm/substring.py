"""Substring dedup: FM-indexes of repeated passages, searched backwards.

A window is ``window`` consecutive words. Each word covered by a window whose word
sequence also starts in a document of smaller doc_id is removed.

Windows are sharded by content. A window's anchor is the least hash among its
``gram``-word runs; a segment is a stretch of windows with the same anchor. Equal windows
have equal anchors, so they meet in one shard however far apart their documents are:
1. anchors that occur in one document only are set aside (two joins on 64-bit anchors);
2. segments of the others go to their anchor's shard, equal ones (by 128-bit keys) sent once for each batch with their
   smallest and largest doc_id, so that a passage that a third of all documents share arrives a few times;
3. a shard builds one FM-index of all its segments and streams them through it. Backward search from each of a
   segment's words gives the matching statistics: the length of the longest stretch that ends there and also
   stands in a smaller document. Stretches of ``window`` words or more are reported as covered windows. A segment that several
   documents have is searched whole, too: the smallest document in its interval covers it in all others;
4. the verdicts go back to the documents by segment.
Anchors with more than ``HOT`` segments send every window as a segment of its own, sharded by its own
hash, so no shard grows with them.

Null texts and texts shorter than a window lose nothing; texts of any length are taken whole. Rows of one doc_id never
cover each other; repeated rows get equal results, rows that share a doc_id with other texts their own. Rows without doc_id neither cover nor lose
anything. An empty table gives no rows. Only doc_id and text are read; ``dedup`` carries all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import id_and_text, stored, unused
from .fmindex import FMIndex
from .wordhash import NUMBERS, OTHERS, PRIME, mix, rolled, span_hashes, spans

HOT = 50_000
#: Segments in a shard, about.
SHARD = 30_000
#: Bytes of text gone through at once.
SLICE = 1 << 20
WORDS = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def segments(hashes: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each segment of texts whose words lie end to end, text k from ``at[k]`` on."""
    count = len(hashes) - window + 1
    if count < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    span = window - gram + 1
    low = np.uint64((1 << span.bit_length()) - 1)
    # The low bits give way to the place in the text, which tells runs of equal hashes apart; the anchor is the rest.
    least = rolled(hashes, gram)
    place = (np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at)))[: len(least)]
    least = (least & ~low) | (place.astype(np.uint64) & low)
    held = 1
    while held < span:
        step = min(held, span - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    # Windows that reach into the next text are none, and part segments.
    inner = at[1:-1]
    torn = np.zeros(count + 1, np.int32)
    np.add.at(torn, np.clip(inner - window + 1, 0, count), 1)
    np.add.at(torn, np.clip(inner, 0, count), -1)
    torn = np.cumsum(torn[:-1]) > 0
    fresh = np.append(True, least[1:] != least[:-1])
    fresh[at[:-1][at[:-1] < count]] = True
    edges = np.flatnonzero(fresh | torn)
    sizes = np.append(edges[1:], count) - edges
    whole = ~torn[edges]
    starts = edges[whole]
    return starts, sizes[whole], least[starts] & ~low


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each segment: doc_id, anchor and its first window."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, firsts, ends, at = spans(batch.column("text"))
                starts, _, found = segments(span_hashes(raw, firsts, ends, NUMBERS), at, window, gram)
                row = np.searchsorted(at, starts, "right") - 1
                lists = pa.array(np.searchsorted(starts, at), pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "starts": pa.ListArray.from_arrays(lists, pa.array((starts - at[row]).astype(np.int32))),
                        "anchors": pa.ListArray.from_arrays(lists, pa.array(found.view(np.int64))),
                    }
                )

    found = docs.mapInArrow(run, f"doc_id {kind}, starts array<int>, anchors array<long>")
    return found.select("doc_id", F.inline(F.arrays_zip("anchors", "starts"))).withColumnsRenamed({"anchors": "anchor", "starts": "start"})


def key(hashes: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """A hash of each segment's words. A segment is shorter than two windows: its first and last window have all of them."""
    if not len(start):
        return np.empty(0, np.uint64)
    whole = rolled(hashes, window)
    return mix((whole[start] * PRIME + whole[start + n - 1]) * PRIME + n.astype(np.uint64))


def keyed_segments(batch: pa.RecordBatch, window: int, gram: int) -> dict[str, np.ndarray]:
    """The chosen segments of all texts of a batch, hot ones window by window: row (of the batch), start (first window), n (windows),
    anchor, two hashes as key, and the bytes from ``begin`` to ``end`` of all texts end to end (``raw``) that hold its words.

    Rows that share a doc_id have the starts of all of them; those that begin no segment of a row's own are left out.
    """
    raw, firsts, ends, at = spans(batch.column("text"))
    one, two = span_hashes(raw, firsts, ends, NUMBERS), span_hashes(raw, firsts, ends, OTHERS)
    starts, sizes, found = segments(one, at, window, gram)
    lists = batch.column("starts")
    times = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(times)), times)
    start = at[row] + lists.flatten().to_numpy().astype(np.int64)
    hot = batch.column("hot").flatten().to_numpy(zero_copy_only=False).astype(bool)
    inside = start < at[row + 1]
    row, start, hot = row[inside], start[inside], hot[inside]
    order = np.argsort(start)
    row, start, hot = row[order], start[order], hot[order]
    place = np.searchsorted(starts, start)
    own = place < len(starts)
    own[own] = starts[place[own]] == start[own]
    row, start, hot, place = row[own], start[own], hot[own], place[own]
    times = np.where(hot, sizes[place], 1)
    total = int(times.sum())
    start = np.repeat(start, times) + np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    row, hot, place = (np.repeat(x, times) for x in (row, hot, place))
    n = np.where(hot, 1, sizes[place])
    out = {"raw": raw, "row": row, "start": start - at[row], "n": n}
    out["one"], out["two"] = (key(hashes, start, n, window) for hashes in (one, two))
    out["anchor"] = np.where(hot, out["one"], found[place])
    return out | {"begin": firsts[start], "end": ends[start + n + window - 2]}


def to_shards(chosen: DataFrame, shards: int, window: int, gram: int) -> DataFrame:
    """shard, segment, first (smallest doc_id) and last (largest), merged within each batch. A shard works out the keys anew: they would not get smaller on the way."""
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                got = keyed_segments(batch, window, gram)
                ids = batch.column("doc_id")
                # Rows in order of doc_id: the least and the greatest of a segment are the first and last of its run.
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                order = np.lexsort((rank[got["row"]], got["two"], got["one"]))
                one, two = got["one"][order], got["two"][order]
                head = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(order)])
                tail = np.append(head[1:], len(order))[: len(head)] - 1
                first, last = order[head], order[tail]
                raw = got["raw"].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array((mix(got["anchor"][first]) % np.uint64(shards)).astype(np.int32)),
                        "segment": pa.array([raw[a:b] for a, b in zip(got["begin"][first].tolist(), got["end"][first].tolist())], pa.binary()),
                        "first": ids.take(pa.array(got["row"][first])),
                        "last": ids.take(pa.array(got["row"][last])),
                    }
                )

    return chosen.mapInArrow(run, f"shard int, segment binary, first {kind}, last {kind}")


def search_shard(table: pa.Table, window: int) -> pa.Table:
    """key, first and mask (covered windows of the segment as its smallest document has it, by bits); any other document loses the whole segment.

    Segments that occur in one document and have no covered window are left out.
    """
    raw, starts, ends, at = spans(table.column("segment").combine_chunks().cast(pa.large_string()))
    keys = {name: key(span_hashes(raw, starts, ends, numbers), at[:-1], np.diff(at) - window + 1, window).view(np.int64) for name, numbers in (("one", NUMBERS), ("two", OTHERS))}
    rows = pa.table({"one": keys["one"], "two": keys["two"], "segment": table.column("segment"), "first": table.column("first"), "last": table.column("last")})
    merged = rows.group_by(["one", "two"]).aggregate([("segment", "min"), ("first", "min"), ("last", "max")]).combine_chunks()
    first, last = merged.column("first_min").combine_chunks(), merged.column("last_max").combine_chunks()
    # Owners by order of doc_id.
    values = pc.unique(first)
    values = values.take(pc.sort_indices(values))
    owner = pc.index_in(first, values).to_numpy(zero_copy_only=False).astype(np.int32)
    ids: dict[bytes, int] = {}
    parts, sizes = [], []
    for raw in merged.column("segment_min").to_pylist():
        words = raw.split()
        parts += [ids.setdefault(w, len(ids) + 1) for w in words]
        parts.append(0)
        sizes.append(len(words))
    text, size = np.array(parts, np.int64), np.array(sizes, np.int64)
    begins = np.cumsum(size + 1) - size - 1
    index = FMIndex(text, np.repeat(owner, size + 1), int(size.max(initial=0)) + 1)
    # Matching statistics of each segment's words from the first that can end a window.
    n = size - window + 1
    which = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    length = index.longest_earlier(text, begins[which] + nth + window - 1, nth + window, owner[which])
    mask = np.zeros(len(size), np.int64)
    reported = length >= window
    np.bitwise_or.at(mask, which[reported], np.int64(1) << nth[reported])
    # Segments of several documents: the least owner of the whole.
    several = np.flatnonzero(~np.asarray(pc.equal(first, last)))
    least = owner.copy()
    least[several] = index.least_of(text, begins[several], size[several])
    told = mask != 0
    told[several] = True
    out = {"one": merged.column("one").combine_chunks(), "two": merged.column("two").combine_chunks(), "first": values.take(pa.array(least)), "mask": pa.array(mask)}
    return pa.table(out).filter(pa.array(told))


def occurrences(chosen: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row_key, key (one, two), start and n (windows) of every chosen segment."""
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                got = keyed_segments(batch, window, gram)
                ends = pa.array(np.searchsorted(got["row"], np.arange(batch.num_rows + 1)), pa.int32())
                out = {"one": got["one"].view(np.int64), "two": got["two"].view(np.int64), "start": got["start"].astype(np.int32), "n": got["n"].astype(np.int32)}
                lists = {k: pa.ListArray.from_arrays(ends, pa.array(x)) for k, x in out.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key")} | lists)

    out = chosen.mapInArrow(run, f"doc_id {kind}, row_key long, one array<long>, two array<long>, start array<int>, n array<int>")
    return out.select("doc_id", "row_key", F.inline(F.arrays_zip("one", "two", "start", "n")))


def cut(text: str | None, covered: list[tuple[int, int]], window: int) -> tuple[np.ndarray, list[bytes]]:
    """A mask of the removed words, and all words each with the white space after it."""
    pieces = WORDS.findall((text or "").encode())
    mask = np.zeros(len(pieces), bool)
    for start, bits in covered:
        while bits:
            low = (bits & -bits).bit_length() - 1
            mask[start + low : start + low + window] = True
            bits &= bits - 1
    return mask, pieces


def removals(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Documents with anchors that several share (doc_id, row_key, text, starts, hot), and doc_id, row_key, covered for those with covered windows."""
    known = docs.where(F.col("doc_id").isNotNull())
    each = anchors(known, window, gram)
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    # Written first: an anchor that very many segments have can then be split in the join.
    shared = stored(shared.where("lo < hi").select("anchor", (F.col("n") > HOT).alias("hot")), "anchors")
    # By doc_id alone: rows that share one are few, and get each other's places, which does no harm.
    marked = each.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("start", "hot")).alias("s"))
    marked = marked.select("doc_id", F.col("s.start").alias("starts"), F.col("s.hot").alias("hot"))
    chosen = stored(known.join(marked, "doc_id"), "shared")
    total = chosen.agg(F.sum(F.size("starts"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = to_shards(chosen, int(total // SHARD) + 1, window, gram)
    verdicts = sent.groupBy("shard").applyInArrow(lambda t: search_shard(t, window), f"one long, two long, first {kind}, mask long")
    own = occurrences(chosen, window, gram).join(verdicts, ["one", "two"])
    bits = F.when(F.col("doc_id") > F.col("first"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask"))
    own = own.select("doc_id", "row_key", "start", bits.alias("bits")).where("bits != 0")
    return chosen, own.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "bits")).alias("covered"))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows that share a doc_id stay apart by the hash of their text."""
    return id_and_text(docs).withColumn("row_key", F.xxhash64("text"))


def changed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row_key, n_removed, kept_text (white space as it was) and kept_sha256 (kept words joined by spaces) of the documents that lose words."""
    docs = keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen, covered = removals(docs, window, gram)
    touched = chosen.select("doc_id", "row_key", "text").join(covered, ["doc_id", "row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                removed, kept, digest = [], [], []
                for text, runs in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist()):
                    mask, pieces = cut(text, [(x["start"], x["bits"]) for x in runs], window)
                    rest = b"".join([p for p, out in zip(pieces, mask) if not out])
                    removed.append(int(mask.sum()))
                    kept.append(rest.decode())
                    digest.append(hashlib.sha256(b" ".join(rest.split())).hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "row_key": batch.column("row_key"),
                        "n_removed": pa.array(removed, pa.int64()),
                        "kept_text": pa.array(kept, pa.string()),
                        "kept_sha256": pa.array(digest, pa.string()),
                    }
                )

    out = touched.mapInArrow(run, f"doc_id {kind}, row_key long, n_removed long, kept_text string, kept_sha256 string")
    return out.dropDuplicates(["doc_id", "row_key"])


def dedup(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """``docs`` with all their columns, ``text`` without the covered words. Documents that lose nothing keep their text to the byte."""
    own, key, kept = unused(docs, "own_id", "own_key", "own_text")
    new = changed(docs, window, gram).select(F.col("doc_id").alias(own), F.col("row_key").alias(key), F.col("kept_text").alias(kept))
    both = docs.join(new, (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(key)), "left")
    return both.withColumn("text", F.coalesce(kept, "text")).select(*docs.columns)


def word_digests(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_words and the digest of all words joined by spaces."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(x or "").encode().split() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "row_key": batch.column("row_key"),
                    "n_words": pa.array([len(x) for x in words], pa.int64()),
                    "all_sha256": pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in words], pa.string()),
                }
            )

    return docs.mapInArrow(run, f"doc_id {kind}, row_key long, n_words long, all_sha256 string")


def digests(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    new = changed(docs, window, gram).select("doc_id", "row_key", "n_removed", "kept_sha256")
    both = word_digests(keyed(docs)).join(new, ["doc_id", "row_key"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
