"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, each text scanned once.

Normalising lower-cases A-Z and turns every ASCII byte that is neither letter
nor digit into a space, byte by byte, so that a word's place in the normalised
text maps straight to its offsets in the original. The automaton reads words, not letters: each word of the
items has a code of one to a few characters, shorter for more frequent ones, whose first character begins no other
place of a code, so that a match begins and ends with whole words; all other words are one character that no
pattern has. A worker builds it once for all its tasks.

Nulls and empty texts have no words and are never hit; an item without words has
no window. Texts and items of any length are taken whole. Repeated rows give repeated results, rows that share a doc_id each its own.
Empty tables give no rows, and no hits. Only doc_id, item_id and text are read (``clean_documents`` passes all columns through), so other
columns of any name don't matter. Items beyond ``BLOCK_BYTES`` of
text, some 300 MB of a worker's memory, make further blocks, each an automaton and a scan of its own.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text

WINDOW = 10
#: Bytes of item text per automaton: bounds both what one broadcast holds and a worker's memory.
BLOCK_BYTES = 4 << 20
#: Characters that begin a code of each length, and those that go on with one; from this character on.
DIGITS, MORE = 64, 1 << 12
OTHER = "\0"
#: Fixed values: [0-9A-Za-z] and all non-ASCII bytes belong to words; the rest parts them.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def code(rank: int) -> str:
    """The code of the word of a rank: its length's first character, and digits."""
    length = 1
    while rank >= DIGITS**length:
        rank -= DIGITS**length
        length += 1
    first, rest = divmod(rank, DIGITS ** (length - 1))
    return chr(1 + DIGITS * (length - 1) + first) + "".join(chr(MORE + rest // DIGITS**k % DIGITS) for k in range(length - 2, -1, -1))


class Scanner:
    """The automaton of a list of (item id, text), with each pattern's number of words and the items it occurs in."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        counts = Counter(w for _, text in items for w in words_of(text))
        self.codes = {w: code(rank) for rank, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.spans: list[int] = []
        self.owners: list[object] = []
        for item, text in items:
            own = [self.codes[w] for w in words_of(text)]
            for i in range(len(own) - size + 1 if len(own) > size else min(1, len(own))):
                window = "".join(own[i : i + size])
                at = self.auto.get(window, -1)
                if at < 0:
                    self.auto.add_word(window, len(self.spans))
                    self.spans.append(min(size, len(own)))
                    self.owners.append(item)
                elif isinstance(self.owners[at], set):
                    self.owners[at].add(item)
                elif self.owners[at] != item:
                    self.owners[at] = {self.owners[at], item}
        if self.spans:
            self.auto.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set]:
        """Number of words, a mask of the hit ones (None without any) and the items found."""
        words = words_of(text)
        if not words or not self.spans:
            return len(words), None, set()
        get = self.codes.get
        own = [get(w, OTHER) for w in words]
        hits = list(self.auto.iter("".join(own)))
        if not hits:
            return len(words), None, set()
        items: set = set()
        for at in {at for _, at in hits}:
            found = self.owners[at]
            items |= found if isinstance(found, set) else {found}
        last = np.searchsorted(np.cumsum([len(c) for c in own]), [end for end, _ in hits], "right") + 1
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - np.array([self.spans[at] for _, at in hits]), 1)
        np.add.at(edge, last, -1)
        return len(words), np.cumsum(edge)[:-1] > 0, items


_BUILT: dict[str, Scanner] = {}


def built(key: str, items: list[tuple[object, str | None]], size: int) -> Scanner:
    """The scanner of a block of items, built once per Python worker; the last one only is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(items, size)
    return _BUILT[key]


def offsets(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of the runs of hit words."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0]))))
    starts, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    head = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # bytes to characters
    return [(int(head[starts[a]]) - 1, int(head[ends[b - 1] - 1])) for a, b in zip(runs[::2], runs[1::2])]


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """Item rows in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        n = len((row[1] or "").encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    yield held


def scan_block(source: DataFrame, items: list[tuple[object, str | None]], size: int) -> DataFrame:
    """One scan of all documents with the automaton of one block of items."""
    kind, key = source.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    shipped = source.sparkSession.sparkContext.broadcast(items)
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = built(key, shipped.value, size)
        for batch in batches:
            n_words, n_hit, ids, runs, spans = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                n, mask, found = scanner.scan(text)
                n_words.append(n)
                n_hit.append(0 if mask is None else int(mask.sum()))
                ids.append(sorted(map(str, found)))
                hit = [] if mask is None else np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8))).tolist()
                runs.append([{"start": x, "end": y} for x, y in zip(hit[::2], hit[1::2])])
                spans.append([] if mask is None else [{"start": x, "end": y} for x, y in offsets(text, mask)])
            out = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(ids, pa.list_(pa.string())),
                "word_runs": pa.array(runs, pairs),
                "spans": pa.array(spans, pairs),
            }
            yield pa.RecordBatch.from_pydict(out)

    pair = "array<struct<start:int,end:int>>"
    shape = f"doc_id {kind}, n_words long, n_hit long, items array<string>, word_runs {pair}, spans {pair}"
    return source.mapInArrow(run, shape)


def union_length(runs: Column) -> Column:
    """How many places a list of [start, end) runs covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, run: Column) -> Column:
        new = F.greatest(F.lit(0), run["end"] - F.greatest(acc["end"], run["start"]))
        return F.struct(F.greatest(acc["end"], run["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(runs), start, add)["n"]


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, items (found item ids as sorted strings), word_runs and spans.

    ``word_runs`` are the [start, end) word numbers of each run of hit words and
    ``spans`` its character offsets in the original text. Items within one block,
    the usual case, need no shuffle. Each further block is broadcast and scanned by
    itself; the results then meet per document and text.
    """
    source = id_and_text(docs)
    lists = blocks(benchmark.select("item_id", "text"), block_bytes)
    first, second = next(lists), next(lists, None)
    if second is None:
        return scan_block(source, first, size)
    # Rows that repeat a doc_id stay apart by their text; equal rows are counted and dealt out again.
    keyed = source.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    row = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
    one = keyed.select(F.struct("doc_id", row.alias("key"), "copies").alias("doc_id"), "text")
    # The driver holds a block only until it is shipped.
    every = scan_block(one, first, size)
    for items in chain([second], lists):
        every = every.unionByName(scan_block(one, items, size))
    flat = lambda c: F.flatten(F.collect_list(c))
    merged = every.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(flat("items"))).alias("items"),
        F.array_sort(F.array_distinct(flat("word_runs"))).alias("word_runs"),
        F.array_sort(F.array_distinct(flat("spans"))).alias("spans"),
    )
    out = merged.withColumn("n_hit", union_length(F.col("word_runs"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "doc_id.copies")))
    return out.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "n_hit", "items", "word_runs", "spans")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan_documents(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, with all columns, without those that hold a window of an item; a filter for each block of items, no shuffle."""
    bounded_batches(docs.sparkSession)
    for items in blocks(benchmark.select("item_id", "text"), block_bytes):
        shipped, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key) -> Iterator[pa.RecordBatch]:
            scanner = built(key, shipped.value, size)
            for batch in batches:
                clean = [scanner.scan(text)[1] is None for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
