"""BPE encoding and decoding with a contiguous rank array per short word.

A word is a list of parts and a parallel list of the ranks of adjacent parts. The
loop takes the minimum rank (leftmost on ties), merges there, deletes the
boundary and refreshes the two neighbouring ranks: quadratic, but over a few
bytes, so it beats a heap. Words above ``SHORT`` bytes take the heap instead, with
the same result.

Null text encodes as the empty text: no ids, empty decoded text. Repeated rows
give repeated results, rows that share a doc_id each its own; texts and words of any length are encoded whole. An empty table
gives no rows. Only doc_id and text are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

SHORT = 200
NONE = 1 << 60
#: Words remembered per Python worker, and the longest of them in characters; about 250 bytes each.
CACHE_WORDS, CACHE_LONGEST = 300_000, 64
#: Fixed value: the byte-level splitting pattern, white space spelled as the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + n) for n in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class RankBPE(dict):
    """word -> ids as little-endian uint32 bytes, filled on demand."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.cache_words = cache_words
        self.of_byte = [vocab[x] for x in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = n
            self.merged.append(vocab[a + b])
        byte_of = {x: b for b, x in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * (top + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split = regex.compile(SPLIT)
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None

    def __missing__(self, word: str) -> bytes:
        parts = [self.of_byte[b] for b in word.encode()]
        ids = self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHE_LONGEST:
            self[word] = out
        return out

    def merge_short(self, parts: list[int]) -> list[int]:
        get, merged = self.rank.get, self.merged
        ranks = [get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), NONE)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, place) over a linked list of parts."""
        n, get = len(parts), self.rank.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != r:
                continue  # a neighbour has changed since
            parts[i], parts[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in parts if x >= 0]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32. A special token's string in the text is that token."""
        if not text:
            return b""
        if len(self) > self.cache_words:
            self.clear()
        find, get = self.split.findall, self.__getitem__
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(get, find(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += map(get, find(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join([*out, *map(get, find(text[at:]))])

    def decode(self, ids: bytes | None) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


_LOADED: dict[str, RankBPE] = {}


def load(path: str) -> RankBPE:
    """One tokenizer per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = RankBPE(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most_bytes`` of one column, one row at least."""
    data, start, held = batch.column(column), 0, 0
    sizes = pc.fill_null(pc.binary_length(data), 0).to_pylist()
    for n, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, n - start)
            start, held = n, 0
        held += size
    yield batch.slice(start)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) with ids a binary of little-endian uint32; with ``decoded``, also the text the ids decode to."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [bpe.encode(x) for x in batch.column("text").to_pylist()]
                out = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of a table with binary ids; null ids decode to the empty text."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in slices(whole, "ids"):
                text = [bpe.decode(x) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(text, pa.string())})

    return source.mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of the ids and of the text decoded from them."""
    both = encode(docs, path, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
