"""Scores of queries against a shard of one block's records, in arrays: a query's pairs are summed and cut to its best in one place.

Rows come in groups (src, country, shard, chunk), records (side 0) before queries (side 1). A group holds its records as an
inverted index in arrays; its queries pass by batch after batch. So pairs that are not among a query's best never leave the task.
A query may ask for several lists, each under wider limits than the one before: a token then counts from the list of its level on, and
a list's scores are divided by its norm. The sums go on from list to list, and lists that are equal leave the task once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEY = ("src", "country", "shard", "chunk")
#: Tokens of a fourth of a shard's records are held as full rows, this many at most.
FULL = 32
#: A query weight of 0 keeps its pairs, with a score of 0.
LEAST = 1e-300


def split(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's tokens begin, with their end, and all tokens."""
    lists = pc.split_pattern(tokens, " ")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), lists.flatten()


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the k best above 0; ties go to the smaller place."""
    low, m = 0.0, len(scores) // 64
    if m >= 2 * k:
        # The k-th of the maxima of 64 places each is no more than the k-th of all.
        peaks = scores[: 64 * m].reshape(64, m).max(axis=0)
        low = np.partition(peaks, m - k)[m - k] - 1e-6
    found = np.flatnonzero(scores >= low) if low > 0 else np.flatnonzero(scores > 0)
    rounded = np.floor(scores[found] * 1e6 + 0.5) / 1e6
    order = np.lexsort((found, -rounded))[:k]
    return found[order], rounded[order]


class Shard:
    def __init__(self, ids: list[pa.Array], tokens: list[pa.Array], weights: list[pa.Array]):
        all_ids = pa.concat_arrays(ids)
        order = pc.sort_indices(all_ids)
        self.ids, self.n = all_ids.take(order), len(all_ids)
        place = np.empty(self.n, np.int64)
        place[order.to_numpy()] = np.arange(self.n)
        begin, words = split(pa.concat_arrays(tokens))
        coded = words.dictionary_encode()
        codes, self.tokens = coded.indices.to_numpy(), coded.dictionary
        by = np.argsort(codes, kind="stable")
        self.places = np.repeat(place, np.diff(begin))[by]
        self.w = pa.concat_arrays(weights).flatten().to_numpy()[by]
        self.df = np.bincount(codes, minlength=len(self.tokens))
        self.ends = np.cumsum(self.df)
        often = np.argsort(-self.df, kind="stable")[:FULL]
        self.full = {int(t): self.row(t) for t in often[4 * self.df[often] > self.n]}

    def row(self, t: int) -> np.ndarray:
        out = np.zeros(self.n)
        own = slice(self.ends[t] - self.df[t], self.ends[t])
        out[self.places[own]] = self.w[own]
        return out

    def score(self, tokens: pa.Array, weights: pa.Array, levels: np.ndarray, norms: np.ndarray, k: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(query, first and last list that are so, places, scores). ``levels``: of each token; ``norms``: a row for each query, a column for each list."""
        begin, words = split(tokens)
        codes = pc.fill_null(pc.index_in(words, value_set=self.tokens), -1).to_numpy(zero_copy_only=False)
        v = np.maximum(weights.flatten().to_numpy(), LEAST)
        rows = np.repeat(np.arange(len(tokens)), np.diff(begin))[codes >= 0]
        codes, v, levels = codes[codes >= 0], v[codes >= 0], levels[codes >= 0]
        begin = np.searchsorted(rows, np.arange(len(tokens) + 1)).tolist()
        ends, sizes, codes, v, levels = self.ends[codes].tolist(), self.df[codes].tolist(), codes.tolist(), v.tolist(), levels.tolist()
        places, w = np.empty(0, np.int64), np.empty(0)
        for query, (first, last) in enumerate(zip(begin, begin[1:])):
            total, held = None, None
            for level, norm in enumerate(norms[query].tolist()):
                own = [i for i in range(first, last) if levels[i] == level]
                if held and not own and norm == held[0]:
                    continue
                full, rest = [i for i in own if codes[i] in self.full], [i for i in own if codes[i] not in self.full]
                need, at = sum(sizes[i] for i in rest), 0
                if need > len(w):
                    places, w = np.empty(2 * need, np.int64), np.empty(2 * need)
                for i in rest:
                    n = sizes[i]
                    places[at : at + n] = self.places[ends[i] - n : ends[i]]
                    np.multiply(self.w[ends[i] - n : ends[i]], v[i], out=w[at : at + n])
                    at += n
                if at or total is None:
                    # Of no places it is whole numbers.
                    more = np.bincount(places[:at], weights=w[:at], minlength=self.n).astype(np.float64, copy=False)
                    total = more if total is None else total + more
                for i in full:
                    total += v[i] * self.full[codes[i]]
                if held:
                    yield query, held[1], level - 1, *held[2]
                held = norm, level, best(total if norm == 1 else total / norm, k)
            yield query, held[1], norms.shape[1] - 1, *held[2]


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """The stretches of one group and side."""
    names = [*KEY, "side"]
    codes = np.stack([batch.column(c).dictionary_encode().indices.to_numpy() for c in names])
    cuts = np.flatnonzero((np.diff(codes, axis=1) != 0).any(axis=0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        *key, side = (batch.column(c)[a].as_py() for c in names)
        yield tuple(key), side, batch.slice(a, b - a)


def found(part: pa.RecordBatch, shard: Shard, k: int) -> pa.RecordBatch:
    weights, levels, norms = part.column("weights"), part.column("levels"), part.column("norms")
    one = levels.null_count == len(levels)  # a single list, with its norm in the weights
    levels = np.zeros(len(weights.flatten()), np.int64) if one else levels.flatten().to_numpy()
    norms = np.ones((len(part), 1)) if one else norms.flatten().to_numpy().reshape(len(part), -1)
    query, first, last, places, scores = zip(*shard.score(part.column("tokens"), weights, levels, norms, k))
    ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]), pa.int32())
    lists_of = lambda values: pa.ListArray.from_arrays(ends, values)
    named = {"s1_id": part.column("id"), "src": part.column("src"), "country": part.column("country")}
    named = {n: c.take(pa.array(query, pa.int64())) for n, c in named.items()} | {"first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())}
    named |= {"ids": lists_of(shard.ids.take(pa.array(np.concatenate(places)))), "scores": lists_of(pa.array(np.concatenate(scores)))}
    return pa.RecordBatch.from_pydict(named)


def scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    key, held, shard = None, [], None
    for batch in batches:
        for own, side, part in runs(batch) if batch.num_rows else ():
            if own != key:
                key, held, shard = own, [], None
            if side == 0:
                held.append(part)
            elif held or shard:
                if shard is None:
                    shard = Shard(*([p.column(c) for p in held] for c in ("id", "tokens", "weights")))
                    held = []
                yield found(part, shard, k)
