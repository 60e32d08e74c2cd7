"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens (words led by the piece mark) go into a trie. A node holds the best
score of its prefix under a unigram model and the number of pieces that attain
it, computed once from the nodes above it however many words share the prefix;
the node where a word ends stores the word's count.

A word longer than ``LONG`` characters is computed by the same recurrence over its last few prefixes
and leaves nothing in the trie, so memory is bounded by nodes whatever the words.

Scores: the vocabulary file ranks its pieces but gives no probabilities; piece
number r has log-probability -ln(r + 1) less the harmonic sum's logarithm, Zipf's
law. A character no piece begins with costs its UTF-8 bytes as byte pieces. Ties go to
fewer pieces. Null and blank texts have no pre-tokens and no tokens; texts of any length are counted whole. Repeated
rows repeat their counts, rows that share a doc_id each has its own text's; an empty table gives no rows. Only doc_id and text are read, so other columns
of any name don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_and_text

MARK = "▁"
#: Trie nodes kept per Python worker, about 250 bytes each; beyond it the trie starts anew between texts.
MOST_NODES = 600_000
LONG = 256


def zipf_scores(path: str) -> dict[str, float]:
    """Piece -> log-probability by the order of the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class Trie:
    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        self.scores, self.most_nodes = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        self.reset()

    def reset(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of one pre-token; only prefixes not in the trie are computed."""
        node, path, token = 0, [0], MARK + word
        best, count, get = self.best, self.count, self.scores.get
        for end in range(1, len(token) + 1):
            c = token[end - 1]
            child = self.next.get((node, c))
            if child is None:
                child = self.next[node, c] = len(best)
                n = len(c.encode())
                top, least = best[node] + n * self.byte, count[node] + n
                for start in range(max(0, end - self.longest), end):
                    s = get(token[start:end])
                    if s is not None:
                        at = path[start]
                        total = best[at] + s
                        if total > top or total == top and count[at] + 1 < least:
                            top, least = total, count[at] + 1
                best.append(top)
                count.append(least)
            path.append(child)
            node = child
        self.terminal[word] = count[node]
        return count[node]

    def count_long(self, word: str) -> int:
        """Tokens of one pre-token, without the trie."""
        token, get, longest = MARK + word, self.scores.get, self.longest
        # The last ``longest`` prefixes, the shortest first.
        held = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            n = len(token[end - 1].encode())
            top, least = held[-1][0] + n * self.byte, held[-1][1] + n
            first = end - len(held)
            for start in range(first, end):
                s = get(token[start:end])
                if s is not None:
                    total, count = held[start - first][0] + s, held[start - first][1] + 1
                    if total > top or total == top and count < least:
                        top, least = total, count
            held.append((top, least))
            if len(held) > longest:
                del held[0]
        return held[-1][1]

    def counts(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = (text or "").split()
        if len(self.best) > self.most_nodes or len(self.terminal) > self.most_nodes:
            self.reset()
        long: dict[str, int] = {}
        for word in set(words).difference(self.terminal):
            if len(word) <= LONG:
                self.insert(word)
            else:
                long[word] = self.count_long(word)
        if not long:
            return len(words), sum(map(self.terminal.__getitem__, words))
        return len(words), sum(long[w] if w in long else self.terminal[w] for w in words)


_LOADED: dict[str, Trie] = {}


def load(path: str) -> Trie:
    if path not in _LOADED:
        _LOADED[path] = Trie(zipf_scores(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_bytes) of whole texts; the trie is shared by all texts of a Python worker."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for batch in batches:
            text = batch.column("text").to_pylist()
            got = np.array([trie.counts(x) for x in text], np.int64).reshape(-1, 2)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_pretokens": pa.array(got[:, 0]), "n_tokens": pa.array(got[:, 1]), "n_bytes": size})

    return source.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, n_bytes long")
