"""Ids of many texts at once, by looking their pieces up in arrays.

Where a tokenizer file's steps are the known ones (NFC, white space, lower case, runs of
letters, single digits, runs of signs, byte letters), white space parts words that
are encoded independently of each other, and a word of ASCII and of the letters from U+00C0 to
U+00FF falls into runs of one class. The bytes of a batch are classed by vector operations, and every
piece is looked up by its own bytes in an open-addressing table of arrays: no Python object for a
piece that has come before. The tokenizers library merges each new piece. A word with other
characters, an apostrophe or the beginning of a special token is one piece, and the library takes it through
all steps. With any other file, every text goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_letters
from .wordhash import PRIME, mix

#: Bytes remembered per Python worker, about: beyond them the table starts anew between batches.
MOST_BYTES = 128 << 20
#: Fixed value: the splitting pattern that runs of one class reproduce.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: Longer pieces are looked up as Python bytes.
INLINE = 16
#: Masks that leave the first n bytes of a little-endian word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: U+00C0 to U+00FF in UTF-8 are this byte and one more; two of them, the signs of multiplication and division, are no letters.
LATIN, NO_LETTERS, SHARP_S = 0xC3, (0x97, 0xB7), 0x9F


def classes(special: list[str]) -> np.ndarray:
    """Class of each byte; ``OTHER`` bytes leave their word to the library."""
    out = np.full(256, SIGN, np.uint8)
    out[[32, *range(9, 14)]] = SPACE
    out[97:123] = out[65:91] = LETTER
    out[48:58] = DIGIT
    out[[39, *range(128, 256), *(x.encode()[0] for x in special)]] = OTHER
    return out


class PieceTable:
    """Pieces and their ids: a number for each piece, found by its bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known, self.held = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.low, self.high, self.size = np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.int32)
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.pool, self.filled = np.empty(1 << 16, np.uint16), 0
        self.long: dict[bytes, int] = {}

    def numbers(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece of at most ``INLINE`` bytes, -1 where it is new."""
        found = np.full(len(low), -1, np.int64)
        mask = len(self.slots) - 1
        slot = (hashed(low, high, size) & np.uint64(mask)).astype(np.int64)
        at = np.arange(len(low))
        while len(at):
            there = self.slots[slot]
            # An empty slot ends the search.
            taken = there >= 0
            if not taken.all():
                at, slot, there = at[taken], slot[taken], there[taken]
            same = (self.low[there] == low[at]) & (self.high[there] == high[at]) & (self.size[there] == size[at])
            found[at[same]] = there[same]
            rest = ~same
            at, slot = at[rest], (slot[rest] + 1) & mask
        return found

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Numbers for new, distinct pieces; those of long ones are found by their bytes, so their keys are not entered (size 0)."""
        n, counts = len(ids), np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(counts.sum()))
        numbers = np.arange(self.known, self.known + n)
        self.pool = grown(self.pool, self.filled + len(flat))
        self.pool[self.filled : self.filled + len(flat)] = flat
        for name, values in (("low", low), ("high", high), ("size", size), ("start", self.filled + np.cumsum(counts) - counts), ("count", counts)):
            own = grown(getattr(self, name), self.known + n)
            own[self.known : self.known + n] = values
            setattr(self, name, own)
        self.filled += len(flat)
        self.known += n
        self.held += 44 * n + 2 * len(flat)
        if 3 * self.known > len(self.slots):
            self.slots = np.full(1 << int(6 * self.known).bit_length(), -1, np.int32)
            self.enter(np.arange(self.known))
        else:
            self.enter(numbers)
        return numbers

    def enter(self, numbers: np.ndarray) -> None:
        numbers = numbers[self.size[numbers] > 0]
        mask = len(self.slots) - 1
        slot = (hashed(self.low[numbers], self.high[numbers], self.size[numbers]) & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            # Of several that want a slot one has got it.
            rest = self.slots[slot] != numbers
            numbers, slot = numbers[rest], (slot[rest] + 1) & mask


def hashed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((low ^ size.astype(np.uint64)) * PRIME + high)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for n elements at least."""
    if n <= len(x):
        return x
    out = np.empty(1 << int(n - 1).bit_length(), x.dtype)
    out[: len(x)] = x
    return out


class PieceEncoder:
    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size, self.most_bytes = self.whole.get_vocab_size(with_added_tokens=True), most_bytes
        special = [x["content"] for x in spec.get("added_tokens", [])]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        known = known and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and splits[0]["pattern"] == {"Regex": PATTERN}
        known = known and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        self.known = known and not any(set(x.encode()) & {32, *range(9, 14)} for x in special)
        self.classes = classes(special)
        # Upper case is lower case to the library too: fewer distinct pieces.
        self.lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
        others = bytes(b for b in range(128) if self.classes[b] == OTHER)
        self.plain = re.compile(rb"(?:[^\x80-\xff" + re.escape(others) + rb"]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch
        self.letters = byte_letters()
        # Merging alone, for pieces that need none of the other steps.
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []})) if self.known else None
        self.table = PieceTable()

    def pieces(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts that lie end to end; ``edges`` are the places where one begins.
        Latin letters become lower case in ``raw``."""
        n = len(raw)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = self.classes[raw]
        own = kind[1:-1]
        latin = np.flatnonzero(raw == LATIN)
        second = raw[latin + 1]
        letter = (second != NO_LETTERS[0]) & (second != NO_LETTERS[1])
        latin, second = latin[letter], second[letter]
        own[latin] = own[latin + 1] = LETTER
        raw[latin + 1] = np.where(second < SHARP_S, second | 32, second)
        solid = own != SPACE
        fresh = np.zeros(n + 1, bool)
        fresh[edges] = True
        new_word = solid & ((kind[:-2] == SPACE) | fresh[:-1])
        start = solid & ((own != kind[:-2]) | (own == DIGIT) | fresh[:-1])
        other = np.flatnonzero(own == OTHER)
        if len(other):
            # Words that have such a byte are one piece each.
            words = np.flatnonzero(new_word)
            which = np.searchsorted(words, other, "right") - 1
            which = which[np.diff(which, prepend=-1) > 0]
            first, after = words[which], np.append(words, n)[which + 1]
            inside = np.zeros(n + 1, np.int8)
            inside[first + 1] += 1
            inside[after] -= 1
            start &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        stop = np.append(start[1:] | ~solid[1:], True) & solid
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> dict[bytes, int]:
        """Takes in the pieces that are not known yet; the number of each."""
        out: dict[bytes, int] = {}
        for a, b in zip(starts.tolist(), ends.tolist()):
            out.setdefault(data[a:b], len(out))
        new, plain, letters = list(out), self.plain, self.letters
        ids: list[list[int]] = [[]] * len(new)
        merged = [i for i, x in enumerate(new) if plain(x)]
        spelled = [new[i].decode() if new[i].isalnum() else "".join([letters[b] for b in new[i]]) for i in merged]
        for i, x in zip(merged, self.bare.encode_batch_fast(spelled, add_special_tokens=False)):
            ids[i] = x.ids
        rest = [i for i, x in enumerate(new) if not plain(x)]
        for i, x in zip(rest, self.whole.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False)):
            ids[i] = x.ids
        size = np.array([len(x) for x in new], np.int32)
        padded = np.frombuffer(b"".join([x[:INLINE].ljust(INLINE, b"\0") for x in new]), "<u8").reshape(-1, 2)
        numbers = self.table.add(padded[:, 0], padded[:, 1], np.where(size <= INLINE, size, 0), ids)
        for x, n in zip(new, numbers.tolist()):
            out[x] = n
            if len(x) > INLINE:
                self.table.long[x] = n
                self.table.held += 100 + len(x)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, as uint16, and how many each text has; null is the empty text."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        if not self.known:
            got = [x.ids for x in self.whole.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint16), np.array([len(x) for x in got], np.int64)
        if self.table.held > self.most_bytes:
            self.table.clear()
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(bytearray(bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(self.lower) if data is not None else b""), np.uint8)
        offsets = offsets - offsets[0]
        starts, ends = self.pieces(raw, offsets[:-1])
        text = raw.tobytes()
        size = ends - starts
        words = np.ndarray((len(raw) + 8,), "<u8", text + bytes(15), strides=(1,))
        low = words[starts] & FIRST[np.minimum(size, 8)]
        high = words[np.minimum(starts + 8, len(raw))] & FIRST[np.clip(size - 8, 0, 8)]
        numbers = self.table.numbers(low, high, size)
        lacking = np.flatnonzero(numbers < 0)
        if len(lacking):
            get = self.table.long.get
            for i in lacking[size[lacking] > INLINE].tolist():
                numbers[i] = get(text[starts[i] : ends[i]], -1)
            lacking = lacking[numbers[lacking] < 0]
            new = self.learn(text, starts[lacking], ends[lacking])
            numbers[lacking] = [new[text[a:b]] for a, b in zip(starts[lacking].tolist(), ends[lacking].tolist())]
        count = self.table.count[numbers]
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        ids = self.table.pool[np.repeat(self.table.start[numbers] - (last - count), count) + np.arange(total)]
        before = np.concatenate(([0], last))[np.searchsorted(starts, offsets)]
        return ids, np.diff(before)


_LOADED: dict[str, PieceEncoder] = {}


def load(path: str) -> PieceEncoder:
    """One encoder per Python worker and file: its table outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
