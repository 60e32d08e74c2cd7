"""64-bit hashes of all words of a batch of texts, without a Python object for any word.

A word is a run of bytes other than the ASCII white space; its hash is a polynomial in
an odd base over a random number for each byte, finished by a mixer. Prefix sums
over a stretch of the batch and the base's inverse give every word's sum at once. Stretches are
bounded, and a word longer than one is summed piece by piece, so memory beyond the text itself and 8
bytes a word does not grow with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes summed at once.
STRETCH = 1 << 20
_rng = np.random.default_rng(911)
NUMBERS = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
#: For hashes that are independent of the first.
OTHERS = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: The numbers with those of A-Z replaced by those of a-z.
LOWERED = NUMBERS.copy()
LOWERED[65:91] = NUMBERS[97:123]
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest stretch so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1) - 1, b)))) for b in (PRIME, INVERSE)]
    return _POWERS


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of texts, end to end; where each word starts and ends; and the number of words before each text, and in all. Null texts have none."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), *(np.empty(0, np.int64),) * 2, np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[raw]
    word = inside[1:-1]
    # Texts lie end to end; a word ends where its text does.
    first, last = word & ~inside[:-2], word & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return raw, starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = int(starts[k])
        after = int(np.searchsorted(ends, base + STRETCH, "right"))
        if after == k:
            # One word longer than a stretch.
            total, scale = 0, 1
            up, _ = powers(STRETCH)
            for a in range(base, int(ends[k]), STRETCH):
                part = numbers[raw[a : min(a + STRETCH, int(ends[k]))]]
                total += scale * int((part * up[: len(part)]).sum())
                scale = scale * pow(int(PRIME), len(part), 1 << 64) % (1 << 64)
            out[k] = total % (1 << 64)
            k += 1
            continue
        part = numbers[raw[base : int(ends[after - 1])]]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[k:after] = (sums[ends[k:after] - base] - sums[starts[k:after] - base]) * down[starts[k:after] - base]
        k = after
    return mix(out)


def word_hashes(column: pa.Array, lower: bool = False) -> list[np.ndarray]:
    """The hashes of the words of each text, in order; null texts have none."""
    raw, starts, ends, at = spans(column)
    hashes = span_hashes(raw, starts, ends, LOWERED if lower else NUMBERS)
    return [hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words: a polynomial, put together from runs of powers of two."""
    n = len(hashes) - size + 1
    out, have, block, width = None, 0, hashes, 1
    left = size
    while left:
        if left & 1:
            # Behind what is put together so far, that is ``have`` words on.
            out = block[:n] if out is None else out * PRIME ** np.uint64(width) + block[have : have + n]
            have += width
        left >>= 1
        if left:
            block = block[: len(block) - width] * PRIME ** np.uint64(width) + block[width:]
            width *= 2
    return mix(out + np.uint64(size * pow(int(PRIME), size, 1 << 64) % (1 << 64)))
