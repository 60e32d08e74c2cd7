"""String scorers of one pair, bit-parallel on Python integers: the definition that ``batchsim`` follows for many pairs at once. ``ratio`` also as an expression.

Both strings empty: ratio, token_sort_ratio and partial_ratio are 100, Jaro-Winkler 1,
token_set_ratio and WRatio 0. One empty: all 0. Nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def of_lengths(both: int, total: int) -> float:
    return 200.0 * both / total if total else 100.0


def ratio(a: str, b: str) -> float:
    return 100.0 if a == b else of_lengths(common(a, b), len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    n = len(shared)
    gap = 1 if shared else 0
    n_left, n_right = n + gap + len(left), n + gap + len(right)
    # Equal beginnings are common in full: only the rests need comparing.
    best = of_lengths(n + gap + common(left, right), n_left + n_right)
    if shared:
        best = max(best, of_lengths(n, n + n_left), of_lengths(n, n + n_right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a stretch of the longer, of its length or cut off at an end."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = one_way(a, b)
    return max(best, one_way(b, a)) if len(a) == len(b) and best < 100 else best


def one_way(short: str, long: str) -> float:
    n, letters, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        start = max(0, end - n)
        piece = long[start : min(end, len(long))]
        # The best stretch starts or ends with a letter of the shorter string.
        if piece[-1] in letters if end <= len(long) else piece[0] in letters:
            top = of_lengths(min(n, len(piece)), n + len(piece))
            if top > best:
                best = max(best, ratio(short, piece))
                if best == 100:
                    break
    return best


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    best = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(best, partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    whole, spread = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread <= 8.0 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Bound of a table of letters.
MOST_LETTERS = 2 << 20
#: Feature -> scorer, the view of the record it reads, and what a whole score is.
SCORERS = {
    "nm_ratio": ("ratio", "nm", 100),
    "nm_jw": ("jaro_winkler", "nm", 1),
    "nm_tset": ("token_set_ratio", "nmc", 100),
    "nm_tsort": ("token_sort_ratio", "nmc", 100),
    "nm_partial": ("partial_ratio", "nm", 100),
    "nm_sorted": ("ratio", "nms", 100),
    "nm_wratio": ("weighted_ratio", "nm", 100),
    "ad_ratio": ("ratio", "ad", 100),
    "ad_tset": ("token_set_ratio", "adn", 100),
    "ad_tsort": ("token_sort_ratio", "adn", 100),
    "ad_partial": ("partial_ratio", "ad", 100),
    "ad_sorted": ("ratio", "ads", 100),
    "ad_wratio": ("weighted_ratio", "ad", 100),
    "num_ratio": ("ratio", "num", 100),
    "zip_ratio": ("ratio", "zip", 100),
    "ad_jw": ("jaro_winkler", "ad", 1),
}


def evenly(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose number times their longest string is bounded, one row at least: tables of letters are as wide as the longest."""
    longest = [max(x) for x in zip(*(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_pylist() for c in columns))]
    start, most = 0, 0
    for n, size in enumerate(longest):
        if n > start and max(most, size) * (n - start + 1) > MOST_LETTERS:
            yield batch.slice(start, n - start)
            start, most = n, 0
        most = max(most, size)
    yield batch.slice(start)


def with_scores(pairs: DataFrame, names: list[str] | None = None, left: str = "a_", right: str = "b_") -> DataFrame:
    """``pairs`` with a column for each named scorer, from the views ``a_*`` and ``b_*``, in one pass of Arrow batches over arrays of bits."""
    names = list(SCORERS) if names is None else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import batchsim

        used = sorted({c for n in names for c in (left + SCORERS[n][1], right + SCORERS[n][1])})
        for batch in (part for whole in batches for part in evenly(whole, used)):
            views = {c: batchsim.Texts(x or "" for x in batch.column(c).to_pylist()) for n in names for c in (left + SCORERS[n][1], right + SCORERS[n][1])}
            scores = []
            for n in names:
                scorer, view, whole = SCORERS[n]
                scores.append(pa.array(getattr(batchsim, scorer)(views[left + view], views[right + view]) / whole))
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], [*batch.schema.names, *names])

    shape = StructType([*pairs.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return pairs.mapInArrow(run, shape)


def ratio_expression(a: Column, b: Column) -> Column:
    """``ratio`` / 100 without Python: a row of the subsequence table is folded over the letters of ``b``."""
    left, zero = F.split(a, ""), F.array_repeat(F.lit(0), F.length(a) + 1)

    def step(row: Column, c: Column) -> Column:
        def cell(made: Column, x: Column) -> Column:
            i = F.size(made)
            own = F.when(x == c, F.get(row, i - 1) + 1).otherwise(F.greatest(F.get(made, i - 1), F.get(row, i)))
            return F.concat(made, F.array(own))

        return F.aggregate(left, F.array(F.lit(0)), cell)

    both = F.element_at(F.aggregate(F.split(b, ""), zero, step), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(2.0 * both / total)
