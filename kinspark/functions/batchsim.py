"""The scorers of ``similarity`` over many pairs at once: bit-parallel rows of 64 letters in numpy arrays.

Strings are numbered, and every table is made once for each distinct one. One step of a
loop takes the next letter of the right strings of all pairs; a row of bits for each pair
tells, as in the scalar functions, where the longest common subsequence grows.
Results are those of the scalar functions to the last bit: both put lengths into the same formulas.
"""

from __future__ import annotations

from functools import cached_property, wraps

import numpy as np

#: Pairs or stretches that go in step, and windows of them that are held at once: bounds of memory.
STEP = 8192
ONES = np.uint64((1 << 64) - 1)
U1 = np.uint64(1)
POWERS = np.ldexp(1.0, np.arange(32))


def percent(both: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``similarity.of_lengths`` of arrays."""
    return np.where(total > 0, 200.0 * both / np.maximum(total, 1), 100.0)


class Strings:
    """Distinct strings: numbers of their letters in rows padded with 0, and their lengths."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.length = np.array([len(s) for s in strings], np.int64)
        self.most = max(1, int(self.length.max(initial=0)))
        self.width = -(-self.most // 64)
        self.made: dict[tuple, np.ndarray] = {}

    def letters(self, reverse: bool = False) -> np.ndarray:
        """Code points by string and place, one up, so that 0 is none."""
        own = [s[::-1] for s in self.strings] if reverse else self.strings
        out = np.array(own, f"<U{self.most}").view("<u4").reshape(len(own), self.most).astype(np.int32)
        out += np.arange(self.most, dtype=np.int32) < self.length[:, None]
        return out

    @cached_property
    def alphabet(self) -> np.ndarray:
        found = np.flatnonzero(np.bincount(self.letters().ravel(), minlength=1))
        return found[found > 0]

    def codes(self, alphabet: np.ndarray, reverse: bool = False) -> np.ndarray:
        """Letters by place, then string: their numbers in ``alphabet``, which has all, from 1; 0 where the string has ended."""
        key = ("codes", alphabet.tobytes(), reverse)
        if key not in self.made:
            table = np.zeros(int(alphabet.max(initial=0)) + 1, np.int32)
            table[alphabet] = np.arange(1, len(alphabet) + 1)
            self.made[key] = np.ascontiguousarray(table[self.letters(reverse)].T) if len(self.strings) else np.zeros((1, 0), np.int32)
        return self.made[key]

    def masks(self, alphabet: np.ndarray, reverse: bool = False) -> np.ndarray:
        """A row of words of bits for each string and letter number: the places where it has the letter. Letter 0 is nowhere."""
        key = ("masks", alphabet.tobytes(), reverse)
        if key not in self.made:
            codes, size, at = self.codes(alphabet, reverse).T, len(alphabet) + 1, np.arange(self.most)
            # Every bit is set once, so a sum is a union; halves of 32 bits are exact as doubles.
            cell = (np.arange(len(self.strings))[:, None] * size + codes) * (2 * self.width) + (at >> 5)
            halves = np.bincount(cell.ravel(), np.broadcast_to(POWERS[at & 31], cell.shape).ravel(), len(self.strings) * size * self.width * 2).astype(np.uint64).reshape(-1, 2)
            made = (halves[:, 0] | halves[:, 1] << np.uint64(32)).reshape(len(self.strings), size, self.width)
            made[:, 0] = 0
            self.made[key] = made.reshape(-1, self.width)
        return self.made[key]


class Texts(list):
    """A list of strings whose numbers, and whose scores with another list, are worked out once."""

    @cached_property
    def numbered(self) -> tuple[Strings, np.ndarray]:
        return number(self)

    @cached_property
    def scores(self) -> dict[tuple[str, int], np.ndarray]:
        return {}


def number(values: list[str]) -> tuple[Strings, np.ndarray]:
    seen: dict[str, int] = {}
    at = np.array([seen.setdefault(v, len(seen)) for v in values], np.int64)
    return Strings(list(seen)), at


def numbered(values: list[str]) -> tuple[Strings, np.ndarray]:
    return values.numbered if isinstance(values, Texts) else number(values)


def once(scorer):
    """A scorer that remembers its result for two ``Texts``."""

    @wraps(scorer)
    def run(a: list[str], b: list[str]) -> np.ndarray:
        if not (isinstance(a, Texts) and isinstance(b, Texts)):
            return scorer(a, b)
        key = (scorer.__name__, id(b))
        if key not in a.scores:
            a.scores[key] = scorer(a, b)
        return a.scores[key]

    return run


def alphabet_of(left: Strings, right: Strings) -> np.ndarray:
    return np.union1d(left.alphabet, right.alphabet)


class Rows:
    """Runs of bit rows: the subsequence table of left strings, one letter of the right strings at a time."""

    def __init__(self, left: Strings, right: Strings, reverse: bool = False):
        alphabet = alphabet_of(left, right)
        self.right = right
        self.masks, self.size = left.masks(alphabet, reverse), len(alphabet) + 1
        self.codes = right.codes(alphabet, reverse)

    def run(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None, length: np.ndarray | None = None, each=None) -> np.ndarray:
        """Common letters of left string a and ``length`` letters of right string b from ``start``. ``each(step, order, common)`` hears the value after every step."""
        length = self.right.length[b] if length is None else length
        out = np.zeros(len(a), np.int64)
        for k in range(0, len(a), STEP):
            some = slice(k, k + STEP)
            out[some] = self.stepped(a[some], b[some], None if start is None else start[some], length[some], each, k)
        return out

    def stepped(self, a, b, start, length, each, offset) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        base, b, length = a[order] * self.size, b[order], length[order]
        first = None if start is None else start[order]
        width = self.masks.shape[1]
        rows = [np.full(len(a), ONES) for _ in range(width)]
        live = len(a) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), "right")
        stride = self.codes.shape[1]
        flat = self.codes.ravel()
        for step, n in enumerate(live.tolist()):
            letters = self.codes[step].take(b[:n]) if first is None else flat.take((first[:n] + step) * stride + b[:n])
            cell = base[:n] + letters
            if width == 1:
                row = rows[0][:n]
                hit = row & self.masks.take(cell)
                rows[0][:n] = (row + hit) | (row - hit)
            else:
                carry = None
                for w in range(width):
                    row = rows[w][:n]
                    hit = row & self.masks.take(cell * width + w)
                    total = row + hit
                    over = total < row
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    rows[w][:n] = total | (row - hit)
                    carry = over.astype(np.uint64)
            if each is not None:
                each(step, order[:n] + offset, 64 * width - sum(np.bitwise_count(r[:n]).astype(np.int64) for r in rows))
        out = np.zeros(len(a), np.int64)
        out[order] = 64 * width - sum(np.bitwise_count(r).astype(np.int64) for r in rows)
        return out


def common(left: Strings, right: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each pair of numbered strings; equal pairs are computed once."""
    pairs, back = np.unique(a * len(right.strings) + b, return_inverse=True)
    n = max(len(right.strings), 1)
    return Rows(left, right).run(pairs // n, pairs % n)[back]


def common_of(a: list[str], b: list[str]) -> np.ndarray:
    (left, i), (right, j) = numbered(a), numbered(b)
    return common(left, right, i, j)


@once
def ratio(a: list[str], b: list[str]) -> np.ndarray:
    (left, i), (right, j) = numbered(a), numbered(b)
    return percent(common(left, right, i, j), left.length[i] + right.length[j])


class Tokens:
    """Words of strings, split and sorted once for each distinct one."""

    def __init__(self):
        self.known: dict[str, tuple[frozenset, str]] = {}

    def __call__(self, s: str) -> tuple[frozenset, str]:
        own = self.known.get(s)
        if own is None:
            words = s.split()
            self.known[s] = own = (frozenset(words), " ".join(sorted(words)))
        return own


@once
def token_sort_ratio(a: list[str], b: list[str]) -> np.ndarray:
    tokens = Tokens()
    return ratio([tokens(s)[1] for s in a], [tokens(s)[1] for s in b])


@once
def token_set_ratio(a: list[str], b: list[str]) -> np.ndarray:
    tokens, out = Tokens(), np.zeros(len(a))
    places: dict[tuple[str, str], list[int]] = {}
    for n, pair in enumerate(zip(a, b)):
        places.setdefault(pair, []).append(n)
    todo, shared, left, right = [], [], [], []
    for (s, t), where in places.items():
        (x, _), (y, _) = tokens(s), tokens(t)
        if x and y:
            both = x & y
            if both and (both == x or both == y):
                out[where] = 100.0
            else:
                todo.append(where)
                shared.append(sum(map(len, both)) + max(len(both) - 1, 0))
                left.append(" ".join(sorted(x - both)))
                right.append(" ".join(sorted(y - both)))
    if todo:
        n = np.array(shared)
        gap = (n > 0).astype(np.int64)
        n_left, n_right = (n + gap + np.array([len(s) for s in side]) for side in (left, right))
        best = percent(n + gap + common_of(left, right), n_left + n_right)
        best = np.where(n > 0, np.maximum(best, np.maximum(percent(n, n + n_left), percent(n, n + n_right))), best)
        for value, where in zip(best.tolist(), todo):
            out[where] = value
    return out


@once
def partial_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """Stretches at either end of the longer string come from one run in each direction; those inside are runs of their own,
    every fourth first: a stretch one letter further on has at most one more in common, so most of the others need none."""
    places: dict[tuple[str, str], int] = {}
    back = np.array([places.setdefault((s, t) if len(s) <= len(t) else (t, s), len(places)) for s, t in zip(a, b)], np.int64)
    shorts, longs = [s for s, _ in places], [t for _, t in places]
    # Of equal lengths either may be the longer.
    n = len(shorts)
    twice = [k for k in range(n) if len(shorts[k]) == len(longs[k])]
    (left, i), (right, j) = numbered(shorts + [longs[k] for k in twice]), numbered(longs + [shorts[k] for k in twice])
    best = one_way(left, right, i, j)
    out = best[:n].copy()
    out[twice] = np.maximum(out[twice], best[n:])
    return out[back]


def one_way(left: Strings, right: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    short, long = left.length[i], right.length[j]
    best = np.where(short == 0, np.where(long == 0, 100.0, 0.0), 0.0)
    # At the ends: the first k letters of the longer string, for every k up to the shorter's length.
    for reverse in (False, True):
        rows = Rows(left, right, reverse)

        def hear(step: int, order: np.ndarray, both: np.ndarray) -> None:
            np.maximum.at(best, order, percent(both, short[order] + step + 1))

        rows.run(i, j, length=short, each=hear)
    rows = Rows(left, right)
    last = long - short  # stretches inside start from 1 to this, less one: the ends have both others
    every = 4
    inside = np.maximum(last - 1, 0)
    count = np.where((short > 0) & (best < 100), -(-inside // every), 0)
    pair = np.repeat(np.arange(len(i)), count)
    start = 1 + every * (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count))
    got = rows.run(i[pair], j[pair], start, short[pair])
    np.maximum.at(best, pair, percent(got, 2 * short[pair]))
    # The stretches after each that may still be better.
    for step in range(1, every):
        at = start + step
        able = (at <= inside[pair]) & (percent(np.minimum(got + step, short[pair]), 2 * short[pair]) > best[pair])
        some = np.flatnonzero(able)
        more = rows.run(i[pair[some]], j[pair[some]], at[some], short[pair[some]])
        np.maximum.at(best, pair[some], percent(more, 2 * short[pair[some]]))
        # From here the bound starts anew.
        got[some] = more - step
    return best


def partial_token_ratio(a: list[str], b: list[str]) -> np.ndarray:
    tokens, out = Tokens(), np.full(len(a), 100.0)
    todo, sorted_a, sorted_b, rest_a, rest_b = [], [], [], [], []
    for n, (s, t) in enumerate(zip(a, b)):
        (x, sx), (y, sy) = tokens(s), tokens(t)
        if not x & y:
            todo.append(n)
            sorted_a.append(sx)
            sorted_b.append(sy)
            rest_a.append(" ".join(sorted(x)))
            rest_b.append(" ".join(sorted(y)))
    if todo:
        out[todo] = np.maximum(partial_ratio(sorted_a, sorted_b), partial_ratio(rest_a, rest_b))
    return out


@once
def weighted_ratio(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    size_a, size_b = (np.array([len(s) for s in side]) for side in (a, b))
    full = np.flatnonzero((size_a > 0) & (size_b > 0))
    if not len(full):
        return out
    take = lambda at: ([a[k] for k in at], [b[k] for k in at])
    whole = ratio(a, b)
    spread = np.maximum(size_a, size_b) / np.maximum(np.minimum(size_a, size_b), 1)
    near, far = full[spread[full] < 1.5], full[spread[full] >= 1.5]
    if len(near):
        out[near] = np.maximum(whole[near], 0.95 * np.maximum(token_sort_ratio(*take(near)), token_set_ratio(*take(near))))
    if len(far):
        scale = np.where(spread[far] <= 8.0, 0.9, 0.6)
        out[far] = np.maximum(whole[far], np.maximum(scale * partial_ratio(*take(far)), 0.95 * scale * partial_token_ratio(*take(far))))
    return out


@once
def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    (left, i), (right, j) = numbered(a), numbered(b)
    n = max(len(right.strings), 1)
    pairs, back = np.unique(i * n + j, return_inverse=True)
    out = [winkler(left, right, pairs[k : k + STEP] // n, pairs[k : k + STEP] % n) for k in range(0, len(pairs), STEP)]
    return np.concatenate([np.empty(0), *out])[back]


def winkler(left: Strings, right: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    la, lb, n = left.length[i], right.length[j], len(i)
    alphabet = alphabet_of(left, right)
    masks, size, width = right.masks(alphabet), len(alphabet) + 1, right.width
    codes, codes_b = left.codes(alphabet), right.codes(alphabet)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    order = np.argsort(-la, kind="stable")
    la_s, lb_s, reach_s, base, mine = la[order], lb[order], reach[order], j[order] * size, i[order]
    steps = int(la.max(initial=0))
    taken = np.zeros((n, width), np.uint64)
    matched = np.zeros((n, steps), bool)
    live = n - np.searchsorted(la_s[::-1], np.arange(steps), "right")

    def below(m: np.ndarray) -> np.ndarray:
        """The m lowest bits of a word, m clipped to 0 and 64."""
        m = np.clip(m, 0, 64)
        return np.where(m == 64, ONES, (U1 << (m & 63).astype(np.uint64)) - U1)

    for step, k in enumerate(live.tolist()):
        cell = (base[:k] + codes[step].take(mine[:k])) * width
        low, high = step - reach_s[:k], np.minimum(step + reach_s[:k] + 1, lb_s[:k])
        free = np.ones(k, bool)
        for w in range(width):
            window = below(high - 64 * w) & ~below(low - 64 * w)
            able = np.where(free, masks.take(cell + w) & window & ~taken[:k, w], 0).astype(np.uint64)
            taken[:k, w] |= able & (~able + U1)
            free &= able == 0
        matched[:k, step] = ~free
    hits = matched.sum(1)
    # The matched letters of both, in order, side by side.
    rows, places = np.nonzero(matched)
    bits = np.unpackbits(taken.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    rows_b, places_b = np.nonzero(bits)
    differ = codes[places, mine[rows]] != codes_b[places_b, j[order][rows_b]]
    swaps = np.bincount(rows[differ], minlength=n)[:n] // 2
    m = np.maximum(hits, 1)
    jaro = (hits / np.maximum(la_s, 1) + hits / np.maximum(lb_s, 1) + (hits - swaps) / m) / 3
    same = np.ones(n, bool)
    prefix = np.zeros(n, np.int64)
    for k in range(min(4, len(codes), len(codes_b))):
        same &= (codes[k][mine] == codes_b[k][j[order]]) & (k < la_s) & (k < lb_s)
        prefix += same
    score = np.where(hits == 0, 0.0, np.where(jaro <= 0.7, jaro, jaro + 0.1 * prefix * (1 - jaro)))
    score = np.where((la_s == 0) | (lb_s == 0), ((la_s == 0) & (lb_s == 0)).astype(float), score)
    out = np.empty(n)
    out[order] = score
    return out
