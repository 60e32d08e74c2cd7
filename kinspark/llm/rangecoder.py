"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

A block of ids lies in up to ``LANES`` runs of equal length, each with a range coder of its own
over one shared model, so the arithmetic works on arrays: one element for each lane of each
block. Three orders predict the next id, and their distributions are mixed into one:
* order 2 and order 1 put their mass on the id that last followed the two ids, or the one id, before;
* order 0 spreads its mass over all ids as often as each has come in the block.
The weights of the mixture are counted for each combination of both confidences (how often
in a row the prediction held) and of whether the two agree. An id's interval on the scale is its
part of all three, so every id is coded by one step of the range coder.

Weights, predictions and counts are renewed at the places ``rounds`` gives, from ids that the decoder
has by then, and begin anew in each block. All arithmetic is on whole numbers.
Every block carries the checksum of its ids and of its payload; decoding verifies both.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, LANE = 1024, 1024
BLOCK = LANES * LANE
#: Ids of a lane at least, where a block has fewer than LANES times as many.
SHORT_LANE = 256
#: Blocks coded in step: bounds the memory of the models.
GROUP = 4
#: Steps whose symbols the encoder finds at once.
CHUNK = 16
#: Bits of the order-0 scale, of a weight, of the whole scale, and of the slots of order-2 contexts in a block.
ID_BITS, WEIGHT_BITS, SLOT_BITS = 19, 7, 18
SCALE_BITS = ID_BITS + WEIGHT_BITS
#: Confidences are 0 to 7; a place is one of each order and a bit for agreement.
PLACES, SURE = 128, 7
MAGIC = b"KRB2"
HEADER = struct.Struct("<4sIIIHIII")  # magic, ids, lanes, lane length, alphabet, checksums of ids and payload, bytes of payload
U = np.uint64
HALF, SCALE, SCALE_TOP = U(32), U(SCALE_BITS), U((1 << SCALE_BITS) - 1)
SMALL, HALF_MASK = U(1 << 32), U((1 << 32) - 1)
SHARE = (1 << 20) - 1
#: Bits of the reciprocals of weights: (u * reciprocal) >> bits is u // weight for every u on the scale.
RECIPROCAL = 34


class DamagedBlock(ValueError):
    """A checksum or a length doesn't hold."""


def rounds(lane: int) -> list[tuple[int, int]]:
    """Stretches of places after which the model is renewed: doubling up to 64, then of 64 each."""
    ends = [e for e in (1, 2, 4, 8, 16, 32, *range(64, lane, 64)) if e < lane] + [lane]
    return list(zip([0, *ends[:-1]], ends))


class Model:
    """Predictions and counts of ``blocks`` blocks of ``lanes`` lanes, of ids below ``alphabet`` (at most 65,536)."""

    def __init__(self, blocks: int, lanes: int, alphabet: int):
        self.blocks, self.alphabet = blocks, alphabet
        number = np.repeat(np.arange(blocks), lanes)
        self.of_id, self.of_slot, self.of_one, self.of_place, self.of_scale = number * alphabet, number << SLOT_BITS, number << 16, number * PLACES, number << ID_BITS
        # By context: the id that came last, and above 16 bits the confidence.
        self.two, self.one = np.zeros(blocks << SLOT_BITS, np.uint32), np.zeros(blocks << 16, np.uint32)
        self.ids = np.zeros(blocks * alphabet, np.int64)
        self.hits = np.tile(np.array([2, 1, 2], np.int64), blocks * PLACES)
        self.renew()

    def renew(self) -> None:
        """For each place the weights of the orders; for each id its place on the order-0 scale, and its share in the low 20 bits."""
        hits = self.hits.reshape(-1, 3)
        place = np.arange(len(hits)) % PLACES
        has2, has1 = place >> 4 > 0, (place >> 1 & 7) > 0
        n2, n1 = np.where(has2, hits[:, 0], 0), np.where(has1 & ~(has2 & (place & 1 > 0)), hits[:, 1], 0)
        total = n2 + n1 + hits[:, 2]
        whole = 1 << WEIGHT_BITS
        self.weight = np.where(n2 + n1 > 0, np.clip((hits[:, 2] * whole + total // 2) // total, 1, whole - 1), whole)
        rest = (whole - self.weight) << ID_BITS
        self.mass2 = rest * n2 // np.maximum(n2 + n1, 1)
        self.mass1 = np.where(n1 > 0, rest - self.mass2, 0)
        self.mass2 = np.where(n1 > 0, self.mass2, rest)
        self.reciprocal = ((1 << RECIPROCAL) + self.weight - 1) // self.weight
        counts = self.ids.reshape(self.blocks, -1)
        seen = counts.sum(1, keepdims=True)
        room = (1 << ID_BITS) - self.alphabet
        share = 1 + np.where(seen > 0, counts * room // np.maximum(seen, 1), room // self.alphabet)
        share[:, 0] += (1 << ID_BITS) - share.sum(1)
        self.share = share
        self.order0 = ((np.cumsum(share, 1) - share) << 20 | share).ravel()

    def inverse(self) -> np.ndarray:
        """Place on the order-0 scale -> id, for decoding."""
        return np.concatenate([np.repeat(np.arange(self.alphabet, dtype=np.uint16), s) for s in self.share])

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in both tables, their entries and the place of the weights, after the ids ``two`` and ``one``."""
        at2 = (two * 40503 + one * 25717 + (two >> 3)) & ((1 << SLOT_BITS) - 1)
        at2 += self.of_slot
        at1 = one + self.of_one
        e2, e1 = self.two.take(at2).astype(np.int64), self.one.take(at1).astype(np.int64)
        place = (e2 >> 16 << 4) + (e1 >> 16 << 1) + (((e1 ^ e2) & 0xFFFF) == 0) + self.of_place
        return at2, at1, e2, e1, place

    def interval(self, x: np.ndarray, id2: np.ndarray, id1: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of x on the whole scale: the parts of order 0, 2 and 1 of all lesser ids, and of x."""
        weight, mass2, mass1 = self.weight.take(place), self.mass2.take(place), self.mass1.take(place)
        own = self.order0.take(self.of_id + x)
        start = weight * (own >> 20) + mass2 * (id2 < x) + mass1 * (id1 < x)
        return start.view(U), (weight * (own & SHARE) + mass2 * (id2 == x) + mass1 * (id1 == x)).view(U)

    def learn(self, x: np.ndarray, seen: tuple[np.ndarray, ...]) -> None:
        """Takes in a round of [step, lane] arrays, ``seen`` being what ``predict`` gave; where a context
        came several times, the last in the order of the arrays stays."""
        of_id = np.broadcast_to(self.of_id, x.shape).ravel()
        x = x.ravel()
        at2, at1, e2, e1, place = (y.ravel() for y in seen)
        k2, k1 = e2 >> 16, e1 >> 16
        held2, held1 = (e2 & 0xFFFF) == x, (e1 & 0xFFFF) == x
        held2 &= k2 > 0
        held1 &= k1 > 0
        hit = np.where(held2, 0, np.where(held1, 1, 2))
        self.hits += np.bincount(place * 3 + hit, minlength=len(self.hits))
        self.two[at2] = np.where(held2, np.minimum(k2 + 1, SURE), 1) << 16 | x
        self.one[at1] = np.where(held1, np.minimum(k1 + 1, SURE), 1) << 16 | x
        self.ids += np.bincount(of_id + x, minlength=len(self.ids))
        self.renew()


def encode_group(x: np.ndarray, alphabet: int) -> list[bytes]:
    """Payloads of blocks x[block, lane, place]."""
    n, lanes, lane = x.shape
    width = n * lanes
    # By place, then lane; two rows of zeros stand before each lane's start.
    ids = np.zeros((lane + 2, width), np.int64)
    ids[2:] = x.reshape(width, lane).T
    model = Model(n, lanes, alphabet)
    low, span = np.zeros(width, U), np.full(width, (1 << 64) - 1, U)
    # Digits of 32 bits; a carry is added to the digit before it, and passed on at the end. An id takes 27 bits at most.
    depth = lane * 27 // 32 + 4
    out, first = np.zeros(width * depth, U), np.arange(width) * depth
    at = first.copy()
    for a, b in rounds(lane):
        seen = []
        for i in range(a, b, CHUNK):
            j = min(i + CHUNK, b)
            own = ids[i + 2 : j + 2]
            got = model.predict(ids[i + 1 : j + 1], ids[i:j])
            seen.append(got)
            starts, sizes = model.interval(own, got[2] & 0xFFFF, got[3] & 0xFFFF, got[4])
            for start, size in zip(starts, sizes):
                unit = span >> SCALE
                start = start * unit
                low += start
                carried = low < start
                if carried.any():
                    out[at[carried] - 1] += U(1)
                span = size * unit
                # The digit is written at every step, and stays once its place is left behind.
                out[at] = low >> HALF
                small = span < SMALL
                at += small
                shift = small.astype(U) << U(5)
                low <<= shift
                span <<= shift
        model.learn(ids[a + 2 : b + 2], tuple(np.concatenate(y) for y in zip(*seen)))
    # One more digit names a number within every lane's last interval.
    last = low + HALF_MASK
    out[at[last < low] - 1] += U(1)
    out[at] = last >> HALF
    used = at + 1 - first
    digits = out.reshape(width, depth)
    digits = digits * (np.arange(depth) < used[:, None])
    for k in range(int(used.max()) - 1, 0, -1):
        digits[:, k - 1] += digits[:, k] >> HALF
    made = []
    for k in range(n):
        mine = slice(k * lanes, (k + 1) * lanes)
        keep = np.arange(depth) < used[mine, None]
        made.append(used[mine].astype("<u2").tobytes() + (digits[mine][keep] & HALF_MASK).astype("<u4").tobytes())
    return made


def decode_group(payloads: list[bytes], lanes: int, lane: int, alphabet: int) -> np.ndarray:
    """x[block, lane, place] of payloads of blocks of one shape."""
    n, width = len(payloads), len(payloads) * lanes
    sizes = np.concatenate([np.frombuffer(p, "<u2", lanes) for p in payloads]).astype(np.int64)
    depth = int(sizes.max()) + 3
    words = np.zeros((width, depth), U)
    words[np.arange(depth) < sizes[:, None]] = np.concatenate([np.frombuffer(p, "<u4", -1, 2 * lanes) for p in payloads])
    words = words.ravel()
    model = Model(n, lanes, alphabet)
    at = np.arange(width) * depth
    span, rest = np.full(width, (1 << 64) - 1, U), words[at] << HALF | words[at + 1]
    at += 2
    x = np.zeros((lane + 2, width), np.int64)
    for a, b in rounds(lane):
        inverse, seen = model.inverse(), np.empty((5, b - a, width), np.int64)
        for i in range(a, b):
            got = model.predict(x[i + 1], x[i])
            seen[:, i - a] = got
            _, _, e2, e1, place = got
            id2, id1 = e2 & 0xFFFF, e1 & 0xFFFF
            weight, mass2, mass1 = model.weight.take(place), model.mass2.take(place), model.mass1.take(place)
            unit = span >> SCALE
            u = np.minimum(rest // unit, SCALE_TOP).view(np.int64)
            # Take the masses of orders 2 and 1 off the scale, that of the lesser id first: order 0 is left.
            swap = id1 < id2
            lesser, greater = np.where(swap, id1, id2), np.where(swap, id2, id1)
            less, more = np.where(swap, mass1, mass2), np.where(swap, mass2, mass1)
            u = np.maximum(u - less, np.minimum(u, weight * (model.order0.take(model.of_id + lesser) >> 20)))
            u = np.maximum(u - more, np.minimum(u, weight * (model.order0.take(model.of_id + greater) >> 20)))
            own = inverse.take(model.of_scale + (u * model.reciprocal.take(place) >> RECIPROCAL)).astype(np.int64)
            x[i + 2] = own
            there = model.order0.take(model.of_id + own)
            start = weight * (there >> 20) + mass2 * (id2 < own) + mass1 * (id1 < own)
            size = weight * (there & SHARE) + mass2 * (id2 == own) + mass1 * (id1 == own)
            rest -= start.view(U) * unit
            span = size.view(U) * unit
            small = span < SMALL
            shift = small.astype(U) << U(5)
            span <<= shift
            rest = (rest << shift) | words.take(at, mode="clip") * small
            at += small
        model.learn(x[a + 2 : b + 2], tuple(seen))
    return np.ascontiguousarray(x[2:].T).reshape(n, lanes, lane)


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """Blocks of equal shape, one after the other; the last is padded with zeros."""
    if not len(ids):
        return b""
    if alphabet > 1 << 16:
        raise ValueError(f"ids must be below 65,536; the vocabulary has {alphabet}")
    count = -(-len(ids) // BLOCK)
    lanes = min(LANES, -(-len(ids) // (count * SHORT_LANE)))
    lane = -(-len(ids) // (count * lanes))
    size = lanes * lane
    padded = np.zeros(count * size, np.uint16)
    padded[: len(ids)] = ids
    x = padded.reshape(count, lanes, lane)
    out = []
    for k in range(0, count, GROUP):
        for j, payload in enumerate(encode_group(x[k : k + GROUP], alphabet), k):
            own = padded[j * size : (j + 1) * size][: max(0, len(ids) - j * size)]
            out += [HEADER.pack(MAGIC, len(own), lanes, lane, alphabet - 1, zlib.crc32(own.tobytes()), zlib.crc32(payload), len(payload)), payload]
    return b"".join(out)


def decode(data: bytes) -> np.ndarray:
    """The ids of what ``encode`` made; raises DamagedBlock where a checksum fails."""
    heads, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise DamagedBlock(f"header of block {len(heads)}")
        magic, n, lanes, lane, top, crc, payload_crc, size = HEADER.unpack_from(data, at)
        at += HEADER.size
        payload = data[at : at + size]
        at += size
        if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != payload_crc:
            raise DamagedBlock(f"payload of block {len(heads)}")
        heads.append((n, lanes, lane, top + 1, crc, payload))
    out = []
    for k in range(0, len(heads), GROUP):
        some = heads[k : k + GROUP]
        x = decode_group([h[5] for h in some], *some[0][1:4]).astype(np.uint16)
        for (n, *_, crc, _), own in zip(some, x):
            own = own.ravel()[:n]
            if zlib.crc32(own.tobytes()) != crc:
                raise DamagedBlock("ids")
            out.append(own)
    return np.concatenate(out) if out else np.empty(0, np.uint16)
