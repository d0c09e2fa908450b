"""Hamming distances over bit planes.

Fingerprints are stored vertically: plane b holds bit b of 64 fingerprints in each word, so that one
XOR gives bit b of 64 differences. The differences are added up lane by lane in carry-save form (ones,
twos, fours, eights: one bit plane per power of two), and a lane whose count passes the radius is dead
for good. Words without a live lane are abandoned before the remaining planes are read.
"""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Planes added between two looks at which words still live.
_STEP = 4


def to_planes(values: np.ndarray) -> np.ndarray:
    """uint64 values, (n,) or (n, parts) for wide ones, to (64 * parts, words) planes.

    Plane 0 has the highest bits; lane i is bit i % 64 of word i // 64.
    """
    n, wide = len(values), values.shape[1] if values.ndim > 1 else 1
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64 * wide), dtype=np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(values).astype(">u8").view(np.uint8).reshape(n, 8 * wide), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(64 * wide, words)


def lanes(words: np.ndarray) -> np.ndarray:
    """The numbers of the lanes that are set."""
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def lane_mask(n: int) -> np.ndarray:
    """Words whose first ``n`` lanes are set."""
    bits = np.zeros(-(-n // 64) * 64, dtype=np.uint8)
    bits[:n] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, live: np.ndarray, radius: int) -> np.ndarray:
    """Words of lanes, of those set in ``live``, whose distance is at most ``radius``.

    ``left`` and ``right`` are (bits, words) planes; one may be (bits, 1), words of all ones or zeros, to
    compare one fingerprint with a whole block.
    """
    n_planes, n_counters = len(left), max(1, int(radius + 1).bit_length())
    at = np.flatnonzero(live)
    alive = live[at].copy()
    counters = np.zeros((n_counters, len(at)), dtype=np.uint64)
    for first in range(0, n_planes, _STEP):
        if not len(at):
            break
        for b in range(first, min(first + _STEP, n_planes)):
            x = left[b] if left.shape[1] == 1 else left[b][at]
            carry = x ^ (right[b] if right.shape[1] == 1 else right[b][at])
            carry = np.broadcast_to(carry, (len(at),)) & alive
            for c in range(n_counters):
                up = counters[c] & carry
                counters[c] ^= carry
                carry = up
            alive &= ~carry  # the count ran over all counters
        over = _above(counters, radius)
        alive &= ~over
        keep = alive != 0
        if not keep.all():
            at, alive, counters = at[keep], alive[keep], counters[:, keep]
    out = np.zeros_like(live)
    out[at] = alive
    return out


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``: a comparison from the highest bit plane down."""
    above = np.zeros(counters.shape[1], dtype=np.uint64)
    equal = np.full(counters.shape[1], _ALL, dtype=np.uint64)
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            equal &= counters[c]
        else:
            above |= equal & counters[c]
            equal &= ~counters[c]
    return above


def spread(value: np.ndarray) -> np.ndarray:
    """One fingerprint, a uint64 or the parts of a wide one, as (bits, 1) planes."""
    bits = np.unpackbits(np.atleast_1d(value).astype(">u8").view(np.uint8)).astype(bool)
    return np.where(bits, _ALL, np.uint64(0))[:, None]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the graph that links values at most ``radius`` apart.

    Every member asks the block once, and a member that has been reached is not compared again, so that
    a dense block costs little more than its length.
    """
    n = len(values)
    if n < 2:
        return []
    planes, open_, edges = to_planes(values), lane_mask(n), []
    for seed in range(n):
        if not int(open_[seed >> 6]) >> (seed & 63) & 1:
            continue
        open_[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        todo = [seed]
        while todo:
            asks = todo.pop()
            near = within(spread(values[asks]), planes, open_, radius)
            reached = lanes(near).tolist()
            open_ &= ~near
            edges += [(asks, r) for r in reached]
            todo += reached
    return edges


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int, chunk: int = 1 << 15) -> np.ndarray:
    """Whether a[i] and b[i] are at most ``radius`` apart, for many pairs at once."""
    out = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), chunk):
        x, y = a[lo : lo + chunk], b[lo : lo + chunk]
        out[lo + lanes(within(to_planes(x), to_planes(y), lane_mask(len(x)), radius))] = True
    return out
