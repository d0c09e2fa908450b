"""MD5 of many numbered messages at once, in numpy: the draws of a bootstrap over items are nothing but such digests."""

from __future__ import annotations

import math
import struct

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

#: Messages at a time: a dozen arrays of so many words stay in a core's cache.
LANES = 1 << 14


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """(width, n) ASCII digits of numbers that have so many."""
    out, rest = np.empty((width, len(numbers)), np.uint32), numbers.astype(np.int64)
    for i in range(width - 1, -1, -1):
        whole = rest // 10
        out[i], rest = rest - whole * 10 + 48, whole
    return out


class Numbered:
    """Messages ``prefix`` + decimal number for a run of numbers with as many digits each; the digits are laid out once for all prefixes."""

    def __init__(self, first: int, stop: int):
        self.n, self.width = stop - first, len(str(first))
        if stop <= first or len(str(stop - 1)) != self.width:
            raise ValueError("numbers of one run have as many digits")
        self.digits = _digits(np.arange(first, stop), self.width)
        self.words: dict[int, dict[int, np.ndarray]] = {}
        self.room = [np.empty(self.n, np.uint32) for _ in range(7)]

    def _laid(self, shift: int) -> dict[int, np.ndarray]:
        """The words that the digits fill in part, by their number, where the first digit is byte ``shift`` of word 0."""
        if shift not in self.words:
            laid: dict[int, np.ndarray] = {}
            for i, digit in enumerate(self.digits):
                word, byte = divmod(shift + i, 4)
                laid[word] = laid.get(word, np.uint32(0)) | (digit << np.uint32(8 * byte))
            self.words[shift] = laid
        return self.words[shift]

    def first_48(self, prefix: bytes) -> np.ndarray:
        """The first 12 hex digits of each message's MD5 as a number."""
        size = len(prefix) + self.width
        raw = prefix + b"\0" * self.width + b"\x80"
        raw += b"\0" * ((56 - len(raw)) % 64) + struct.pack("<Q", 8 * size)
        fixed = struct.unpack(f"<{len(raw) // 4}I", raw)
        at, shift = divmod(len(prefix), 4)
        varying = {at + w: v | np.uint32(fixed[at + w]) for w, v in self._laid(shift).items()}
        state: list = [np.full(self.n, v, np.uint32) for v in _START]
        for block in range(0, len(fixed), 16):
            state = self._block(state, [varying.get(i, fixed[i]) for i in range(block, block + 16)])
        low, high = state[0].byteswap().astype(np.int64), (state[1] & np.uint32(0xFFFF)).astype(np.uint16).byteswap()
        return (low << 16) | high

    def _block(self, state: list[np.ndarray], words: list) -> list[np.ndarray]:
        a, b, c, d = (r[:] for r in self.room[:4])
        f, g, _ = self.room[4:]
        for mine, held in zip((a, b, c, d), state):
            np.copyto(mine, held)
        for i in range(64):
            kind = i // 16
            if kind == 0:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                k = i
            elif kind == 1:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                k = (5 * i + 1) % 16
            elif kind == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                k = (3 * i + 5) % 16
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                k = 7 * i % 16
            np.add(f, a, out=f)
            if isinstance(words[k], np.ndarray):
                np.add(f, words[k], out=f)
                np.add(f, np.uint32(_K[i]), out=f)
            else:
                np.add(f, np.uint32((_K[i] + words[k]) & 0xFFFFFFFF), out=f)
            turn = _TURNS[kind][i % 4]
            np.left_shift(f, np.uint32(turn), out=g), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        return [x + y for x, y in zip(state, (a, b, c, d))]


def runs(first: int, stop: int, most: int = LANES):
    """``Numbered`` runs that make up the numbers from ``first`` up to ``stop``."""
    while first < stop:
        end = min(stop, first + most, 10 ** len(str(first)))
        yield first, Numbered(first, end)
        first = end
