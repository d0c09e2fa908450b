"""Token ids in patched frame-of-reference blocks.

A file holds the ids of consecutive documents:

    magic "PFORIDS1"
    blocks      of BLOCK ids (the last may have fewer), each
                minimum uint32, width uint8, unused uint8, exceptions uint16,
                the ids less the minimum, cut to ``width`` bits, 64 values to ``width`` words of 64 bits,
                position uint8 of each exception, then its bits above ``width`` as uint32
    documents   id int64, null flag uint8, number of ids uint32, column by column
    starts      of the blocks in the file, uint64
    trailer     n_ids, n_blocks, n_docs, documents' position uint64, CRC-32 of all this uint32, magic

The width of a block is the cheapest of a few percentiles of its values; larger ones are exceptions.
The block starts make any run of ids readable without the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILES = (75, 90, 95, 98, 100)

_HEADER = np.dtype([("minimum", "<u4"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u2")])
_TRAILER = struct.Struct("<QQQQI")
_LANES = 64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) values below 2^width to (rows, words) of 64 bits."""
    lanes = np.ascontiguousarray(values.reshape(-1, _LANES).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(_LANES):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of ``_pack``."""
    rows = len(words)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((_LANES, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(_LANES):
        word, shift = divmod(i * width, 64)
        out[i] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= lanes[word + 1] << np.uint64(64 - shift)
    out &= mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """uint32 ids to blocks; the last is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    padded = np.empty(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    rows = padded.reshape(n, BLOCK)
    low = rows.min(axis=1)
    values = rows - low[:, None]
    ordered = np.sort(values, axis=1)
    best_cost, width = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for p in PERCENTILES:
        w = _widths(ordered[:, min(BLOCK - 1, -(-BLOCK * p // 100) - 1)])
        over = (values >> np.minimum(w, 31)[:, None].astype(np.uint32) > 0).sum(axis=1)
        over[w >= 32] = 0
        cost = w * BLOCK + over * 40
        better = cost < best_cost
        best_cost[better], width[better] = cost[better], w[better]
    out: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        mine = values[at]
        high = mine >> np.uint32(w) if w < 32 else np.zeros_like(mine)
        body = _pack(mine & np.uint32((1 << w) - 1), w).astype("<u8") if w else np.empty((len(at), 0), "<u8")
        row, column = np.nonzero(high)
        cuts = np.searchsorted(row, np.arange(len(at) + 1)).tolist()
        positions, highs = column.astype(np.uint8), high[row, column].astype("<u4")
        head = np.zeros(len(at), _HEADER)
        head["minimum"], head["width"], head["exceptions"] = low[at], w, np.diff(cuts)
        raw, size = head.tobytes(), _HEADER.itemsize
        for k, i in enumerate(at.tolist()):
            a, b = cuts[k], cuts[k + 1]
            out[i] = raw[k * size : (k + 1) * size] + body[k].tobytes() + positions[a:b].tobytes() + highs[a:b].tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Whole blocks at ``starts`` (ascending, relative to ``data``) to their ids, padding included."""
    n = len(starts)
    out = np.empty((n, BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(_HEADER.itemsize)].copy().view(_HEADER).reshape(n)
    for w in np.unique(head["width"]).tolist():
        at = np.flatnonzero(head["width"] == w)
        first = starts[at] + _HEADER.itemsize
        size = w * BLOCK // 8
        values = _unpack(raw[first[:, None] + np.arange(size)].view("<u8").astype(np.uint64), w) if w else np.zeros((len(at), BLOCK), np.uint64)
        count = head["exceptions"][at].astype(np.int64)
        if count.any():
            row = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            position = raw[(first + size)[row] + nth]
            high = raw[((first + size + count)[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
            values[row, position] |= high.astype(np.uint64) << np.uint64(w)
        out[at] = values.astype(np.uint32) + head["minimum"][at][:, None]
    return out.ravel()


class Writer:
    """Writes one file, a run of documents at a time; memory is bounded by what is added at once."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.held, self.starts = b"", []
        self.ids, self.nulls, self.counts = [], [], []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self, data: bytes) -> None:
        blocks = encode_blocks(np.frombuffer(data, "<u4"))
        ends = self.at + np.cumsum([len(b) for b in blocks])
        self.starts.append(ends - [len(b) for b in blocks])
        self._write(b"".join(blocks))

    def add(self, doc_ids: list[int | None], encoded: list[bytes]) -> None:
        """Append documents with their ids as little-endian uint32 bytes."""
        self.ids.append(np.array([i or 0 for i in doc_ids], "<i8"))
        self.nulls.append(np.array([i is None for i in doc_ids], np.uint8))
        self.counts.append(np.array([len(e) // 4 for e in encoded], "<u4"))
        data = self.held + b"".join(encoded)
        whole = len(data) // (4 * BLOCK) * 4 * BLOCK
        if whole:
            self._flush(data[:whole])
        self.held = data[whole:]

    def close(self) -> tuple[int, int]:
        """Finish the file; the numbers of documents and of ids."""
        if self.held:
            self._flush(self.held)
        join = lambda arrays, kind: np.concatenate([*arrays, np.empty(0, kind)]).astype(kind)
        counts, starts = join(self.counts, "<u4"), join(self.starts, "<u8")
        docs_at = self.at
        tail = join(self.ids, "<i8").tobytes() + join(self.nulls, "u1").tobytes() + counts.tobytes() + starts.tobytes()
        n_ids = int(counts.sum(dtype=np.int64))
        self._write(tail)
        sizes = struct.pack("<QQQQ", n_ids, len(starts), len(counts), docs_at)
        self._write(sizes + struct.pack("<I", zlib.crc32(tail + sizes)) + MAGIC)
        self.stream.close()
        return len(counts), n_ids


class Reader:
    """Reads a file: all documents in order, or any run of ids."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        size = _TRAILER.size + len(MAGIC)
        trailer = self._read(end - size, size)
        if end < size or trailer[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_ids, n_blocks, n_docs, docs_at, crc = _TRAILER.unpack(trailer[: _TRAILER.size])
        if docs_at > end:
            raise ValueError("the index of a file of token ids is damaged")
        tail = self._read(docs_at, end - size - docs_at)
        if zlib.crc32(tail + trailer[:32]) != crc or len(tail) != 13 * n_docs + 8 * n_blocks:
            raise ValueError("the index of a file of token ids is damaged")
        self.doc_ids = np.frombuffer(tail, "<i8", n_docs)
        self.nulls = np.frombuffer(tail, "u1", n_docs, 8 * n_docs)
        self.counts = np.frombuffer(tail, "<u4", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = np.append(np.frombuffer(tail, "<u8", n_blocks, 13 * n_docs).astype(np.int64), docs_at)
        self.first = np.cumsum(self.counts) - self.counts

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids from number ``first`` on, read from the blocks that hold them."""
        if n <= 0:
            return np.empty(0, np.uint32)
        lo, hi = first // BLOCK, -(-(first + n) // BLOCK)
        data = self._read(int(self.starts[lo]), int(self.starts[hi] - self.starts[lo]))
        return decode_blocks(data, self.starts[lo:hi] - self.starts[lo])[first - lo * BLOCK : first - lo * BLOCK + n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.counts[k]))

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """The file's ids in order, at most ``most`` at a time, each run with the number of its first id."""
        for at in range(0, self.n_ids, most):
            yield at, self.ids(at, min(most, self.n_ids - at))

    def checksums(self) -> np.ndarray:
        """CRC-32 of each document's ids as little-endian uint32, in one pass with bounded memory."""
        out = np.zeros(len(self.counts), np.int64)
        ends = self.first + self.counts
        doc = 0
        for at, ids in self.runs():
            data = memoryview(ids.astype("<u4").tobytes())
            stop = at + len(ids)
            while doc < len(out):
                a, b = max(int(self.first[doc]), at), min(int(ends[doc]), stop)
                if a < b:
                    out[doc] = zlib.crc32(data[4 * (a - at) : 4 * (b - at)], int(out[doc]))
                if ends[doc] > stop:
                    break
                doc += 1
        return out
