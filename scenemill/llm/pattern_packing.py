"""Best-fit packing planned on the histogram of lengths: patterns by non-negative least squares, rest by best fit.

(Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021.) The plan is made on the
driver from one count per length, so its size depends on the sequence length alone. Lengths are put
into classes of ``STEP``; the patterns are the ways of choosing at most three classes whose lengths can
add up to a full sequence, their repeat counts are fitted to the class histogram, and each rounded
count is spent on exact lengths that fill a sequence completely. What remains is packed by best-fit
decreasing, many equal pieces at a time. How much of the fitted counts to spend is tried out. Pieces then find their place from their rank among the pieces
of their length: no piece is compared with another.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.llm.common import bounded_batches, materialise
from scenemill.llm.tokens import WORD_BPE, encoder, tokenizer_path

MAX_TOKENS = 2048

#: Width of the length classes that the patterns are fitted on.
STEP = 32

#: Pieces below this share of a sequence are kept for the residual: best fit closes its last gaps with them.
SMALL = 1 / 8

#: Shares of each pattern's fitted repeats that are held back for the residual; the best of these plans is taken.
RESERVES = (0.0, 0.2, 0.4, 0.6, 0.8)

_END = b"\0\0\0\0"


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        if not n or gradient.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[gradient.argmax()] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at[low]] / np.maximum(x[at[low]] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            passive[at[low & (x[at] <= 1e-12)]] = False
            passive[at[np.argmin(np.where(low, x[at], np.inf))]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def class_patterns(classes: int, full: int, step: int) -> list[tuple[int, ...]]:
    """Multisets of two or three classes (1 to ``classes``) of which some exact lengths add up to ``full``.

    Class c holds the lengths step * (c - 1) + 1 to step * c; of the possible class sums those are taken
    that leave the most combinations of exact lengths.
    """
    out: list[tuple[int, ...]] = []
    for k in (2, 3):
        middle = (full + k * (step - 1) / 2) / step
        for total in sorted({int(np.floor(middle)), int(np.ceil(middle))}):
            spare = full - step * (total - k)
            if not k <= spare <= k * step:
                continue
            for first in range(1, classes + 1):
                if k == 2:
                    second = total - first
                    if first <= second <= classes:
                        out.append((first, second))
                else:
                    for second in range(first, (total - first) // 2 + 1):
                        third = total - first - second
                        if second <= third <= classes:
                            out.append((first, second, third))
    return out


def _spend(pattern: tuple[int, ...], repeats: int, left: np.ndarray, full: int, step: int, plan: Counter) -> None:
    """Turn up to ``repeats`` copies of a class pattern into sequences filled exactly, from the counts in ``left``."""

    def lengths(c: int) -> list[int]:
        return [v for v in range(step * c, step * (c - 1), -1) if v < len(left) and left[v]]

    heads = [(v,) for v in lengths(pattern[-1])] if len(pattern) == 2 else [(v, w) for v in lengths(pattern[-1]) for w in lengths(pattern[-2])]
    for head in heads:
        last = full - sum(head)
        if not step * (pattern[0] - 1) < last <= step * pattern[0]:
            continue
        need = Counter((*head, last))
        n = min([repeats, *(int(left[v]) // m for v, m in need.items())])
        if n > 0:
            plan[(*head, last)] += n
            repeats -= n
            for v, m in need.items():
                left[v] -= n * m
        if not repeats:
            return


def _best_fit(left: np.ndarray, full: int, plan: Counter) -> None:
    """Best-fit decreasing over the remaining counts, equal bins and equal pieces in bulk."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(full + 1)]
    count = np.zeros(full + 1, np.int64)

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            open_[room].append((pattern, n))
            count[room] += n

    for v in range(full, 0, -1):
        c = int(left[v])
        while c:
            rooms = np.flatnonzero(count[v:])
            if not len(rooms):
                put(full, (), -(-c // (full // v)))
                continue
            room = int(rooms[0]) + v
            pattern, n = open_[room].pop()
            each = min(room // v, c)
            used = min(n, c // each)
            count[room] -= n
            if n > used:
                put(room, pattern, n - used)
            put(room - each * v, pattern + (v,) * each, used)
            c -= used * each
    for room in open_:
        for pattern, n in room:
            if pattern:
                plan[pattern] += n


def plan_packing(histogram: np.ndarray, full: int = MAX_TOKENS, step: int = STEP) -> dict[tuple[int, ...], int]:
    """``histogram[v]`` pieces of length v (1 to ``full``) to {lengths of a sequence's pieces: how many such sequences}."""
    whole = int(histogram[full])
    open_ = histogram.astype(np.int64).copy()
    open_[full] = 0
    classes = -(-full // step)
    counts = np.bincount(-(-np.arange(full + 1) // step), weights=open_, minlength=classes + 1)
    held = np.flatnonzero(counts)
    patterns = [p for p in class_patterns(classes, full, step) if all(counts[c] for c in p) and p[0] * step > SMALL * full]
    repeats = np.zeros(len(patterns))
    if patterns:
        a = np.zeros((classes + 1, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c, j] += 1
        repeats = nnls(a[held], counts[held])
    best: Counter | None = None
    for reserve in RESERVES:
        left, plan = open_.copy(), Counter()
        for j in np.argsort(-repeats, kind="stable"):
            if (n := int(repeats[j] * (1 - reserve))) > 0:
                _spend(patterns[j], n, left, full, step, plan)
        _best_fit(left, full, plan)
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
    if whole:
        best[(full,)] += whole
    return dict(best)


@dataclass
class Slots:
    """Where the pieces of each length go: the r-th of a length (from 0) is in the slot that ``keys`` finds for it."""

    keys: np.ndarray  # length << 44 | first rank, ascending
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: dict[tuple[int, ...], int]) -> Slots:
        rows, taken, base = [], Counter(), 0
        for pattern, n in sorted(plan.items(), reverse=True):
            offset = 0
            for v in pattern:
                rows.append((v, taken[v], base, offset))
                taken[v] += n
                offset += v
            base += n
        rows.sort()
        v, first, sequence, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4
        return cls((v << 44) | first, first, sequence, offset)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) | rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


_PIECES = "id {id}, piece int, start long, length int, ids_crc32 long, part int, rank_in_part long{ids}"


def _cutter(path: str, full: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(path), TaskContext.get().partitionId()
        ranks: Counter = Counter()
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 256):
                found = words.encode([t if t is not None else "" for t in texts.slice(lo, 256).to_pylist()])
                at, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for i, data in enumerate(found):
                    data += _END
                    for k, s in enumerate(range(0, len(data), 4 * full)):
                        own = data[s : s + 4 * full]
                        n = len(own) // 4
                        at.append(lo + i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(ranks[n])
                        ranks[n] += 1
                        ids.append(own if with_ids else None)
                columns = [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(rank, pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: int = MAX_TOKENS, tokenizer: str = WORD_BPE, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` on request).

    A document is its token ids and a final id 0 (null text: the 0 alone); only documents of more than
    ``full`` ids are cut, into pieces of ``full`` and a last one that may be shorter. Every row is packed,
    repeated rows and null ids too; extra columns are ignored; an empty table gives an empty result.
    ``offset`` is a piece's place in its sequence; the pieces of a sequence follow each other from 0 without gaps.
    ``ids`` holds a piece's ids as little-endian uint32.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _PIECES.format(id=id_type, ids=", ids binary" if with_ids else "")
    pieces = docs.select(id_col, text_col).mapInArrow(_cutter(tokenizer_path(tokenizer), full, with_ids), schema)
    pieces = materialise(pieces, "packing-pieces")
    by_part = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = np.zeros(full + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[r["length"]] = r["n"]
    slots = docs.sparkSession.sparkContext.broadcast(Slots.of(plan_packing(histogram, full)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = materialise(ranked, "packing-bases")

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = slots.value.find(length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = pieces.join(ranked, ["part", "length"]).withColumn(
        "at", F.arrow_udf(place, kind)(F.col("length"), F.col("base") + F.col("rank_in_part"))
    )
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else [])
    )
