"""SimHash near-duplicates at a likeness: wide fingerprints, bit-sliced comparison, exact check.

Two texts are linked if the sets of their word shingles have a Jaccard likeness of ``least`` or more. A
64-bit fingerprint cannot tell them: at 0.8 two differ in about 10 bits of 64. So a text gets ``WIDE``
bits, one SimHash per 64, each of its own mix of the shingle digests. Sets of a likeness J are at an angle
of at most acos(2 J / (1 + J)), so each bit differs with a chance of at most that over pi. From this
follow

* the keys: each fingerprint is dealt to one bucket per table, by that many drawn bits. Keys are as long as
  the number of texts, so that chance meetings stay few, and there are as many tables as let a pair at
  ``least`` meet with a chance of ``FOUND``;
* the radius: members of a bucket are compared in bit planes (bitslice.py) over the first ``COMPARED`` bits,
  within the distance that such a pair keeps but for three standard deviations.

Texts so linked, directly or by others, form a pool, and within a pool all pairs are compared on the
shingles themselves (64-bit digests). Pools above ``chunk`` members or ``CHUNK_SHINGLES`` shingles are cut
into chunks, and every two chunks meet in a task of their own, so no pool is capped. A task hands on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemill.llm.common import bounded_batches, broadcast_if_small, materialise, row_key
from scenemill.llm.components import connected_components
from scenemill.llm.simhash import bucket_links, grouped, keep_least, shingle_digests

SHINGLE_WORDS = 5
LEAST = 0.8
WIDE = 512
COMPARED = 128
FOUND = 0.99
LEAST_KEY_BITS = 12
CHUNK = 512
CHUNK_SHINGLES = 500_000

_DRAWN = np.random.default_rng(42).integers(1, 1 << 63, size=(2, WIDE // 64), dtype=np.uint64)
_XORS, _FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
_COLUMN = np.arange(WIDE // 8, dtype=np.int64) * 256

#: Shingles mixed at a time, and up to which bits are counted one by one.
_STEP, _FEW = 4096, 128


def shingle_set(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct digests of a text's word shingles, ascending; words as in simhash.py."""
    return np.unique(np.frombuffer(shingle_digests(text, shingle_words), np.uint64))


def wide_fingerprint(digests: np.ndarray) -> bytes:
    """The ``WIDE`` bits of a set of digests: a bit is 1 if it is in over half of its mixes."""
    ones = np.zeros(WIDE, np.float64)
    for at in range(0, len(digests), _STEP):
        mixed = (digests[at : at + _STEP, None] ^ _XORS) * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[::-1]
        by_byte = mixed.astype(">u8").view(np.uint8).reshape(len(mixed), WIDE // 8)
        if len(by_byte) <= _FEW:
            ones += np.unpackbits(by_byte, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts = np.bincount((by_byte + _COLUMN).ravel(), minlength=256 * len(_COLUMN)).reshape(-1, 256)
            ones += (counts.astype(np.float32) @ _BYTE_BITS).ravel()
    return np.packbits(2 * ones > len(digests)).tobytes()


_ARROW = pa.struct([("fp", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("digests", pa.binary())])


def _sketch_column(text: Column, shingle_words: int) -> Column:
    """``fp, size, bits, digests`` of a text; fp tells apart sets of shingles and is 0 for a text without words. Null texts count as empty."""

    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.large_binary()):
            found = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words)
            raw = found.tobytes()
            fp = int(np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64)) if raw else 0
            rows.append((fp, len(found), wide_fingerprint(found), raw))
        columns = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "struct<fp: long, size: long, bits: binary, digests: binary>")(text)


def bit_chance(least: float) -> float:
    """The most that the chance of a bit to differ can be for sets of a Jaccard likeness of ``least``."""
    return math.acos(2 * least / (1 + least)) / math.pi


def key_plan(n: int, least: float) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` texts."""
    bits = min(48, max(LEAST_KEY_BITS, n.bit_length()))
    meet = (1 - bit_chance(least)) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log1p(-meet)) if meet < FOUND else 1


def _keys_column(bits: Column, key_bits: int, tables: int) -> Column:
    """One key per table: its number above the bits drawn for it."""
    drawn = np.argsort(np.random.default_rng(7).random((tables, WIDE)), axis=1)[:, :key_bits]
    values = np.exp2(np.arange(key_bits))
    above = np.arange(tables, dtype=np.int64) << 48

    def of(batch: pa.Array) -> pa.Array:
        out = np.empty((len(batch), tables), np.int64)
        raw = np.frombuffer(b"".join(batch.to_pylist()), np.uint8).reshape(len(batch), WIDE // 8)
        for at in range(0, len(raw), 256):
            own = np.unpackbits(raw[at : at + 256], axis=1)[:, drawn.ravel()].reshape(-1, key_bits)
            out[at : at + 256] = (own.astype(np.float64) @ values).astype(np.int64).reshape(-1, tables) | above
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))

    of.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "array<long>")(bits)


def near_links(nodes: DataFrame, n: int, least: float = LEAST) -> DataFrame:
    """Links ``(u, v)`` among the ``n`` rows of ``nodes(fp, bits)`` that connect those whose fingerprints say a likeness of ``least`` or so."""
    key_bits, tables = key_plan(n, least)
    differ = COMPARED * bit_chance(least)
    radius = math.ceil(differ + 3 * math.sqrt(differ * (1 - bit_chance(least))))
    parts = [F.conv(F.hex(F.substring("bits", 1 + 8 * k, 8)), 16, -10).cast("long").alias(f"part{k}") for k in range(COMPARED // 64)]
    # The bits are spread over the cluster again before each row becomes ``tables`` rows.
    dealt = nodes.select(F.explode(_keys_column(F.col("bits"), key_bits, tables)).alias("key"), F.col("fp").alias("node"), *parts)
    return bucket_links(dealt, radius, n * tables)


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Positions of links that connect every two sets of a likeness of ``least`` or more, directly or by others."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    names, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(names), np.int64)
    comp = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        # A larger set that is alike has at most 1 / least times as many shingles.
        top = int(np.searchsorted(sizes, sizes[i] / least + 1e-6, "right"))
        if top <= i + 1 or (comp[i + 1 : top] == comp[i]).all():
            continue
        own = dense[starts[i] : ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[dense[ends[i] : ends[top - 1]]], starts[i + 1 : top] - ends[i])
        mark[own] = 0
        alike = both >= least * (sizes[i] + sizes[i + 1 : top] - both) - 1e-9
        for j in (np.flatnonzero(alike) + i + 1).tolist():
            if comp[j] != comp[i]:
                out.append((order[i], order[j]))
                comp[comp == comp[j]] = comp[i]
    return out


def _verifier(least: float):
    def verify(pool: pa.Table) -> pa.Table:
        fps = pool.column("fp").to_numpy()
        sets = [np.frombuffer(d.as_py(), np.uint64) for d in pool.column("digests")]
        found = np.array(forest(sets, least) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        return pa.table({"u": fps[found[:, 0]], "v": fps[found[:, 1]]})

    return verify


def alike_links(sketches: DataFrame, nodes: DataFrame, n: int, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` of a likeness of ``least`` or more between ``sketches(fp, size, digests)``, found among ``nodes(fp, bits)``."""
    pools = materialise(connected_components(near_links(nodes, n, least)), "alike-pools")
    members = pools.select(F.col("u").alias("fp"), "root").unionByName(pools.select(F.col("root").alias("fp"), "root").distinct())
    members = materialise(members, "alike-members")
    sets = sketches.select("fp", "size", "digests").join(broadcast_if_small(members), "fp").dropDuplicates(["fp"])
    sets = materialise(sets, "alike-sets")
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int")
    hot = materialise(sets.groupBy("root").agg(parts.alias("parts")).where("parts > 1"), "alike-hot")
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    # Each member of a hot pool goes to every pair of chunks that its own chunk is in.
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("root", F.least(o, "part"), F.greatest(o, "part")))
    spread = sets.join(broadcast_if_small(hot), "root", "left").withColumn("part", part)
    tasks = F.explode(F.when(F.col("parts").isNull(), F.array(F.xxhash64("root"))).otherwise(pairs))
    return spread.select("fp", "digests", tasks.alias("task")).groupBy("task").applyInArrow(_verifier(least), "u long, v long")


def keep_one_of_alike(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, least: float = LEAST
) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a likeness of ``least``: the one with the least id (then text digest).

    Null texts count as empty; texts without words are all alike. Rows that repeat id and text are one; a null
    id is kept only where its group has no other. Texts are taken whole however long. All columns are kept,
    whatever they are called; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    sketch = _sketch_column(F.col(text_col), shingle_words).alias("s")
    seen = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("row_key"), sketch).select("id", "row_key", "s.*")
    seen = materialise(seen, "alike-seen")
    nodes = materialise(seen.groupBy("fp").agg(F.min("id").alias("least")), "alike-nodes")
    distinct = materialise(seen.select("fp", "bits").distinct(), "alike-bits")
    found = grouped(nodes, alike_links(seen, distinct, distinct.count(), least))
    return keep_least(docs, seen.select("id", "row_key", "fp"), found, id_col, text_col)
