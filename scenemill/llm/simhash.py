"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Links are found among distinct fingerprints. Two that differ in at most r bits agree on at least
``blocks - r`` of ``blocks`` bit blocks, so each fingerprint is dealt to one bucket for every choice of
that many blocks, and only members of a bucket are compared, in bit planes (bitslice.py). There are as
many blocks as make a key as long as the number of fingerprints, so that buckets do not grow with it. A bucket
hands on a spanning forest of its links, never all pairs. Buckets above ``chunk`` members are cut into
chunks, and every two chunks meet in a task of their own, so no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenemill.llm.bitslice import forest, pairs_within
from scenemill.llm.common import bounded_batches, materialise, one_of_repeated, row_key, without
from scenemill.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
CHUNK = 4096

#: Runs up to this length are compared pair by pair in shared planes, longer ones block by block.
_SHORT_RUN = 16

#: Rows of (key, node, parts) compared at a time.
_HELD = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def shingle_digests(text: bytes, shingle_words: int) -> bytes:
    """The 8-byte digests of a text's word shingles in text order, repeats included; empty for a text without words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one shingle.
    """
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return b""
    joined = b" ".join(words)
    if n <= shingle_words:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle_words] + 1)).tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist())])


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    digests = shingle_digests(text, shingle_words)
    if not digests:
        return 0
    by_byte = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((by_byte + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(by_byte)).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long; null texts count as empty."""

    def of(texts: pa.Array) -> pa.Array:
        cast = texts.cast(pa.large_binary())
        found = (fingerprint(t.as_buffer().to_pybytes(), shingle_words) if t.is_valid else 0 for t in cast)
        return pa.array(np.fromiter(found, np.uint64, len(cast)).view(np.int64))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "long")(text)


def _block_masks(blocks: int) -> list[int]:
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def blocks_for(n: int, radius: int) -> int:
    """How many blocks keep the buckets of ``n`` fingerprints small: keys of log2(n) bits or more, found links being the same for any number."""
    blocks = radius + 2
    while blocks < 4 * radius and (blocks - radius) * 64 // blocks < max(1, n).bit_length():
        blocks += 1
    return max(blocks, radius + 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _run_edges(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal keys (sorted); values as uint64, (n,) or (n, parts)."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    short = (lengths > 1) & (lengths <= _SHORT_RUN)
    if short.any():
        at = np.repeat(starts[short], lengths[short])
        inside = np.arange(len(at)) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short])
        left = np.repeat(lengths[short], lengths[short]) - inside
        pos = at + inside
        for d in range(1, int(lengths[short].max())):
            i = pos[left > d]
            hit = pairs_within(values[i], values[i + d], radius)
            yield nodes[i[hit]], nodes[i[hit] + d]
    for run in np.flatnonzero(lengths > _SHORT_RUN):
        own = slice(starts[run], starts[run] + lengths[run])
        found = np.array(forest(values[own], radius), dtype=np.int64).reshape(-1, 2)
        yield nodes[own][found[:, 0]], nodes[own][found[:, 1]]


def _linker(radius: int):
    """Arrow batches of (key, node, parts of the fingerprint) sorted by key, one run after another, to batches of links.

    Without parts the node is the fingerprint. Rows of a key come by node, so that the least node asks first and the same links
    are found in every bucket that a group shares. Batches are gathered to ``_HELD`` rows, since they are narrow.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            values = rows[:, 2:] if rows.shape[1] > 2 else rows[:, 1]
            for a, b in _run_edges(rows[:, 0], rows[:, 1], values.view(np.uint64), radius):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        def gathered() -> Iterator[np.ndarray]:
            some, n = [], 0
            for batch in batches:
                some.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
                n += len(some[-1])
                if n >= _HELD:
                    yield np.concatenate(some)
                    some, n = [], 0
            if n:
                yield np.concatenate(some)

        for rows in gathered():
            rows = rows if held is None else np.concatenate((held, rows))
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last run may go on in the next batch
            if last:
                yield from out(rows[:last])
            held = rows[last:]
        if held is not None and len(held):
            yield from out(held)

    return link


def bucket_links(dealt: DataFrame, radius: int, rows: int, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` that connect, within each bucket of ``dealt(key, node, *parts)``, every two nodes at most ``radius`` bits apart.

    ``rows``: about how many rows there are. Hot buckets are cut into chunks, and every two chunks meet in a task of their own.
    """
    spark = dealt.sparkSession
    hot = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = materialise(hot.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "simhash-hot")
    names = dealt.columns[1:]
    if not hot.isEmpty():
        # Each member of a hot bucket goes to every pair of chunks that its own chunk is in.
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.xxhash64("key", F.least(o, "part"), F.greatest(o, "part")),
        )
        dealt = dealt.join(hot, "key", "left").withColumn("part", part)
        dealt = dealt.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("key"), *names)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2_000_000)
    sorted_ = dealt.select("key", *names).repartition(n, "key").sortWithinPartitions("key", "node")
    return sorted_.mapInArrow(_linker(radius), "u long, v long")


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links ``(u, v)`` that connect every two of the distinct ``fp`` at most ``radius`` bits apart, directly or by others."""
    n = fingerprints.count()
    blocks = blocks or blocks_for(n, radius)
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed the radius")
    masks = _block_masks(blocks)
    choices = [sum(masks[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(choices)])
    return bucket_links(fingerprints.select(F.explode(keys).alias("key"), F.col("fp").alias("node")), radius, n * len(choices), chunk)


def simhash_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``; the fingerprint is 16 hex digits.

    The component is the least id reachable over fingerprints that differ in at most ``radius`` bits.
    Null texts count as empty; texts without words have fingerprint zero and are linked like any other.
    Repeated rows give repeated results. A null id never becomes a component unless the component has no other.
    Texts are read whole however long; extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    seen = materialise(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")), "simhash-fp"
    )
    found = _components(seen, radius)
    return seen.join(found, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(seen: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint of ``seen(id, fp)``."""
    nodes = materialise(seen.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    return grouped(nodes, links(nodes.select("fp"), radius))


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for each row of ``nodes(fp, least)``: the least ``least`` of those that ``edges(u, v)`` connect."""
    stars = connected_components(edges)
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return materialise(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least id (then text digest).

    All columns are kept, whatever they are called; an empty table stays empty; the rest is as in ``simhash_near_duplicates``.
    """
    bounded_batches(docs.sparkSession)
    shingle_words, radius = how.get("shingle_words", SHINGLE_WORDS), how.get("radius", RADIUS)
    seen = docs.select(
        F.col(id_col).alias("id"), row_key(text_col).alias("row_key"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")
    )
    seen = materialise(seen, "simhash-fp")
    return keep_least(docs, seen, _components(seen.select("id", "fp"), radius), id_col, text_col)


def keep_least(docs: DataFrame, seen: DataFrame, components: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the least row of each component, by ``seen(id, row_key, fp)`` and ``components(fp, component_id)``."""
    groups = materialise(seen.join(components, "fp"), "simhash-groups")
    # The least row of each component; sizes first, so that rows without a near-duplicate need no join.
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("best"), F.count("*").alias("n"))
    best = materialise(best.where("n > 1").drop("n"), "simhash-best")
    marked = groups.join(best, groups.component_id.eqNullSafe(best.component_id), "inner")
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row_key") == F.col("best.row_key"))
    marked = materialise(marked.select("id", "row_key", same.alias("keep")), "simhash-marked")
    left = without(docs, marked.where("not keep"), id_col, text_col)
    again = marked.where("keep").groupBy("id", "row_key").agg(F.count("*").alias("n")).where("n > 1")
    return one_of_repeated(left, again, id_col, text_col)
