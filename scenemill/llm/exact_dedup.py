"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level only hands on the groups that still hold more than one row, and only rows of such groups
have their whole text hashed. The text itself is never shuffled: levels one and two work on
(length, prefix hash) pairs, and which rows survive them is told to the second scan by a bitmap of
fixed size, so that a false positive costs one more hash and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenemill.llm.common import materialise, one_of_repeated, text_of, without

PREFIX_CHARS = 64

#: The bitmap of surviving groups has 8 buckets a group, but no fewer and no more than 2 to these: 128 KB to 16 MB of bits.
LEAST_BITS, MOST_BITS = 20, 27


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    report_digest: bool = True,
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the largest
    id stays; of rows that repeat both id and text, one. A null id sorts below all others. Extra
    columns are ignored; an empty table gives an empty result. Without ``report_digest``,
    ``text_sha256`` is null for rows that no other row resembles, whose text is then never hashed.
    """
    text = text_of(text_col)
    levels = materialise(
        docs.select(F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash")),
        "dedup-levels",
    )
    lengths = levels.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    lengths = materialise(lengths, "dedup-lengths")
    prefixes = (
        levels.join(lengths, "n_bytes", "left_semi")
        .groupBy("n_bytes", "prefix_hash")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    prefixes = materialise(prefixes, "dedup-prefixes")
    bits = min(MOST_BITS, max(LEAST_BITS, prefixes.count().bit_length() + 3))
    bucket = F.pmod(F.xxhash64("n_bytes", "prefix_hash"), F.lit(1 << bits))
    bitmap = (
        prefixes.select(bucket.alias("bucket"))
        .select(F.shiftright("bucket", 6).alias("word"), F.expr("shiftleft(1L, cast(bucket & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    bitmap = materialise(bitmap, "dedup-bitmap")  # at most 2^(MOST_BITS - 6) rows of 16 bytes
    seen = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
    ).withColumn("bucket", bucket)
    seen = seen.join(F.broadcast(bitmap), F.shiftright("bucket", 6) == F.col("word"), "left")
    survives = F.coalesce(F.expr("getbit(bits, cast(bucket & 63 as int)) = 1"), F.lit(False))
    digest = F.sha2("text", 256)
    rows = seen.select(
        "id",
        survives.alias("survives"),
        "n_bytes",
        (digest if report_digest else F.when(survives, digest)).alias("text_sha256"),
    )
    rows = materialise(rows, "dedup-rows")
    members = rows.where("survives").groupBy("n_bytes", "text_sha256", "id").agg(F.count("*").alias("copies"))
    members = materialise(members, "dedup-members")
    groups = (
        members.groupBy("n_bytes", "text_sha256")
        .agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    )
    # Written, so that both sides of the join below are plain shuffles and a hot group can be split.
    groups = materialise(groups.where("group_size > 1"), "dedup-groups")
    refined = members.join(groups, ["n_bytes", "text_sha256"], "left").select(
        "id",
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"),
        "text_sha256",
    )
    alone = rows.where("not survives").select(
        F.col("id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("nth"), "text_sha256"
    )
    both = refined.unionByName(alone)
    return both.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever they are called.

    Rows that no other resembles in length and prefix are never hashed whole. Nulls, ties and repeated rows
    are as in ``exact_dedup``; an empty table stays empty.
    """
    found = exact_dedup(docs.select(id_col, text_col), id_col, text_col, report_digest=False).where("group_size > 1")
    found = materialise(found.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("row_key"), "kept"), "dedup-found")
    per_key = materialise(
        found.groupBy("id", "row_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "dedup-keys"
    )
    left = without(docs, per_key.where("not kept"), id_col, text_col)
    return one_of_repeated(left, per_key.where("kept and n > 1"), id_col, text_col)
