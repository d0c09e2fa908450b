"""Checked joins, look-ups and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, out: str = "c", buckets: int = 64) -> DataFrame:
    """Dense numbers from 0 for distinct keys, without gathering them: by bucket (MD5 of the key), then key.

    Rows are numbered within their bucket; the buckets' starts come from one row per bucket.
    """
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 4), 16, 10).cast("long") % buckets
    rows = rows.withColumn("__b", place)
    nth = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("n"))
    held = sizes.agg(F.collect_list(F.struct("__b", "n")).alias("__held"))  # one row of at most ``buckets`` pairs
    found = rows.withColumn("__nth", nth).withColumn("__held", held.scalar())
    start = F.aggregate("__held", F.lit(0).cast("long"), lambda acc, h: acc + F.when(h["__b"] < F.col("__b"), h.n).otherwise(0))
    return found.withColumn(out, start + F.col("__nth") - 1).drop("__b", "__nth", "__held")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that rounds built on it do not repeat it; as it is where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def cardinality(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row that tells whether a join on ``on`` is one to one and misses nothing on either side."""
    side = lambda df, s: df.groupBy(*on).agg(F.count("*").alias("n")).agg(F.sum("n").alias(f"{s}_rows"), F.count("*").alias(f"{s}_keys"))
    both = left.select(*on).distinct().join(right.select(*on).distinct(), on, "inner").agg(F.count("*").alias("shared_keys"))
    rows = side(left, "left").crossJoin(side(right, "right")).crossJoin(both)  # one row each
    single = (F.col("left_rows") == F.col("left_keys")) & (F.col("right_rows") == F.col("right_keys"))
    whole = (F.col("shared_keys") == F.col("left_keys")) & (F.col("shared_keys") == F.col("right_keys"))
    return rows.withColumn("one_to_one", single & whole)


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that fails on a repeated key of either side when it is run."""

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        return df.withColumn("__n", F.when(n > 1, F.raise_error(F.lit(f"{side}: repeated key in a one-to-one join"))).otherwise(n)).where("__n = 1").drop("__n")

    return checked(left, "left").join(checked(right, "right"), on)


def in_order_of(asked: DataFrame, rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows by a list of keys, in its order; a key without a row fails when it is run."""
    found = asked.join(rows.withColumn("__hit", F.lit(1)), key, "left")
    ok = F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string")))).otherwise(F.lit(1))
    return found.withColumn("__hit", ok).where("__hit = 1").drop("__hit").orderBy(pos)


def last_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, columns: list[str], within: float | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before it, by one sort of both sides together."""
    value = F.struct(F.col(t).alias("__at"), *columns)
    both = left.withColumns({"__right": F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType), "__side": F.lit(1)}).unionByName(
        right.select(key, t, value.alias("__right"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(t, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    ok = F.lit(True) if within is None else F.col(t) - F.col("__last.__at") <= within
    return found.select(*left.columns, *[F.when(ok, F.col(f"__last.{c}")).alias(f"{c}_before") for c in columns])


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_match(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The style of the first prefix that fits, in order."""
    out = F.lit(default)
    for prefix, style in reversed(rules):
        out = F.when(value.startswith(prefix), style).otherwise(out)
    return out
