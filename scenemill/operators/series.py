"""Time series per key: rebase, unwrap, resample, smooth, differentiate, sliding windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.operators.intervals import points_in_intervals


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rebase(df: DataFrame, key: str, ts: str, tie: str, unit_s: float = 1.0) -> DataFrame:
    """One row per (key, timestamp), the first by ``tie``; adds ``k`` from 0 and ``t``, time since the key's first row."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    new = (F.row_number().over(order) == 1) | ~F.col(ts).eqNullSafe(F.lag(ts).over(order))
    rows = df.withColumn("__new", new).where("__new").drop("__new")
    us = micros(F.col(ts))
    start = F.min(us).over(Window.partitionBy(key))
    return rows.withColumns({"k": (F.row_number().over(order) - 1).cast("int"), "t": (us - start) / F.lit(1e6 * unit_s)})


def unwrap(df: DataFrame, key: str, order: str, angle: str, out: str) -> DataFrame:
    """Multiples of 2 pi added so that no step exceeds pi: a running sum of the corrections."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.col(angle) - F.lag(angle).over(w)
    turns = F.floor((step + F.pi()) / (2 * F.pi()))
    # A step of exactly +pi stays, as it is within bounds.
    turns = F.when(F.abs(step) <= F.pi(), 0).otherwise(turns)
    rows = df.withColumn("__turns", F.coalesce(turns, F.lit(0)))
    return rows.withColumn(out, F.col(angle) - 2 * F.pi() * F.sum("__turns").over(w)).drop("__turns")


def resample(df: DataFrame, key: str, t: str, columns: list[str], dt: float) -> DataFrame:
    """Linear interpolation on the grid 0, dt, 2 dt, ... up to the key's last time.

    Each row makes the grid points from its own time up to, not including, the next row's; the last row
    makes its own if it is one. No join is needed.
    """
    w = Window.partitionBy(key).orderBy(t)
    rows = df.select(key, t, *columns, F.lead(t).over(w).alias("__t1"), *[F.lead(c).over(w).alias(f"__{c}1") for c in columns])
    first = F.ceil(F.col(t) / dt)
    last = F.when(F.col("__t1").isNull(), F.floor(F.col(t) / dt)).otherwise(F.ceil(F.col("__t1") / dt) - 1)
    grid = rows.withColumn("grid_i", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    share = F.coalesce(F.try_divide(F.col("grid_i") * dt - F.col(t), F.col("__t1") - F.col(t)), F.lit(0.0))
    values = [(F.col(c) + F.coalesce(share * (F.col(f"__{c}1") - F.col(c)), F.lit(0.0))).alias(c) for c in columns]
    return grid.select(key, "grid_i", (F.col("grid_i") * dt).alias("grid_t"), *values)


def smoothing_matrix(window: int, order: int = 2) -> list[list[float]]:
    """Row p: the weights that evaluate, at place p of a window, the polynomial fitted to its samples."""
    a = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def smooth(df: DataFrame, key: str, order: str, column: str, out: str, window: int, degree: int = 2) -> DataFrame:
    """Savitzky-Golay: a polynomial over each window of rows, the first and last windows serving the edges too.

    Keys with fewer rows than the window are left as they are. A row reads at most 2 * window - 1 neighbours.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    w, half = Window.partitionBy(key).orderBy(order), window // 2
    whole = Window.partitionBy(key)
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("__s", F.greatest(F.lit(0), F.least(F.col("__i") - half, F.col("__n") - window)))
    near = F.collect_list(column).over(w.rowsBetween(-(window - 1), window - 1))
    before = F.least(F.col("__i"), F.lit(window - 1))  # rows of the frame before this one
    samples = F.slice(near, (F.col("__s") - F.col("__i") + before + 1).cast("int"), window)
    matrix = F.array(*[F.array(*[F.lit(v) for v in r]) for r in smoothing_matrix(window, degree)])
    weights = F.get(matrix, (F.col("__i") - F.col("__s")).cast("int"))
    dot = F.aggregate(F.zip_with(samples, weights, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn(out, F.when(F.col("__n") < window, F.col(column)).otherwise(dot)).drop("__i", "__n", "__s")


def gradient(df: DataFrame, key: str, order: str, column: str, out: str, dt: float) -> DataFrame:
    """Central differences of an evenly spaced column, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    slope = (
        F.when(before.isNull(), (after - F.col(column)) / dt).when(after.isNull(), (F.col(column) - before) / dt).otherwise((after - before) / (2 * dt))
    )
    return df.withColumn(out, slope)


def trend(df: DataFrame, key: str, order: str, column: str, out: str, window: int, dt: float) -> DataFrame:
    """The gradient of the smoothed column."""
    return gradient(smooth(df, key, order, column, "__smooth", window), key, order, "__smooth", out, dt).drop("__smooth")


def window_bounds(df: DataFrame, key: str, t: str, width: float) -> DataFrame:
    """A window of constant length around each row: centred, slid inwards at the ends, or the whole series if that is shorter."""
    w = Window.partitionBy(key)
    first, last = F.min(t).over(w), F.max(t).over(w)
    full = last - first >= width
    start = F.when(~full, first).otherwise(F.greatest(first, F.least(F.col(t) - width / 2, last - width)))
    end = F.when(~full, last).otherwise(start + width)
    rows = df.withColumns({"window_start": start, "window_end": end, "window_full": full})
    return rows.withColumn("window_offset", (F.col("window_start") + F.col("window_end")) / 2 - F.col(t))


def edge_guard(df: DataFrame, key: str, t: str, margin: float = 0.30, out: str = "edge_guard") -> DataFrame:
    """Flags rows within ``margin`` of their key's start (0) or last time: differences there are one-sided."""
    last = F.max(t).over(Window.partitionBy(key))
    return df.withColumn(out, (F.col(t) < margin) | (F.col(t) > last - margin))


def interpolate_at(times: DataFrame, samples: DataFrame, key: str, at: str, t: str, columns: dict[str, str]) -> DataFrame:
    """``times`` with each sample column interpolated at ``at``, under its new name; before the first and after the last sample, theirs.

    Times and samples are put in order together, so each time reads the segment that holds it and nothing is joined.
    """
    w = Window.partitionBy(key).orderBy(t)
    after = [F.lead(c).over(w).alias(f"{c}1") for c in columns]
    segment = F.struct(F.col(t).alias("t0"), F.lead(t).over(w).alias("t1"), *[F.col(c).alias(f"{c}0") for c in columns], *after)
    own = samples.select(F.col(key).alias("__key"), F.col(t).alias("__t"), segment.alias("__seg"), F.lit(0).alias("__ask"))
    asks = times.withColumns({"__key": F.col(key), "__t": F.col(at), "__ask": F.lit(1), "__seg": F.lit(None).cast(own.schema["__seg"].dataType)})
    both = asks.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("__key").orderBy("__t", "__ask")
    back = F.last("__seg", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min_by("__seg", F.when(F.col("__ask") == 0, F.col("__t"))).over(Window.partitionBy("__key"))
    rows = both.withColumns({"__back": back, "__ahead": ahead}).where("__ask = 1")
    share = F.coalesce(F.try_divide(F.col("__t") - F.col("__back.t0"), F.col("__back.t1") - F.col("__back.t0")), F.lit(0.0))
    value = lambda c: F.when(F.col("__back").isNull(), F.col(f"__ahead.{c}0")).otherwise(
        F.col(f"__back.{c}0") + F.coalesce(share * (F.col(f"__back.{c}1") - F.col(f"__back.{c}0")), F.lit(0.0))
    )
    return rows.select(*times.columns, *[value(c).alias(name) for c, name in columns.items()])


def window_features(rows: DataFrame, samples: DataFrame, key: str, row: str, t: str, column: str, width: float) -> DataFrame:
    """Per row with ``window_start`` and ``window_end``, at most ``width`` apart: features of the samples inside, ends included.

    ``rows`` and ``samples`` share the key; the samples are found by a bucketed join, and the path sums only
    steps between samples that are both inside.
    """
    own = rows.select(key, row, "window_start", "window_end")
    inside = points_in_intervals(samples.select(key, t, column), own, [key], t, "window_start", "window_end", float(width))
    steps = inside.withColumn("__step", F.abs(F.col(column) - F.lag(column).over(Window.partitionBy(key, row).orderBy(t))))
    return steps.groupBy(key, row).agg(
        F.count("*").alias("n_samples"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"),
        F.max(F.abs(column)).alias("abs_most"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path"), (F.max_by(column, t) - F.min_by(column, t)).alias("change"),
    )


def window_kinematics(rows: DataFrame, samples: DataFrame, key: str, row: str, t: str, width: float, margin: float = 0.30) -> DataFrame:
    """Motion over a window of ``width`` around each row (``key, row, t``), from ``samples(key, t, x, y, yaw, speed, yaw_rate)``.

    Values at the row and at the window's ends are interpolated, so that changes are measured over exactly the
    window; means, extremes, path and net displacement are those of the samples inside, ends included.
    """
    bounds = edge_guard(window_bounds(rows.select(key, row, t), key, t, width), key, t, margin)
    inside = points_in_intervals(samples.select(key, F.col(t).alias("__t"), "x", "y", "speed", "yaw_rate"), bounds.select(key, row, "window_start", "window_end"), [key], "__t", "window_start", "window_end", float(width))
    w = Window.partitionBy(key, row).orderBy("__t")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    ends = lambda c: F.max_by(c, "__t") - F.min_by(c, "__t")
    found = inside.withColumn("__step", step).groupBy(key, row).agg(
        F.count("*").alias("n_samples"), F.avg("speed").alias("speed_mean"), F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"),
        F.avg("yaw_rate").alias("yaw_rate_mean"), F.max(F.abs("yaw_rate")).alias("yaw_rate_absmax"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_length"),
        F.hypot(ends("x"), ends("y")).alias("net_displacement"),
    )
    at = interpolate_at(bounds, samples, key, t, t, {"x": "ego_x", "y": "ego_y", "speed": "speed", "yaw": "yaw"})
    for end in ("window_start", "window_end"):
        at = interpolate_at(at, samples, key, end, t, {"yaw": f"__yaw_{end}", "speed": f"__speed_{end}"})
    duration = F.col("window_end") - F.col("window_start")
    at = at.withColumns(
        {
            "heading_change": F.col("__yaw_window_end") - F.col("__yaw_window_start"),
            "accel_window": F.when(duration > 0, (F.col("__speed_window_end") - F.col("__speed_window_start")) / duration).otherwise(0.0),
        }
    )
    return at.drop(*[c for c in at.columns if c.startswith("__")]).join(found, [key, row], "left")


def signed_steps(df: DataFrame, key: str, order: str, x: str, y: str, heading: str, out: str) -> DataFrame:
    """The step from the row before, projected on the heading of the row it arrives in; null for the first row."""
    w = Window.partitionBy(key).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn(out, dx * F.cos(heading) + dy * F.sin(heading))


def history(df: DataFrame, key: str, order: str, column: str, out: str, back: int = 4) -> DataFrame:
    """Up to ``back`` earlier values and the row's own, oldest first, never padded."""
    return df.withColumn(out, F.collect_list(column).over(Window.partitionBy(key).orderBy(order).rowsBetween(-back, 0)))
