"""Sustained events, runs and boundaries of per-key series, by gaps and islands."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.operators.intervals import points_in_intervals


def islands(df: DataFrame, key: str, order: str, inside: Column, out: str = "island") -> DataFrame:
    """The rows where ``inside`` holds, numbered by the stretch they are in."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    changed = (F.col("__in") != F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("int")
    return rows.withColumn("__change", changed).withColumn(out, F.sum("__change").over(w)).where("__in").drop("__in", "__change")


def hysteresis(
    df: DataFrame, key: str, t: str, column: str, enter: float, leave: float, least_s: float = 0.0, valid: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Stretches of abs(column) > leave that hold a valid row with abs(column) > enter and last ``least_s``.

    ``key, island, start, end, n, peak`` (the column where it is largest in size, the first on ties), ``mean``; the
    column's running sum before the first and up to the last row, and each ``carry`` column at both.
    """
    if not leave < enter:
        raise ValueError("the signal must enter above where it leaves")
    hit = F.abs(column) > enter
    hit = hit if valid is None else hit & F.coalesce(valid, F.lit(False))
    w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(column).over(w)
    rows = islands(df.withColumns({"__hit": hit, "__upto": upto, "__before": F.coalesce(upto - F.col(column), upto)}), key, t, F.abs(column) > leave)
    ends = [f(c, t).alias(f"{c}_{name}") for c in carry for name, f in (("start", F.min_by), ("end", F.max_by))]
    found = rows.groupBy(key, "island").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"), F.bool_or("__hit").alias("__hit"),
        F.max_by(column, F.struct(F.abs(column), -F.col(t))).alias("peak"), F.avg(column).alias("mean"),
        F.min_by("__before", t).alias("sum_before"), F.max_by("__upto", t).alias("sum_upto"), *ends,
    )
    return found.where(F.col("__hit") & (F.col("end") - F.col("start") >= least_s)).drop("__hit")


def merge_same_sign(events: DataFrame, key: str, gap_s: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring events of one sign at most ``gap_s`` apart made one (events as ``hysteresis`` gives them).

    A fold: the sign of what has been merged is that of its mean over the whole span, the gaps' rows included,
    which the running sums at both ends tell. The events of one key are one array; rows never are.
    """
    names = ["start", "end", "peak", "sum_before", "sum_upto", *[f"{c}_{e}" for c in carry for e in ("start", "end")]]
    ordered = F.array_sort(F.collect_list(F.struct(*names, F.lit(1).alias("n_merged"))))
    sign = lambda e: F.signum(e.sum_upto - e.sum_before)

    def merged(a: Column, b: Column) -> Column:
        peak = F.when(F.abs(b.peak) > F.abs(a.peak), b.peak).otherwise(a.peak)
        own = {"start": a.start, "end": b.end, "peak": peak, "sum_before": a.sum_before, "sum_upto": b.sum_upto}
        own |= {f"{c}_start": a[f"{c}_start"] for c in carry} | {f"{c}_end": b[f"{c}_end"] for c in carry}
        return F.struct(*[own[n].alias(n) for n in names], (a.n_merged + b.n_merged).alias("n_merged"))

    def step(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (sign(last) == sign(e)) & (e.start - last.end <= gap_s)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged(last, e)))).otherwise(F.concat(acc, F.array(e)))

    folded = events.groupBy(key).agg(ordered.alias("__e")).select(key, F.explode(F.aggregate("__e", F.slice("__e", 1, 0), step)).alias("__m"))
    return folded.select(key, "__m.*").withColumn("sign", sign(F.struct("sum_upto", "sum_before")))


def lateral_events(
    samples: DataFrame, key: str, t: str, rate: str, heading: str, enter: float = 4.0, leave: float = 1.5, least_s: float = 0.5, gap_s: float = 0.5,
    turn: float = 15.0, u_turn: float = 150.0, valid: Column | None = None,
) -> DataFrame:
    """Turns: hysteresis on the turn rate, merged by sign, kept if the heading changes by ``turn`` degrees. ``peak`` is the largest rate."""
    found = merge_same_sign(hysteresis(samples, key, t, rate, enter, leave, least_s, valid, (heading,)), key, gap_s, (heading,))
    found = found.withColumn("total", F.col(f"{heading}_end") - F.col(f"{heading}_start")).where(F.abs("total") >= turn)
    kind = F.when(F.abs("total") >= u_turn, "u_turn").when(F.col("total") > 0, "turn_left").otherwise("turn_right")
    return found.select(key, kind.alias("kind"), "start", "end", (F.col("end") - F.col("start")).alias("duration"), "total", "peak")


def stationary_runs(samples: DataFrame, key: str, t: str, speed: str, below: float = 0.5, least_s: float = 1.0) -> DataFrame:
    """Stretches of speed under ``below`` that last ``least_s``."""
    rows = islands(samples, key, t, F.col(speed) < below).groupBy(key, "island").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return rows.where(F.col("end") - F.col("start") >= least_s).select(key, F.lit("stationary").alias("kind"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def longitudinal_events(
    samples: DataFrame, key: str, t: str, acceleration: str, speed: str, enter: float = 0.6, leave: float = 0.25, least_s: float = 0.5, gap_s: float = 0.5,
    least_change: float = 1.5, still: float = 0.5, still_s: float = 1.0, valid: Column | None = None,
) -> DataFrame:
    """Stationary runs, and speeding up or slowing down by ``least_change``, which only triggers while moving."""
    moving = F.col(speed) >= still
    trigger = moving if valid is None else moving & valid
    found = merge_same_sign(hysteresis(samples, key, t, acceleration, enter, leave, least_s, trigger, (speed,)), key, gap_s, (speed,))
    found = found.withColumn("change", F.col(f"{speed}_end") - F.col(f"{speed}_start")).where(F.abs("change") >= least_change)
    kind = F.when(F.col("change") > 0, "accelerating").otherwise("decelerating")
    found = found.select(key, kind.alias("kind"), "start", "end", (F.col("end") - F.col("start")).alias("duration"), "change")
    return stationary_runs(samples, key, t, speed, still, still_s).unionByName(found, allowMissingColumns=True)


def event_membership(
    rows: DataFrame, events: DataFrame, key: str, row: str, t: str, ranks: dict[str, int], default: str, width: float
) -> DataFrame:
    """Each row with the event whose closed interval holds it: by rank of its kind, then start; ``default`` without one."""
    rank = F.lit(len(ranks))
    for kind, r in ranks.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    hits = points_in_intervals(rows.select(key, row, t), events.select(key, "kind", "start", "end"), [key], t, "start", "end", width)
    first = hits.groupBy(key, row).agg(F.min(F.struct(rank.alias("rank"), "start", "end", "kind")).alias("e"))
    joined = rows.join(first, [key, row], "left")
    progress = F.try_divide(F.col(t) - F.col("e.start"), F.col("e.end") - F.col("e.start"))
    return joined.withColumns({"label": F.coalesce("e.kind", F.lit(default)), "progress": progress}).drop("e")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"is_{v}": F.col(column) == v for v in values})


def runs_below(df: DataFrame, key: str, order: str, column: str, below: float, least_rows: int) -> DataFrame:
    """Stretches of at least ``least_rows`` rows under a threshold: first, last, sum."""
    rows = islands(df, key, order, F.col(column) < below).groupBy(key, "island")
    found = rows.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sum(column).alias("net"))
    return found.where(F.col("n") >= least_rows).drop("island")


def label_runs(df: DataFrame, key: str, order: str, labels: list[str]) -> DataFrame:
    """Maximal runs of rows that agree in all labels: ``run, first, last, n`` and the labels."""
    w = Window.partitionBy(key).orderBy(order)
    now = F.struct(*labels)
    new = F.when(now.eqNullSafe(F.lag(now).over(w)), 0).otherwise(1)
    rows = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    return rows.groupBy(key, "run", *labels).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def merge_short(runs: DataFrame, keys: list[str], start: str, end: str, least: float | str, labels: list[str]) -> DataFrame:
    """Runs of each key until none is shorter than ``least`` (a number or a column): the shortest (earliest on ties) joins its
    longer neighbour (the earlier on ties). What has been merged is labelled by its first row, so by its first run.

    ``keys, start, end, labels, n_runs``. Each step depends on the one before, so one key's runs are folded in one
    task, by a heap of lengths over a linked list: n log n, and only runs, not rows, are gathered.
    """
    floor = least if isinstance(least, str) else None
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(start).reset_index(drop=True)
        a, b = rows[start].tolist(), rows[end].tolist()
        limit = rows[floor].iloc[0] if floor else least
        n, alive, absorbed = len(rows), [True] * len(rows), [1] * len(rows)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(b[i] - a[i], i) for i in range(n)]
        heapq.heapify(heap)
        left = n
        while left > 1:
            length, i = heap[0]
            if not alive[i] or length != b[i] - a[i]:
                heapq.heappop(heap)
                continue
            if length >= limit:
                break
            sides = [j for j in (before[i], after[i]) if j >= 0]
            j = max(sides, key=lambda s: (b[s] - a[s], -s))
            lo, hi = min(i, j), max(i, j)
            b[lo], alive[hi], after[lo] = b[hi], False, after[hi]
            absorbed[lo] += absorbed[hi]
            if after[hi] >= 0:
                before[after[hi]] = lo
            heapq.heappush(heap, (b[lo] - a[lo], lo))
            left -= 1
        out = rows.loc[alive, [*keys, start, *labels]].copy()
        out[end] = [v for v, ok in zip(b, alive) if ok]
        out["n_runs"] = [v for v, ok in zip(absorbed, alive) if ok]
        return out[[*keys, start, end, *labels, "n_runs"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, start, end, *labels)) + ", n_runs long"
    return runs.select(*dict.fromkeys([*keys, start, end, *labels, *([floor] if floor else [])])).groupBy(*keys).applyInPandas(fold, schema)


def collapse(runs: DataFrame, keys: str | list[str], start: str, end: str, labels: str | list[str]) -> DataFrame:
    """Neighbouring runs of the same labels made one."""
    keys, labels = [keys] if isinstance(keys, str) else keys, [labels] if isinstance(labels, str) else labels
    w = Window.partitionBy(*keys).orderBy(start)
    same = F.struct(*labels).eqNullSafe(F.lag(F.struct(*labels)).over(w)) & F.lag(start).over(w).isNotNull()
    rows = runs.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("panel", F.sum("__new").over(w))
    return rows.groupBy(*keys, "panel", *labels).agg(F.min(start).alias(start), F.max(end).alias(end))


def state_before(df: DataFrame, key: str, instance: str, frame: str, us: str, column: str, out: str, back_us: int) -> DataFrame:
    """The oldest state of the same instance within ``back_us``, over frames without a gap; null without an earlier one."""
    w = Window.partitionBy(key, instance).orderBy(frame)
    gap = F.when(F.col(frame) - F.lag(frame).over(w) == 1, 0).otherwise(1)
    rows = df.withColumn("__gap", gap).withColumn("__track", F.sum("__gap").over(w))
    near = Window.partitionBy(key, instance, "__track").orderBy(us).rangeBetween(-(back_us + 1), -1)
    return rows.withColumns({out: F.first(column).over(near), f"{out}_us": F.first(us).over(near)}).drop("__gap", "__track")


def snap(times: DataFrame, rows: DataFrame, key: str, at: str, t: str, k: str) -> DataFrame:
    """Distinct nearest rows of given times, the earlier on ties, first and last rows left out.

    Each time looks at the last row not after it and the first not before it: both come from one sort of
    rows and times together, without a join of all with all.
    """
    both = rows.select(key, F.col(t).alias("__t"), F.struct(F.col(t).alias("t"), F.col(k).alias("k")).alias("__row"), F.lit(0).alias("__ask"))
    asks = times.select(key, F.col(at).alias("__t"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.lit(1).alias("__ask"))
    w = Window.partitionBy(key).orderBy("__t", "__ask")
    back = F.last("__row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The same from the other end, so that both frames only grow.
    down = Window.partitionBy(key).orderBy(F.desc("__t"), F.asc("__ask"))
    ahead = F.last("__row", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    near = both.unionByName(asks).withColumns({"__back": back, "__ahead": ahead}).where("__ask = 1")
    nearer = F.when(F.col("__ahead").isNull() | (F.col("__t") - F.col("__back.t") <= F.col("__ahead.t") - F.col("__t")), F.col("__back.k")).otherwise(F.col("__ahead.k"))
    last = rows.groupBy(key).agg(F.max(k).alias("__last"))
    found = near.select(key, F.coalesce(nearer, "__ahead.k").alias(k)).distinct().join(last, key)
    return found.where((F.col(k) > 0) & (F.col(k) < F.col("__last"))).drop("__last")


def fixed_interval_boundaries(sizes: DataFrame, key: str, n: str, count: str) -> DataFrame:
    """``count`` evenly spaced boundaries of n rows, rounded half to even, kept inside 1 to n - 1."""
    asked = sizes.where(F.col(count) > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    at = F.bround(F.col("__i") * F.col(n) / (F.col(count) + 1)).cast("int")
    return asked.where(F.col(n) > 1).select(key, F.greatest(F.lit(1), F.least(F.col(n).cast("int") - 1, at)).alias("k")).distinct()


def period_boundaries(rows: DataFrame, key: str, t: str, k: str, period: float) -> DataFrame:
    """Nearest rows to every ``period`` after the start."""
    last = rows.groupBy(key).agg(F.max(t).alias("__last")).where(F.col("__last") >= period)
    times = last.select(key, F.explode(F.sequence(F.lit(1), F.floor(F.col("__last") / period).cast("int"))).alias("__i")).withColumn("at", F.col("__i") * float(period))
    return snap(times, rows, key, "at", t, k)


def random_boundaries(sizes: DataFrame, key: str, n: str, count: str, draws: int, seed: str) -> DataFrame:
    """``draws`` times ``count`` distinct interior boundaries, the same on every run.

    Floyd's sampling without replacement: step j takes a hashed place up to j, or j itself if that is taken. Nothing is
    sorted or shuffled, and a draw costs its count, not the number of places.
    """
    places = F.col(n).cast("long") - 1
    asked = F.least(F.col(count).cast("long"), places)
    rows = sizes.where(F.col(n) > 1).where(F.col(count) > 0).withColumns({"__first": places - asked, "__last": places - 1})
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def step(acc: Column, j: Column) -> Column:
        digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.col("draw"), j)), 1, 12), 16, 10).cast("long")
        place = digest % (j + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, place), j).otherwise(place)))

    picks = F.aggregate(F.sequence("__first", "__last"), F.array().cast("array<bigint>"), step)
    return rows.select(key, "draw", F.explode(picks).alias("k")).withColumn("k", (F.col("k") + 1).cast("int"))


def boundary_scores(pred: DataFrame, gold: DataFrame, key: str, tolerances: list[int], compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro precision, recall and F1 of boundaries, a match being any within the tolerance; ``by`` are columns of ``pred``.

    Both sides are put in order together, so that each boundary reads the nearest one of the other side before and
    after it: one sort serves all tolerances, and nothing is compared pair by pair. Recall counts gold boundaries;
    with ``compat`` it mixes matched predictions with missed gold ones, as published figures did.
    """
    own = gold.select(key, "k")
    own = own.join(pred.select(*by, key).distinct(), key) if by else own
    rows = pred.select(*by, key, "k", F.lit(False).alias("__gold")).unionByName(own.select(*by, key, "k", F.lit(True).alias("__gold")))
    up, down = (Window.partitionBy(*by, key).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("k"), F.desc("k")))
    near = lambda side, w: F.last(F.when(F.col("__gold") == F.lit(side), F.col("k")), ignorenulls=True).over(w)
    gap = {side: F.least(F.col("k") - near(side, up), near(side, down) - F.col("k")) for side in (True, False)}
    rows = rows.withColumn("__gap", F.when(F.col("__gold"), gap[False]).otherwise(gap[True]))
    rows = rows.withColumn("tolerance", F.explode(F.array(*[F.lit(x) for x in tolerances])))
    hit = F.coalesce(F.col("__gap") <= F.col("tolerance"), F.lit(False))
    summed = rows.groupBy(*by, "tolerance").agg(
        F.count_if(~F.col("__gold") & hit).alias("tp"), F.count_if(~F.col("__gold") & ~hit).alias("fp"), F.count_if(F.col("__gold") & hit).alias("gold_hits")
    )
    both = summed.crossJoin(F.broadcast(gold.agg(F.count("*").alias("__all"))))  # one row
    both = both.withColumn("fn", F.col("__all") - F.col("gold_hits")).drop("__all")
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    top = F.col("tp") if compat else F.col("gold_hits")
    recall = F.coalesce(F.try_divide(top, top + F.col("fn")), F.lit(0.0))
    both = both.withColumns({"precision": precision, "recall": recall})
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
