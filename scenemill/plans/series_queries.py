"""Time-series and event queries: a user's events stand for a scene's keyframes, value for the signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenemill.operators import events as ev
from scenemill.operators import intervals as iv
from scenemill.operators import series as se
from scenemill.operators.stats import NULL_DRAWS
from scenemill.plans.registry import query, table

#: Hours are the unit of time: users act a few times a day.
HOUR = 3600.0


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_id, event_type, value, k, t`` with t in hours since the user's first event."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return se.rebase(rows, "user_id", "ts", "event_id", HOUR)


KF = """
first AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
kf AS (SELECT user_id, event_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1)::INT AS k,
              (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS t, epoch_us(ts) AS us FROM first)
"""


def r6(name: str):
    return F.round(name, 6).alias(name)


@query("rebase_dedupe", f"WITH {KF} SELECT user_id, event_id, k, round(t, 6) AS t FROM kf")
def rebase_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes(spark, sf_dir).select("user_id", "event_id", "k", r6("t"))


ISLANDS = """
flagged AS (SELECT *, abs(value) > {leave} AS inside FROM kf),
changed AS (SELECT *, CASE WHEN inside <> coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS change FROM flagged WINDOW w AS (PARTITION BY user_id ORDER BY t)),
numbered AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY t) AS island FROM changed),
running AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY t) AS upto FROM numbered),
hyst AS (SELECT user_id, island, min(t) AS start, max(t) AS "end", count(*) AS n, arg_max(value, abs(value)) AS peak, avg(value) AS mean, arg_min(upto - value, t) AS sum0, arg_max(upto, t) AS sum1
         FROM running WHERE inside GROUP BY user_id, island
         HAVING bool_or(abs(value) > {enter}) AND max(t) - min(t) >= {least})
"""
HYST = ISLANDS.format(leave=60, enter=150, least=0)


def _sql_folded(name: str, source: str, gap: int) -> str:
    """``<name>(user_id, start, "end", g)``: the events of ``source`` in order, each with the number of the merged event it is in."""
    same = f"sign(f.u - f.b) = sign(n.sum1 - n.sum0) AND n.start - f.\"end\" <= {gap}"
    return f"""o_{name} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS i FROM {source}),
{name} AS (SELECT user_id, i, start, "end", peak, 1 AS g, sum0 AS b, sum1 AS u FROM o_{name} WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.start, n."end", n.peak, CASE WHEN {same} THEN f.g ELSE f.g + 1 END, CASE WHEN {same} THEN f.b ELSE n.sum0 END, n.sum1 FROM {name} f JOIN o_{name} n ON n.user_id = f.user_id AND n.i = f.i + 1)"""


@query("hysteresis_events", f"""WITH {KF}, {HYST}
SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end", n, round(peak, 6) AS peak, round(mean, 6) AS mean FROM hyst""")
def hysteresis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.hysteresis(keyframes(spark, sf_dir), "user_id", "t", "value", 150.0, 60.0)
    return found.select("user_id", r6("start"), r6("end"), "n", r6("peak"), r6("mean"))


@query("merge_same_sign", f"""WITH RECURSIVE {KF},
centred AS (SELECT * REPLACE (value - 100 AS value) FROM kf), kf2 AS (SELECT * FROM centred),
{ISLANDS.format(leave=20, enter=60, least=0).replace("FROM kf)", "FROM kf2)")},
{_sql_folded("grouped", "hyst", 24)}
SELECT user_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end", count(*) AS n_merged, round(arg_max(peak, abs(peak)), 6) AS peak FROM grouped GROUP BY user_id, g""")
def merge_same_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("value", F.col("value") - 100)
    found = ev.merge_same_sign(ev.hysteresis(rows, "user_id", "t", "value", 60.0, 20.0), "user_id", 24.0)
    return found.select("user_id", r6("start"), r6("end"), F.col("n_merged").cast("long").alias("n_merged"), r6("peak"))


STILL = """
low AS (SELECT *, value < 100 AS inside FROM kf),
low2 AS (SELECT *, CASE WHEN inside <> coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS change FROM low WINDOW w AS (PARTITION BY user_id ORDER BY t)),
low3 AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY t) AS island FROM low2),
still AS (SELECT user_id, min(t) AS start, max(t) AS "end" FROM low3 WHERE inside GROUP BY user_id, island HAVING max(t) - min(t) >= 6)
"""


@query("stationary_runs", f"""WITH {KF}, {STILL}
SELECT user_id, 'stationary' AS kind, round(start, 6) AS start, round("end", 6) AS "end", round("end" - start, 6) AS duration FROM still""")
def stationary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.stationary_runs(keyframes(spark, sf_dir), "user_id", "t", "value", 100.0, 6.0)
    return found.select("user_id", "kind", r6("start"), r6("end"), r6("duration"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("rate", F.col("value") - 100)
    rows = rows.withColumn("heading", F.sum("rate").over(Window.partitionBy("user_id").orderBy("t")))
    return ev.lateral_events(rows, "user_id", "t", "rate", "heading", 60.0, 20.0, 0.0, 24.0, 50.0, 400.0, valid=F.col("k") > 0)


TURNS = f"""
rates AS (SELECT * REPLACE (value - 100 AS value), sum(value - 100) OVER (PARTITION BY user_id ORDER BY t) AS heading FROM kf),
{ISLANDS.format(leave=20, enter=60, least=0).replace("FROM kf)", "FROM rates)").replace("bool_or(abs(value) > 60)", "bool_or(abs(value) > 60 AND k > 0)")},
{_sql_folded("grouped", "hyst", 24)},
merged AS (SELECT user_id, min(start) AS start, max("end") AS "end", arg_max(peak, abs(peak)) AS peak FROM grouped GROUP BY user_id, g),
turns AS (SELECT m.*, b.heading - a.heading AS total FROM merged m
          JOIN rates a ON a.user_id = m.user_id AND a.t = m.start JOIN rates b ON b.user_id = m.user_id AND b.t = m."end"
          WHERE abs(b.heading - a.heading) >= 50)
"""


@query("lateral_events", f"""WITH RECURSIVE {KF}, {TURNS}
SELECT user_id, CASE WHEN abs(total) >= 400 THEN 'u_turn' WHEN total > 0 THEN 'turn_left' ELSE 'turn_right' END AS kind,
       round(start, 6) AS start, round("end", 6) AS "end", round(total, 4) AS total, round(peak, 6) AS peak FROM turns""")
def lateral_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("user_id", "kind", r6("start"), r6("end"), F.round("total", 4).alias("total"), r6("peak"))


LONGITUDINAL = f"""
accel AS (SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY t), 0) AS a FROM kf),
lflag AS (SELECT *, abs(a) > 40 AS inside2 FROM accel),
lch AS (SELECT *, CASE WHEN inside2 <> coalesce(lag(inside2) OVER w, false) THEN 1 ELSE 0 END AS ch FROM lflag WINDOW w AS (PARTITION BY user_id ORDER BY t)),
lnum AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t) AS isl, sum(a) OVER (PARTITION BY user_id ORDER BY t) AS upto FROM lch),
lh AS (SELECT user_id, isl, min(t) AS start, max(t) AS "end", 0 AS peak, arg_min(upto - a, t) AS sum0, arg_max(upto, t) AS sum1 FROM lnum WHERE inside2 GROUP BY user_id, isl
       HAVING bool_or(abs(a) > 120 AND value >= 100)),
{_sql_folded("lg", "lh", 24)},
lm AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM lg GROUP BY user_id, g),
ldv AS (SELECT m.*, b.value - a.value AS dv FROM lm m JOIN kf a ON a.user_id = m.user_id AND a.t = m.start
        JOIN kf b ON b.user_id = m.user_id AND b.t = m."end" WHERE abs(b.value - a.value) >= 30),
levents AS (SELECT user_id, 'stationary' AS kind, start, "end", NULL::DOUBLE AS change FROM still
            UNION ALL SELECT user_id, CASE WHEN dv > 0 THEN 'accelerating' ELSE 'decelerating' END, start, "end", dv FROM ldv)
"""


def _speeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = keyframes(spark, sf_dir)
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("t"))
    rows = rows.withColumn("a", F.coalesce(F.col("value") - before, F.lit(0.0)))
    return rows, ev.longitudinal_events(rows, "user_id", "t", "a", "value", 120.0, 40.0, 0.0, 24.0, 30.0, 100.0, 6.0)


@query("longitudinal_events", f"""WITH RECURSIVE {KF}, {STILL}, {LONGITUDINAL}
SELECT user_id, kind, round(start, 6) AS start, round("end", 6) AS "end", round(change, 6) AS change FROM levents""")
def longitudinal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speeds(spark, sf_dir)[1].select("user_id", "kind", r6("start"), r6("end"), r6("change"))


@query("event_membership", f"""WITH RECURSIVE {KF}, {STILL}, {LONGITUDINAL},
hits AS (SELECT k.user_id, k.k, e.kind, e.start, e."end",
                row_number() OVER (PARTITION BY k.user_id, k.k ORDER BY CASE kind WHEN 'stationary' THEN 0 WHEN 'accelerating' THEN 1 ELSE 2 END, start, "end") AS rn
         FROM kf k JOIN levents e ON e.user_id = k.user_id AND k.t BETWEEN e.start AND e."end")
SELECT kf.user_id, kf.k, coalesce(h.kind, 'cruising') AS label, coalesce(h.kind, 'cruising') = 'stationary' AS is_stationary,
       coalesce(h.kind, 'cruising') = 'cruising' AS is_cruising,
       round(CASE WHEN h."end" > h.start THEN (kf.t - h.start) / (h."end" - h.start) END, 6) AS progress
FROM kf LEFT JOIN hits h ON h.user_id = kf.user_id AND h.k = kf.k AND h.rn = 1""")
def event_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _speeds(spark, sf_dir)
    ranks = {"stationary": 0, "accelerating": 1, "decelerating": 2}
    labelled = ev.event_membership(rows.select("user_id", "k", "t"), found, "user_id", "k", "t", ranks, "cruising", 24.0)
    return ev.one_hot(labelled, "label", ["stationary", "cruising"]).select("user_id", "k", "label", "is_stationary", "is_cruising", r6("progress"))


@query("unwrap_angle", f"""WITH {KF},
a AS (SELECT user_id, k, ((value * 7) % 6.283185307179586) - 3.141592653589793 AS angle FROM kf),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY user_id ORDER BY k) AS d FROM a),
n AS (SELECT *, CASE WHEN d IS NULL OR abs(d) <= pi() THEN 0 ELSE floor((d + pi()) / (2 * pi())) END AS turns FROM d)
SELECT user_id, k, round(angle - 2 * pi() * sum(turns) OVER (PARTITION BY user_id ORDER BY k), 6) AS unwrapped FROM n""")
def unwrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("angle", (F.col("value") * 7) % F.lit(6.283185307179586) - F.lit(3.141592653589793))
    return se.unwrap(rows, "user_id", "k", "angle", "unwrapped").select("user_id", "k", r6("unwrapped"))


GRID = """
seg AS (SELECT user_id, t, value, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY t)),
span AS (SELECT user_id, max(t) AS last FROM kf GROUP BY user_id),
grid AS (SELECT user_id, unnest(range(0, floor(last / 6)::BIGINT + 1)) AS grid_i FROM span),
lerp AS (SELECT g.user_id, g.grid_i, g.grid_i * 6.0::DOUBLE AS grid_t,
                s.value + coalesce((g.grid_i * 6.0::DOUBLE - s.t) / (s.t1 - s.t) * (s.v1 - s.value), 0) AS value
         FROM grid g JOIN seg s ON s.user_id = g.user_id AND g.grid_i * 6.0::DOUBLE >= s.t AND (s.t1 IS NULL OR g.grid_i * 6.0::DOUBLE < s.t1))
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.resample(keyframes(spark, sf_dir), "user_id", "t", ["value"], 6.0)


@query("resample_lerp", f"WITH {KF}, {GRID} SELECT user_id, grid_i, round(grid_t, 6) AS grid_t, round(value, 5) AS value FROM lerp")
def resample_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("user_id", "grid_i", r6("grid_t"), F.round("value", 5).alias("value"))


def _sql_matrix(window: int) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in se.smoothing_matrix(window)) + "]"


SMOOTH = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY grid_i) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
                  list(value) OVER (PARTITION BY user_id ORDER BY grid_i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vs FROM lerp),
started AS (SELECT *, greatest(0, least(i - 2, n - 5)) AS s FROM placed),
smoothed AS (SELECT user_id, grid_i, CASE WHEN n < 5 THEN value ELSE list_dot_product(vs[s + 1 : s + 5], {_sql_matrix(5)}[i - s + 1]) END AS smooth FROM started)
"""


@query("savitzky_golay", f"WITH {KF}, {GRID}, {SMOOTH} SELECT user_id, grid_i, round(smooth, 5) AS smooth FROM smoothed")
def savitzky_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.smooth(_grid(spark, sf_dir), "user_id", "grid_i", "value", "smooth", 5).select("user_id", "grid_i", F.round("smooth", 5).alias("smooth"))


GRADIENT = """(CASE WHEN lag({c}) OVER w IS NULL THEN (lead({c}) OVER w - {c}) / 6 WHEN lead({c}) OVER w IS NULL THEN ({c} - lag({c}) OVER w) / 6
       ELSE (lead({c}) OVER w - lag({c}) OVER w) / 12 END)"""


@query("gradient", f"""WITH {KF}, {GRID}
SELECT user_id, grid_i, round({GRADIENT.format(c="value")}, 5) AS slope FROM lerp WINDOW w AS (PARTITION BY user_id ORDER BY grid_i)""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.gradient(_grid(spark, sf_dir), "user_id", "grid_i", "value", "slope", 6.0).select("user_id", "grid_i", F.round("slope", 5).alias("slope"))


@query("trend_acceleration", f"""WITH {KF}, {GRID}, {SMOOTH}
SELECT user_id, grid_i, round({GRADIENT.format(c="smooth")}, 5) AS trend FROM smoothed WINDOW w AS (PARTITION BY user_id ORDER BY grid_i)""")
def trend_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.trend(_grid(spark, sf_dir), "user_id", "grid_i", "value", "trend", 5, 6.0).select("user_id", "grid_i", F.round("trend", 5).alias("trend"))


BOUNDS = """
ends AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0, max(t) OVER (PARTITION BY user_id) AS t1 FROM kf),
started AS (SELECT *, t1 - t0 >= 48 AS full_, CASE WHEN t1 - t0 < 48 THEN t0 ELSE greatest(t0, least(t - 24, t1 - 48)) END AS ws FROM ends),
bounds AS (SELECT *, CASE WHEN full_ THEN ws + 48 ELSE t1 END AS we FROM started)
"""


@query("sliding_windows", f"""WITH {KF}, {BOUNDS}
SELECT user_id, k, round(ws, 6) AS window_start, round(we, 6) AS window_end, full_ AS window_full, round((ws + we) / 2 - t, 6) AS window_offset FROM bounds""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = se.window_bounds(keyframes(spark, sf_dir), "user_id", "t", 48.0)
    return rows.select("user_id", "k", r6("window_start"), r6("window_end"), "window_full", r6("window_offset"))


@query("sliding_window_features", f"""WITH {KF}, {BOUNDS},
inside AS (SELECT b.user_id, b.k, s.t, s.value, abs(s.value - lag(s.value) OVER (PARTITION BY b.user_id, b.k ORDER BY s.t)) AS step
           FROM bounds b JOIN kf s ON s.user_id = b.user_id AND s.t BETWEEN b.ws AND b.we)
SELECT user_id, k, count(*) AS n_samples, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(coalesce(sum(step), 0), 5) AS path,
       round(arg_max(value, t) - arg_min(value, t), 6) AS change FROM inside GROUP BY user_id, k""")
def sliding_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir)
    found = se.window_features(se.window_bounds(rows, "user_id", "t", 48.0), rows, "user_id", "k", "t", "value", 48.0)
    return found.select("user_id", "k", "n_samples", r6("mean"), "least", "most", F.round("path", 5).alias("path"), r6("change"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumns({"y": F.col("t") / 10, "heading": F.col("value") / 100})
    return se.signed_steps(rows, "user_id", "k", "value", "y", "heading", "step")


STEPS = """steps AS (SELECT user_id, k, (value - lag(value) OVER w) * cos(value / 100) + (t / 10 - lag(t / 10) OVER w) * sin(value / 100) AS step
           FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY k))"""


@query("signed_step", f"WITH {KF}, {STEPS} SELECT user_id, k, round(step, 5) AS step FROM steps")
def signed_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("user_id", "k", F.round("step", 5).alias("step"))


@query("reverse_runs", f"""WITH {KF}, {STEPS},
f AS (SELECT *, coalesce(step < -0.1, false) AS inside FROM steps),
c AS (SELECT *, CASE WHEN inside <> coalesce(lag(inside) OVER w, false) THEN 1 ELSE 0 END AS change FROM f WINDOW w AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY k) AS island FROM c)
SELECT user_id, min(k) AS first, max(k) AS last, count(*) AS n, round(sum(step), 4) AS net FROM g WHERE inside GROUP BY user_id, island HAVING count(*) >= 3""")
def reverse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.runs_below(_steps(spark, sf_dir), "user_id", "k", "step", -0.1, 3)
    return found.select("user_id", "first", "last", "n", F.round("net", 4).alias("net"))


RUNS = """
rch AS (SELECT *, CASE WHEN (event_type, value > 100) IS NOT DISTINCT FROM lag((event_type, value > 100)) OVER w THEN 0 ELSE 1 END AS new
        FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY k)),
rnum AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS run FROM rch),
runs AS (SELECT user_id, run, event_type, value > 100 AS high, min(k) AS first, max(k) AS last, count(*) AS n FROM rnum GROUP BY ALL)
"""


@query("label_runs", f"WITH {KF}, {RUNS} SELECT user_id, event_type, high, first, last, n FROM runs")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("high", F.col("value") > 100)
    return ev.label_runs(rows, "user_id", "k", ["event_type", "high"]).select("user_id", "event_type", "high", "first", "last", "n")


@query("merge_short_runs")
def merge_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ev.label_runs(keyframes(spark, sf_dir), "user_id", "k", ["event_type"])
    return ev.merge_short(runs, ["user_id"], "first", "last", 2, ["event_type"])


@query("collapse_runs", f"""WITH {KF},
rch AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(k) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY k)),
rnum AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS panel FROM rch)
SELECT user_id, panel, event_type, min(k) AS first, max(k) AS last FROM rnum GROUP BY user_id, panel, event_type""")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).select("user_id", "event_type", F.col("k").alias("first"), F.col("k").alias("last"))
    return ev.collapse(rows, "user_id", "first", "last", "event_type")


@query("lookback_state", f"""WITH {KF},
g AS (SELECT *, CASE WHEN k - lag(k) OVER w = 1 THEN 0 ELSE 1 END AS gap FROM kf WINDOW w AS (PARTITION BY user_id, event_type ORDER BY k)),
tr AS (SELECT *, sum(gap) OVER (PARTITION BY user_id, event_type ORDER BY k) AS track FROM g)
SELECT user_id, k, first(value) OVER w AS before, first(us) OVER w AS before_us FROM tr
WINDOW w AS (PARTITION BY user_id, event_type, track ORDER BY us RANGE BETWEEN 86400000001 PRECEDING AND 1 PRECEDING)""")
def lookback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("us", se.micros(F.col("ts")))
    return ev.state_before(rows, "user_id", "event_type", "k", "us", "value", "before", 86_400_000_000).select("user_id", "k", "before", "before_us")


@query("history_sequence", f"""WITH {KF}
SELECT user_id, k, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history FROM kf""")
def history_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = se.history(keyframes(spark, sf_dir), "user_id", "k", "event_id", "history")
    return rows.select("user_id", "k", F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


SNAP = """near AS (SELECT a.user_id, arg_min(kf.k, abs(kf.t - a.at) * 1e6 + kf.k * 1e-9) AS k FROM asked a JOIN kf ON kf.user_id = a.user_id GROUP BY a.user_id, a.at),
last AS (SELECT user_id, max(k) AS last FROM kf GROUP BY user_id),
snapped AS (SELECT DISTINCT n.user_id, n.k FROM near n JOIN last l ON l.user_id = n.user_id WHERE n.k > 0 AND n.k < l.last)"""


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir)
    found = ev.hysteresis(rows, "user_id", "t", "value", 150.0, 60.0)
    times = found.select("user_id", (F.col("start") + 1.7).alias("at")).unionByName(found.select("user_id", (F.col("end") + 2.9).alias("at")))
    return ev.snap(times, rows, "user_id", "at", "t", "k")


@query("snap_to_keyframe", f"""WITH {KF}, {HYST},
asked AS (SELECT DISTINCT user_id, start + 1.7 AS at FROM hyst UNION SELECT user_id, "end" + 2.9 FROM hyst), {SNAP} SELECT user_id, k FROM snapped""")
def snap_to_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapped(spark, sf_dir).select("user_id", "k")


@query("fixed_interval_cuts", f"""WITH {KF}, n AS (SELECT user_id, count(*) AS n FROM kf GROUP BY user_id),
c AS (SELECT user_id, n, unnest(range(1, 8)) AS i FROM n WHERE n > 1)
SELECT DISTINCT user_id, greatest(1, least(n - 1, round_even(i * n / 8.0::DOUBLE, 0)))::INT AS k FROM c""")
def fixed_interval_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = keyframes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("count", F.lit(7))
    return ev.fixed_interval_boundaries(sizes, "user_id", "n", "count")


@query("period_cuts", f"""WITH {KF}, span AS (SELECT user_id, max(t) AS m FROM kf GROUP BY user_id HAVING max(t) >= 50),
asked AS (SELECT user_id, unnest(range(1, floor(m / 50)::BIGINT + 1)) * 50.0::DOUBLE AS at FROM span), {SNAP} SELECT user_id, k FROM snapped""")
def period_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.period_boundaries(keyframes(spark, sf_dir), "user_id", "t", "k", 50.0).select("user_id", "k")


def _sql_random(name: str, sizes: str, seed: str, draws: int = NULL_DRAWS) -> str:
    """``<name>(user_id, draw, k)``: ``count`` of the n - 1 interior places of ``sizes(user_id, n, count)`` per draw, step by step."""
    place = f"(('0x' || substr(md5(concat_ws(':', '{seed}', user_id, draw, m - c + i)), 1, 12))::BIGINT % (m - c + i + 1))"
    return f"""f_{name} AS (SELECT user_id, draw, (n - 1)::BIGINT AS m, least(count, n - 1)::BIGINT AS c, 0::BIGINT AS i, []::BIGINT[] AS acc FROM {sizes}, (SELECT unnest(range(0, {draws})) AS draw) WHERE n > 1 AND count > 0
UNION ALL SELECT user_id, draw, m, c, i + 1, list_append(acc, CASE WHEN list_contains(acc, {place}) THEN m - c + i ELSE {place} END) FROM f_{name} WHERE i < c),
{name} AS (SELECT user_id, draw, (unnest(acc) + 1)::INT AS k FROM f_{name} WHERE i = c)"""


@query("random_cuts", f"""WITH RECURSIVE {KF}, n AS (SELECT user_id, count(*) AS n, 5 AS count FROM kf GROUP BY user_id), {_sql_random("cuts", "n", "cuts")} SELECT user_id, draw, k FROM cuts""")
def random_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = keyframes(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("count", F.lit(5))
    return ev.random_boundaries(sizes, "user_id", "n", "count", NULL_DRAWS, "cuts").withColumn("draw", F.col("draw").cast("long"))


@query("panel_boundaries", f"""WITH {KF}, {RUNS} SELECT user_id, first AS k FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) > 1""")
def panel_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panels(spark, sf_dir)


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("high", F.col("value") > 100)
    runs = ev.label_runs(rows, "user_id", "k", ["event_type", "high"])
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("first"))
    return runs.withColumn("nth", nth).where("nth > 1").select("user_id", F.col("first").alias("k"))


@query("boundary_prf", f"""WITH {KF}, {HYST}, {RUNS},
asked AS (SELECT DISTINCT user_id, start + 1.7 AS at FROM hyst UNION SELECT user_id, "end" + 2.9 FROM hyst), {SNAP},
gold AS (SELECT user_id, first AS k FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) > 1),
tol AS (SELECT unnest([0, 1, 2, 3]) AS tolerance),
p AS (SELECT tolerance, count(*) FILTER (EXISTS (SELECT 1 FROM gold g WHERE g.user_id = s.user_id AND abs(g.k - s.k) <= tolerance)) AS tp, count(*) AS n FROM snapped s, tol GROUP BY tolerance),
q AS (SELECT tolerance, count(*) FILTER (EXISTS (SELECT 1 FROM snapped s WHERE g.user_id = s.user_id AND abs(g.k - s.k) <= tolerance)) AS hit, count(*) AS n FROM gold g, tol GROUP BY tolerance),
r AS (SELECT p.tolerance, tp, p.n - tp AS fp, hit AS gold_hits, q.n - hit AS fn, tp / p.n::DOUBLE AS pr, hit / q.n::DOUBLE AS re FROM p JOIN q USING (tolerance))
SELECT tolerance, tp, fp, gold_hits, fn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r""")
def boundary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.boundary_scores(_snapped(spark, sf_dir), _panels(spark, sf_dir), "user_id", [0, 1, 2, 3])
    return found.select("tolerance", "tp", "fp", "gold_hits", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("coalesce_intervals", f"""WITH {KF}, i AS (SELECT user_id, k AS kf0, k + (value / 100)::BIGINT AS kf1, event_type FROM kf),
m AS (SELECT *, max(kf1) OVER (PARTITION BY user_id ORDER BY kf0, kf1, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN kf0 <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY kf0, kf1, event_type) AS isl FROM m)
SELECT user_id, min(kf0) AS kf0, max(kf1) AS kf1, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS event_type FROM g GROUP BY user_id, isl""")
def coalesce_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coalesce_intervals(_intervals(spark, sf_dir), ["user_id"], "kf0", "kf1", "event_type")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir)
    return rows.select("user_id", F.col("k").alias("kf0"), (F.col("k") + F.bround(F.col("value") / 100).cast("long")).alias("kf1"), "event_type")


@query("expand_intervals", f"""WITH {KF}, i AS (SELECT user_id, k AS kf0, k + (value / 100)::BIGINT AS kf1 FROM kf),
x AS (SELECT DISTINCT user_id, unnest(range(kf0, kf1 + 1)) AS k FROM i)
SELECT kf.user_id, kf.k, x.k IS NOT NULL AS flagged FROM kf LEFT JOIN x ON x.user_id = kf.user_id AND x.k = kf.k""")
def expand_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = iv.expand_intervals(_intervals(spark, sf_dir).drop("event_type"), "kf0", "kf1", "k").distinct().withColumn("hit", F.lit(True))
    return keyframes(spark, sf_dir).select("user_id", "k").join(flags, ["user_id", "k"], "left").select("user_id", "k", F.coalesce("hit", F.lit(False)).alias("flagged"))
