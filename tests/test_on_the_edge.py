"""Frames that lie exactly on an edge or a tie: the query decides them as its SQL does."""

import datetime

import duckdb
from pyspark.sql import functions as F
from test_queries import rows_of

from scenemill.operators import spatial as sp
from scenemill.plans import registry

QUERIES, SQL = registry.load()
START = datetime.datetime(2024, 1, 1)


def same_as_sql(spark, folder, name, special, yaws, most=16):
    """``special``: value by (user, k); other frames are far off. Users come once per yaw: an event's id modulo 7 is its yaw."""
    rows = []
    for user in sorted({u for u, _ in special}):
        for yaw in yaws:
            who = user + 10 * yaw  # the same parity, so the same town
            rows += [(7 * (len(rows) + k) + yaw, START + datetime.timedelta(hours=k), who, "view", special.get((user, k), 500.0), "{}") for k in range(most)]
    rows = [(7 * i + r[0] % 7, *r[1:]) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, str(folder))
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_light_on_the_edge_of_the_image(spark, tmp_path):
    # Straight ahead, and 2/3 as far to the side as ahead: on the image's border.
    same_as_sql(spark, tmp_path, "lights_in_view", {(1, 6): 6.4, (1, 11): 111.6, (2, 7): 311.6}, [3])


def test_frames_are_not_broadcast_to_lights(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(QUERIES["lights_in_view"](spark, "/root/testdata/sf0.001"))
    assert "BuildRight" in found and "BuildLeft" not in found  # the lights, not the frames
    # Lights without a hint; the frames' size is known and small.
    frames, zero = spark.range(8).select("id", F.lit("a").alias("town"), F.col("id").cast("double").alias("x")), F.lit(0.0)
    lights = spark.createDataFrame([("a", 10.0, 0.0, 1.5), ("b", 10.0, 0.0, 1.5)], "town string, x double, y double, z double")
    camera = ([zero, zero, F.lit(1.5)], lambda v: [-v[1], -v[2], v[0]])
    seen = sp.lights_in_view(frames, lights, "id", "town", ([F.col("x"), zero, zero], sp.by_yaw(zero)), camera, 1200.0, 1600.0, 900.0, 9.0)
    assert "BroadcastHashJoin" not in plan(seen)
    assert {r.id: (r.n_in_view, r.nearest_m) for r in seen.collect()} == {0: (0, None)} | {i: (1, 10.0 - i) for i in range(1, 8)}


def test_lights_as_far_as_each_other_or_as_the_radius(spark, tmp_path):
    same_as_sql(spark, tmp_path, "scene_content", {(1, 15): 12.48, (1, 5): 14.0}, range(7))


def test_map_context_and_labels_are_planned_in_pieces(spark):
    for name, most in (("map_context_full", 12_000), ("label_table", 20_000)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < most, (name, len(plan))
