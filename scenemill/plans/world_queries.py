"""Spatial, track, join, set and sampling queries. Points are the first coordinates of the embeddings, tenfold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenemill.functions import scalar as fs
from scenemill.operators import relational as re_
from scenemill.operators import sampling as sa
from scenemill.operators import spatial as sp
from scenemill.operators import tracks as tr
from scenemill.plans.metric_queries import CELLS, cells
from scenemill.plans.registry import query, table
from scenemill.plans.series_queries import KF, RUNS, keyframes
from scenemill.operators import events as ev
from scenemill.operators import series as se


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double") * 10
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e(0).alias("x"), e(1).alias("y"), e(2).alias("h"), e(3).alias("z"))


PTS = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS h, embedding[4]::DOUBLE * 10 AS z FROM embeddings)"


def _ring(cx: float, cy: float, a: float, b: float, n: int) -> list[tuple[float, float]]:
    return [(round(cx + a * math.cos(2 * math.pi * i / n), 6), round(cy + b * math.sin(2 * math.pi * i / n), 6)) for i in range(n)]


#: A donut of road about an oval island, and two overlapping lots.
POLYGONS = [
    ("road", "donut", [_ring(0, 0, 3, 3, 24), _ring(0, 0, 1.2, 0.6, 16)]), ("lot", "a", [[(-1.0, -1.0), (0.8, -1.2), (0.9, 0.7), (-0.9, 0.9)]]),
    ("lot", "b", [[(0.0, 0.0), (2.5, 0.1), (2.4, 2.0), (0.1, 2.2)]]), ("walk", "far", [[(1.5, -3.0), (2.5, -3.0), (2.0, -1.0)]]),
]
_SCHEMA = "layer string, token string, rings array<array<struct<x: double, y: double>>>"
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{la}', '{to}', {i}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
    for la, to, rings in POLYGONS for i, ring in enumerate(rings) for a, b in zip(ring, ring[1:] + ring[:1])
) + ") v(layer, token, ring, ax, ay, bx, ey))"


def polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLYGONS, _SCHEMA)


INSIDE = """inside AS (SELECT vec_id, layer, token FROM pts JOIN edges ON (ay <= y) <> (ey <= y) AND x < ax + (y - ay) * (bx - ax) / (ey - ay)
GROUP BY vec_id, layer, token HAVING count(*) % 2 = 1)"""


@query("point_in_polygon", f"WITH {PTS}, {EDGES}, {INSIDE} SELECT vec_id, layer, min(token) AS token FROM inside GROUP BY vec_id, layer")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).select("vec_id", "x", "y")
    return sp.polygons_at(own, polygons(spark), "x", "y", 1.0).select("vec_id", "layer", "token")


@query("map_context", f"""WITH {PTS}, {EDGES}, {INSIDE} SELECT vec_id, bool_or(coalesce(layer = 'road', false)) AS on_road, bool_or(coalesce(layer = 'lot', false)) AS on_lot,
bool_or(coalesce(layer = 'walk', false)) AS on_walk FROM pts LEFT JOIN inside USING (vec_id) GROUP BY vec_id""")
def map_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).select("vec_id", "x", "y")
    hits = sp.polygons_at(own, polygons(spark), "x", "y", 1.0).groupBy("vec_id").pivot("layer", ["road", "lot", "walk"]).agg(F.first("token"))
    joined = own.join(hits, "vec_id", "left")
    return joined.select("vec_id", *[F.col(c).isNotNull().alias(f"on_{c}") for c in ("road", "lot", "walk")])


@query("on_road_fraction", f"""WITH {PTS}, {EDGES}, {INSIDE} SELECT label, round(avg((i.vec_id IS NOT NULL)::INT), 6) AS on_road FROM pts LEFT JOIN (SELECT DISTINCT vec_id FROM inside WHERE layer = 'road') i USING (vec_id) GROUP BY label""")
def on_road_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    road = sp.polygons_at(own.select("vec_id", "x", "y"), polygons(spark).where("layer = 'road'"), "x", "y", 1.0).select("vec_id", F.lit(1.0).alias("on"))
    return own.join(road, "vec_id", "left").groupBy("label").agg(F.round(F.avg(F.coalesce("on", F.lit(0.0))), 6).alias("on_road"))


AHEAD = """ahead AS (SELECT a.vec_id, b.vec_id AS token, (b.x - a.x) * cos(a.h) + (b.y - a.y) * sin(a.h) AS u, -(b.x - a.x) * sin(a.h) + (b.y - a.y) * cos(a.h) AS v
FROM pts a JOIN pts b ON b.label <> a.label AND b.z > 0), near AS (SELECT vec_id, sqrt(u * u + v * v) AS d, token FROM ahead WHERE u BETWEEN 0 AND 1.5 AND abs(v) <= 0.2)"""


@query("corridor_points_ahead", f"""WITH {PTS}, {AHEAD}, b AS (SELECT vec_id, min(d) AS d FROM near WHERE token <> vec_id GROUP BY vec_id)
SELECT p.vec_id, round(d, 6) AS ahead_m, d IS NOT NULL AS is_ahead FROM pts p LEFT JOIN b USING (vec_id)""")
def corridor_points_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    found = sp.nearest_ahead(own, own, "vec_id", "x", "y", "h", "vec_id", "x", "y", 1.5, 0.2, where=F.col("z") > 0, unlike="label")
    return found.select("vec_id", *r6("ahead_m"), "is_ahead")


#: Rectangle against polygon by corners and edges that cross, distance by the nearest point of each edge.
CORRIDOR = f"""loc AS (SELECT vec_id, layer, token, ring, (ax - x) * cos(h) + (ay - y) * sin(h) AS u0, -(ax - x) * sin(h) + (ay - y) * cos(h) AS v0,
(bx - x) * cos(h) + (ey - y) * sin(h) AS u1, -(bx - x) * sin(h) + (ey - y) * cos(h) AS v1 FROM pts, edges),
par AS (SELECT vec_id, layer, token, count(*) FILTER ((v0 <= 0) <> (v1 <= 0) AND 0 < u0 + (0 - v0) * (u1 - u0) / (v1 - v0)) % 2 = 1 AS inside,
count(*) FILTER ((v0 <= -0.2) <> (v1 <= -0.2) AND 0 < u0 + (-0.2 - v0) * (u1 - u0) / (v1 - v0)) % 2 = 1 AS corner,
bool_or(u0 BETWEEN 0 AND 1.5 AND v0 BETWEEN -0.2 AND 0.2) AS vertex, bool_or(
 (u0 <> u1 AND (0 - u0) / (u1 - u0) BETWEEN 0 AND 1 AND v0 + (0 - u0) / (u1 - u0) * (v1 - v0) BETWEEN -0.2 AND 0.2) OR (u0 <> u1 AND (1.5 - u0) / (u1 - u0) BETWEEN 0 AND 1 AND v0 + (1.5 - u0) / (u1 - u0) * (v1 - v0) BETWEEN -0.2 AND 0.2) OR
 (v0 <> v1 AND (0.2 - v0) / (v1 - v0) BETWEEN 0 AND 1 AND u0 + (0.2 - v0) / (v1 - v0) * (u1 - u0) BETWEEN 0 AND 1.5) OR (v0 <> v1 AND (-0.2 - v0) / (v1 - v0) BETWEEN 0 AND 1 AND u0 + (-0.2 - v0) / (v1 - v0) * (u1 - u0) BETWEEN 0 AND 1.5)) AS crosses,
min(sqrt((u0 + greatest(0, least(1, -(u0 * (u1 - u0) + v0 * (v1 - v0)) / ((u1 - u0) ** 2 + (v1 - v0) ** 2))) * (u1 - u0)) ** 2 + (v0 + greatest(0, least(1, -(u0 * (u1 - u0) + v0 * (v1 - v0)) / ((u1 - u0) ** 2 + (v1 - v0) ** 2))) * (v1 - v0)) ** 2)) AS d FROM loc GROUP BY ALL),
cor AS (SELECT vec_id, layer, token, CASE WHEN inside THEN 0 ELSE d END AS d FROM par WHERE inside OR corner OR vertex OR crosses)"""


@query("corridor_polygons_ahead", f"WITH {PTS}, {EDGES}, {CORRIDOR} SELECT vec_id, layer, round(d, 6) AS ahead_m, token FROM cor QUALIFY row_number() OVER (PARTITION BY vec_id, layer ORDER BY d, token) = 1")
def corridor_polygons_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp.polygons_ahead(points(spark, sf_dir), polygons(spark), "vec_id", "x", "y", "h", 1.5, 0.2, 1.0)
    return found.select("vec_id", "layer", *r6("ahead_m"), "token")


@query("nearest_neighbour", f"""WITH {PTS}, c AS (SELECT a.vec_id AS ask, b.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.h AS ha, b.h AS hb FROM pts a JOIN pts b ON a.label <> b.label),
f AS (SELECT * FROM c WHERE d <= 0.8 AND abs((hb - ha + pi()) - 2 * pi() * floor((hb - ha + pi()) / (2 * pi())) - pi()) <= 0.6)
SELECT ask, arg_min(vec_id, d) AS vec_id, round(min(d), 6) AS distance, count(*) AS n_near FROM f GROUP BY ask""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    found = sp.nearest_within(own.withColumnRenamed("vec_id", "ask"), own, "ask", "vec_id", "x", "y", 0.8, unlike="label", heading="h", parallel=0.6)
    return found.select("ask", "vec_id", *r6("distance"), "n_near")


LINE = [(f"l{j}", i, float(i) - 3, 0.3 * (i % 3) + j) for j in range(3) for i in range(8)]


@query("signed_offset", f"""WITH {PTS}, line AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}, {c}::DOUBLE, {d!r}::DOUBLE)" for a, b, c, d in LINE)}) v(line, seq, px, py)),
seg AS (SELECT *, coalesce(lead(px) OVER w - px, px - lag(px) OVER w) AS dx, coalesce(lead(py) OVER w - py, py - lag(py) OVER w) AS dy FROM line WINDOW w AS (PARTITION BY line ORDER BY seq)),
n AS (SELECT vec_id, line, x, y, px, py, dx, dy, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM pts JOIN seg ON line = 'l' || (label % 3) QUALIFY row_number() OVER (PARTITION BY vec_id, line ORDER BY sqrt((x - px) ** 2 + (y - py) ** 2), seq) = 1)
SELECT vec_id, line, round((dx * (y - py) - dy * (x - px)) / sqrt(dx * dx + dy * dy), 6) AS "offset", round(atan2(dy, dx), 6) AS line_heading, round(d, 6) AS min_distance FROM n""")
def signed_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.createDataFrame(LINE, "line string, seq int, px double, py double")
    own = points(spark, sf_dir).withColumn("line", F.concat(F.lit("l"), (F.col("label") % 3).cast("string")))
    return sp.signed_offset(own, line, "vec_id", "x", "y", "line", "seq", "px", "py").select("vec_id", "line", *r6("offset", "line_heading", "min_distance"))


@query("pinhole_projection", """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS s FROM embeddings),
q AS (SELECT *, cos(s) AS qw, 0.6 * sin(s) AS qx, 0.0 AS qy, 0.8 * sin(s) AS qz, x * 10 AS a, y * 10 AS b, z * 10 + 2 AS c FROM e),
t AS (SELECT *, 2 * (-qy * c + qz * b) AS tx, 2 * (-qz * a + qx * c) AS ty, 2 * (-qx * b + qy * a) AS tz FROM q),
r AS (SELECT vec_id, a + qw * tx + (-qy * tz + qz * ty) AS rx, b + qw * ty + (-qz * tx + qx * tz) AS ry, c + qw * tz + (-qx * ty + qy * tx) AS rz FROM t),
p AS (SELECT *, 500 * rx / rz + 800 AS u, 500 * ry / rz + 450 AS v FROM r)
SELECT vec_id, round(rz, 6) AS depth, round(u, 3) AS u, round(v, 3) AS v, rz > 0.1 AND u BETWEEN 0 AND 1600 AND v BETWEEN 0 AND 900 AS in_image FROM p""")
def pinhole_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    s = e(3)
    q = [F.cos(s), 0.6 * F.sin(s), F.lit(0.0), 0.8 * F.sin(s)]
    made = sp.project([e(0) * 10, e(1) * 10, e(2) * 10 + 2], [F.lit(0.0)] * 3, q, 500.0, 1600.0, 900.0)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(n) for n, c in made.items()])
    return rows.select("vec_id", *r6("depth"), F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), "in_image")


@query("boxes_in_image", """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS s FROM embeddings),
o AS (SELECT unnest([-0.5, 0.5]) AS o), q AS (SELECT vec_id, cos(s) AS qw, 0.6 * sin(s) AS qx, 0.0 AS qy, 0.8 * sin(s) AS qz, x * 10 + i.o AS a, y * 10 + j.o AS b, z * 10 + 2 + k.o AS c FROM e, o i, o j, o k),
t AS (SELECT *, 2 * (-qy * c + qz * b) AS tx, 2 * (-qz * a + qx * c) AS ty, 2 * (-qx * b + qy * a) AS tz FROM q),
r AS (SELECT vec_id, a + qw * tx + (-qy * tz + qz * ty) AS rx, b + qw * ty + (-qz * tx + qx * tz) AS ry, c + qw * tz + (-qx * ty + qy * tx) AS rz FROM t)
SELECT vec_id, bool_or(rz > 0.1 AND 500 * rx / rz + 800 BETWEEN 0 AND 1600 AND 500 * ry / rz + 450 BETWEEN 0 AND 900) AS in_image FROM r GROUP BY vec_id""")
def boxes_in_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    q = [F.cos(e(3)), 0.6 * F.sin(e(3)), F.lit(0.0), 0.8 * F.sin(e(3))]
    corners = [
        sp.project([e(0) * 10 + dx, e(1) * 10 + dy, e(2) * 10 + 2 + dz], [F.lit(0.0)] * 3, q, 500.0, 1600.0, 900.0)
        for dx in (-0.5, 0.5) for dy in (-0.5, 0.5) for dz in (-0.5, 0.5)
    ]
    return table(spark, sf_dir, "embeddings").select("vec_id", sp.box_in_image(corners).alias("in_image"))


@query("bev_content", f"""WITH {PTS}, r AS (SELECT label, vec_id, sqrt(x * x + y * y) AS d FROM pts)
SELECT label, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY d, vec_id) AS nearest_first, round(min(d), 6) AS nearest FROM r WHERE d <= 2 GROUP BY label""")
def bev_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).withColumn("d", F.hypot("x", "y")).where("d <= 2")
    order = F.array_sort(F.collect_list(F.struct("d", "vec_id")))
    return own.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda p: p.vec_id.cast("string")), ",").alias("nearest_first"), F.round(F.min("d"), 6).alias("nearest"))


@query("bev_text", f"""WITH {PTS}, r AS (SELECT label, vec_id, sqrt(x * x + y * y) AS d, x, y FROM pts WHERE sqrt(x * x + y * y) <= 1)
SELECT label, string_agg(printf('agent %d at %.1f m, %s', vec_id, d, CASE WHEN y > 0 THEN 'left' ELSE 'right' END), '; ' ORDER BY d, vec_id) AS description FROM r GROUP BY label""")
def bev_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).withColumn("d", F.hypot("x", "y")).where("d <= 1")
    text = F.format_string("agent %d at %.1f m, %s", F.col("vec_id"), F.col("d"), F.when(F.col("y") > 0, "left").otherwise("right"))
    order = F.array_sort(F.collect_list(F.struct("d", "vec_id", text.alias("t"))))
    return own.groupBy("label").agg(F.array_join(F.transform(order, lambda p: p.t), "; ").alias("description"))


@query("circle_fit", f"""WITH {PTS}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY label) AS u, y - avg(y) OVER (PARTITION BY label) AS v, avg(x) OVER (PARTITION BY label) AS mx, avg(y) OVER (PARTITION BY label) AS my FROM pts),
s AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * u * u + u * v * v) AS a, sum(v * v * v + v * u * u) AS b FROM m GROUP BY label),
c AS (SELECT *, (a * vv - b * uv) / 2 / (uu * vv - uv * uv) AS cu, (b * uu - a * uv) / 2 / (uu * vv - uv * uv) AS cv FROM s)
SELECT label, round(mx + cu, 5) AS cx, round(my + cv, 5) AS cy, round(sqrt(cu * cu + cv * cv + (uu + vv) / n), 5) AS radius FROM c""")
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.fit_circle(points(spark, sf_dir), ["label"], "x", "y").select("label", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "radius")])


@query("angle_wrap", f"WITH {PTS} SELECT vec_id, round((h + pi()) - 2 * pi() * floor((h + pi()) / (2 * pi())) - pi(), 6) AS wrapped FROM pts")
def angle_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", F.round(fs.wrap(F.col("h")), 6).alias("wrapped"))


_W = "((({d}) + pi()) - 2 * pi() * floor((({d}) + pi()) / (2 * pi())) - pi())"


@query("roundabout_traversals", f"""WITH {PTS}, a AS (SELECT label, vec_id, atan2(y, x) AS a, h FROM pts),
s AS (SELECT label, vec_id, coalesce({_W.format(d="a - lag(a) OVER w")}, 0) AS da, coalesce({_W.format(d="h - lag(h) OVER w")}, 0) AS dh FROM a WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
t AS (SELECT label, degrees(sum(da)) AS around, degrees(sum(dh)) AS turned, count(*) AS n FROM s GROUP BY label)
SELECT label, round(around, 4) AS around_deg, round(turned, 4) AS turned_deg, n FROM t WHERE abs(around) >= 45 AND abs(turned) >= 30 AND sign(around) = sign(turned) AND abs(turned) / abs(around) >= 0.1""")
def roundabout_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp.traversals(points(spark, sf_dir), ["label"], "vec_id", "x", "y", F.lit(0.0), F.lit(0.0), "h", 45.0, 30.0, 0.1)
    return found.select("label", F.round("around_deg", 4).alias("around_deg"), F.round("turned_deg", 4).alias("turned_deg"), "n")


@query("island_filter", f"""WITH {EDGES}, m AS (SELECT layer, token, ring, abs(sum(ax * ey - bx * ay)) / 2 AS area, sum(sqrt((bx - ax) ** 2 + (ey - ay) ** 2)) AS perimeter FROM edges GROUP BY ALL)
SELECT layer, token, ring, round(area, 6) AS area, round(4 * pi() * area / perimeter ** 2, 6) AS compactness FROM m WHERE area BETWEEN 1 AND 40 AND 4 * pi() * area / perimeter ** 2 >= 0.55""")
def island_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polygons(spark).select("layer", "token", F.posexplode("rings").alias("ring", "points"))
    area, perimeter = sp.ring_measures(F.col("points"))
    found = sp.island_filter(rows.withColumns({"area": area, "perimeter": perimeter}), "area", "perimeter", 1.0, 40.0)
    return found.select("layer", "token", "ring", *r6("area", "compactness"))


LANES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "e"), ("e", "a")]


@query("lane_paths", f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in LANES)}) v(src, dst)),
p AS (SELECT DISTINCT [src] AS path FROM e UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON e.src = path[-1] WHERE NOT list_contains(path, dst) AND len(path) < 5)
SELECT array_to_string(path, '>') AS path FROM p""")
def lane_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp.simple_paths(spark.createDataFrame(LANES, "src string, dst string"), 5)
    return found.select(F.array_join("path", ">").alias("path"))


SUCC = [("click", "view"), ("view", "click")]


@query("lane_token_flips", f"""WITH {KF}, l AS (SELECT user_id, k, CASE WHEN value > 20 THEN event_type END AS lane FROM kf),
b AS (SELECT *, lag(k) OVER w AS k0, lag(lane) OVER w AS src FROM l WHERE lane IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, k0 AS kf0, k AS kf1, src, lane AS dst FROM b WHERE src <> lane AND k - k0 - 1 <= 1 AND (src, lane) NOT IN (('click', 'view'), ('view', 'click'))""")
def lane_token_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).select("user_id", "k", F.when(F.col("value") > 20, F.col("event_type")).alias("lane"))
    found = sp.token_flips(rows, "user_id", "k", "lane", spark.createDataFrame(SUCC, "src string, dst string"), 1)
    return found.select("user_id", "kf0", "kf1", "src", "dst")


@query("lane_settlement_pairs", f"""WITH {KF}, n AS (SELECT *, lag(k) OVER w AS k0, lag(t) OVER w AS t0, lag(event_type) OVER w AS src FROM kf WHERE abs(value - 100) <= 60 WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, k0 AS kf0, k AS kf1, src, event_type AS dst, round(t - t0, 6) AS duration FROM n WHERE src <> event_type AND t - t0 > 0 AND t - t0 <= 24""")
def lane_settlement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumn("off", F.col("value") - 100)
    return sp.settlement_pairs(rows, "user_id", "k", "t", "event_type", "off", 60.0, 24.0).select("user_id", "kf0", "kf1", "src", "dst", *r6("duration"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as agents: an order is a frame of its customer's scene, a supplier an instance."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("scene"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("instance"),
        F.when(F.col("l_returnflag") == "N", "vehicle.car").when(F.col("l_returnflag") == "R", "human.adult").otherwise("static.cone").alias("category"),
        (F.col("l_quantity") - 5).alias("fwd"), ((F.col("l_discount") - 0.05) * 100).alias("lat"), (F.col("l_extendedprice") / 10000).alias("speed"),
        ((F.col("l_tax") - 0.04) * -50).alias("v_lat"), (F.col("l_linestatus") == "O").alias("in_frustum"),
    )


AGENTS = """ag AS (SELECT o_custkey AS scene, l_orderkey AS frame, l_linenumber AS instance, CASE l_returnflag WHEN 'N' THEN 'vehicle.car' WHEN 'R' THEN 'human.adult' ELSE 'static.cone' END AS category,
l_quantity - 5 AS fwd, (l_discount - 0.05::DOUBLE) * 100 AS lat, l_extendedprice / 10000 AS speed, (l_tax - 0.04::DOUBLE) * -50 AS v_lat, l_linestatus = 'O' AS in_frustum
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("corridor_lead", f"""WITH {AGENTS} SELECT scene, frame, round(min(fwd), 6) AS lead_distance, arg_min(instance, fwd * 1000 + instance) AS lead FROM ag
WHERE category LIKE 'vehicle.%' AND fwd > 0 AND fwd < 40 AND abs(lat) < 2.5 GROUP BY scene, frame""")
def corridor_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.lead(agents(spark, sf_dir), ["scene", "frame"]).select("scene", "frame", *r6("lead_distance"), "lead")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one agent per type: a track that moves."""
    rows = keyframes(spark, sf_dir)
    return rows.select(
        F.col("user_id").alias("scene"), "k", se.micros(F.col("ts")).alias("us"), F.col("event_type").alias("instance"), F.lit("vehicle.car").alias("category"),
        (F.col("value") / 10).alias("fwd"), (F.col("value") / 50 - 4).alias("lat"), (F.col("value") / 20).alias("speed"), (2 - F.col("value") / 50).alias("v_lat"), (F.col("event_id") % 2 == 0).alias("in_frustum"),
    )


TRACK = f"""{KF}, fr AS (SELECT user_id AS scene, k, us, event_type AS instance, value / 10 AS fwd, value / 50 - 4 AS lat, value / 20 AS speed, 2 - value / 50 AS v_lat, event_id % 2 = 0 AS in_frustum FROM kf),
g AS (SELECT *, CASE WHEN k - lag(k) OVER w = 1 THEN 0 ELSE 1 END AS gap FROM fr WINDOW w AS (PARTITION BY scene, instance ORDER BY k)),
tk AS (SELECT *, sum(gap) OVER (PARTITION BY scene, instance ORDER BY k) AS track FROM g),
pa AS (SELECT *, first(lat) OVER w AS lat0, first(speed) OVER w AS speed0, first(us) OVER w AS us0 FROM tk WINDOW w AS (PARTITION BY scene, instance, track ORDER BY us RANGE BETWEEN 172800000001 PRECEDING AND 1 PRECEDING))"""
BACK = 172_800_000_000


@query("lead_braking", f"""WITH {TRACK} SELECT scene, k, instance AS lead, round((speed - speed0) / ((us - us0) / 1e6::DOUBLE), 9) AS lead_accel, coalesce((speed - speed0) / ((us - us0) / 1e6::DOUBLE) < -0.00005, false) AS lead_braking
FROM pa WHERE fwd > 0 AND fwd < 40 AND abs(lat) < 2.5""")
def lead_braking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tr.lead_braking(_frames(spark, sf_dir), "scene", "k", "us", -0.00005, BACK)
    return found.select("scene", "k", "lead", F.round("lead_accel", 9).alias("lead_accel"), "lead_braking")


@query("cut_in", f"""WITH {TRACK}, h AS (SELECT *, coalesce(fwd > 0 AND fwd < 40 AND abs(lat) < 2.5 AND abs(lat0) >= 2.5 AND speed > 1 AND lat * v_lat < 0, false) AS hit FROM pa)
SELECT scene, k, bool_or(hit) AS cut_in, count(*) FILTER (hit) AS n_cut_in, count(*) FILTER (hit AND in_frustum) AS n_cut_in_in_frustum, coalesce(string_agg(instance, ',' ORDER BY instance) FILTER (hit), '') AS cut_in_instances FROM h GROUP BY scene, k""")
def cut_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.cut_ins(_frames(spark, sf_dir), "scene", "k", "us", back_us=BACK)


CROSS = "(category LIKE 'human.%' AND fwd > 0 AND sqrt(fwd * fwd + lat * lat) <= 20 AND abs(v_lat) >= 0.5 AND lat * v_lat < 0 AND greatest(abs(lat) - 2.5, 0) / abs(v_lat) <= 4)"


@query("pedestrian_crossing", f"""WITH {AGENTS}, h AS (SELECT *, coalesce({CROSS}, false) AS hit FROM ag)
SELECT scene, frame, bool_or(hit) AS crossing, count(*) FILTER (hit) AS n_crossing, count(*) FILTER (hit AND in_frustum) AS n_crossing_in_frustum, coalesce(array_to_string(list_sort(list(DISTINCT instance::VARCHAR) FILTER (hit)), ','), '') AS crossing_instances FROM h GROUP BY scene, frame""")
def pedestrian_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.crossings(agents(spark, sf_dir), "scene", "frame")


@query("object_tags", f"""WITH {AGENTS}, f AS (SELECT o_custkey AS scene, o_orderkey AS frame FROM orders), b AS (SELECT scene, frame, bool_or(category LIKE 'vehicle.%') AS vehicle, count(*) FILTER (category LIKE 'vehicle.%') AS n_vehicle,
count(*) FILTER (category LIKE 'vehicle.%' AND in_frustum) AS n_vehicle_clear, count(*) FILTER (category = 'human.adult' AND abs(fwd) <= 15) AS n_person_near, count(*) FILTER (abs(fwd) <= 15) AS n_near,
count(*) FILTER (abs(fwd) > 15 AND abs(fwd) <= 30) AS n_mid, count(*) FILTER (abs(fwd) > 30) AS n_far, min(abs(fwd)) AS nearest, max(abs(fwd)) AS farthest FROM ag GROUP BY scene, frame)
SELECT scene, frame, coalesce(vehicle, false) AS vehicle, coalesce(n_vehicle, 0) AS n_vehicle, coalesce(n_vehicle_clear, 0) AS n_vehicle_clear, coalesce(n_person_near, 0) AS n_person_near,
coalesce(n_near, 0) AS n_near, coalesce(n_mid, 0) AS n_mid, coalesce(n_far, 0) AS n_far, nearest, farthest FROM f LEFT JOIN b USING (scene, frame)""")
def object_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("frame"))
    boxes = agents(spark, sf_dir).withColumn("dist", F.abs("fwd"))
    tags = {"vehicle": F.col("category").startswith("vehicle."), "person_near": F.col("category").isin("human.adult") & (F.col("dist") <= 15)}
    found = tr.object_tags(boxes, frames, ["scene", "frame"], tags, "dist", F.col("in_frustum"))
    return found.drop("person_near", "n_person_near_clear")


@query("scenario_actors", f"""WITH {AGENTS} SELECT scene, category, count(DISTINCT instance) AS n, count(DISTINCT instance) FILTER (in_frustum) AS n_in_view, min(fwd) AS range_min, max(fwd) AS range_max,
round(min(speed) FILTER (speed <= 6), 6) AS speed_min, round(max(speed) FILTER (speed <= 6), 6) AS speed_max, count(*) FILTER (speed > 6) AS n_implausible FROM ag GROUP BY scene, category""")
def scenario_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.actors(agents(spark, sf_dir), "scene", 6.0).select("scene", "category", "n", "n_in_view", "range_min", "range_max", *r6("speed_min", "speed_max"), "n_implausible")


@query("one_to_one_check", """SELECT count(*) AS left_rows, count(DISTINCT doc_id) AS left_keys, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(DISTINCT doc_id) FROM labels) AS right_keys,
(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS shared_keys, false AS one_to_one FROM documents""")
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.cardinality(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("join_one_to_one", "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.join_one_to_one(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("lookup_in_order", "SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 64, doc_id) - 1 AS pos, doc_id, lang FROM labels JOIN documents USING (doc_id)")
def lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = re_.numbered(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "pos")  # a list given by the user
    return re_.in_order_of(asked, table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "pos").select("pos", "doc_id", "lang")


@query("last_row_wins", "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.last_by(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("anti_missing", "SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("as_of_join", f"""WITH {KF}, e AS (SELECT user_id, t, value FROM kf WHERE event_type = 'error'), q AS (SELECT user_id, k, t FROM kf WHERE event_type <> 'error')
SELECT q.user_id, q.k, CASE WHEN q.t - e.t <= 24 THEN e.value END AS value_before FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.t >= e.t""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir)
    found = re_.as_of(rows.where("event_type <> 'error'").select("user_id", "k", "t"), rows.where("event_type = 'error'"), "user_id", "t", ["value"], 24.0)
    return found.select("user_id", "k", "value_before")


@query("dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("union_by_name", """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::BIGINT AS part_size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return re_.stack([a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("part_size"))])


@query("set_difference", "SELECT o_custkey AS key FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("key")).subtract(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")))


@query("set_intersection", "SELECT o_custkey AS key FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("key")).intersect(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")))


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("capped_draw", """WITH c AS (SELECT doc_id, source, md5('draw:' || doc_id) AS o FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('draw:' || doc_id), doc_id) <= 12)
SELECT doc_id, source FROM c ORDER BY o, doc_id LIMIT 150""")
def capped_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.capped_draw(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 12, 150, "draw")


@query("stratified_draw", f"""WITH {CELLS}, rare AS (SELECT tag FROM cells WHERE y GROUP BY tag HAVING count(*) < 60), kept AS (SELECT DISTINCT doc_id FROM cells WHERE y AND tag IN (SELECT tag FROM rare)),
rest AS (SELECT DISTINCT doc_id FROM cells WHERE doc_id NOT IN (SELECT doc_id FROM kept) ORDER BY md5('rare:' || doc_id), doc_id LIMIT 50) SELECT doc_id, 'rare' AS reason FROM kept UNION ALL SELECT doc_id, 'drawn' FROM rest""")
def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.rare_kept(cells(spark, sf_dir), "doc_id", 60, 50, "rare", floor=1)


@query("uniform_and_targeted", """WITH u AS (SELECT doc_id, lang FROM documents ORDER BY md5('bdd:' || doc_id), doc_id LIMIT 100),
t AS (SELECT doc_id, lang FROM documents WHERE lang = 'es' AND doc_id NOT IN (SELECT doc_id FROM u) ORDER BY md5('bdd:' || doc_id), doc_id LIMIT 30) SELECT *, 'uniform' AS stratum FROM u UNION ALL SELECT *, 'targeted' FROM t""")
def uniform_and_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.uniform_and_targeted(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", F.col("lang") == "es", 100, 30, "bdd")


@query("quota_cover")
def quota_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cells(spark, sf_dir).where("y").groupBy("source", "tag").agg(F.count("*").alias("n"))
    chosen = sa.quota_cover(counts, "source", "tag", "n", 40)
    return spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate(chosen)], "step int, source string, gain long")


@query("top1_per_scene", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 ORDER BY value DESC, event_id LIMIT 20")
def top1_per_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sa.top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 1)
    return best.orderBy(F.desc("value"), "event_id").limit(20)


@query("rarest_tags", f"""WITH {CELLS}, p AS (SELECT tag, avg(y::INT) AS p FROM cells GROUP BY tag) SELECT array_to_string(list(tag ORDER BY p, tag)[1:2], ',') AS tags FROM p""")
def rarest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cells(spark, sf_dir).groupBy("tag").agg(F.avg(F.col("y").cast("int")).alias("p"))
    return sa.rarest(p, "tag", "p", 2).select(F.array_join("tags", ",").alias("tags"))


@query("panel_thumbnail", f"""WITH {KF}, {RUNS}, m AS (SELECT r.user_id, r.run, k.k, k.value, abs(k.k - (r.first + r.last) / 2.0) AS off FROM runs r JOIN kf k ON k.user_id = r.user_id AND k.k BETWEEN r.first AND r.last)
SELECT user_id, run, k AS thumbnail FROM m QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY floor(value / 100) DESC, off, k) = 1""")
def panel_thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyframes(spark, sf_dir).withColumns({"high": F.col("value") > 100, "score": F.floor(F.col("value") / 100)})
    runs = ev.label_runs(rows, "user_id", "k", ["event_type", "high"]).select("user_id", "run", F.explode(F.sequence("first", "last")).alias("k"))
    return sa.thumbnail(rows.join(runs, ["user_id", "k"]), ["user_id", "run"], "k", "score")


@query("pair_items", f"WITH {KF}, p AS (SELECT user_id, k, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY k)) SELECT * FROM p WHERE before IS NOT NULL AND after IS NOT NULL")
def pair_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.pair_items(keyframes(spark, sf_dir), "user_id", "k", "event_id")


@query("category_style", f"""WITH {AGENTS} SELECT CASE WHEN category LIKE 'vehicle.car%' THEN 'car' WHEN category LIKE 'vehicle.%' THEN 'vehicle' WHEN category LIKE 'human.%' THEN 'person' ELSE 'other' END AS style, count(*) AS n FROM ag GROUP BY 1""")
def category_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = re_.first_match(F.col("category"), [("vehicle.car", "car"), ("vehicle.", "vehicle"), ("human.", "person")], "other")
    return agents(spark, sf_dir).groupBy(style.alias("style")).agg(F.count("*").alias("n"))
