"""Spatial operators on cell keys: every join is on equality of grid cells, with the exact test as a residual."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenemill.functions.scalar import point_in_polygon, rotate, wrap
from scenemill.operators.intervals import coalesce_intervals
from scenemill.operators.relational import cut


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def _covering(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    """The cells that a box touches, as array<struct<cx, cy>>."""
    columns = F.sequence(_cell(x0, size), _cell(x1, size))
    rows = F.sequence(_cell(y0, size), _cell(y1, size))
    return F.flatten(F.transform(columns, lambda a: F.transform(rows, lambda b: F.struct(a.alias("cx"), b.alias("cy")))))


def polygon_boxes(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds the bounding box of the outer rings."""
    xs, ys = F.transform(F.flatten(rings), lambda p: p.x), F.transform(F.flatten(rings), lambda p: p.y)
    return polygons.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def polygons_at(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float, layer: str = "layer", token: str = "token") -> DataFrame:
    """Points with each layer's first polygon (least token) that holds them; points outside all are left out."""
    dealt = polygon_boxes(polygons).withColumn("c", F.explode(_covering(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), cell)))
    dealt = dealt.select(layer, token, "rings", F.col("c.cx").alias("__cx"), F.col("c.cy").alias("__cy"))
    own = points.withColumns({"__cx": _cell(F.col(x), cell), "__cy": _cell(F.col(y), cell)})
    hits = own.join(dealt, ["__cx", "__cy"]).where(point_in_polygon(F.col(x), F.col(y), F.col("rings")))
    return hits.groupBy(*points.columns, layer).agg(F.min(token).alias(token))


def nearest_ahead(
    egos: DataFrame, targets: DataFrame, ego: str, x: str, y: str, heading: str, token: str, tx: str, ty: str, length: float, half_width: float,
    where: Column | None = None, unlike: str | None = None,
) -> DataFrame:
    """Per ego the nearest target point in the corridor ahead (0 to ``length``, ``half_width`` to each side); null without one.

    ``where`` filters the targets; with ``unlike`` only those count that differ from the ego in that column.

    An ego is dealt to the cells within reach of the corridor's far corners.
    """
    reach = (length**2 + half_width**2) ** 0.5
    near = F.explode(_covering(F.col(x) - reach, F.col(x) + reach, F.col(y) - reach, F.col(y) + reach, reach))
    kind = lambda name: [F.col(unlike).alias(name)] if unlike else []
    asks = egos.select(ego, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(heading).alias("__h"), *kind("__kind"), near.alias("__c"))
    asks = asks.withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy")}).drop("__c")
    there = (targets if where is None else targets.where(where)).select(
        F.col(token).alias("__token"), F.col(tx).alias("__tx"), F.col(ty).alias("__ty"), _cell(F.col(tx), reach).alias("__cx"), _cell(F.col(ty), reach).alias("__cy"), *kind("__other")
    )
    u, v = rotate(F.col("__tx") - F.col("__x"), F.col("__ty") - F.col("__y"), F.col("__h"))
    hits = asks.join(there, ["__cx", "__cy"]).withColumns({"__u": u, "__v": v})
    hits = hits.where(F.col("__kind") != F.col("__other")) if unlike else hits
    hits = hits.where(F.col("__u").between(0, length) & (F.abs("__v") <= half_width)).withColumn("__d", F.hypot(F.col("__u"), F.col("__v")))
    best = hits.groupBy(ego).agg(F.min(F.struct("__d", "__token")).alias("b"))
    return egos.join(best, ego, "left").select(*egos.columns, F.col("b.__d").alias("ahead_m"), F.col("b.__token").alias("ahead_token"), F.col("b").isNotNull().alias("is_ahead"))


def _clip(u0: Column, v0: Column, u1: Column, v1: Column, length: float, half: float) -> Column:
    """Whether a segment touches the box [0, length] x [-half, half] (Liang and Barsky)."""
    du, dv = u1 - u0, v1 - v0
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for p, q in ((-du, u0), (du, length - u0), (-dv, v0 + half), (dv, half - v0)):
        r = F.try_divide(q, p)
        outside = outside | ((p == 0) & (q < 0))
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
    return ~outside & (low <= high)


def polygons_ahead(
    egos: DataFrame, polygons: DataFrame, ego: str, x: str, y: str, heading: str, length: float, half_width: float, cell: float, layer: str = "layer", token: str = "token",
    where: Column | None = None,
) -> DataFrame:
    """Per ego and layer the nearest polygon that the corridor ahead touches, by distance from the ego (0 inside); ``where`` filters the polygons."""
    polygons = polygons if where is None else polygons.where(where)
    reach = (length**2 + half_width**2) ** 0.5
    asks = egos.withColumn("__c", F.explode(_covering(F.col(x) - reach, F.col(x) + reach, F.col(y) - reach, F.col(y) + reach, cell)))
    asks = asks.select(F.col(ego).alias("__ego"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(heading).alias("__h"), F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    dealt = polygon_boxes(polygons).withColumn("__c", F.explode(_covering(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), cell)))
    dealt = dealt.select(layer, token, F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    pairs = asks.join(dealt, ["__cx", "__cy"]).select("__ego", "__x", "__y", "__h", layer, token).distinct()
    pairs = pairs.join(polygons.select(layer, token, "rings"), [layer, token])
    inside = point_in_polygon(F.col("__x"), F.col("__y"), F.col("rings"))
    # A box inside the polygon touches no edge: one of its corners is then inside.
    corner = point_in_polygon(F.col("__x") - half_width * -F.sin("__h"), F.col("__y") - half_width * F.cos("__h"), F.col("rings"))
    rows = pairs.withColumns({"__inside": inside, "__corner": corner}).withColumn("ring", F.explode("rings")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)))
    a, b = F.get("ring", F.col("i")), F.get("ring", F.pmod(F.col("i") + 1, F.size("ring")))
    u0, v0 = rotate(a.x - F.col("__x"), a.y - F.col("__y"), F.col("__h"))
    u1, v1 = rotate(b.x - F.col("__x"), b.y - F.col("__y"), F.col("__h"))
    rows = rows.withColumns({"u0": u0, "v0": v0, "u1": u1, "v1": v1})
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(F.col("u0") * du + F.col("v0") * dv), du * du + dv * dv), F.lit(0.0))))
    rows = rows.withColumns({"__touch": _clip(F.col("u0"), F.col("v0"), F.col("u1"), F.col("v1"), length, half_width), "__d": F.hypot(F.col("u0") + at * du, F.col("v0") + at * dv)})
    each = rows.groupBy("__ego", layer, token).agg(F.bool_or(F.col("__touch") | F.col("__inside") | F.col("__corner")).alias("touch"), F.min(F.when(F.col("__inside"), 0.0).otherwise(F.col("__d"))).alias("d"))
    best = each.where("touch").groupBy("__ego", layer).agg(F.min(F.struct("d", token)).alias("b"))
    return best.select(F.col("__ego").alias(ego), layer, F.col("b.d").alias("ahead_m"), F.col(f"b.{token}").alias(token))


def map_context(
    points: DataFrame, polygons: DataFrame, lights: DataFrame, key: str, x: str, y: str, yaw: str, length: float = 30.0, half_width: float = 4.0, cell: float = 30.0
) -> DataFrame:
    """Where each point is and what lies ahead: seven containments, four distances ahead with their flags, and the stop line's type.

    ``polygons(layer, token, is_intersection, kind, rings)`` of the layers drivable_area, road_segment, lane, ped_crossing, walkway,
    stop_line and carpark_area; ``lights(light, lx, ly)``. Distances are null where the corridor ahead holds nothing.
    The points and each of the three searches are written (``cut``): the driver plans and runs them one after the other.
    """
    points = cut(points.select(key, x, y, yaw))
    inside = polygons_at(points.select(key, x, y), polygons, x, y, cell)
    crossing = polygons.where("layer = 'road_segment' and is_intersection").select("layer", "token", F.lit(True).alias("__crossing"))
    inside = inside.join(crossing, ["layer", "token"], "left")
    on = lambda layer: F.bool_or(F.col("layer") == layer)
    names = {"on_drivable_area": "drivable_area", "on_lane": "lane", "on_ped_crossing": "ped_crossing", "on_walkway": "walkway", "on_stop_line": "stop_line", "on_carpark": "carpark_area"}
    at = inside.groupBy(key).agg(*[on(layer).alias(name) for name, layer in names.items()], F.bool_or(F.coalesce("__crossing", F.lit(False))).alias("at_intersection"))
    wanted = F.col("layer").isin("ped_crossing", "stop_line") | ((F.col("layer") == "road_segment") & F.col("is_intersection"))
    ahead = polygons_ahead(points, polygons, key, x, y, yaw, length, half_width, cell, where=wanted)
    kinds = polygons.where("layer = 'stop_line'").select("layer", "token", F.col("kind").alias("__kind"))
    ahead = ahead.join(kinds, ["layer", "token"], "left")
    pick = lambda layer, c: F.max(F.when(F.col("layer") == layer, F.col(c)))
    ahead = ahead.groupBy(key).agg(
        pick("ped_crossing", "ahead_m").alias("ped_crossing_ahead_m"), pick("stop_line", "ahead_m").alias("stop_line_ahead_m"), pick("road_segment", "ahead_m").alias("intersection_ahead_m"),
        pick("stop_line", "__kind").alias("stop_line_ahead_type"),
    )
    lit = nearest_ahead(points.select(key, x, y, yaw), lights, key, x, y, yaw, "light", "lx", "ly", length, half_width).select(key, F.col("ahead_m").alias("traffic_light_ahead_m"))
    rows = points.select(key)
    for found in (at, ahead, lit):
        rows = rows.join(cut(found), key, "left")
    flags = [*names, "at_intersection"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    return rows.withColumns({f"{c}_ahead": F.col(f"{c}_ahead_m").isNotNull() for c in ("ped_crossing", "stop_line", "intersection", "traffic_light")})


def nearest_within(
    asks: DataFrame, points: DataFrame, ask: str, token: str, x: str, y: str, radius: float, unlike: str | None = None, heading: str | None = None, parallel: float | None = None
) -> DataFrame:
    """Per ask the nearest point within ``radius`` (least token on ties), exact: cells as wide as the radius, 3 x 3 of them.

    With ``heading`` and ``parallel`` only points count whose heading differs by at most ``parallel`` radians; with
    ``unlike`` only those that differ from the ask in that column.
    """
    around = F.explode(_covering(F.col(x) - radius, F.col(x) + radius, F.col(y) - radius, F.col(y) + radius, radius))
    kind = lambda name: [F.col(unlike).alias(name)] if unlike else []
    own = asks.select(F.col(ask), F.col(x).alias("__x"), F.col(y).alias("__y"), *([F.col(heading).alias("__h")] if heading else []), *kind("__kind"), around.alias("__c"))
    own = own.withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy")}).drop("__c")
    there = points.withColumns({"__cx": _cell(F.col(x), radius), "__cy": _cell(F.col(y), radius)})
    there = there.select("__cx", "__cy", F.col(token).alias("__token"), F.col(x).alias("__px"), F.col(y).alias("__py"), *([F.col(heading).alias("__ph")] if heading else []), *kind("__other"))
    rows = own.join(there, ["__cx", "__cy"]).withColumn("__d", F.hypot(F.col("__px") - F.col("__x"), F.col("__py") - F.col("__y"))).where(F.col("__d") <= radius)
    if heading:
        rows = rows.where(F.abs(wrap(F.col("__ph") - F.col("__h"))) <= parallel)
    if unlike:
        rows = rows.where(F.col("__kind") != F.col("__other"))
    return rows.groupBy(ask).agg(F.min(F.struct("__d", "__token")).alias("b"), F.count("*").alias("n_near")).select(ask, F.col("b.__token").alias(token), F.col("b.__d").alias("distance"), "n_near")


def line_arrays(line: DataFrame, line_id: str, seq: str, px: str, py: str) -> DataFrame:
    """One row per line of at least two vertices: ``line_id, pts``, its vertices in order as array<struct<x, y>>."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(px).cast("double").alias("x"), F.col(py).cast("double").alias("y"))))
    found = line.groupBy(line_id).agg(F.transform(ordered, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("pts"))
    return found.where(F.size("pts") >= 2)


def with_offset(rows: DataFrame, pts: str, x: str, y: str, prefix: str = "") -> DataFrame:
    """Adds, for the line in ``pts``, the ``offset`` of (x, y) from it (left of its direction is positive), its ``heading`` and the
    ``distance`` of its nearest vertex, all by the segment that starts there (the last one at the end)."""
    near = F.array_min(F.transform(F.sequence(F.lit(0), F.size(pts) - 1), lambda i: F.struct(F.hypot(F.get(pts, i).x - F.col(x), F.get(pts, i).y - F.col(y)).alias("d"), i.alias("i"))))
    rows = rows.withColumn("__near", near)
    i = F.least(F.col("__near.i"), F.size(pts) - 2)
    rows = rows.withColumns({"__a": F.get(pts, i), "__b": F.get(pts, i + 1)})
    dx, dy = F.col("__b.x") - F.col("__a.x"), F.col("__b.y") - F.col("__a.y")
    offset = F.try_divide(dx * (F.col(y) - F.col("__a.y")) - dy * (F.col(x) - F.col("__a.x")), F.hypot(dx, dy))
    return rows.withColumns({f"{prefix}offset": offset, f"{prefix}heading": F.atan2(dy, dx), f"{prefix}distance": F.col("__near.d")}).drop("__near", "__a", "__b")


def signed_offset(rows: DataFrame, line: DataFrame, key: str, x: str, y: str, line_id: str, seq: str, px: str, py: str) -> DataFrame:
    """Signed distance of each row's point from its line at the nearest vertex: left of the line's direction is positive.

    A line is one row with its vertices as an array, joined by its id; no row is repeated per vertex.
    """
    near = with_offset(rows.join(line_arrays(line, line_id, seq, px, py), line_id), "pts", x, y, "__")
    return near.select(key, line_id, F.col("__offset").alias("offset"), F.col("__heading").alias("line_heading"), F.col("__distance").alias("min_distance"))


def nearest_parallel(
    asks: DataFrame, line: DataFrame, ask: list[str], x: str, y: str, heading: str, line_id: str, seq: str, px: str, py: str, radius: float = 8.0, parallel: float = 35.0
) -> DataFrame:
    """Per ask the nearest line with a vertex within ``radius`` whose heading there differs by at most ``parallel`` degrees: ``line, distance``.

    The least distance counts per line, then over lines (least id on ties); asks without such a line are left out.
    Cells are as wide as the radius, so an ask meets the vertices of 3 x 3 of them and no others.
    """
    w = Window.partitionBy(line_id).orderBy(seq)
    after, before = F.lead(F.struct(px, py)).over(w), F.lag(F.struct(px, py)).over(w)
    h = F.coalesce(F.atan2(after[py] - F.col(py), after[px] - F.col(px)), F.atan2(F.col(py) - before[py], F.col(px) - before[px]))
    there = line.withColumn("__h", h).select(F.col(line_id).alias("__line"), F.col(px).alias("__px"), F.col(py).alias("__py"), "__h", _cell(F.col(px), radius).alias("__cx"), _cell(F.col(py), radius).alias("__cy"))
    around = F.explode(_covering(F.col(x) - radius, F.col(x) + radius, F.col(y) - radius, F.col(y) + radius, radius))
    own = asks.withColumn("__c", around)
    own = own.select(*ask, F.col(x).alias("__ax"), F.col(y).alias("__ay"), F.col(heading).alias("__ah"), F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    hits = own.join(there, ["__cx", "__cy"]).withColumn("__d", F.hypot(F.col("__px") - F.col("__ax"), F.col("__py") - F.col("__ay")))
    hits = hits.where((F.col("__d") <= radius) & (F.abs(wrap(F.col("__h") - F.col("__ah"))) <= F.radians(F.lit(float(parallel)))))
    each = hits.groupBy(*ask, "__line").agg(F.min("__d").alias("__d"))
    return each.groupBy(*ask).agg(F.min(F.struct("__d", "__line")).alias("b")).select(*ask, F.col("b.__line").alias("line"), F.col("b.__d").alias("distance"))


def into(turn, v: list[Column]) -> list[Column]:
    """A world vector in a frame: ``turn`` is the frame's unit quaternion, or a function that turns vectors, as where the axes are plain."""
    return turn(v) if callable(turn) else quaternion_rotate(turn, v, inverse=True)


def by_yaw(yaw: Column):
    """For ``into``: a frame turned by ``yaw`` about z alone, without the half angles of a quaternion and their rounding."""
    return lambda v: [*rotate(v[0], v[1], yaw), v[2]]


def quaternion_rotate(q: list[Column], v: list[Column], inverse: bool = False) -> list[Column]:
    """A vector turned by a unit quaternion (w, x, y, z), or back."""
    w, x, y, z = q
    if inverse:
        x, y, z = -x, -y, -z
    a, b, c = v
    tx, ty, tz = 2 * (y * c - z * b), 2 * (z * a - x * c), 2 * (x * b - y * a)
    return [a + w * tx + y * tz - z * ty, b + w * ty + z * tx - x * tz, c + w * tz + x * ty - y * tx]


def project(point: list[Column], origin: list[Column], q: list[Column], focal: float, width: float, height: float, least_depth: float = 0.1) -> dict[str, Column]:
    """World point to a pinhole camera at ``origin`` turned by ``q``: depth, pixel and whether it is in the image."""
    x, y, z = quaternion_rotate(q, [p - o for p, o in zip(point, origin)], inverse=True)
    u, v = F.try_divide(focal * x, z) + width / 2, F.try_divide(focal * y, z) + height / 2
    seen = (z > least_depth) & u.between(0, width) & v.between(0, height)
    return {"depth": z, "u": u, "v": v, "in_image": F.coalesce(seen, F.lit(False))}


def box_in_image(corners: list[dict[str, Column]]) -> Column:
    """A box is visible if any of its corners is."""
    out = F.lit(False)
    for c in corners:
        out = out | c["in_image"]
    return out


def traversals(rows: DataFrame, by: list[str], order: str, x: str, y: str, cx: Column, cy: Column, yaw: str, around: float, turned: float, least_ratio: float) -> DataFrame:
    """Passages around a centre: total angle about it and total heading change, unwrapped, in degrees, of one sign."""
    w = Window.partitionBy(*by).orderBy(order)
    angle = F.atan2(F.col(y) - cy, F.col(x) - cx)
    rows = rows.withColumn("__a", angle)
    step = lambda c: F.coalesce(wrap(F.col(c) - F.lag(c).over(w)), F.lit(0.0))
    rows = rows.withColumns({"__da": step("__a"), "__dy": step(yaw)})
    total = rows.groupBy(*by).agg(F.degrees(F.sum("__da")).alias("around_deg"), F.degrees(F.sum("__dy")).alias("turned_deg"), F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    enough = (F.abs("around_deg") >= around) & (F.abs("turned_deg") >= turned) & (F.signum("around_deg") == F.signum("turned_deg"))
    return total.where(enough & (F.try_divide(F.abs("turned_deg"), F.abs("around_deg")) >= least_ratio))


def _turn(step: Column) -> Column:
    """A step between angles as unwrapping takes it: what lies within pi stays."""
    return F.when(F.abs(step) <= F.pi(), step).otherwise(wrap(step))


def island_traversals(
    rows: DataFrame, islands: DataFrame, scene: str, order: str, x: str, y: str, yaw: str, pad: float = 22.0, around: float = 90.0, turned: float = 60.0,
    least_ratio: float = 0.45, cell: float = 50.0,
) -> DataFrame:
    """Passages around islands ``island, ix, iy, area``: ``angle_around``, ``heading_sweep`` (degrees) and their ratio, of one sign.

    A scene and an island are a pair if the track comes within the island's radius and ``pad`` of its centre, found
    over cells; the angles are then those of the scene's whole track about the island.
    """
    reach = F.sqrt(F.col("area") / F.pi()) + pad
    dealt = islands.withColumn("__r", reach).withColumn("__c", F.explode(_covering(F.col("ix") - F.col("__r"), F.col("ix") + F.col("__r"), F.col("iy") - F.col("__r"), F.col("iy") + F.col("__r"), cell)))
    dealt = dealt.select("island", "ix", "iy", "area", "__r", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    own = rows.select(scene, F.col(x).alias("__x"), F.col(y).alias("__y"), _cell(F.col(x), cell).alias("__cx"), _cell(F.col(y), cell).alias("__cy"))
    met = own.join(dealt, ["__cx", "__cy"]).where(F.hypot(F.col("__x") - F.col("ix"), F.col("__y") - F.col("iy")) <= F.col("__r"))
    pairs = met.select(scene, "island", "ix", "iy", "area").distinct()
    track = rows.select(scene, order, x, y, yaw).join(pairs, scene).withColumn("__a", F.atan2(F.col(y) - F.col("iy"), F.col(x) - F.col("ix")))
    w = Window.partitionBy(scene, "island").orderBy(order)
    step = lambda c: F.coalesce(_turn(F.col(c) - F.lag(c).over(w)), F.lit(0.0))
    total = track.withColumns({"__da": step("__a"), "__dy": step(yaw)}).groupBy(scene, "island", "ix", "iy", "area").agg(
        F.degrees(F.sum("__da")).alias("angle_around"), F.degrees(F.sum("__dy")).alias("heading_sweep")
    )
    total = total.withColumn("sweep_ratio", F.try_divide(F.abs("heading_sweep"), F.abs("angle_around")))
    enough = (F.abs("angle_around") >= around) & (F.abs("heading_sweep") >= turned) & (F.signum("angle_around") == F.signum("heading_sweep"))
    return total.where(enough & (F.col("sweep_ratio") >= least_ratio))


def circulatory_winding(
    islands: DataFrame, line: DataFrame, successors: DataFrame, line_id: str, seq: str, px: str, py: str, pad: float = 25.0, depth: int = 14, least: float = 300.0, cell: float = 50.0
) -> DataFrame:
    """Per island the most degrees that a directed path of at most ``depth`` lanes near it winds about its centre: ``winding, lanes, is_roundabout``.

    Near are lanes with a vertex within the island's radius and ``pad``, found over cells. Of a lane only its own winding
    and its first and last angle count, since the winding of a path is the sum of its lanes' and of the steps between
    them; the paths of one island are then searched in one task, which holds that island's lanes alone.
    """
    reach = F.sqrt(F.col("area") / F.pi()) + pad
    dealt = islands.withColumn("__r", reach).withColumn("__c", F.explode(_covering(F.col("ix") - F.col("__r"), F.col("ix") + F.col("__r"), F.col("iy") - F.col("__r"), F.col("iy") + F.col("__r"), cell)))
    dealt = dealt.select("island", "ix", "iy", "__r", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    vertices = line.withColumns({"__cx": _cell(F.col(px), cell), "__cy": _cell(F.col(py), cell)})
    near = vertices.join(dealt, ["__cx", "__cy"]).where(F.hypot(F.col(px) - F.col("ix"), F.col(py) - F.col("iy")) < F.col("__r"))
    near = near.select("island", "ix", "iy", line_id).distinct()
    angle = F.atan2(F.col(py) - F.col("iy"), F.col(px) - F.col("ix"))
    w = Window.partitionBy("island", line_id).orderBy(seq)
    turns = line.select(line_id, seq, px, py).join(near, line_id).withColumn("__a", angle).withColumn("__d", F.coalesce(_turn(F.col("__a") - F.lag("__a").over(w)), F.lit(0.0)))
    lanes = turns.groupBy("island", line_id).agg(F.sum("__d").alias("own"), F.min_by("__a", seq).alias("first"), F.max_by("__a", seq).alias("last"))
    onward = successors.groupBy(F.col("src").alias(line_id)).agg(F.collect_set("dst").alias("onward"))
    lanes = lanes.join(onward, line_id, "left").select("island", F.col(line_id).cast("string").alias("lane"), "own", "first", "last", F.col("onward").cast("array<string>").alias("onward"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        own = {r.lane: (r.own, r.first, r.last) for r in frame.itertuples()}
        onward_ = {r.lane: [] if r.onward is None else [o for o in r.onward if o in own] for r in frame.itertuples()}
        best, lanes_ = 0.0, 0
        for lane in own:
            todo = [(lane, own[lane][0], (lane,))]
            while todo:
                at, wound, path = todo.pop()
                if abs(wound) > best + 1e-12 or (abs(wound) > best - 1e-12 and 0 < len(path) < lanes_):
                    best, lanes_ = max(best, abs(wound)), len(path)
                if len(path) < depth:
                    for other in onward_[at]:
                        if other not in path:
                            step = own[other][1] - own[at][2]
                            step = step if abs(step) <= math.pi else (step + math.pi) % (2 * math.pi) - math.pi
                            todo.append((other, wound + step + own[other][0], (*path, other)))
        return pd.DataFrame({"island": [frame["island"].iloc[0]], "winding": [math.degrees(best)], "lanes": [lanes_]})

    kind = islands.schema["island"].dataType.simpleString()
    found = lanes.groupBy("island").applyInPandas(search, f"island {kind}, winding double, lanes int")
    found = islands.select("island").join(found, "island", "left")
    found = found.select("island", F.coalesce("winding", F.lit(0.0)).alias("winding"), F.coalesce("lanes", F.lit(0)).alias("lanes"))
    return found.withColumn("is_roundabout", F.col("winding") >= least)


def island_filter(holes: DataFrame, area: str, perimeter: str, least: float = 5.0, most: float = 1500.0, compact: float = 0.55) -> DataFrame:
    """Holes of an island's size and roundness (4 pi area / perimeter squared)."""
    roundness = F.try_divide(4 * F.pi() * F.col(area), F.col(perimeter) * F.col(perimeter))
    return holes.withColumn("compactness", roundness).where(F.col(area).between(least, most) & (F.col("compactness") >= compact))


def ring_measures(ring: Column) -> tuple[Column, Column]:
    """Area and perimeter of a ring of struct(x, y)."""
    index = F.sequence(F.lit(0), F.size(ring) - 1)
    following = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    cross = F.aggregate(index, F.lit(0.0), lambda acc, i: acc + F.get(ring, i).x * following(i).y - following(i).x * F.get(ring, i).y)
    length = F.aggregate(index, F.lit(0.0), lambda acc, i: acc + F.hypot(following(i).x - F.get(ring, i).x, following(i).y - F.get(ring, i).y))
    return F.abs(cross) / 2, length


def simple_paths(edges: DataFrame, depth: int) -> DataFrame:
    """Paths of a directed graph without a repeated node, up to ``depth`` nodes: ``path`` arrays.

    The graph is a map's lanes, so each round is one join on what the round before has written; paths are what is
    asked for here, so they are all kept.
    """
    out = paths = edges.select(F.array("src").alias("path")).distinct()
    for _ in range(depth - 1):
        longer = paths.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = cut(longer.select(F.concat("path", F.array("dst")).alias("path")))
        out = out.unionByName(paths)
    return out


def fit_circle(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kasa's least squares circle per group from moments about the mean: centre and radius; null where the points are on a line."""
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"__mx": F.avg(x).over(w), "__my": F.avg(y).over(w)})
    u, v = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    s = lambda c: F.sum(c)
    m = rows.groupBy(*by).agg(
        F.first("__mx").alias("mx"), F.first("__my").alias("my"), F.count("*").alias("n"), s(u * u).alias("uu"), s(v * v).alias("vv"), s(u * v).alias("uv"),
        s(u * u * u + u * v * v).alias("a"), s(v * v * v + v * u * u).alias("b"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    cu, cv = F.try_divide((F.col("a") * F.col("vv") - F.col("b") * F.col("uv")) / 2, det), F.try_divide((F.col("b") * F.col("uu") - F.col("a") * F.col("uv")) / 2, det)
    return m.select(*by, (F.col("mx") + cu).alias("cx"), (F.col("my") + cv).alias("cy"), F.sqrt(cu * cu + cv * cv + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"))


def token_flips(rows: DataFrame, key: str, k: str, lane: str, successors: DataFrame, look_back: int = 4) -> DataFrame:
    """Changes of lane token between rows at most ``look_back`` unmapped rows apart that are not to a successor lane."""
    w = Window.partitionBy(key).orderBy(k)
    known = F.when(F.col(lane).isNotNull(), F.struct(k, lane))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flips = rows.withColumn("__b", before).where(F.col(lane).isNotNull() & (F.col(f"__b.{lane}") != F.col(lane)) & (F.col(k) - F.col(f"__b.{k}") - 1 <= look_back))
    flips = flips.select(key, F.col(f"__b.{k}").alias("kf0"), F.col(k).alias("kf1"), F.col(f"__b.{lane}").alias("src"), F.col(lane).alias("dst"))
    return flips.join(successors, ["src", "dst"], "left_anti")


def settlement_pairs(rows: DataFrame, key: str, k: str, t: str, line: str, offset: str, settled: float, longest: float) -> DataFrame:
    """Consecutive rows settled on a line (within ``settled``), on different lines and at most ``longest`` apart in time."""
    w = Window.partitionBy(key).orderBy(k)
    near = rows.where(F.abs(offset) <= settled)
    pairs = near.withColumns({"__k": F.lag(k).over(w), "__t": F.lag(t).over(w), "__l": F.lag(line).over(w)})
    gap = F.col(t) - F.col("__t")
    return pairs.where((F.col("__l") != F.col(line)) & (gap > 0) & (gap <= longest)).select(key, F.col("__k").alias("kf0"), F.col(k).alias("kf1"), F.col("__l").alias("src"), F.col(line).alias("dst"), gap.alias("duration"))


def lane_changes(
    rows: DataFrame, line: DataFrame, successors: DataFrame, key: str, k: str, x: str, y: str, yaw: str, speed: str, straight: str, lane: str, line_id: str, seq: str, px: str, py: str,
    step_s: float = 0.5, look_back: int = 4, sep: tuple[float, float] = (1.8, 7.0), rate: float = 2.0, least_speed: float = 2.0, lines_within: float = 25.0, yaw_within: float = 45.0,
    settled: float = 0.9, longest: float = 8.0, radius: float = 8.0, parallel: float = 35.0,
) -> DataFrame:
    """Changes of lane as intervals ``kf0, kf1, detector, window_clamped``: two detectors, overlapping or adjacent finds made one.

    *token_flip*: the lane token changes between rows with at most ``look_back`` rows without a token in between, not to a
    successor; all rows between are straight, the speed is ``least_speed`` or more, the two lines' headings are within
    ``lines_within`` degrees of each other and the yaw within ``yaw_within`` of the new one's, the lines are ``sep`` apart
    sideways at the new position, and over more than one step no faster than ``rate``. The interval is padded to the time that
    the crossing takes at ``rate``, and clamped to the key's rows.
    *settlement*: consecutive rows within ``settled`` of their nearest parallel line are on different lines that are ``sep``
    apart, at most ``longest`` seconds and no faster than ``rate``, straight throughout and at ``least_speed`` in the mean.
    """
    w = Window.partitionBy(key).orderBy(k)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bent = (~F.coalesce(F.col(straight), F.lit(False))).cast("int")
    whole = Window.partitionBy(key)
    base = rows.select(key, k, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(yaw).alias("__yaw"), F.col(speed).alias("__v"), bent.alias("__bent"), F.col(lane).alias("__lane"))
    base = base.withColumns(
        {"__i": F.row_number().over(w), "__bends": F.sum("__bent").over(upto), "__vs": F.sum("__v").over(upto), "__lo": F.min(k).over(whole), "__hi": F.max(k).over(whole)}
    )
    arrays = line_arrays(line, line_id, seq, px, py)
    state = F.struct(F.col("__i").alias("i"), F.col(k).alias("k"), F.col("__lane").alias("lane"), (F.col("__bends") - F.col("__bent")).alias("bends"), (F.col("__vs") - F.col("__v")).alias("vs"))
    # -- token flips
    before = F.last(F.when(F.col("__lane").isNotNull(), state), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flips = base.withColumn("__p", before).where(F.col("__lane").isNotNull() & (F.col("__p.lane") != F.col("__lane")))
    flips = flips.where((F.col("__i") - F.col("__p.i") <= look_back + 1) & (F.col("__bends") == F.col("__p.bends")) & (F.col("__v") >= least_speed))
    flips = flips.withColumns({"src": F.col("__p.lane"), "dst": F.col("__lane")}).join(successors.select("src", "dst"), ["src", "dst"], "left_anti")
    named = lambda name, pts: arrays.select(F.col(line_id).alias(name), F.col("pts").alias(pts))
    flips = flips.join(named("src", "__old"), "src").join(named("dst", "__new"), "dst")
    flips = with_offset(with_offset(flips, "__old", "__x", "__y", "__o"), "__new", "__x", "__y", "__n")
    flips = flips.where(F.abs(wrap(F.col("__oheading") - F.col("__nheading"))) <= F.radians(F.lit(float(lines_within))))
    flips = flips.where(F.abs(wrap(F.col("__yaw") - F.col("__nheading"))) <= F.radians(F.lit(float(yaw_within))))
    flips = flips.withColumns({"__sep": F.abs(F.col("__ooffset") - F.col("__noffset")), "__span": (F.col(k) - F.col("__p.k")) * step_s})
    flips = flips.where(F.col("__sep").between(*sep) & ~((F.col("__span") > step_s) & (F.col("__sep") / F.col("__span") > rate)))
    need = F.ceil(F.col("__sep") / rate / step_s)
    pad = F.greatest(F.lit(0), F.ceil((need - (F.col("__i") - F.col("__p.i"))) / 2))
    flips = flips.withColumns({"__a": F.col("__p.k") - pad, "__b": F.col(k) + pad})
    flips = flips.select(
        key, F.greatest("__lo", "__a").cast("long").alias("kf0"), F.least("__hi", "__b").cast("long").alias("kf1"), F.lit("token_flip").alias("detector"),
        ((F.col("__a") < F.col("__lo")) | (F.col("__b") > F.col("__hi"))).alias("window_clamped"),
    )
    # -- settlement pairs
    on = nearest_parallel(base, line, [key, k], "__x", "__y", "__yaw", line_id, seq, px, py, radius, parallel).where(F.col("distance") <= settled)
    calm = base.join(on.select(key, k, F.col("line").alias("__line")), [key, k])
    own = F.struct(F.col("__i").alias("i"), F.col(k).alias("k"), F.col("__line").alias("line"), (F.col("__bends") - F.col("__bent")).alias("bends"), (F.col("__vs") - F.col("__v")).alias("vs"))
    pairs = calm.withColumn("__p", F.lag(own).over(w)).where(F.col("__p.line") != F.col("__line")).withColumn("__from", F.col("__p.line"))
    pairs = with_offset(pairs.join(named("__from", "__old"), "__from"), "__old", "__x", "__y", "__o")
    pairs = pairs.withColumns({"__sep": F.abs("__ooffset"), "__span": (F.col(k) - F.col("__p.k")) * step_s})
    mean = (F.col("__vs") - F.col("__p.vs")) / (F.col("__i") - F.col("__p.i") + 1)
    pairs = pairs.where(
        F.col("__sep").between(*sep) & (F.col("__span") > 0) & (F.col("__span") <= longest) & (F.col("__sep") / F.col("__span") <= rate) & (F.col("__bends") == F.col("__p.bends")) & (mean >= least_speed)
    )
    pairs = pairs.select(key, F.col("__p.k").cast("long").alias("kf0"), F.col(k).cast("long").alias("kf1"), F.lit("settlement").alias("detector"), F.lit(False).alias("window_clamped"))
    return coalesce_intervals(flips.unionByName(pairs), [key], "kf0", "kf1", "detector", any_of=["window_clamped"])


def _bound(side, inside, cross):
    """A lambda of one argument, as transform() counts them."""
    return lambda points: side(points, inside, cross)


def clip_ring(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A ring of struct(x, y) cut to a box, side by side (Sutherland and Hodgman); empty where nothing is left.

    Rings that cross themselves are split first (``repaired``), or the parts' areas would cancel.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def side(points: Column, inside, cross) -> Column:
        def step(i: Column) -> Column:
            a, b = F.get(points, F.pmod(i - 1 + F.size(points), F.size(points))), F.get(points, i)
            entering, leaving = ~inside(a) & inside(b), inside(a) & ~inside(b)
            return F.when(entering, F.array(cross(a, b), point(b.x, b.y))).when(leaving, F.array(cross(a, b))).when(inside(b), F.array(point(b.x, b.y))).otherwise(F.slice(F.array(point(b.x, b.y)), 1, 0))

        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(points) - 1), step))
        return F.when(F.size(points) == 0, points).otherwise(kept)

    at_x = lambda v: lambda a, b: point(F.lit(v), a.y + F.try_divide((v - a.x) * (b.y - a.y), b.x - a.x))
    at_y = lambda v: lambda a, b: point(a.x + F.try_divide((v - a.y) * (b.x - a.x), b.y - a.y), F.lit(v))
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    out = F.transform(ring, lambda p: point(p.x, p.y))
    for inside, cross in (
        (lambda p: p.x >= x0, at_x(x0)), (lambda p: p.x <= x1, at_x(x1)), (lambda p: p.y >= y0, at_y(y0)), (lambda p: p.y <= y1, at_y(y1)),
    ):
        out = let(out, _bound(side, inside, cross))
    return out


def layer_geometry(
    egos: DataFrame, polygons: DataFrame, ego: str, x: str, y: str, heading: str, location: str, radius: float, layer: str = "layer", bearings: tuple[float, ...] = (0.0, 90.0, -90.0, 180.0)
) -> DataFrame:
    """Per ego and layer of its location within ``radius``: ``on_it``, ``range`` and ``bearing`` (degrees, left positive) of the nearest
    point (0 on it), and ``reach``: along each bearing how far the layer's farthest point on that ray is, within the radius.

    Polygons are dealt to the cells that their box, grown by the radius, touches; an ego meets those of its own cell. Edges
    stay in an array per polygon, so a pair is one row whatever the polygon's length.
    """
    edge = lambda ring, i: F.struct(
        F.get(ring, i).x.alias("ax"), F.get(ring, i).y.alias("ay"), F.get(ring, F.pmod(i + 1, F.size(ring))).x.alias("bx"), F.get(ring, F.pmod(i + 1, F.size(ring))).y.alias("by")
    )
    edges = F.flatten(F.transform("rings", lambda ring: F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: edge(ring, i))))
    dealt = polygon_boxes(polygons).withColumn("__edges", edges)
    dealt = dealt.withColumn("__c", F.explode(_covering(F.col("x0") - radius, F.col("x1") + radius, F.col("y0") - radius, F.col("y1") + radius, radius)))
    dealt = dealt.select(F.col(location).alias("__where"), layer, "rings", "__edges", F.col("__c.cx").alias("__cx"), F.col("__c.cy").alias("__cy"))
    own = egos.select(F.col(ego), F.col(location).alias("__where"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(heading).alias("__h"))
    own = own.withColumns({"__cx": _cell(F.col("__x"), radius), "__cy": _cell(F.col("__y"), radius)})
    px, py, h = F.col("__x"), F.col("__y"), F.col("__h")

    def nearest(e: Column) -> Column:
        dx, dy = e.bx - e.ax, e.by - e.ay
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - e.ax) * dx + (py - e.ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
        u, v = rotate(e.ax + at * dx - px, e.ay + at * dy - py, h)
        return F.struct(F.hypot(u, v).alias("d"), F.degrees(F.atan2(v, u)).alias("b"))

    def reach(bearing: float) -> Column:
        ux, uy = F.cos(h + math.radians(bearing)), F.sin(h + math.radians(bearing))

        def crossing(e: Column) -> Column:
            dx, dy = e.bx - e.ax, e.by - e.ay
            cross = ux * dy - uy * dx
            t = F.try_divide((e.ax - px) * dy - (e.ay - py) * dx, cross)
            s = F.try_divide((e.ax - px) * uy - (e.ay - py) * ux, cross)
            return F.when(t.between(0.0, radius) & s.between(0.0, 1.0), t).otherwise(0.0)

        end = point_in_polygon(px + radius * ux, py + radius * uy, F.col("rings"))
        return F.when(end, F.lit(float(radius))).otherwise(F.array_max(F.transform("__edges", crossing)))

    rows = own.join(dealt, ["__where", "__cx", "__cy"]).withColumns(
        {"__on": point_in_polygon(px, py, F.col("rings")), "__near": F.array_min(F.transform("__edges", nearest)), "__reach": F.array(*[reach(b) for b in bearings])}
    )
    best = rows.groupBy(ego, layer).agg(F.bool_or("__on").alias("on_it"), F.min("__near").alias("n"), *[F.max(F.get("__reach", F.lit(i))).alias(f"r{i}") for i in range(len(bearings))])
    best = best.where(F.col("on_it") | (F.col("n.d") <= radius))
    return best.select(
        ego, layer, "on_it", F.when(F.col("on_it"), 0.0).otherwise(F.col("n.d")).alias("range"), F.when(F.col("on_it"), 0.0).otherwise(F.col("n.b")).alias("bearing"),
        F.array(*[F.col(f"r{i}") for i in range(len(bearings))]).alias("reach"),
    )


def lights_in_view(
    frames: DataFrame, lights: DataFrame, frame: str, location: str, ego: tuple, camera: tuple,
    focal: float, width: float, height: float, most_m: float = 50.0, least_depth: float = 0.1,
) -> DataFrame:
    """Per frame the lights ``x, y, z`` of its location that fall in its image within ``most_m`` of the camera: ``n_in_view, nearest_m``.

    ``ego`` and ``camera`` are (origin, turn) of the vehicle in the world and of the camera in the vehicle, turns as ``into`` takes
    them. Lights are met over cells as wide as ``most_m``, those that lie within it and the camera's distance of the vehicle's
    x and y. Frames without a light stay, with 0 and null. Lights that are few may come with a broadcast hint; frames are never broadcast.
    """
    (ox, oy, _), (cx, cy, cz) = ego[0], camera[0]
    reach = F.sqrt(cx * cx + cy * cy + cz * cz) + most_m
    around = F.explode(_covering(ox - reach, ox + reach, oy - reach, oy + reach, most_m))
    asks = frames.withColumn("__c", around).withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy"), "__where": F.col(location)})
    there = lights.select(F.col(location).alias("__where"), F.col("x").alias("__lx"), F.col("y").alias("__ly"), F.col("z").alias("__lz"), _cell(F.col("x"), most_m).alias("__cx"), _cell(F.col("y"), most_m).alias("__cy"))
    # A frame has a row per cell, which Spark's estimate of its size leaves out: unhinted, the driver would gather them all.
    hits = asks.hint("merge").join(there, ["__where", "__cx", "__cy"])
    turned = into(ego[1], [F.col(c) - o for c, o in zip(("__lx", "__ly", "__lz"), ego[0])])
    hits = hits.withColumns({f"__i{k}": c for k, c in enumerate(turned)})
    at = [F.col(f"__i{k}") - o for k, o in enumerate(camera[0])]
    distance = F.sqrt(at[0] * at[0] + at[1] * at[1] + at[2] * at[2])  # a rotation keeps distances
    hits = hits.withColumn("__d", distance).where(F.col("__d") <= most_m)
    hits = hits.withColumns({f"__c{k}": c for k, c in enumerate(into(camera[1], at))}).where(F.col("__c2") > least_depth)
    u, v = focal * F.col("__c0") / F.col("__c2") + width / 2, focal * F.col("__c1") / F.col("__c2") + height / 2
    found = hits.where(u.between(0, width) & v.between(0, height))
    counted = found.groupBy(frame).agg(F.count("*").alias("n_in_view"), F.min("__d").alias("nearest_m"))
    return frames.select(frame).join(counted, frame, "left").select(frame, F.coalesce("n_in_view", F.lit(0)).alias("n_in_view"), "nearest_m")


def simple_rings(ring: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A ring that crosses itself as rings that do not: cut at a crossing, the loop between the two edges and the rest are taken each."""
    todo, out = [list(ring)], []
    while todo:
        points = todo.pop()
        n, cut_ = len(points), None
        for i in range(n):
            for j in range(i + 2, n):
                if i == 0 and j == n - 1:
                    continue
                (ax, ay), (bx, by), (cx, cy), (dx, dy) = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
                cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                if not cross:
                    continue
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / cross
                s = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / cross
                if 0 < t < 1 and 0 < s < 1:
                    cut_ = i, j, (ax + t * (bx - ax), ay + t * (by - ay))
                    break
            if cut_:
                break
        if cut_ is None:
            if n >= 3:
                out.append(points)
            continue
        i, j, p = cut_
        todo += [[p, *points[i + 1 : j + 1]], [*points[: i + 1], p, *points[j + 1 :]]]
    return out


def repaired(rows: DataFrame, ring: str) -> DataFrame:
    """``rows`` with ``ring`` (struct(x, y), open) split where it crosses itself: a row per simple ring. Others pass as they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = batch.schema.get_field_index(ring), batch.column(ring).to_pylist()
            index, rings = [], []
            for i, points in enumerate(column):
                for one in simple_rings([(p["x"], p["y"]) for p in points or []]) or [[]]:
                    index.append(i)
                    rings.append([{"x": px_, "y": py_} for px_, py_ in one])
            taken = batch.take(pa.array(index, pa.int64()))
            yield taken.set_column(at, batch.schema.field(ring), pa.array(rings, batch.schema.field(ring).type))

    return rows.mapInArrow(split, rows.schema)
