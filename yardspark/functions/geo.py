"""Geometry and geography as column expressions: no UDF, so they stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius and feet per metre of the spot distances, and the WGS84 ellipsoid.
EARTH_M, FEET = 6371000.0, 3.28084
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)


def haversine_ft(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the sphere in feet."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * F.lit(FEET)


def to_local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(east, north) in metres from a reference, by the Gauss mid-latitude formula on WGS84."""
    mid, dlat, dlon = F.radians((lat + lat0) / 2), F.radians(lat - lat0), F.radians(lon - lon0)
    w = F.sqrt(1 - _E2 * F.pow(F.sin(mid), 2))
    m, n = WGS84_A * (1 - _E2) / F.pow(w, 3), WGS84_A / w
    e, north, h = n * F.cos(mid) * dlon, m * dlat, dlon * F.sin(mid) / 2
    return e * F.cos(h) - north * F.sin(h), north * F.cos(h) + e * F.sin(h)


def to_gps(east: Column, north: Column, lat0: float, lon0: float, rounds: int = 2) -> tuple[Column, Column]:
    """(lat, lon) of metres from a reference: a first guess by local radii, corrected by the forward residual."""
    p = math.radians(lat0)
    w = math.sqrt(1 - _E2 * math.sin(p) ** 2)
    m, n = WGS84_A * (1 - _E2) / w**3, WGS84_A / w
    lat, lon = lat0 + F.degrees(north / m), lon0 + F.degrees(east / (n * math.cos(p)))
    for _ in range(rounds):
        e, nn = to_local(lat, lon, lat0, lon0)
        lat, lon = lat + F.degrees((north - nn) / m), lon + F.degrees((east - e) / (n * math.cos(p)))
    return lat, lon


def valid_coords(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def area(box: dict[str, Column]) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def corners(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")}


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies strictly inside a ring (array of struct x, y, not closed); its border is outside."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cross(e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    def on_edge(e: Column) -> Column:
        return (cross(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))

    def crossed(e: Column) -> Column:
        up = e["b"]["y"] > e["a"]["y"]
        return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & F.when(up, cross(e) > 0).otherwise(cross(e) < 0)

    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crossed(e), 1).otherwise(0)) % 2 == 1
    return odd & ~F.exists(edges, on_edge)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a ring by the shoelace sums."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e))
    x = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * cross(e))
    y = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * cross(e))
    return x / (3 * total), y / (3 * total)


def homography(x: Column, y: Column, h: list[list[float]]) -> tuple[Column, Column]:
    """A pixel on the ground plane by a 3x3 matrix with perspective division; null where the divisor is 0."""
    row = lambda r: h[r][0] * x + h[r][1] * y + h[r][2]
    w = F.nullif(row(2), F.lit(0.0))
    return row(0) / w, row(1) / w


def register_sql(spark) -> None:
    """haversine_ft, iou, ground_point and point_in_polygon as SQL functions that Catalyst inlines."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_ft(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
      RETURN 2 * {EARTH_M}D * {FEET}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION overlap(a1 DOUBLE, a2 DOUBLE, b1 DOUBLE, b2 DOUBLE) RETURNS DOUBLE
      RETURN greatest(0D, least(a2, b2) - greatest(a1, b1))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE
      RETURN coalesce(overlap(ax1, ax2, bx1, bx2) * overlap(ay1, ay2, by1, by2)
        / nullif((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - overlap(ax1, ax2, bx1, bx2) * overlap(ay1, ay2, by1, by2), 0D), 0D)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION ground_point(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS ARRAY<DOUBLE>
      RETURN array((x1 + x2) / 2, y2)""")
    # edges from each point to the next one: crossings of the ray to the right, and edges that hold the point
    side = "(e.bx - e.ax) * (py - e.ay) - (e.by - e.ay) * (px - e.ax)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION point_in_polygon(px DOUBLE, py DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS BOOLEAN
      RETURN size(filter(zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y)),
        e -> (e.ay > py) != (e.by > py) AND (({side}) > 0) = (e.by > e.ay) AND ({side}) != 0)) % 2 = 1
      AND NOT exists(zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y)),
        e -> ({side}) = 0 AND px BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND py BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by))""")
