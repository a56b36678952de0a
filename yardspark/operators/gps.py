"""Positions: robust averages, accuracy, reports, landmarks and references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardspark.functions.geo import haversine_ft, homography, to_gps, to_local
from yardspark.operators.assign import BROADCAST_ROWS, few_rows, near_pairs, nearest_centre, written
from yardspark.operators.numbering import number_rows

METRES = 1 / 3.28084


def average_position(fixes: DataFrame, latest: int = 120, least: int = 20) -> DataFrame:
    """A robust mean of each device's latest fixes, for devices with at least `least` of them.

    Kept: quality at least 1 or unknown, and HDOP under 10 or unknown; at least 3. From 5 on, values outside the index
    quartiles by more than 1.5 times their range go if 3 remain. Weights by HDOP: 3 under 2, 2 under 5, 1 under 10 else 0.5.
    """
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    rows = fixes.withColumn("_r", rank).filter(F.col("_r") <= latest)
    good = (F.col("fix_quality").isNull() | (F.col("fix_quality") >= 1)) & (F.col("hdop").isNull() | (F.col("hdop") < 10))
    item = F.struct("lat", "lon", "hdop", "event_id")
    held = rows.groupBy("device").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(good, item))).alias("_f")).filter((F.col("_n") >= least) & (F.size("_f") >= 3))

    def fences(name: str) -> tuple[Column, Column]:
        s, n = F.array_sort(F.transform("_f", lambda x: x[name])), F.size("_f")
        q1, q3 = F.get(s, F.floor(n / 4).cast("int")), F.get(s, F.floor(3 * n / 4).cast("int"))
        return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)

    (a, b), (c, d) = fences("lat"), fences("lon")
    held = held.withColumns({"_a": a, "_b": b, "_c": c, "_d": d})
    inner = F.filter("_f", lambda x: x["lat"].between(F.col("_a"), F.col("_b")) & x["lon"].between(F.col("_c"), F.col("_d")))
    used = F.when((F.size("_f") >= 5) & (F.size(inner) >= 3), inner).otherwise(F.col("_f"))
    weight = lambda x: F.when(x["hdop"].isNull(), 1.0).when(x["hdop"] < 2, 3.0).when(x["hdop"] < 5, 2.0).when(x["hdop"] < 10, 1.0).otherwise(0.5)
    held = held.withColumn("_u", used)
    total = lambda f: F.aggregate("_u", F.lit(0.0), lambda s, x: s + f(x))
    return held.select("device", (total(lambda x: weight(x) * x["lat"]) / total(weight)).alias("lat"), (total(lambda x: weight(x) * x["lon"]) / total(weight)).alias("lon"), F.size("_u").alias("samples"))


def position_accuracy(fixes: DataFrame, lat: float, lon: float) -> DataFrame:
    """fixes with the error to a known position in metres, its band and the offset that would mend it."""
    error = haversine_ft(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) * METRES
    band = F.when(F.col("error_m") < 5, "excellent").when(F.col("error_m") < 10, "good").when(F.col("error_m") < 20, "fair").when(F.col("error_m") < 50, "poor").otherwise("bad")
    return fixes.withColumn("error_m", error).withColumns({"band": band, "offset_lat": lat - F.col("lat"), "offset_lon": lon - F.col("lon")})


def reprojection_report(points: DataFrame, h: list[list[float]], by: list[str] | None = None) -> DataFrame:
    """Errors of projected pixels (px, py) against world points (x, y): count, rmse, max, min, mean."""
    u, v = homography(F.col("px"), F.col("py"), h)
    e = F.sqrt(F.pow(u - F.col("x"), 2) + F.pow(v - F.col("y"), 2))
    return points.withColumn("_e", e).groupBy(*(by or [])).agg(F.count("_e").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.max("_e").alias("max"), F.min("_e").alias("min"), F.avg("_e").alias("mean"))


def round_trip_report(points: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Per point the metres lost by local coordinates and back."""
    e, n = to_local(F.col("latitude"), F.col("longitude"), lat0, lon0)
    out = points.withColumns({"east": e, "north": n})
    lat, lon = to_gps(F.col("east"), F.col("north"), lat0, lon0)
    out = out.withColumns({"_lat": lat, "_lon": lon})
    return out.withColumn("error_m", haversine_ft(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")) * METRES).drop("_lat", "_lon")


#: Points of a block; two blocks' distances are one row's work.
_BLOCK = 1024


def _distances(points: DataFrame) -> DataFrame:
    """(n, total, most) of the distances of all pairs of points (x, y), by pairs of blocks dealt over the tasks."""
    placed = number_rows(points.select("x", "y"), [], [F.col("x"), F.col("y")], "_n")
    blocks = written(placed.groupBy(F.floor((F.col("_n") - 1) / _BLOCK).alias("a")).agg(F.collect_list("x").alias("ax"), F.collect_list("y").alias("ay")))
    count = blocks.count()
    pairs = blocks.select("a", F.explode(F.sequence(F.col("a"), F.lit(count - 1).cast("long"))).alias("b")).repartition(max(1, min(count * count // 8, 4096)))
    other = blocks.select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, most = 0, 0.0, 0.0
        for frame in batches:
            for a, b, ax, ay, bx, by in frame[["a", "b", "ax", "ay", "bx", "by"]].itertuples(index=False):
                apart = np.hypot(np.subtract.outer(ax, bx), np.subtract.outer(ay, by))
                inner = apart[np.triu_indices(len(ax), 1)] if a == b else apart
                n, total, most = n + inner.size, total + float(inner.sum()), max(most, float(inner.max(initial=0.0)))
        yield pd.DataFrame({"n": [n], "total": [total], "most": [most]})

    rows = pairs.join(blocks, "a").join(other, "b").select("a", "b", "ax", "ay", "bx", "by")
    return rows.mapInPandas(measure, "n long, total double, most double").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


def calibration_region(calib: DataFrame) -> DataFrame:
    """Bounds of the calibration points (x, y), mean and greatest distance of their pairs, and the trusted radius.

    One point alone gets the distances 10 and 20. Points without both coordinates make no pairs. All pairs are measured:
    those of a short list in one row, those of a longer one by blocks over many tasks.
    """
    held = calib.agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    whole = calib.filter("x is not null and y is not null")
    if whole.limit(_BLOCK + 1).count() <= _BLOCK:
        points = whole.agg(F.collect_list(F.struct("x", "y")).alias("_p"))
        apart = F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))))
        points = points.select(apart.alias("_d")).select(F.size("_d").alias("n"), F.aggregate("_d", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("_d").alias("most"))
    else:
        points = _distances(whole)
    mean, most = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(10.0), F.when(F.col("n") > 0, F.col("most")).otherwise(20.0)
    return held.join(F.broadcast(points)).select("x1", "x2", "y1", "y2", mean.alias("mean_distance"), most.alias("max_distance"), (1.5 * most).alias("trusted_radius"))


def nearest_in_plane(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(x, y, name, d) of each place of the points (x, y): the nearest centre (ord, name, sx, sy) and its distance, of
    equal ones the first. A short list is folded in each row, a longer one searched by cells that widen."""
    held = centres.filter("sx is not null and sy is not null")
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null").distinct()
    if few_rows(held):
        row = held.agg(F.collect_list(F.struct("ord", "name", "sx", "sy")).alias("_c"))
        apart = F.transform("_c", lambda s: F.struct(F.sqrt(F.pow(F.col("x") - s["sx"], 2) + F.pow(F.col("y") - s["sy"], 2)).alias("d"), s["ord"].alias("ord"), s["name"].alias("name")))
        best = places.join(F.broadcast(row)).withColumn("_b", F.array_min(apart)).filter("_b is not null")
        return best.select("x", "y", "_b.name", "_b.d")
    span = held.agg((F.max("sx") - F.min("sx")).alias("w"), (F.max("sy") - F.min("sy")).alias("h"), F.count("*").alias("n")).first()
    size = max(1e-9, (max(span["w"], 1e-9) * max(span["h"], 1e-9) / span["n"]) ** 0.5)  # about one centre a cell
    return nearest_centre(places.withColumn("id", F.lit(0)), held, size).select("x", "y", "name", "d")


def _by_place(points: DataFrame, best: DataFrame) -> DataFrame:
    """points (x, y) with the columns of best, null where a place has none."""
    right = best.withColumnsRenamed({"x": "_x", "y": "_y"})
    return points.join(right, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_x", "_y")


def position_confidence(points: DataFrame, calib: DataFrame) -> DataFrame:
    """points (x, y) with the distance to the nearest calibration point, a score, trust and use.

    The score falls from 1 at a calibration point: 0.8 at the mean distance, 0.5 at the greatest, 0.2 at the trusted radius, 0 beyond.
    """
    region = calibration_region(calib)
    near = nearest_in_plane(points, calib.select(F.lit(0).alias("ord"), F.lit(0).alias("name"), F.col("x").alias("sx"), F.col("y").alias("sy")))
    rows = _by_place(points, near.select("x", "y", F.col("d").alias("distance"))).join(F.broadcast(region))
    d, m, g, r = (F.col(c) for c in ("distance", "mean_distance", "max_distance", "trusted_radius"))
    score = F.when(d <= m, 1.0 - 0.2 * d / m).when(d <= g, 0.8 - 0.3 * (d - m) / (g - m)).when(d <= r, 0.5 - 0.3 * (d - g) / (r - g)).otherwise(0.0)
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return rows.withColumn("score", score).select(*points.columns, "distance", "score", (inside | (d <= r)).alias("trusted"), (F.col("score") >= 0.5).alias("use"))


def hybrid_position(estimates: DataFrame) -> DataFrame:
    """Weighted mean of several methods' positions (id, method, lat, lon, weight) with a confidence.

    One method has 0.5, none 0; more have 1 / (1 + 1000 (spread of lat + spread of lon)).
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("weight") > 0)
    w = F.when(known, F.col("weight"))
    rows = estimates.groupBy("id").agg(F.sum(w).alias("_w"), F.sum(w * F.col("lat")).alias("_a"), F.sum(w * F.col("lon")).alias("_o"), F.count(w).alias("methods"), F.stddev_pop(F.when(known, F.col("lat"))).alias("_sa"), F.stddev_pop(F.when(known, F.col("lon"))).alias("_so"))
    confidence = F.when(F.col("methods") == 0, 0.0).when(F.col("methods") == 1, 0.5).otherwise(1 / (1 + 1000 * (F.col("_sa") + F.col("_so"))))
    return rows.select("id", (F.col("_a") / F.col("_w")).alias("lat"), (F.col("_o") / F.col("_w")).alias("lon"), "methods", confidence.alias("confidence"))


def landmark_position(points: DataFrame, landmarks: DataFrame, how: str = "nearest") -> DataFrame:
    """points (x, y) with the position of the nearest landmark, or the inverse-square mean of all.

    landmarks: ord, lx, ly, lat, lon; fewer than three give no nearest position. The mean takes every landmark to every
    point, in parts of a bounded number of landmarks that are folded in each point's row.
    """
    if how == "nearest":
        enough = landmarks.limit(3).count() >= 3
        near = nearest_in_plane(points, landmarks.select("ord", F.struct("lat", "lon").alias("name"), F.col("lx").alias("sx"), F.col("ly").alias("sy")))
        rows = _by_place(points, near.filter(F.lit(enough)))
        return rows.select(*points.columns, F.col("name.lat").alias("lat"), F.col("name.lon").alias("lon"))
    parts = 1 + landmarks.count() // BROADCAST_ROWS
    rows = points.withColumns({"_w": F.lit(0.0), "_a": F.lit(0.0), "_o": F.lit(0.0)})
    apart = lambda s: F.sqrt(F.pow(F.col("x") - s["lx"], 2) + F.pow(F.col("y") - s["ly"], 2))
    weight = lambda s: F.when(apart(s) < 1e-6, 1e6).otherwise(1 / F.pow(apart(s), 2))
    total = lambda f: F.aggregate("_l", F.lit(0.0), lambda a, s: a + f(s))
    for i in range(parts):
        held = landmarks.filter(F.pmod(F.xxhash64("ord"), F.lit(parts)) == i).agg(F.array_sort(F.collect_list(F.struct("ord", "lx", "ly", "lat", "lon"))).alias("_l"))
        rows = rows.join(F.broadcast(held)).withColumns({"_w": F.col("_w") + total(weight), "_a": F.col("_a") + total(lambda s: weight(s) * s["lat"]), "_o": F.col("_o") + total(lambda s: weight(s) * s["lon"])}).drop("_l")
    return rows.select(*points.columns, (F.col("_a") / F.col("_w")).alias("lat"), (F.col("_o") / F.col("_w")).alias("lon"))


def nearest_reference_offset(points: DataFrame, refs: DataFrame, limit_m: float = 50.0) -> DataFrame:
    """points (lat, lon) moved by the correction of the nearest reference (ord, rlat, rlon, dlat, dlon) within the limit.

    A short list is folded in each row; of a longer one a point meets those in the cells around it.
    """
    keep = [c for c in points.columns if c not in ("lat", "lon")]
    if few_rows(refs):
        held = refs.agg(F.array_sort(F.collect_list(F.struct("ord", "rlat", "rlon", "dlat", "dlon"))).alias("_r"))
        best = F.array_min(F.transform("_r", lambda s: F.struct((haversine_ft(F.col("lat"), F.col("lon"), s["rlat"], s["rlon"]) * METRES).alias("d"), s["ord"].alias("ord"), s["dlat"].alias("dlat"), s["dlon"].alias("dlon"))))
        rows = points.join(F.broadcast(held)).withColumn("_b", best)
    else:
        places = points.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).distinct()
        spots = refs.select("ord", F.col("rlat").alias("spot_lat"), F.col("rlon").alias("spot_lon"), "dlat", "dlon")
        near = near_pairs(places, spots, limit_m / METRES * 1.000001).withColumn("d", F.col("distance") * METRES)
        best = near.groupBy(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).agg(F.min(F.struct("d", "ord", "dlat", "dlon")).alias("_b"))
        rows = points.join(best, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    hit = F.col("_b.d") <= limit_m
    move = lambda c, d: F.col(c) + F.when(hit, F.coalesce(F.col(f"_b.{d}"), F.lit(0.0))).otherwise(0.0)
    return rows.select(*keep, move("lat", "dlat").alias("lat"), move("lon", "dlon").alias("lon"), F.coalesce(hit, F.lit(False)).alias("corrected"))


def blend_positions(a: DataFrame, b: DataFrame, share: float = 0.7) -> DataFrame:
    """`share` of the first projection and the rest of the second; the other one where one is missing. Both: id, x, y."""
    right = b.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    mix = lambda p, q: F.coalesce(share * F.col(p) + (1 - share) * F.col(q), F.col(p), F.col(q))
    return a.join(right, "id", "full_outer").select("id", mix("x", "_x").alias("x"), mix("y", "_y").alias("y"))


def resolve_position(df: DataFrame) -> DataFrame:
    """df with latitude and longitude: lat and lon, else world_coords as [lat, lon] where in range, else swapped where that is, else null."""
    a, b = F.get("world_coords", F.lit(0)), F.get("world_coords", F.lit(1))
    pair = F.when(a.between(-90, 90) & b.between(-180, 180), F.struct(a.alias("lat"), b.alias("lon"))).when(b.between(-90, 90) & a.between(-180, 180), F.struct(b.alias("lat"), a.alias("lon")))
    own = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    best = F.coalesce(own, pair)
    return df.withColumns({"latitude": best["lat"], "longitude": best["lon"]})


def offset_position(boxes: DataFrame, lat0: float, lon0: float, frame: tuple[int, int], metres: tuple[float, float]) -> DataFrame:
    """boxes with the position that their centre's offset from the frame's centre gives about a camera; y points north."""
    east = ((F.col("x1") + F.col("x2")) / 2 - frame[0] / 2) / (frame[0] / 2) * metres[0]
    north = -((F.col("y1") + F.col("y2")) / 2 - frame[1] / 2) / (frame[1] / 2) * metres[1]
    out = boxes.withColumns({"_e": east, "_n": north})
    lat, lon = to_gps(F.col("_e"), F.col("_n"), lat0, lon0)
    return out.withColumns({"latitude": lat, "longitude": lon}).drop("_e", "_n")


def check_position(df: DataFrame, lat0: float, lon0: float, km: float = 1.0) -> DataFrame:
    """df (latitude, longitude) with the distance from a camera in km and whether it is within the threshold."""
    far = haversine_ft(F.col("latitude"), F.col("longitude"), F.lit(lat0), F.lit(lon0)) * METRES / 1000
    return df.withColumns({"distance_km": far, "valid": far <= km})


def project_plane(df: DataFrame, camera: dict, z: float = 0.0) -> DataFrame:
    """df (px, py) with the world point (wx, wy) where the pixel's ray meets the plane of height z; a parallel ray gives null.

    camera: K and R (3 x 3) and t (3) without lens distortion; the matrices become literals of the expressions.
    """
    import numpy as np

    k, r, t = (np.array(camera[c], float) for c in ("K", "R", "t"))
    back, centre = r.T @ np.linalg.inv(k), -r.T @ t.reshape(3)
    ray = [float(m[0]) * F.col("px") + float(m[1]) * F.col("py") + float(m[2]) for m in back]
    s = (z - float(centre[2])) / F.when(F.abs(ray[2]) > 1e-9, ray[2])
    return df.withColumns({"wx": float(centre[0]) + s * ray[0], "wy": float(centre[1]) + s * ray[1]})


#: Fixed value: metres from the ground to the middle of a trailer's back.
BACK_HEIGHT = 2.6


def ground_of_boxes(boxes: DataFrame, camera: dict, method: str = "bottom_center", height: float = BACK_HEIGHT, frame: tuple[int, int] | None = None) -> DataFrame:
    """boxes with the ground point (wx, wy): of the bottom centre on the plane 0, or (`backside_projection`) below the
    centre on the plane of the back's height. frame: the boxes' frame size, where it differs from the camera's `size`."""
    if method not in ("bottom_center", "backside_projection"):
        raise ValueError(f"no such method: {method}")
    (w, h), (cw, ch) = frame or (1, 1), camera.get("size", frame or (1, 1)) if frame else (1, 1)
    back = method == "backside_projection"
    y = (F.col("y1") + F.col("y2")) / 2 if back else F.col("y2").cast("double")
    rows = boxes.withColumns({"px": (F.col("x1") + F.col("x2")) / 2 * (cw / w), "py": y * (ch / h)})
    return project_plane(rows, camera, height if back else 0.0).drop("px", "py")


def project_pixel(df: DataFrame, camera: dict, z: float = 0.0) -> DataFrame:
    """df (wx, wy) with the pixel of the world point at height z; (-1, -1) behind the camera."""
    k, r, t = camera["K"], camera["R"], camera["t"]
    seen = [r[i][0] * F.col("wx") + r[i][1] * F.col("wy") + (r[i][2] * z + t[i]) for i in range(3)]
    image = [sum((k[i][j] * seen[j] for j in range(3)), F.lit(0.0)) for i in range(2)]
    front = seen[2] > 0
    return df.withColumns({"px": F.when(front, image[0] / seen[2]).otherwise(-1.0), "py": F.when(front, image[1] / seen[2]).otherwise(-1.0)})
