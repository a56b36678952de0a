"""Numbering, means and lists at sizes that one task or one row does not hold, against plain versions."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from yardspark.operators import assign, boxes, calibrate, dataset, gps
from yardspark.operators.numbering import number_rows


def test_number_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(40), i) for i in range(500)]
    table = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    out = number_rows(table, ["g"], [F.col("v"), F.col("i")], "n").collect()
    want, seen = {}, defaultdict(int)
    for g, v, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[g] += 1
        want[i] = seen[g]
    assert {r.i: r.n for r in out} == want and len(out) == 500
    hot = number_rows(spark.range(30_000).withColumn("g", F.lit(1)), ["g"], [F.col("id").desc()], "n")
    assert hot.filter("n <> 30000 - id").count() == 0
    assert number_rows(table.limit(0), [], [F.col("v")], "n").count() == 0


def test_split_is_exact(spark):
    for names in ([str(i) for i in range(137)], ["same"] * 50 + [None] * 3, []):
        table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int")
        for ratio in (0.0, 0.2, 1.0):
            out = dataset.split_dataset(table, "name", ratio).collect()
            assert len(out) == len(names) and sum(r.split == "val" for r in out) == int(len(names) * ratio)
    first = {r.name for r in dataset.split_dataset(spark.createDataFrame([(str(i),) for i in range(50)], "name string"), "name").collect() if r.split == "val"}
    more = {r.name for r in dataset.split_dataset(spark.createDataFrame([(str(i),) for i in range(50)], "name string").repartition(5), "name").collect() if r.split == "val"}
    assert first == more


def test_ema_in_runs(spark, monkeypatch):
    monkeypatch.setattr(boxes, "_FOLD", 8)
    rng, rows = random.Random(2), []
    for camera, n in (("a", 1), ("b", 8), ("c", 9), ("d", 100), ("e", 4)):
        rows += [(camera, "d1", rng.randrange(50), i, rng.uniform(-5, 5) if camera != "e" else None) for i in range(n)]
    out = {r.camera_id: (r.ema, r.n) for r in boxes.ema(spark.createDataFrame(rows, "camera_id string, day string, ts_s long, id long, value double").repartition(6)).collect()}
    for camera in "abcd":
        held = [r[4] for r in sorted((r for r in rows if r[0] == camera), key=lambda r: (r[2], r[3]))]
        mean = held[0]
        for x in held[1:]:
            mean = 0.9 * mean + 0.1 * x
        assert abs(out[camera][0] - mean) < 1e-12 and out[camera][1] == len(held)
    assert out["e"] == (None, 4)


def test_ema_of_one_busy_camera(spark):
    table = spark.range(1_000_000).select(F.lit("c").alias("camera_id"), F.lit("d").alias("day"), F.col("id").alias("ts_s"), "id", (F.col("id") % 7).cast("double").alias("value"))
    r = boxes.ema(table).first()
    mean = 0.0
    for i in range(999_000, 1_000_000):
        mean = 0.9 * mean + 0.1 * (i % 7)
    assert abs(r.ema - mean) < 1e-9 and r.n == 1_000_000


def test_distances_by_blocks(spark, monkeypatch):
    rng = random.Random(3)
    points = [(rng.uniform(0, 50), rng.uniform(-9, 9)) for _ in range(150)] + [(1.0, 2.0)] * 3 + [(None, 60.0)]
    table = spark.createDataFrame(points, "x double, y double").repartition(4)
    whole = gps.calibration_region(table).first()
    monkeypatch.setattr(gps, "_BLOCK", 16)
    r = gps.calibration_region(table).first()
    a = np.array(points[:-1], float)
    d = np.hypot(np.subtract.outer(a[:, 0], a[:, 0]), np.subtract.outer(a[:, 1], a[:, 1]))[np.triu_indices(len(a), 1)]
    for found in (whole, r):
        assert abs(found.mean_distance - d.mean()) < 1e-9 and abs(found.max_distance - d.max()) < 1e-9 and found.y2 == 60.0


def test_distances_of_a_hundred_thousand_points(spark):
    r = gps.calibration_region(spark.range(100_000).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))).first()
    assert r.max_distance == 99_999 and abs(r.mean_distance - 100_001 / 3) < 1e-6 and r.trusted_radius == 1.5 * 99_999


def test_lists_beyond_a_row(spark, monkeypatch):
    """Landmarks, references, calibration points and expected pixels give the same from cells as from one row."""
    rng = random.Random(4)
    points = spark.createDataFrame([(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(80)] + [(900, None, 1.0)], "id long, x double, y double")
    centres = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(40)]
    marks = spark.createDataFrame([(i, x, y, x / 100, y / 100) for i, x, y in centres], "ord int, lx double, ly double, lat double, lon double")
    calib = spark.createDataFrame([(x, y) for _, x, y in centres], "x double, y double")
    fixes = spark.createDataFrame([(i, 41.9 + rng.uniform(0, 0.002), -89.0 + rng.uniform(0, 0.002)) for i in range(60)] + [(900, None, 1.0)], "id long, lat double, lon double")
    refs = spark.createDataFrame([(i, 41.9 + rng.uniform(0, 0.002), -89.0 + rng.uniform(0, 0.002), 0.1, None if i % 5 == 0 else 0.2) for i in range(12)], "ord int, rlat double, rlon double, dlat double, dlon double")
    crops = spark.createDataFrame([(i, i % 9, x, y, x + 5, y + 7) for i, x, y in centres], "frame int, track_id int, x1 double, y1 double, x2 double, y2 double")
    expected = spark.createDataFrame([(f"s{i}", rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(15)], "spot string, ex double, ey double")
    manual = spark.createDataFrame([(3, "m")], "track_id int, spot string")

    def shown():
        tables = [
            gps.landmark_position(points, marks), gps.landmark_position(points, marks, "mean"), gps.landmark_position(points, marks.limit(2)), gps.position_confidence(points, calib),
            gps.nearest_reference_offset(fixes, refs), calibrate.match_calibration(crops, expected, manual, 30.0),
        ]
        return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()), key=repr) for t in tables]

    few = shown()
    monkeypatch.setattr(assign, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(gps, "BROADCAST_ROWS", 3)
    assert shown() == few and [len(t) for t in few[:5]] == [81, 81, 81, 81, 61] and 5 < len(few[5]) < 40
    assert {r[-1] for r in few[4]} == {True, False}


def test_polygons_of_many_sizes(spark, monkeypatch):
    """Small polygons in large ones: the first by order that holds a point, whatever its size."""
    rng = random.Random(9)
    square = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rings = [(f"p{i}", (i * 37) % 101, square(rng.uniform(-200, 200), rng.uniform(-200, 200), w := 2.0 ** rng.uniform(-3, 8), w * rng.choice([1, 1, 0.01]))) for i in range(60)]
    rings += [("all", 500, square(-300.0, -300.0, 600.0, 600.0)), ("none", 501, [])]
    points = [(i, rng.uniform(-320, 320), rng.uniform(-320, 320)) for i in range(400)] + [(900, None, 1.0)]
    table, held = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rings, "name string, ord int, ring array<struct<x: double, y: double>>")

    def inside(x, y, ring):
        (x0, y0), (x1, y1) = ring[0], ring[2]
        return x0 < x < x1 and y0 < y < y1

    want = {i: min(((o, n) for n, o, r in rings if r and inside(x, y, r)), default=(0, None))[1] for i, x, y in points if x is not None}
    for bound in (20_000, 1):
        monkeypatch.setattr(assign, "BROADCAST_ROWS", bound)
        out = {r.id: (r.spot, r.method) for r in assign.resolve_spot(table, held).collect()}
        assert len(out) == 401 and all(out[i][0] == n and out[i][1] == "point-in-polygon" if n else out[i][1] == "nearest-centroid" for i, n in want.items())
