"""Every registered query with SQL agrees with DuckDB; the others run and keep their invariants."""

import pytest
from compare import DATA, same

from yardspark import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_merge_clusters_follows_rules(spark):
    from yardspark.operators.tracking import merge_clusters

    rows = [("v", 1, 0.0, 0.0, 20, "A"), ("v", 2, 9.0, 0.0, 3, "A"), ("v", 3, 2.0, 0.0, 4, "B"), ("v", 4, 30.0, 0.0, 12, None), ("v", 5, 32.0, 0.0, 11, None), ("v", 6, 90.0, 0.0, 2, "unknown"), ("v", 7, 94.0, 0.0, 2, "unknown")]
    out = {r.id: r.root for r in merge_clusters(spark.createDataFrame(rows, "video string, id long, x double, y double, n long, spot string")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_point_in_polygon_border_is_outside(spark):
    from yardspark.operators.assign import resolve_spot
    from yardspark.plans.views import spot_polygons

    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.5, 1.0), (3, 0.0, 5.0), (4, 9.0, 9.0)], "id long, x double, y double")
    got = {r.id: (r.spot, r.method) for r in resolve_spot(points, spot_polygons(spark)).collect()}
    assert got[1] == ("A1", "point-in-polygon") and got[2][1] == got[3][1] == got[4][1] == "nearest-centroid"
    assert resolve_spot(points, spot_polygons(spark).limit(0)).first().method == "no-spots"


def test_nearest_spots_by_cells_equals_broadcast(spark, monkeypatch):
    from yardspark.operators import assign

    scans = spark.createDataFrame([(i, 41.9 + i * 1e-5, -89.0 + (i % 7) * 1e-5) for i in range(60)] + [(99, 41.9, 179.99999)], "id long, latitude double, longitude double")
    spots = spark.createDataFrame([(f"s{i}", 41.9 + i * 3e-5, -89.0, i) for i in range(20)] + [("w", 41.9, -179.99999, 99)], "spot string, spot_lat double, spot_lon double, ord int")
    want = {(r.id, r.spot, r.rank) for r in assign.nearest_spots(scans, spots, 20.0).collect()}
    monkeypatch.setattr(assign, "BROADCAST_ROWS", 1)
    assert {(r.id, r.spot, r.rank) for r in assign.nearest_spots(scans, spots, 20.0).collect()} == want and (99, "w", 1) in want


def test_latest_fix_within_tolerance(spark):
    import datetime as dt

    from yardspark.operators.timejoin import gps_at

    t = dt.datetime(2024, 1, 1)
    frames = spark.createDataFrame([(1, "d", t)], "event_id long, device string, ts timestamp_ntz")
    s = lambda x: t + dt.timedelta(seconds=x)
    fixes = spark.createDataFrame([(10, "d", s(0), 1.0, 1.0), (11, "d", s(0.7), None, None), (12, "d", s(0.71), 2.0, 2.0)], "event_id long, device string, ts timestamp_ntz, lat double, lon double")
    r = gps_at(frames, fixes, 0.7).first()
    assert (r.fix_id, r.lat) == (11, None)


def test_infer_keeps_going(spark):
    from yardspark.operators.infer import best_of_attempts, infer_readings

    def factory():
        return lambda data: (data.decode(), 0.9) if data else (_ for _ in ()).throw(ValueError())

    images = spark.createDataFrame([("a", bytearray(b"TRL1")), ("b", bytearray(b""))], "path string, content binary")
    assert {(r.path, r.text, r.method) for r in infer_readings(images, factory).collect()} == {("a", "TRL1", "model"), ("b", "", "error")}
    best = {r.path: r.text for r in best_of_attempts(images, {"twice": lambda d: bytes(d) * 2}, factory).collect()}
    assert best["b"] == "" and best["a"] in ("TRL1", "TRL1TRL1")


def test_sql_functions(spark):
    from yardspark.functions.geo import register_sql

    register_sql(spark)
    r = spark.sql("select haversine_ft(0D, 0D, 0D, 1D) as d, iou(0D, 0D, 2D, 2D, 1D, 0D, 3D, 2D) as i").first()
    assert abs(r.d - 364813.0) < 200 and abs(r.i - 1 / 3) < 1e-12


def test_gps_logs_of_a_hot_camera(spark):
    """The ladder by brute force on a few rows; one camera's day of 40,000 videos and logs makes no pairs."""
    import random

    from pyspark.sql import functions as F

    from yardspark.operators.timejoin import match_gps_log

    rng, kind = random.Random(4), "name string, camera string, date string, time_s int, stem string"
    row = lambda i: (f"n{i}", rng.choice(["a", "b", None]), rng.choice(["d", "e"]), rng.choice([None, *[rng.randrange(3000) for _ in range(5)]]), rng.choice(["s", "t", "u", None]))
    for n in (0, 3, 12):
        videos, logs = [row(i) for i in range(60)], [row(i) for i in range(n)]
        want = {}
        for v in videos:
            found = [(4, 0, x[0]) for x in logs if v[4] and v[4] == x[4]]
            for x in (x for x in logs if v[1] and v[1:3] == x[1:3]):
                gap = None if v[3] is None or x[3] is None else abs(v[3] - x[3])
                found.append((3, 0, x[0]) if gap is None else (1 if gap == 0 else 2 if gap <= 300 else 5, gap, x[0]))
            if found:
                want[v[0]] = min(found)
        got = match_gps_log(spark.createDataFrame(videos, kind), spark.createDataFrame(logs, kind)).collect()
        assert {r.name: (r.step, r.gap, r.log) for r in got} == want
    hot = spark.range(40000).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("c").alias("camera"), F.lit("d").alias("date"), (F.col("id") * 2).cast("int").alias("time_s"), F.lit("s").alias("stem"))
    logs = hot.withColumn("time_s", F.col("time_s") + 1)
    out = match_gps_log(hot, logs)
    assert out.filter("gap = 1 and step = 2").count() == 40000
    assert "match_gps_log_all" in QUERIES


def test_lists_beyond_the_broadcast_bound(spark, monkeypatch):
    """Searches by widening cells find what the fold over a short list finds, also far away and over the date line."""
    import random

    from yardspark.operators import assign

    rng = random.Random(8)
    spots = spark.createDataFrame([(f"s{i}", rng.uniform(-60, 60), rng.choice([rng.uniform(-180, 180), rng.uniform(-89.1, -89.0)]), i) for i in range(60)] + [("w", 10.0, -179.9999, 99), ("n", None, 1.0, 98)], "spot string, spot_lat double, spot_lon double, ord int")
    scans = spark.createDataFrame([(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(40)] + [(100, 10.0, 179.9999), (101, None, 1.0)], "id long, latitude double, longitude double")
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rings = spark.createDataFrame([(f"p{i}", i, square(rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(1, 9))) for i in range(80)], "name string, ord int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(i, rng.uniform(-50, 250), rng.uniform(-50, 250)) for i in range(300)] + [(900, 1e5, -1e5)], "id long, x double, y double")
    shown = lambda: ({(r.id, r.spot, round(r.distance, 3)) for r in assign.nearest_any(scans, spots).collect()}, {tuple(r) for r in assign.resolve_spot(points, rings).collect()})
    few = shown()
    monkeypatch.setattr(assign, "BROADCAST_ROWS", 1)
    assert shown() == few and len(few[0]) == 41 and len(few[1]) == 301 and {r[4] for r in few[1]} == {"point-in-polygon", "nearest-centroid"}


def test_sites_have_cells_of_their_own_width(spark):
    """Verdicts by brute force where limits differ by site, one has none, and one is far beyond a spot's own cell."""
    import random

    from yardspark.operators import assign

    rng = random.Random(11)
    limits = {1: 20.0, 2: 400.0, 3: 0.0, 4: 60_000.0}
    place = lambda: (41.9 + rng.uniform(0, 0.002), -89.0 + rng.uniform(0, 0.002))
    spots = [(site, f"s{site}-{i}", *place(), i) for site in limits for i in range(40)]
    scans = [(i, rng.choice([1, 2, 3, 4, 5]), "T" * 25, *place(), rng.choice([None, 10.0, 200.0]), 5.0) for i in range(200)] + [(900, 2, "T" * 25, None, 1.0, 10.0, 5.0)]
    table = spark.createDataFrame(scans, "id long, site_id int, plate string, latitude double, longitude double, heading double, speed double")
    held = spark.createDataFrame(spots, "site_id int, spot string, spot_lat double, spot_lon double, ord int")
    settings = spark.createDataFrame([(k, 0.0, 60.0, v) for k, v in limits.items()], "site_id int, min_speed double, max_speed double, max_slot_distance double")
    far, to = assign.haversine_ft(assign.F.col("latitude"), assign.F.col("longitude"), assign.F.col("spot_lat"), assign.F.col("spot_lon")), assign.bearing(assign.F.col("latitude"), assign.F.col("longitude"), assign.F.col("spot_lat"), assign.F.col("spot_lon"))
    pairs = table.join(held, "site_id").join(settings, "site_id").withColumn("d", far).filter("d < max_slot_distance").filter(assign.heading_valid(assign.F.col("heading"), to))
    want = {r.id: r.spot for r in pairs.groupBy("id").agg(assign.F.min_by("spot", assign.F.struct("d", "ord")).alias("spot")).collect()}
    out = assign.assign_spots_by_site(table, held, settings)
    assert {r.id: r.spot for r in out.filter("spot is not null").collect()} == want and len(want) > 60
    assert {r.id for r in out.collect()} == {r[0] for r in scans if r[1] != 5}
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "_x" in plan
