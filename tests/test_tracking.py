"""Links of detections in ranges of frames against one pass over each video, on every cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardspark.operators import tracking

KIND = "video string, frame long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double"


def walk(rng, video, frames, things):
    """Things that move, stand, meet, and are hidden for a while; a frame may hold none."""
    rows, held = [], [[rng.uniform(0, 900), rng.uniform(0, 500), rng.uniform(20, 90), rng.choice([0.0, 0.0, 3.0, -2.0]), 0] for _ in range(things)]
    for f in range(frames):
        for i, h in enumerate(held):
            h[0] += h[3] + rng.choice([0.0, 0.0, 0.5])
            h[4] = h[4] - 1 if h[4] else rng.choice([0] * 60 + [5, 20, 45])
            if not h[4]:
                rows.append((video, f, i, h[0], h[1], h[0] + h[2], h[1] + h[2], rng.choice([0.9, 0.9, 0.3, 0.19])))
        if f % 211 == 210:
            held[rng.randrange(things)] = [rng.uniform(0, 900), rng.uniform(0, 500), 50.0, 1.0, 0]
    return rows


def one_pass(rows):
    out, videos = {}, {}
    for r in rows:
        if r[7] >= tracking.LEAST_CONF:
            videos.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for video, frames in videos.items():
        linker = tracking.Linker()
        for f in sorted(frames):
            boxes = sorted(frames[f], key=lambda r: r[2])
            for b, t in zip(boxes, linker.frame(f, np.array([b[3:7] for b in boxes], float)), strict=True):
                out[video, f, b[2]] = t
    return out


@pytest.mark.parametrize(("size", "warm"), [(40, 0), (47, 5), (60, 40), (200, 64), (5000, 120)])
def test_ranges_equal_one_pass(spark, size, warm):
    """Also without frames to begin from, where many ranges have to be linked again."""
    rng = random.Random(size)
    rows = walk(rng, "a", 330, 6) + walk(rng, "b", 90, 2) + [(None, 7, 1, 0.0, 0.0, 9.0, 9.0, 0.9), ("gap", 0, 1, 0.0, 0.0, 9.0, 9.0, 0.9), ("gap", 900, 1, 0.0, 0.0, 9.0, 9.0, 0.9)]
    rows += [("twins", f, i, 5.0, 5.0, 25.0, 25.0, 0.9) for f in range(100) for i in range(2)]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    out = tracking.link_detections(table, size=size, warm=warm).collect()
    got = {(r.video, r.frame, r.box_id): r.track_id for r in out}
    want = one_pass(rows)
    assert len(out) == len(want)
    assert {k: t for k, t in got.items() if k[0] != "twins"} == {k: t for k, t in want.items() if k[0] != "twins"}
    # boxes that are equal in all are told apart by nothing: their ids may change places at a border, and stay two
    assert all({got["twins", f, 0], got["twins", f, 1]} == {1, 2} for f in range(100))


def test_small_and_many_ranges(spark):
    assert tracking.link_detections(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(ValueError, match="range"):
        tracking.link_detections(spark.createDataFrame([], KIND), size=20, warm=0)
    table = spark.range(20_000).select(F.lit("long").alias("video"), F.col("id").alias("frame"), F.lit(1).cast("long").alias("box_id"), (F.col("id") * 0.5).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * 0.5 + 50).alias("x2"), F.lit(50.0).alias("y2"), F.lit(0.9).alias("conf"))
    out = tracking.link_detections(table, size=500, warm=64)
    assert out.select("track_id").distinct().collect() == [(1,)] and out.count() == 20_000


def test_given_boxes_equal_one_pass(spark):
    from compare import DATA

    from yardspark.plans.streams import _boxes

    table = _boxes(spark, DATA)
    rows = [tuple(r) for r in table.select("video", "frame", "box_id", "x1", "y1", "x2", "y2", "conf").collect()]
    got = {(r.video, r.frame, r.box_id): r.track_id for r in tracking.link_detections(table, size=64, warm=40).collect()}
    assert got == one_pass(rows)


@pytest.mark.parametrize("boxes", [1, 4, 300])
def test_few_pairs_are_measured_as_many(monkeypatch, boxes):
    """small frames are measured by plain numbers, exactly as arrays measure them."""
    rng = random.Random(boxes)
    box = lambda: [x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(0, 90), y + rng.choice([0.0, 60.5])]
    tracks, found = [[i, rng.randrange(30), *box(), rng.uniform(-3, 3), 0.1] for i in range(9)], [box() for _ in range(boxes)]
    got = []
    for limit in (0, 10**9):
        monkeypatch.setattr(tracking, "ARRAY_PAIRS", limit)
        got.append(tracking.measured(tracks, 31, found))
    assert got[0] == got[1]


@pytest.mark.parametrize("boxes", [1, 4, 300])
def test_fitting_pairs_are_those_of_all_measured(monkeypatch, boxes):
    """F1: pairs that cannot fit are not measured to the end, few or many of them; the others have the same scores."""
    rng = random.Random(boxes)
    box = lambda: [x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(0, 90), y + rng.choice([0.0, 60.5])]
    tracks, found = [[i, rng.randrange(30), *box(), rng.choice([0.0, rng.uniform(-9, 9)]), 0.1] for i in range(30)], [box() for _ in range(boxes)]
    found[0] = [tracks[7][k] + tracks[7][6 + k % 2] * (31 - tracks[7][1]) for k in (2, 3, 4, 5)]  # where track 7 is now
    at, rest, pairs = list(range(2, 30)), list(range(boxes)), []
    for rule, sure in ((tracking.ACTIVE, tracking.SURE_IOU), (tracking.LOST, tracking.LOST_IOU)):
        far, least, a, b = rule
        over, apart = tracking.measured([tracks[i] for i in at], 31, found)
        want = [(-(a * o + b * max(1 - d / far, 0.0)), i, j, o) for i, x, y in zip(at, over, apart, strict=True) for j, o, d in zip(rest, x, y, strict=True) if (d <= far and o >= least) or o > sure]
        for limit in (0, 10**9):
            monkeypatch.setattr(tracking, "ARRAY_PAIRS", limit)
            assert sorted(tracking.fitting(tracks, at, 31, found, rest, rule, sure)) == sorted(want)
        pairs += want
    assert pairs
