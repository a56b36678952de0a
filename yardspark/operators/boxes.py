"""Detections, tracks and crops: gates, ground points, overlap suppression, choices per frame and track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardspark.functions.geo import area, corners, iou
from yardspark.operators.numbering import number_rows
from yardspark.operators.timejoin import bucket_ends

#: Fixed values by mode: least confidence of a detection; least width, height, area and aspect range of a track.
DETECTION = {"car": 0.40, "trailer": 0.10}
TRACK = {"car": (100, 40, 5000, 0.6, 2.5), "trailer": (80, 30, 2400, 0.15, 10.0)}
#: Least width, height and area of a crop, least visible share, greatest aspects, share of the frame that is central.
CROP = (200, 150, 30000)
VISIBLE, ASPECT, CENTRAL = 0.90, 1.8, 0.30
ASPECT_CLIPPED, ASPECT_WHOLE = 2.5, 3.0


def size() -> tuple[Column, Column]:
    return F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def filter_detections(df: DataFrame, mode: str = "trailer", cls: int | None = None) -> DataFrame:
    rows = df.filter(F.col("conf") >= DETECTION[mode])
    return rows if cls is None else rows.filter(F.col("cls") == cls)


def clean_boxes(df: DataFrame, in_size: tuple[int, int], frame: tuple[int, int], least: float = 0.25) -> DataFrame:
    """Boxes scaled to the frame, cut to whole pixels and clipped; not finite, empty and unsure ones go."""
    sx, sy = frame[0] / in_size[0], frame[1] / in_size[1]
    finite = F.lit(True)
    for c in corners().values():
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    clip = lambda c, s, top: F.least(F.greatest((F.col(c) * s).cast("int"), F.lit(0)), F.lit(top - 1))
    rows = df.filter(finite & (F.col("conf") >= least))
    rows = rows.withColumns({"x1": clip("x1", sx, frame[0]), "y1": clip("y1", sy, frame[1]), "x2": clip("x2", sx, frame[0]), "y2": clip("y2", sy, frame[1])})
    return rows.filter("x1 < x2 and y1 < y2")


def filter_tracks(df: DataFrame, mode: str = "trailer") -> DataFrame:
    w, h = size()
    least_w, least_h, least_a, low, high = TRACK[mode]
    return df.filter((w >= least_w) & (h >= least_h) & (w * h >= least_a) & (h > 0) & (w / h).between(low, high))


def rear_face(df: DataFrame, frame_width: int, aspect: float = 1.5, share: float = 0.65) -> DataFrame:
    """Wide boxes lose their sides: the centred `share` of the width stays, clipped to the frame."""
    w, h = size()
    wide, middle = w / h > aspect, (F.col("x1") + F.col("x2")) / 2
    left, right = F.greatest(F.lit(0.0), middle - w * share / 2), F.least(F.lit(float(frame_width)), middle + w * share / 2)
    return df.withColumns({"x1": F.when(wide, left).otherwise(F.col("x1")), "x2": F.when(wide, right).otherwise(F.col("x2"))})


def _visible(frame: tuple[int, int]) -> dict[str, Column]:
    """The crop (the box clipped to the frame, in whole pixels) and its shares of the box."""
    w, h = size()
    cw = F.least(F.lit(frame[0]), F.col("x2").cast("int")) - F.greatest(F.lit(0), F.col("x1").cast("int"))
    ch = F.least(F.lit(frame[1]), F.col("y2").cast("int")) - F.greatest(F.lit(0), F.col("y1").cast("int"))
    return {"w": w, "h": h, "cw": cw, "ch": ch, "visible": cw * ch / F.nullif(w * h, F.lit(0.0)), "wide": cw / F.nullif(w, F.lit(0.0)), "high": ch / F.nullif(h, F.lit(0.0)), "aspect": F.when(ch > 0, cw / ch).otherwise(0.0)}


def crop_gate(df: DataFrame, frame: tuple[int, int] = (1280, 720)) -> DataFrame:
    """df with reject_reason: too_small, clipped, aspect_ratio, not_centered, or null for a good crop."""
    v = _visible(frame)
    small = (v["w"] < CROP[0]) | (v["h"] < CROP[1]) | (v["w"] * v["h"] < CROP[2])
    off_x, off_y = F.abs((F.col("x1") + F.col("x2")) / 2 - frame[0] / 2), F.abs((F.col("y1") + F.col("y2")) / 2 - frame[1] / 2)
    reason = (
        F.when(small, "too_small").when((v["visible"] < VISIBLE) | (v["wide"] < VISIBLE) | (v["high"] < VISIBLE), "clipped")
        .when(v["aspect"] > ASPECT, "aspect_ratio").when((off_x >= frame[0] * CENTRAL) | (off_y >= frame[1] * CENTRAL), "not_centered")
    )
    return df.withColumn("reject_reason", reason)


def fallback_crop_gate(df: DataFrame, frame: tuple[int, int] = (1280, 720), fallback: bool = False) -> DataFrame:
    """df with `valid`: the gate of crops that are cut later, stricter at the frame's edges, or laxer as a last choice."""
    v, (w, h) = _visible(frame), frame
    edge_x, edge_y = max(w * 0.05, 100), max(h * 0.05, 100)
    left, right, top, bottom = F.col("x1") < edge_x, F.col("x2") > w - edge_x, F.col("y1") < edge_y, F.col("y2") > h - edge_y
    edges = sum((c.cast("int") for c in (left, right, top, bottom)), F.lit(0))
    small = (v["w"] < CROP[0]) | (v["h"] < CROP[1]) | (v["w"] * v["h"] < CROP[2])
    beyond = (F.col("x1") < 0) | (F.col("x2") >= w) | (F.col("y1") < 0) | (F.col("y2") >= h)
    cut = (v["visible"] < VISIBLE) | (v["wide"] < VISIBLE) | (v["high"] < VISIBLE)
    if fallback:
        whole = (v["visible"] >= 0.99) & (v["wide"] >= 0.99) & (v["high"] >= 0.99)
        bad = F.when(whole, v["aspect"] > ASPECT_WHOLE).otherwise((v["aspect"] > ASPECT_CLIPPED) | (edges >= 2) & ((v["wide"] < 0.95) | (v["high"] < 0.95)))
    else:
        bad = (v["aspect"] > ASPECT) | left | right | (edges >= 2) | (top | bottom) & (v["high"] < 0.95)
    return df.withColumn("valid", ~(small | beyond | cut | bad))


def middle_region(df: DataFrame, width: float, low: float = 0.3, high: float = 0.7) -> DataFrame:
    x = (F.col("x1") + F.col("x2")) / 2 / width
    return df.filter((x > low) & (x < high))


def ground_point(method: str) -> tuple[Column, Column]:
    """The pixel where a box meets the ground, by one of the methods; `optimal_percentage:x:y[:reference]` takes shares."""
    w, h = size()
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    centre, low = (x1 + x2) / 2, y1 + h * 0.64
    if method.startswith("optimal_percentage:"):
        x, y, *ref = method.split(":")[1:]
        base = {"left_edge": x1, "center": centre}.get(ref[0] if ref else "right_edge", x2)
        return base + w * float(x), y1 + h * float(y)
    share = lambda wide: F.when(w > 800, wide).otherwise(0.12)
    aspect = F.when(h > 0, w / h).otherwise(1.0)
    return {
        "bottom_center": (centre, y2),
        "right_bottom": (x2, y2),
        "adaptive_percentage": (x2 + w * F.when(w > 800, 0.15).when(w > 600, 0.13).otherwise(0.12), y1 + h * F.when(h > 900, 0.39).when(h > 700, 0.385).otherwise(0.38)),
        "fixed_offset": (x2 + 100, y2 - 200),
        "from_left_percentage": (x1 + w, y1 + h * 0.38),
        "bottom_intersection": (centre, low),
        "learned_features": (0.3 * centre + 0.4 * (x2 + w * share(0.16)) + 0.3 * (centre + w * 0.1 * aspect), low),
        "perspective_corrected": (x2 + w * 0.16 * (1 + (1 - F.least(w * h / 1e6, F.lit(1.0))) * 0.5), low),
        "dimension_based": (x2 + w * (0.16 + (w / 1000 - 0.8) * 0.05), low),
    }[method]


METHODS = ["bottom_center", "right_bottom", "adaptive_percentage", "fixed_offset", "from_left_percentage", "bottom_intersection", "learned_features", "perspective_corrected", "dimension_based"]


def overlaps(boxes: DataFrame, keys: list[str], order: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one frame (by keys) with an IoU above `least`; `order` is a unique key within the frame.

    A frame holds few boxes, so the self join by frame stays near the size of its input.
    """
    left = boxes.select(*keys, F.struct(*order).alias("a"), *[F.col(c).alias(f"a_{c}") for c in corners()])
    right = boxes.select(*keys, F.struct(*order).alias("b"), *[F.col(c).alias(f"b_{c}") for c in corners()])
    return left.join(right, keys).filter("a < b").withColumn("iou", iou(corners("a_"), corners("b_"))).filter(F.col("iou") > least).select(*keys, "a", "b", "iou")


def suppress_boxes(boxes: DataFrame, keys: list[str], order: list[str], limit: float = 0.45, strict: bool = False) -> DataFrame:
    """Greedy suppression in each frame: from the surest box on, those that overlap a kept one by `limit` go.

    strict: only an overlap above the limit counts. Equal confidences go by `order`.
    """
    item = F.struct((-F.col("conf")).alias("_c"), *order, *[F.col(c).cast("double").alias(c) for c in corners()])
    held = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    box = lambda s: {c: s[c] for c in corners()}
    over = (lambda x: x > limit) if strict else (lambda x: x >= limit)
    none = F.filter("_all", lambda x: F.lit(False))
    kept = F.aggregate("_all", none, lambda acc, x: F.when(F.exists(acc, lambda y: over(iou(box(x), box(y)))), acc).otherwise(F.concat(acc, F.array(x))))
    out = held.select(*keys, F.explode(kept).alias("k"))
    return out.select(*keys, *[F.col(f"k.{c}") for c in order], *[F.col(f"k.{c}") for c in corners()], (-F.col("k._c")).alias("conf"))


def dedupe_tracks(tracks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return suppress_boxes(tracks, keys, order, 0.70, strict=True)


def nearest_in_frame(tracks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per frame the track that reaches lowest, the first of equal ones."""
    best = F.min_by(F.struct(*order, "y2"), F.struct(-F.col("y2"), *order))
    return tracks.groupBy(*keys).agg(best.alias("t")).select(*keys, "t.*")


def crop_funnel(gated: DataFrame) -> DataFrame:
    """Counts of a gate's outcome: those not rejected before centring are detections; the capture rate is the centred share."""
    n = lambda r: F.count_if(F.col("reject_reason") == r)
    centred = F.count_if(F.col("reject_reason").isNull())
    found = centred + n("not_centered")
    return gated.agg(found.alias("detected"), centred.alias("centered"), n("not_centered").alias("not_centered"), n("too_small").alias("too_small"), n("clipped").alias("clipped"), n("aspect_ratio").alias("aspect_ratio"), F.when(found > 0, F.round(100.0 * centred / found, 1)).otherwise(0.0).alias("capture_rate"))


def best_crop(crops: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per track the valid crop of the largest area, then the surest, then the first."""
    best = F.min_by(F.struct(*order, area(corners()).alias("area"), "conf"), F.struct(-area(corners()), -F.col("conf"), *order))
    return crops.groupBy(key).agg(best.alias("c")).select(key, "c.*")


def replace_crop(crops: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The crop a track ends with when each next one replaces the kept one only if 1.2 times larger, or at least 0.9
    times as large and surer by more than 0.15: an ordered fold over the track's own crops."""
    item = F.struct(*order, area(corners()).alias("a"), F.col("conf").alias("c"))
    held = crops.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    better = lambda k, x: (x["a"] > 1.2 * k["a"]) | ((x["a"] >= 0.9 * k["a"]) & (x["c"] > k["c"] + 0.15))
    kept = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0)), lambda k, x: F.when(better(k, x), x).otherwise(k))
    return held.withColumn("k", kept).select(key, "k.*")


def bbox_key(df: DataFrame) -> DataFrame:
    """df with bbox_hash and the crop's file name."""
    whole = F.concat_ws("_", *[F.col(c).cast("int").cast("string") for c in corners()])
    h = F.substring(F.md5(whole.cast("binary")), 1, 8)
    return df.withColumns({"bbox_hash": h, "crop_filename": F.format_string("crop_%06d_track%03d_%s.jpg", F.col("frame").cast("long"), F.col("track_id").cast("long"), h)})


def sample_every(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    return df.filter(F.pmod(F.col(frame), F.lit(n)) == 0)


def chunk_frames(df: DataFrame, size_: int = 1500) -> DataFrame:
    """Frames with their chunk, the frame within it and the chunk's offset."""
    chunk = F.floor(F.col("frame") / size_)
    return df.withColumns({"chunk": chunk, "chunk_frame": F.col("frame") - chunk * size_, "chunk_offset": chunk * size_})


def first_and_latest(events: DataFrame, key: str = "track_id", stamp: str = "created_on") -> DataFrame:
    """The first event of each track, and its latest."""
    rows = events.filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min_by("id", F.struct(stamp, "id")).alias("first_id"), F.max_by("id", F.struct(F.col(stamp), -F.col("id"))).alias("latest_id"), F.count("*").alias("events"))


def tracks_without_crop(tracks: DataFrame, crops: DataFrame, key: str = "track_id") -> DataFrame:
    return tracks.select(key).filter(F.col(key).isNotNull()).distinct().join(crops.select(key), key, "left_anti")


def video_summary(events: DataFrame, video: str = "camera_id") -> DataFrame:
    text = F.regexp_replace("plate", r"^\s+|\s+$", "") != ""
    return events.groupBy(video).agg(F.count("*").alias("detections"), F.countDistinct("track_id").alias("tracks"), F.countDistinct(F.when(text, F.col("track_id"))).alias("tracks_with_text"), F.countDistinct("created_on").alias("frames"))


def video_events(events: DataFrame, video: str = "camera_id", top: int = 100) -> DataFrame:
    """Per video its latest events, one for each track and the newest first: as many as a page shows."""
    newest = events.groupBy(video, "track_id").agg(F.max_by(F.struct("id", "created_on", "plate"), F.struct("created_on", F.col("id"))).alias("e")).select(video, "track_id", "e.*")
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.desc("created_on"), F.desc("id")))
    return newest.withColumn("rank", rank).filter(F.col("rank") <= top)


def _within(rows: DataFrame, key: str, seconds: int, value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of the value over the key's rows of the last `seconds` seconds, both ends included.

    Rows stand in buckets as wide as the window, each also as context (`_own` false) of the next bucket, so no key's whole
    history meets in one task. A window is the start of its own bucket, a sum from the bucket's first row on, and the end
    of the one before, a sum from that bucket's last row back; so no row is added anew for each window that holds it.
    """
    b = F.floor(F.col("ts_s") / seconds)
    both = rows.withColumn("_in", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own")))))
    both = both.withColumn("_from", F.when(F.col("_in.own"), F.col("ts_s") - seconds).otherwise(F.col("ts_s")))
    group = Window.partitionBy(key, "_in.b")
    first, here = Window.unboundedPreceding, Window.currentRow
    own = F.sum(F.when(F.col("_in.own"), value)).over(group.orderBy("ts_s").rangeBetween(first, here))
    before = F.sum(F.when(~F.col("_in.own"), value)).over(group.orderBy(F.col("_from").desc()).rangeBetween(first, here))
    zero = F.lit(0).cast("double" if name == "rate" else "long")
    return both.withColumns({"_o": own, "_c": before}).filter("_in.own").withColumn(name, F.coalesce("_o", zero) + F.coalesce("_c", zero)).drop("_in", "_from", "_o", "_c")


def counter_rate(metrics: DataFrame, seconds: int = 300) -> DataFrame:
    """metrics (camera_id, ts_s, value) with the per-second increase of the counter over the window before; a fall counts as a restart."""
    last = F.struct(F.col("ts_s").cast("long").alias("t"), F.col("value").cast("double").alias("v"))
    rows = metrics.withColumns({"_b": F.floor(F.col("ts_s") / seconds), "_own": F.lit(True)})
    # the last value before a bucket stands in it as a row
    ends = bucket_ends(rows, "camera_id", "_b", last, last, "struct<t:bigint,v:double>").filter("_prev is not null")
    carried = {"ts_s": F.col("_prev.t").cast(metrics.schema["ts_s"].dataType), "value": F.col("_prev.v").cast(metrics.schema["value"].dataType), "_own": F.lit(False)}
    rows = rows.unionByName(ends.withColumns(carried).drop("_prev", "_next"), allowMissingColumns=True)
    before = F.lag("value").over(Window.partitionBy("camera_id", "_b").orderBy("ts_s", "value"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    rows = rows.withColumn("_up", step).filter("_own").drop("_b", "_own")
    return _within(rows, "camera_id", seconds, F.col("_up"), "rate").withColumn("rate", F.col("rate") / seconds).drop("_up")


#: Values that are folded in one row.
_FOLD = 4096


def ema(metrics: DataFrame, alpha: float = 0.1) -> DataFrame:
    """The exponential mean of each camera's and day's values in order of time and id, from the first value on.

    A run of values turns a mean m into a * m + b; runs of a few thousand values are folded apart, over many tasks, and
    only their (a, b) meet, a row for each run.
    """
    rows = number_rows(metrics.select("camera_id", "day", "ts_s", "id", F.col("value").cast("double").alias("value")), ["camera_id", "day"], [F.col("ts_s"), F.col("id")], "_n")
    runs = rows.groupBy("camera_id", "day", F.floor((F.col("_n") - 1) / _FOLD).alias("_run")).agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("_v"))
    first = F.col("_run") == 0  # whose first value is the mean to begin with
    start = F.struct(F.when(first, 0.0).otherwise(1.0).alias("a"), F.when(first, F.get("_v", F.lit(0))["value"]).otherwise(0.0).alias("b"))
    values = F.when(first, F.slice("_v", 2, F.size("_v"))).otherwise(F.col("_v"))
    folded = F.aggregate(values, start, lambda m, x: F.struct(((1 - alpha) * m["a"]).alias("a"), ((1 - alpha) * m["b"] + alpha * x["value"]).alias("b")))
    runs = runs.select("camera_id", "day", F.struct("_run", folded.alias("f"), F.size("_v").alias("n")).alias("r"))
    held = runs.groupBy("camera_id", "day").agg(F.array_sort(F.collect_list("r")).alias("_r"), F.sum("r.n").cast("int").alias("n"))
    mean = F.aggregate("_r", F.lit(0.0), lambda m, r: r["f"]["a"] * m + r["f"]["b"])
    return held.select("camera_id", "day", mean.alias("ema"), "n")


def observation_count(observations: DataFrame, cutoff_s: int, least: int) -> DataFrame:
    """observations (tag, ts_s, id) with how many the tag had in the window up to each, and whether the location moves."""
    rows = _within(observations, "tag", cutoff_s, F.lit(1), "n")
    return rows.withColumn("moves", F.col("n") >= least)
