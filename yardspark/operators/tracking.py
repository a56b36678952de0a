"""Identities over frames: links of detections, merges of position clusters."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.sources.folders import shared_folder

#: Least confidence of a detection, sure overlap, then the rules of active and of lost tracks as greatest
#: distance in box diagonals, least overlap, and shares of overlap and nearness in the score.
LEAST_CONF, SURE_IOU = 0.20, 0.8
ACTIVE = (2.0, 0.20, 0.7, 0.3)
LOST = (3.0, 0.02, 0.4, 0.6)
LOST_IOU, LOST_FRAMES = 0.15, 30


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.prod(np.clip(high - low, 0, None), axis=2)
    size = lambda x: np.prod(x[:, 2:] - x[:, :2], axis=1)
    return inner / np.maximum(size(a)[:, None] + size(b)[None, :] - inner, 1e-9)


#: Pairs of tracks and boxes from which arrays measure them faster than numbers one by one.
ARRAY_PAIRS = 400


def arrays(tracks: list[list], number: int, boxes: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and distance (in the track's diagonals) of each track, moved on to the frame, with each box."""
    t, box = np.array(tracks, float), np.array(boxes, float)
    old = t[:, 2:6] + t[:, [6, 7, 6, 7]] * (number - t[:, 1])[:, None]
    centre = lambda x: (x[:, :2] + x[:, 2:]) / 2
    apart = np.sqrt(((centre(old)[:, None] - centre(box)[None]) ** 2).sum(2)) / np.maximum(np.sqrt(((old[:, 2:] - old[:, :2]) ** 2).sum(1))[:, None], 1e-9)
    return _iou(old, box), apart


def measured(tracks: list[list], number: int, boxes: list[list[float]]) -> tuple[list[list[float]], list[list[float]]]:
    """All that `arrays` gives, as lists, few pairs one by one: what `fitting` chooses from."""
    if len(tracks) * len(boxes) > ARRAY_PAIRS:
        over, apart = arrays(tracks, number, boxes)
        return over.tolist(), apart.tolist()
    over, apart = [], []
    known = [(x1, y1, x2, y2, (x2 - x1) * (y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2) for x1, y1, x2, y2 in boxes]
    for _, at, l, u, r, d, vx, vy in tracks:
        gap = number - at
        l, u, r, d = l + vx * gap, u + vy * gap, r + vx * gap, d + vy * gap
        w, h = r - l, d - u
        size, long, cx, cy = w * h, sqrt(w * w + h * h), (l + r) / 2, (u + d) / 2
        long = 1e-9 if long < 1e-9 else long
        o, far = [], []
        for x1, y1, x2, y2, other, bx, by in known:
            iw, ih = (r if r < x2 else x2) - (l if l > x1 else x1), (d if d < y2 else y2) - (u if u > y1 else y1)
            inner = iw * ih if iw > 0 and ih > 0 else 0.0
            both = size + other - inner
            o.append(inner / (1e-9 if both < 1e-9 else both))
            far.append(sqrt((cx - bx) * (cx - bx) + (cy - by) * (cy - by)) / long)
        over.append(o)
        apart.append(far)
    return over, apart


def fitting(tracks: list[list], at: list[int], number: int, boxes: list[list[float]], rest: list[int], rule: tuple, sure: float) -> list[tuple[float, int, int, float]]:
    """(score below zero, track, box, overlap) of the pairs of the tracks `at` and the boxes `rest` that the rule or the
    sure overlap allows, as `measured` has it; pairs whose overlap is too small for both are not measured further."""
    far, least, a, b = rule
    if len(at) * len(rest) > ARRAY_PAIRS:
        over, apart = arrays([tracks[i] for i in at], number, [boxes[j] for j in rest])
        i, j = np.nonzero(((apart <= far) & (over >= least)) | (over > sure))
        o = over[i, j]
        score = -(a * o + b * np.maximum(1 - apart[i, j] / far, 0.0))
        return list(zip(score.tolist(), np.array(at)[i].tolist(), np.array(rest)[j].tolist(), o.tolist(), strict=True))
    known = [(j, x1, y1, x2, y2, (x2 - x1) * (y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2) for j, (x1, y1, x2, y2) in [(j, boxes[j]) for j in rest]]
    left, up, right, down = min(k[1] for k in known), min(k[2] for k in known), max(k[3] for k in known), max(k[4] for k in known)
    enough, out = min(least, sure), []
    for i in at:
        _, seen, l, u, r, d, vx, vy = tracks[i]
        gap = number - seen
        l, r = l + vx * gap, r + vx * gap
        if l >= right or r <= left:  # beside all boxes, as most tracks are that moved on for long
            continue
        u, d = u + vy * gap, d + vy * gap
        if u >= down or d <= up:
            continue
        w, h = r - l, d - u
        size, long = w * h, None
        for j, x1, y1, x2, y2, other, bx, by in known:
            iw = (r if r < x2 else x2) - (l if l > x1 else x1)
            if iw <= 0:
                continue
            ih = (d if d < y2 else y2) - (u if u > y1 else y1)
            if ih <= 0:
                continue
            inner = iw * ih
            both = size + other - inner
            o = inner / (1e-9 if both < 1e-9 else both)
            if o >= enough:
                if long is None:
                    long, cx, cy = sqrt(w * w + h * h), (l + r) / 2, (u + d) / 2
                    long = 1e-9 if long < 1e-9 else long
                off = sqrt((cx - bx) * (cx - bx) + (cy - by) * (cy - by)) / long
                if off <= far and o >= least or o > sure:
                    near = 1 - off / far
                    out.append((-(a * o + b * (near if near > 0.0 else 0.0)), i, j, o))
    return out


def _place(track: list) -> tuple:
    return track[1:], track[0]


class Linker:
    """Active tracks of one video: each frame's detections go to tracks at most once each, the best pairs first.

    A track's box moves on with its last velocity. State is plain lists, so that a stream can keep it. Tracks stand in
    order of what they hold, not of their ids, so that equal scores are told apart alike wherever linking began: the
    frame comes first, so a later frame puts those that it changes behind the others, which stay in order. Lost tracks
    are measured only against the boxes that the active ones leave.
    """

    def __init__(self, state: list | None = None, next_id: int = 1):
        self.tracks: list[list] = state or []  # [id, frame, x1, y1, x2, y2, vx, vy]
        self.next_id = next_id
        self.last: int | None = None  # the last frame, where the tracks stand in order and none is of a later one

    def forget(self, number: int) -> None:
        """Drop the tracks that are lost for good at a frame."""
        self.tracks = sorted((t for t in self.tracks if number - t[1] <= LOST_FRAMES + 1), key=_place)

    def frame(self, number: int, boxes: list[list[float]] | np.ndarray) -> list[int]:
        boxes = boxes.tolist() if isinstance(boxes, np.ndarray) else boxes
        if self.last is None or self.last >= number:
            self.forget(number)
        tracks, n = self.tracks, len(self.tracks)
        gone = 0
        while gone < n and number - tracks[gone][1] > LOST_FRAMES + 1:
            gone += 1
        ordered = not n or tracks[-1][1] < number
        first = n  # of the active tracks
        while first > gone and number - tracks[first - 1][1] <= 1:
            first -= 1
        out, taken = [0] * len(boxes), {}

        def take(pairs: list[tuple]) -> None:
            pairs.sort()
            for pair in pairs:
                i, j = pair[1], pair[2]
                if i not in taken and not out[j]:
                    t, (l, u, r, d) = tracks[i], boxes[j]
                    steps = max(1, number - t[1])
                    out[j] = t[0]
                    taken[i] = [t[0], number, l, u, r, d, ((l + r) - (t[2] + t[4])) / 2 / steps, ((u + d) - (t[3] + t[5])) / 2 / steps]

        if first < n and boxes:
            pairs = fitting(tracks, list(range(first, n)), number, boxes, list(range(len(boxes))), ACTIVE, SURE_IOU)
            take([(-o, i, j) for _, i, j, o in pairs if o > SURE_IOU])
            take([p for p in pairs if p[3] >= ACTIVE[1]])
        rest = [j for j, track in enumerate(out) if not track]
        if gone < first and rest:
            take(fitting(tracks, list(range(gone, first)), number, boxes, rest, LOST, LOST_IOU))
        new = list(taken.values())
        for j in rest:
            if not out[j]:
                out[j] = self.next_id
                new.append([self.next_id, number, *boxes[j], 0.0, 0.0])
                self.next_id += 1
        new.sort(key=_place)
        self.tracks = [tracks[i] for i in range(gone, n) if i not in taken] + new
        self.last = number if ordered else None
        return out


#: Frames of a range that is one task's work, and frames before it from which a task without a given state begins.
RANGE_FRAMES, WARM_FRAMES = 3000, 120
_KEYS = ["_v", "_r"]


def _link_range(number: int, frame: pd.DataFrame, order: str, size: int, given: list[list[float]] | None) -> tuple[pd.DataFrame, list[int], Linker, list[list], int]:
    """(rows, their ids, linker, tracks at the start, ids used before it) of the range that begins at number * size."""
    begin = number * size
    linker = Linker() if given is None else Linker([[i + 1, int(c[0]), *c[1:]] for i, c in enumerate(given)], len(given) + 1)
    rows = frame if given is None else frame[frame["frame"] >= begin]
    rows = rows.sort_values(["frame", order], kind="stable")
    frames, boxes = rows["frame"].to_numpy(np.int64), rows[["x1", "y1", "x2", "y2"]].to_numpy(float).tolist()
    first = int(np.searchsorted(frames, begin))
    firsts = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1)).tolist()
    start, before, ids = None, 0, []
    for a, z in zip(firsts, [*firsts, len(frames)][1:], strict=True):
        if a == first:
            linker.forget(begin)
            start, before = [list(t) for t in linker.tracks], linker.next_id - 1
        got = linker.frame(int(frames[a]), boxes[a:z])
        if a >= first:
            ids += got
    if start is None:
        linker.forget(begin)
        start, before = [list(t) for t in linker.tracks], linker.next_id - 1
    linker.forget(begin + size)
    return rows.iloc[first:], ids, linker, start, before


def link_detections(detections: DataFrame, key: str = "video", order: str = "box_id", size: int = RANGE_FRAMES, warm: int = WARM_FRAMES) -> DataFrame:
    """detections (key, frame, order, x1, y1, x2, y2, conf) with track_id, numbered within a video as its tracks begin.

    Detections under the least confidence are left out. A video is cut into ranges of `size` frames (more than a lost
    track lasts), each of them one task's work. A range first links the `warm` frames before its own, as what a linker
    holds mostly depends on the last frames alone. Where its tracks at its start are not exactly those at the end of the
    range before, it is linked again from those, until all ranges fit; so the result is that of one pass over the video.
    Ids go from range to range by the equal tracks at their borders, by pointer jumping over written tables.
    """
    if not LOST_FRAMES + 1 < size or warm > size:
        raise ValueError("a range is longer than a lost track lasts and than the frames before it")
    spark, root = detections.sparkSession, shared_folder(detections.sparkSession, "links")
    cols = [key, "frame", order, "x1", "y1", "x2", "y2", "conf"]
    rows = detections.filter(F.col("conf") >= LEAST_CONF).select(*cols).withColumn("_v", F.to_json(F.struct(F.col(key).alias("v"))))
    own = F.floor(F.col("frame") / size)
    # without a video name or frames the rows have no sequence; equal names meet, also null ones
    ranges = rows.withColumn("_r", F.explode(F.when(F.pmod(F.col("frame"), F.lit(size)) >= size - warm, F.array(own, own + 1)).otherwise(F.array(own))))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField("_v", T.StringType()), T.StructField("_r", T.LongType()), T.StructField("_what", T.StringType()), T.StructField("_local", T.LongType()), T.StructField("_c", T.ArrayType(T.DoubleType())), *[T.StructField(c, kinds[c]) for c in cols]])

    def work(v: str, number: int, frame: pd.DataFrame, given: list[list[float]] | None) -> pd.DataFrame:
        done, ids, linker, start, before = _link_range(number, frame, order, size, given)
        out = [done[cols].astype(object).assign(_what="box", _local=ids)]
        told = [("start", t[0], [float(x) for x in t[1:]]) for t in start] + [("end", t[0], [float(x) for x in t[1:]]) for t in linker.tracks]
        told.append(("count", before, [float(linker.next_id - 1 - before)]))
        out.append(pd.DataFrame(told, columns=["_what", "_local", "_c"], dtype=object))
        return pd.concat(out, ignore_index=True).assign(_v=v, _r=number).reindex(columns=schema.names).astype(object).pipe(lambda f: f.where(f.notna(), None))

    def first(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return work(keys[0], int(keys[1]), frame, None)

    def again(keys: tuple, frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        held = [list(c) for c in state["_c"] if c is not None]
        return work(keys[0], int(keys[1]), frame, sorted(held))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    linked, turn = written(ranges.groupBy(*_KEYS).applyInPandas(first, schema), "linked-0"), 0
    while True:
        held = lambda what, ahead: linked.filter(F.col("_what") == what).groupBy("_v", (F.col("_r") + ahead).alias("_r")).agg(F.array_sort(F.collect_list("_c")).alias(what))  # noqa: E731, B023
        counted = linked.filter("_what = 'count'").select(*_KEYS)
        nothing = F.array().cast("array<array<double>>")
        both = counted.join(held("start", 0), _KEYS, "left").join(held("end", 1), _KEYS, "left").select(*_KEYS, F.coalesce("start", nothing).alias("start"), F.coalesce("end", nothing).alias("end"))
        # equal tracks in one place cannot be told apart at a border: the range is linked from the given ones
        misfits = both.filter((F.col("start") != F.col("end")) | ((F.size(F.array_distinct("end")) < F.size("end")) & F.lit(turn == 0)))
        misfits = written(misfits.select(*_KEYS, F.explode_outer("end").alias("_c")), f"misfits-{turn}")
        if misfits.isEmpty():
            break
        turn += 1
        wrong = misfits.select(*_KEYS).distinct()
        redone = ranges.join(wrong, _KEYS, "left_semi").groupBy(*_KEYS).cogroup(misfits.groupBy(*_KEYS)).applyInPandas(again, schema)
        linked = written(linked.join(wrong, _KEYS, "left_anti").select(*schema.names).unionByName(redone), f"linked-{turn}")
    counts = linked.filter("_what = 'count'").select(*_KEYS, F.col("_local").alias("_before"), F.get("_c", F.lit(0)).cast("long").alias("_new"))
    counts = counts.withColumn("_offset", F.sum("_new").over(Window.partitionBy("_v").orderBy("_r")) - F.col("_new"))  # a row for each range
    # tracks that go over a border, in equal order on both sides
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("_c", "_local"))
    side = lambda what, ahead, name: linked.filter(F.col("_what") == what).select("_v", (F.col("_r") + ahead).alias("_r"), "_local", "_c").withColumn("_p", place).select(*_KEYS, "_p", F.col("_local").alias(name))
    up = side("start", 0, "_local").join(side("end", 1, "_to"), [*_KEYS, "_p"]).select(*_KEYS, "_local", (F.col("_r") - 1).alias("_to_r"), "_to")
    up = written(up, "up-0")
    turn = 0
    while True:
        step = up.select("_v", F.col("_r").alias("_to_r"), F.col("_local").alias("_to"), F.col("_to_r").alias("_up_r"), F.col("_to").alias("_up"))
        turn += 1
        new = written(up.join(step, ["_v", "_to_r", "_to"], "left").select(*_KEYS, "_local", F.coalesce("_up_r", "_to_r").alias("_to_r"), F.coalesce("_up", "_to").alias("_to"), F.col("_up").isNotNull().alias("_moved")), f"up-{turn}")
        up = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            break
    known = up.join(counts.select("_v", F.col("_r").alias("_to_r"), "_before", "_offset"), ["_v", "_to_r"]).select(*_KEYS, "_local", (F.col("_offset") + F.col("_to") - F.col("_before")).alias("_old"))
    boxes = linked.filter("_what = 'box'").join(counts, _KEYS).join(known, [*_KEYS, "_local"], "left")
    born = F.col("_offset") + F.col("_local") - F.col("_before")
    return boxes.select(*cols, F.when(F.col("_local") > F.col("_before"), born).otherwise(F.col("_old")).alias("track_id"))


#: Fixed value: metres of the widest merge rule.
WIDEST = 15.0


def merge_clusters(clusters: DataFrame) -> DataFrame:
    """clusters (video, id, x, y, n, spot) merged by spot, size and distance: (video, id, root, x, y, n of the root).

    Pairs of a video: in one known spot (two without a spot count as one) within 10 m if the smaller has under 5, within
    8 m if it has under 10 and the larger 15 or more, within 15 m if the larger has 15 or more, else within 3 m; in
    different spots within 3 m if the smaller has under 5. The smaller joins the larger (the earlier of equal ones); each
    keeps its last pair in id order, and chains are followed.
    """
    spark = clusters.sparkSession
    # cells as wide as the widest rule: a cluster meets those of its own cell and of the cells around it
    cell = lambda c: F.floor(F.col(c) / WIDEST)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = clusters.select("video", *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "n", "spot")], cell("x").alias("_x"), cell("y").alias("_y"))
    b = clusters.withColumn("_o", around).select("video", *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "n", "spot")], (cell("x") + F.col("_o.i")).alias("_x"), (cell("y") + F.col("_o.j")).alias("_y"))
    far = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2))
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    same = F.col("a_spot").eqNullSafe(F.col("b_spot")) & F.coalesce(F.col("a_spot") != "unknown", F.lit(True))
    limit = F.when(same, F.when(low < 5, 10.0).when((low < 10) & (high >= 15), 8.0).when(high >= 15, 15.0).otherwise(3.0)).otherwise(F.when(low < 5, 3.0))
    pairs = a.join(b, ["video", "_x", "_y"]).filter(F.col("a_id") < F.col("b_id")).filter(far <= limit)
    smaller, larger = F.when(F.col("a_n") >= F.col("b_n"), F.col("b_id")).otherwise(F.col("a_id")), F.when(F.col("a_n") >= F.col("b_n"), F.col("a_id")).otherwise(F.col("b_id"))
    last = pairs.select("video", smaller.alias("id"), larger.alias("to"), "a_id", "b_id").groupBy("video", "id").agg(F.max_by("to", F.struct("a_id", "b_id")).alias("to"))
    path = shared_folder(spark, "clusters")
    last.write.parquet(f"{path}/0")
    parents, turn = spark.read.parquet(f"{path}/0"), 0
    while True:  # pointer jumping: chains lead to larger or earlier clusters and halve, so rounds grow with the logarithm of the longest
        up = parents.select("video", F.col("id").alias("to"), F.col("to").alias("up"))
        new = parents.join(up, ["video", "to"], "left").select("video", "id", F.coalesce("up", "to").alias("to"), (F.col("up").isNotNull()).alias("moved"))
        turn += 1
        new.write.parquet(f"{path}/{turn}")
        new = spark.read.parquet(f"{path}/{turn}")
        parents = new.select("video", "id", "to")
        if new.filter("moved").isEmpty():
            break
    rooted = clusters.join(parents, ["video", "id"], "left").withColumn("root", F.coalesce("to", "id")).drop("to")
    whole = rooted.groupBy("video", "root").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("root_x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("root_y"), F.sum("n").alias("root_n"))
    return rooted.select("video", "id", "root").join(whole, ["video", "root"])


def filter_clusters(clusters: DataFrame, least: int = 2, bound: float = 200.0) -> DataFrame:
    """clusters with the reason to drop them: too_few, out_of_bounds, or null."""
    off = (F.abs("x") > bound) | (F.abs("y") > bound)
    return clusters.withColumn("reason", F.when(F.col("n") < least, "too_few").when(off, "out_of_bounds"))

