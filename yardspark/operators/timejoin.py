"""Joins in time between frames and position fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def gps_at(frames: DataFrame, fixes: DataFrame, tolerance_s: float = 0.2, key: str = "device", bucket_s: int = 3600) -> DataFrame:
    """frames with the latest fix within the tolerance (inclusive), null where there is none.

    A frame stands at the end of its tolerance, where the last fix before it is the one, if it is not too old. Sorting
    each key's bucket of time finds it, without pairs; the last fix of the buckets before stands in a bucket as a row of
    its own. A chosen fix without position gives no position.
    """
    width = int(tolerance_s * 1_000_000)
    kinds = {c: fixes.schema[c].dataType.simpleString() for c in ("event_id", "lat", "lon")}
    kind = f"struct<t:bigint,fix_id:{kinds['event_id']},lat:{kinds['lat']},lon:{kinds['lon']}>"
    known = fixes.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    fix = F.struct(_micros("ts").alias("t"), F.col("event_id").alias("fix_id"), "lat", "lon").cast(kind)
    none = F.lit(None).cast(frames.select(F.struct(*frames.columns).alias("s")).schema["s"].dataType)
    both = frames.select(key, F.struct(*frames.columns).alias("_row"), (_micros("ts") + width).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(kind).alias("_f"))
    both = both.unionByName(known.select(key, none.alias("_row"), _micros("ts").alias("_t"), F.lit(0).alias("_k"), fix.alias("_f"))).withColumn("_b", F.floor(F.col("_t") / (bucket_s * 1_000_000)))
    ends = bucket_ends(both, key, "_b", F.col("_f"), F.col("_f"), kind).filter("_prev is not null")
    both = both.unionByName(ends.select(key, none.alias("_row"), F.col("_prev.t").alias("_t"), F.lit(0).alias("_k"), F.col("_prev").alias("_f"), "_b"))
    before = F.last("_f", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy("_t", "_k", "_f.fix_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_p", before).filter("_k = 1")
    rows = rows.withColumn("_p", F.when(F.col("_t") - F.col("_p.t") <= 2 * width, F.col("_p")))
    return rows.select("_row.*", "_p.fix_id", "_p.lat", "_p.lon")


def bucket_ends(rows: DataFrame, key: str, bucket: str, low: Column, high: Column, kind: str) -> DataFrame:
    """(key, bucket, _prev, _next) of each bucket: the greatest `high` of the key's earlier buckets and the least `low` of
    its later ones that have any. Only one row for each bucket is ordered along the whole time of a key."""
    ends = rows.groupBy(key, bucket).agg(F.min(low).cast(kind).alias("_low"), F.max(high).cast(kind).alias("_high"))
    along = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(key).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(key, bucket, F.last("_high", ignorenulls=True).over(along).alias("_prev"), F.last("_low", ignorenulls=True).over(back).alias("_next"))


def gps_nearest(frames: DataFrame, fixes: DataFrame, key: str = "device", bucket_s: int = 3600) -> DataFrame:
    """frames with the fix nearest in time, without tolerance; of equal gaps the earlier fix.

    Sorting each key's bucket of time gives each frame the last fix before it and the first one after it; the nearest
    fixes of other buckets stand in each bucket as rows of their own.
    """
    kind = "struct<t:bigint,fix_id:bigint>"
    fix = F.struct(_micros("ts").alias("t"), F.col("event_id").alias("fix_id"))
    none = F.lit(None).cast("long").alias("event_id")
    both = frames.select(key, "event_id", _micros("ts").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(kind).alias("_f"))
    both = both.unionByName(fixes.select(key, none, _micros("ts").alias("_t"), F.lit(0).alias("_k"), fix.alias("_f"))).withColumn("_b", F.floor(F.col("_t") / (bucket_s * 1_000_000)))
    ends = bucket_ends(both, key, "_b", F.col("_f"), F.col("_f"), kind).withColumn("_f", F.explode(F.array_compact(F.array("_prev", "_next"))))
    both = both.unionByName(ends.select(key, none, F.col("_f.t").alias("_t"), F.lit(0).alias("_k"), "_f", "_b"))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_k", "_f.fix_id")
    before = F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_f", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy(F.col("_t").desc(), F.col("_k").desc(), F.col("_f.fix_id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"_p": before, "_n": after}).filter("_k = 1")
    closer = F.when(F.col("_n").isNull() | (F.col("_t") - F.col("_p.t") <= F.col("_n.t") - F.col("_t")), F.col("_p")).otherwise(F.col("_n"))
    rows = rows.withColumn("_c", F.coalesce(closer, F.col("_n")))
    return rows.select("event_id", F.col("_c.fix_id").alias("fix_id"), (F.abs(F.col("_t") - F.col("_c.t")) / 1e6).alias("gap_s"))


def frame_time(frames: DataFrame, fixes: DataFrame, fps: float = 30.0) -> DataFrame:
    """frames (video, frame, total) with the time of the frame between the video's first and last fix.

    Where both fixes have one time, `total` frames at `fps` count from it.
    """
    span = fixes.groupBy("video").agg(F.min(_micros("ts")).alias("_a"), F.max(_micros("ts")).alias("_z"))
    at = F.when(F.col("_z") > F.col("_a"), F.col("frame") / F.col("total") * (F.col("_z") - F.col("_a"))).otherwise(F.col("frame") / F.lit(fps) * 1_000_000)
    return frames.join(span, "video").select(*frames.columns, (F.col("_a") + F.floor(at)).alias("micros"))


def match_gps_log(videos: DataFrame, logs: DataFrame, near_s: int = 300) -> DataFrame:
    """Each video's log by the ladder: same camera, date and time; nearest time of camera and date within near_s; camera
    and date without time; same stem; last the nearest time beyond near_s.

    videos, logs: name, camera, date, time_s (null: none), stem.

    Rows of one camera and date are not paired: their distinct times are sorted once, which gives each video's time the
    logs next before and after it, and for the other steps the first log of each camera, date and stem is enough.
    """
    key = ["camera", "date"]
    right = logs.select(*key, "time_s", "stem", F.struct(F.col("name").alias("log")).alias("_l"))
    timed = F.col("camera").isNotNull() & F.col("date").isNotNull() & F.col("time_s").isNotNull()
    times = right.filter(timed).select(*key, "time_s", "_l", F.lit(0).alias("_k"))
    times = times.unionByName(videos.filter(timed).select(*key, "time_s", F.lit(1).alias("_k")), allowMissingColumns=True)
    times = times.groupBy(*key, "time_s").agg(F.min("_l").alias("_l"), F.max("_k").alias("_k"))
    held, w = F.when(F.col("_l").isNotNull(), F.struct("time_s", "_l")), Window.partitionBy(*key)
    first, last = Window.unboundedPreceding, Window.currentRow
    times = times.withColumns({
        "_p": F.last(held, ignorenulls=True).over(w.orderBy("time_s").rowsBetween(first, last)),
        "_n": F.last(held, ignorenulls=True).over(w.orderBy(F.col("time_s").desc()).rowsBetween(first, last)),
    }).filter("_k = 1")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("time_s") - F.col(f"{c}.time_s")).alias("gap"), F.col(f"{c}._l.log").alias("log")))
    near = times.select(*key, "time_s", F.array_min(F.array(gap("_p"), gap("_n"))).alias("_near"))
    day = right.groupBy(*key).agg(F.min("_l").alias("_any"), F.min(F.when(F.col("time_s").isNull(), F.col("_l"))).alias("_untimed"))
    stems = right.groupBy("stem").agg(F.min("_l").alias("_stem"))
    found = videos.join(near, [*key, "time_s"], "left").join(day, key, "left").join(stems, "stem", "left")
    g = F.col("_near.gap")
    step = F.when(g == 0, 1).when(g <= near_s, 2).otherwise(5)
    choice = lambda l, step, gap: F.when(l.isNotNull(), F.struct(step.alias("step"), gap.alias("gap"), l["log"].alias("log")))
    untimed = F.when(F.col("time_s").isNull(), F.col("_any")).otherwise(F.col("_untimed"))
    best = F.array_min(F.array(choice(F.col("_near"), step, g), choice(untimed, F.lit(3), F.lit(0)), choice(F.col("_stem"), F.lit(4), F.lit(0))))
    out = found.select("name", best.alias("b")).filter("b is not null").groupBy("name").agg(F.min("b").alias("b"))
    return out.select("name", "b.log", "b.step", "b.gap")
