"""Streaming forms of the yard's operators: each takes a streaming table and returns one, unless it writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from yardspark.functions.text import nz
from yardspark.operators.lanes import link_frames
from yardspark.operators.tracking import LEAST_CONF, Linker
from yardspark.sources.folders import shared_folder
from yardspark.streaming.keyed import in_order


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """A stream that starts within has its state in two parts for each core, at most as many as the session shuffles to:
    in every batch each part costs files and a Python worker, also where it holds nothing."""
    name = "spark.sql.shuffle.partitions"
    held = spark.conf.get(name)
    spark.conf.set(name, min(int(held), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """What a stream makes of the input there is, as a table under the shared folder: every batch is one Parquet
    folder of its own number, so that a batch that is run again overwrites itself; in complete mode the last one counts."""
    spark = stream.sparkSession
    root = shared_folder(spark, "stream")
    seen: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        seen.append(number)

    with state_partitions(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}-state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    numbers = sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen))
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batch={n}" for n in numbers])


def hourly_rollup(events: DataFrame, late: str = "3 hours") -> DataFrame:
    """Events and mean confidence per hour, camera and spot; rows up to `late` behind the newest are still counted."""
    hour = F.window("ts", "1 hour").alias("w")
    return events.withWatermark("ts", late).groupBy(hour, "camera_id", "spot_name").agg(F.count("*").alias("event_count"), F.avg("conf").alias("avg_confidence")).select(F.col("w.start").alias("hour"), "camera_id", "spot_name", "event_count", "avg_confidence")


def dedupe(events: DataFrame, key: str = "plate", within: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def chunks(events: DataFrame, length: str = "45 seconds", late: str = "1 minute") -> DataFrame:
    """Fixed segments of each camera with their number of entries."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "camera_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "camera_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits of tracks: activity up to a gap. Rows without a track only move the watermark."""
    # the condition names the event time too, or it would be moved in front of the watermark
    rows = events.withWatermark("ts", late).filter(F.array_min(F.array(F.col("ts").isNotNull(), F.col("track_id").isNotNull())))
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "track_id").agg(F.count("*").alias("n")).select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(metrics: DataFrame, seconds: int = 300, step_s: int = 60, late: str = "10 minutes", key: str = "camera_id", order: str = "id") -> DataFrame:
    """(key, start, rate, last_value): per-second increase of each key's counter (value) over sliding windows.

    The counter's last value is state, so increases are those between neighbours in time, of whatever window; a fall
    counts as a restart. Each step's increase is kept until the last window that holds it is over.
    """
    step, length = step_s * 1_000_000, seconds * 1_000_000

    def on(key, state, t: int, rows: list[tuple]):
        last, at, ups, values, shown = state or (None, [], [], [], 0)
        at, ups, values = list(at), list(ups), list(values)
        for _, v in rows:
            up = 0.0 if last is None else v if v < last else v - last
            last = float(v)
            if not at or at[-1] != t // step * step:
                at.append(t // step * step)
                ups.append(0.0)
                values.append(0.0)
            ups[-1] += up
            values[-1] = last
        state = (last, at, ups, values, shown)
        return state, [], next_end(state)

    def next_end(state) -> int | None:
        """The end of the next window to show, of those that hold a step and are not shown yet."""
        _, at, _, _, shown = state
        ends = [max(a + step, shown + step) for a in at if shown < a + length]
        return min(ends, default=None)

    def end_of(key, state, until: int):
        last, at, ups, values, _ = state
        held = [i for i, a in enumerate(at) if until - length <= a < until]
        out = [(until - length, sum(ups[i] for i in held) / seconds, values[held[-1]])] if held else []
        keep = [i for i, a in enumerate(at) if a + length > until]
        state = (last, [at[i] for i in keep], [ups[i] for i in keep], [values[i] for i in keep], until)
        return state, out, next_end(state)

    rows = metrics.withColumn("value", F.col("value").cast("double"))
    return in_order(rows, [key], order, ["value"], "last double, steps array<long>, ups array<double>, values array<double>, shown long", "start timestamp, rate double, last_value double", on, end_of, late)


def gps_join(frames: DataFrame, fixes: DataFrame, tolerance_s: int, late_s: int = 3600) -> DataFrame:
    """(device, event_id, fix_id, g_ts): each frame (device, event_id, ts) with the latest fix (device, fix_id, ts) of its
    device within the tolerance (inclusive), of equal times the greater fix; frames without one are left out.

    A frame stands at the end of its tolerance, where the last fix before it is the one, if it is not too old. So state is
    one fix a device, and no pairs are made, however dense the fixes are. Rows may be `late_s` seconds late.
    """
    width = tolerance_s * 1_000_000

    def on(key, state, t: int, rows: list[tuple]):
        here = [i for i, is_fix in rows if is_fix]
        last = (t, max(here)) if here else state
        if last is None:
            return None, [], None
        out = [(i, last[1], last[0]) for i, is_fix in rows if not is_fix and t - last[0] <= 2 * width]
        return last, out, last[0] + 2 * width

    both = frames.select("device", F.col("event_id").alias("id"), F.lit(False).alias("is_fix"), (F.col("ts") + F.expr(f"interval {tolerance_s} seconds")).alias("at"))
    both = both.unionByName(fixes.select("device", F.col("fix_id").alias("id"), F.lit(True).alias("is_fix"), F.col("ts").alias("at")))
    return in_order(both, ["device"], "id", ["is_fix"], "at long, fix long", "event_id long, fix_id long, g_ts timestamp", on, late=f"{late_s + tolerance_s} seconds", stamp="at")


def ingest(stream: DataFrame, target: str, checkpoint: str, required: tuple[str, ...] = ("id", "ts")) -> None:
    """Appends valid rows as they arrive; a batch is written under its own number, so a repeated one is not doubled."""
    sound = stream
    for c in required:
        sound = sound.filter(F.col(c).isNotNull())
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    sound.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def assign(stream: DataFrame, place: Callable[[DataFrame], DataFrame], settle_s: int = 10, keep_s: int = 3600, late: str = "1 minute", stamp: str = "ts", plate: str = "plate", order: str = "id", only: Column | None = None) -> DataFrame:
    """What `place` (such as place_scans) makes of each plate's settled row, as a table.

    A plate's first row opens a wait of `settle_s` seconds; the newest row within it (of equal times the one that comes
    first) is placed when the watermark is past the wait. For `keep_s` seconds more the plate is handled and its rows are
    left out; then it is forgotten. Blank plates only move the watermark, as do rows that are not `only`. State is one
    row a plate that was seen lately; nothing that was written is read again, and a repeated batch overwrites itself.
    """
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession, "assign")
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    settle, keep = settle_s * 1_000_000, keep_s * 1_000_000

    def on(key, state, t: int, rows: list[tuple]):
        opened, _, handled = state or (t, "", False)
        if handled:
            return state, [], opened + settle + keep
        return (opened, rows[0][1], False), [], opened + settle

    def end_of(key, state, until: int):
        opened, best, handled = state
        return (None, [], None) if handled else ((opened, "", True), [(best,)], opened + settle + keep)

    counts = nz(plate).isNotNull() if only is None else nz(plate).isNotNull() & only
    rows = stream.withColumns({"whole_row": F.to_json(F.struct(*stream.columns), form), "plate_key": F.col(plate)})
    chosen = in_order(rows, ["plate_key"], order, ["whole_row"], "opened long, best string, handled boolean", "row string", on, end_of, late, stamp, counts)

    def each(batch: DataFrame, n: int) -> None:
        place(batch.select(F.from_json("row", stream.schema, form).alias("r")).select("r.*")).write.mode("overwrite").parquet(f"{root}/placed/batch={n}")

    with state_partitions(spark):
        query = chosen.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/placed").drop("batch")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]]):
    """A writer that gives each batch, as JSON with its id, to every sink."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.select(F.to_json(F.struct(*batch.columns)).alias("value")).persist()
        try:
            for sink in sinks.values():
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each)


def event_csv(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Daily CSV folders of a stream."""
    rows = stream.withColumn("date", F.to_date("ts"))
    rows.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).start().awaitTermination()


def observations(events: DataFrame, cutoff_s: int, least: int, keep_s: int = 86_400, late: str = "1 hour", tag: str = "tag", order: str = "id") -> DataFrame:
    """(tag, at, n): the moment (in seconds) when `least` observations of a tag lie within the cutoff; then the tag is
    ignored for `keep_s` seconds and forgotten.

    State holds the times within the cutoff, or the mark of a reported tag, and goes when its time is over. Times are
    whole seconds: the last second that counts as within a span lasts to its end.
    """

    def on(key, state, t: int, rows: list[tuple]):
        times, reported = state or ([], 0)
        times, s = list(times), t // 1_000_000
        if reported:
            return state, [], (reported + keep_s + 1) * 1_000_000 - 1
        times = [x for x in times if x >= s - cutoff_s]
        for _ in rows:
            times.append(s)
            if len(times) >= least:
                return ([], s), [(s, len(times))], (s + keep_s + 1) * 1_000_000 - 1
        return (times, 0), [], (s + cutoff_s + 1) * 1_000_000

    return in_order(events, [tag], order, [], "times array<long>, reported long", "at long, n long", on, late=late)


def tracks(detections: DataFrame, idle_s: int = 60, late: str = "10 seconds", stamp: str = "ts") -> DataFrame:
    """link_detections with keyed state: (video, frame, box_id, track_id), each frame once the watermark is past its time.

    A video without frames for `idle_s` seconds is over and forgotten; if it comes back its tracks are numbered anew.
    Frames that come due together are linked side by side, where they are many.
    """

    idle = idle_s * 1_000_000

    def on(key, state, until: int | None, rows: pd.DataFrame):
        times, frames, box_ids = (rows[c].to_numpy(np.int64) for c in ("event_us", "frame", "box_id"))
        order = np.lexsort((box_ids, frames, times))
        times, frames, box_ids, boxes = times[order], frames[order], box_ids[order], rows[["x1", "y1", "x2", "y2"]].to_numpy(float)[order]
        firsts = np.flatnonzero(np.append(True, (np.diff(times) != 0) | (np.diff(frames) != 0)))
        over = np.flatnonzero(np.diff(times[firsts]) > idle) + 1
        firsts = np.append(firsts, len(frames))
        linker = opened(*state) if state and (until is None or until >= times[0]) else Linker()
        ids = np.empty(len(frames), np.int64)
        for n, (a, z) in enumerate(zip([0, *over], [*over, len(firsts) - 1], strict=True)):
            linker = Linker() if n else linker
            own = slice(firsts[a], firsts[z])
            ids[own] = link_frames(linker, frames[firsts[a:z]], firsts[a : z + 1] - firsts[a], boxes[own])
        flat = [float(x) for track in linker.tracks for x in track]
        return (flat, linker.next_id), pd.DataFrame({"frame": frames, "box_id": box_ids, "track_id": ids}), int(times[-1]) + idle

    def opened(flat, next_id: int) -> Linker:
        flat = [float(x) for x in flat]
        return Linker([[int(flat[i]), int(flat[i + 1]), *flat[i + 2 : i + 8]] for i in range(0, len(flat), 8)], int(next_id))

    rows = detections.withColumns({"video": F.col("video").cast("string"), "frame": F.col("frame").cast("long"), "box_id": F.col("box_id").cast("long"), **{c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}})
    return in_order(rows, ["video"], "box_id", ["frame", "x1", "y1", "x2", "y2"], "flat array<double>, next_id long", "frame long, box_id long, track_id long", on, late=late, stamp=stamp, only=F.col("conf") >= LEAST_CONF, whole=True)


def reading_cache(readings: DataFrame, stale: int = 30, often: int = 10, low: float = 0.5, idle_s: int = 3600, late: str = "1 minute") -> DataFrame:
    """readings (camera_id, track_id, frame, text, conf, ts) with the text in use and whether it was read anew.

    Text that is there is used again; it is read anew when `stale` frames old, or each `often` frames while its
    confidence is under `low`. A track without readings for more than `idle_s` seconds of event time is forgotten, which
    bounds the cache.
    """

    def on(key, state, t: int, rows: list[tuple]):
        text, conf, at = state or ("", 0.0, None)
        out = []
        for frame, new, c in rows:
            again = not text or frame - at >= stale or (conf < low and frame - at >= often)
            if again:
                text, conf, at = new or "", float(c or 0.0), int(frame)
            out.append((int(frame), text, again))
        return (text, conf, at), out, t + idle_s * 1_000_000

    return in_order(readings, ["camera_id", "track_id"], "frame", ["text", "conf"], "text string, conf double, at long", "frame long, text string, fresh boolean", on, late=late)


def liveness(events: DataFrame, silent_s: int = 30, late: str = "1 minute") -> DataFrame:
    """(camera_id, online, at): a row when a camera is first seen or comes back after silence in event time, and one when
    it went silent: as soon as the watermark is past its last event and the silence, also if it never comes back."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, online = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out, online = [(key[0], False, last + silent_s)], False
        else:
            for t in sorted(t for f in frames for t in f["ts_s"].tolist()):
                if last is not None and online and t - last > silent_s:
                    out.append((key[0], False, last + silent_s))
                    online = False
                if not online:
                    out.append((key[0], True, t))
                last, online = t if last is None else max(last, t), True
        due = (last + silent_s) * 1000
        if online and due < state.getCurrentWatermarkMs():
            out.append((key[0], False, last + silent_s))
            online = False
        state.update((last, online))
        if online:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["camera_id", "online", "at"])

    rows = events.withWatermark("ts", late).select("camera_id", "ts", F.unix_timestamp("ts").alias("ts_s"))
    return rows.groupBy("camera_id").applyInPandasWithState(step, "camera_id string, online boolean, at long", "last long, online boolean", "append", GroupStateTimeout.EventTimeTimeout)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, most: int = 200, every: str | None = None, remove: Callable[[DataFrame, int], None] | None = None, key: str = "id") -> None:
    """Gives the processed rows of each batch to the sink in groups of at most `most`, newest first, and then their keys
    to `remove`; a group that fails stops the stream, which goes on from its last batch.

    What is to be sent is written first, under the batch's number, and read by both, so that a repeated batch removes
    exactly what was sent; a batch whose sink ended well is marked, and only removed when it is repeated. every: a
    processing time such as "60 seconds", else what there is.
    """
    from pyspark.sql import Window

    spark = stream.sparkSession
    sent = lambda number: f"{checkpoint}-sent/batch={number}"

    def each(batch: DataFrame, number: int) -> None:
        if not _there(spark, f"{sent(number)}/rows/_SUCCESS"):
            rows = batch.filter("is_processed")
            # groups by day and camera keep the ranking within keyed partitions
            rank = F.row_number().over(Window.partitionBy(F.to_date("created_on"), "camera_id").orderBy(F.col("created_on").desc(), "id"))
            rows.withColumn("drain_group", F.floor((rank - 1) / most)).write.mode("overwrite").parquet(f"{sent(number)}/rows")
        rows = spark.read.parquet(f"{sent(number)}/rows")
        if not _there(spark, f"{sent(number)}/done"):
            sink(rows, number)
            _path(spark, f"{sent(number)}/done")[0].create(_path(spark, f"{sent(number)}/done")[1]).close()
        if remove is not None:
            remove(rows.select(key), number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if not every:
        query.awaitTermination()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _there(spark: SparkSession, name: str) -> bool:
    system, path = _path(spark, name)
    return system.exists(path)
