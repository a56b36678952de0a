"""Dashboard aggregates over scans: counts, accuracy by hour, utilisation, inventory, reports, pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardspark.functions.text import known_spot, nz

#: Under this confidence (missing counts as 0) a scan is an anomaly.
LOW = 0.5


def _conf(c: str = "conf") -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def scan_stats(scans: DataFrame) -> DataFrame:
    done = F.sum(F.when(F.col("is_processed"), 1).otherwise(0))
    return scans.agg(F.count("*").alias("total"), (F.count("*") - done).alias("unprocessed"), done.alias("processed"))


def filter_by_date(df: DataFrame, date: str | None, stamp: str = "created_on", today: dt.date | None = None, other: str = "timestamp") -> DataFrame:
    """Rows of one UTC day: today if no date is given; all rows if the date cannot be read; rows without a stamp go.

    Where the stamp is missing, the column `other` counts if the table has it.
    """
    try:
        day = dt.date.fromisoformat(date) if date else today or dt.datetime.now(dt.UTC).date()
    except ValueError:
        return df
    end = day + dt.timedelta(days=1)
    within = lambda c: (F.col(c) >= F.lit(day).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    rows = within(stamp)  # ranges on bare columns reach the scan
    return df.filter(rows | F.col(stamp).isNull() & within(other) if other in df.columns else rows)


def kpis(scans: DataFrame) -> DataFrame:
    text = nz("plate").isNotNull()
    return scans.agg(
        F.countDistinct("track_id").alias("tracks"), F.countDistinct(known_spot()).alias("spots"), F.count("*").alias("detections"),
        _rate(F.sum(text.cast("int")), F.count("*")).alias("ocr_rate"), F.sum((_conf() < LOW).cast("int")).alias("anomalies"),
    )


def hourly_accuracy(scans: DataFrame) -> DataFrame:
    """24 rows: mean confidence in percent of all scans and of those with text, 0 where an hour has none."""
    hour = scans.groupBy(F.hour("created_on").alias("hour")).agg(F.avg(_conf()).alias("d"), F.avg(F.when(nz("plate").isNotNull(), _conf())).alias("o"))
    hours = scans.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    pct = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 1)
    return hours.join(hour, "hour", "left").select("hour", pct("d").alias("detection"), pct("o").alias("ocr"))


def hourly_accuracy_readings(combined: DataFrame) -> DataFrame:
    """As hourly_accuracy with separate confidences; a missing detection confidence counts as 1."""
    read = (F.coalesce("ocr_conf", F.lit(0.0)) > 0) | nz("text").isNotNull()
    hour = combined.groupBy(F.hour("ts").alias("hour")).agg(F.avg(F.coalesce("det_conf", F.lit(1.0))).alias("d"), F.avg(F.when(read, F.coalesce("ocr_conf", F.lit(0.0)))).alias("o"))
    hours = combined.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    pct = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 1)
    return hours.join(hour, "hour", "left").select("hour", pct("d").alias("detection"), pct("o").alias("ocr"))


def spot_utilisation(scans: DataFrame) -> DataFrame:
    return scans.select(known_spot().alias("spot")).filter("spot is not null").groupBy("spot").agg(F.count("*").alias("n")).orderBy("spot")


def latest_per_track(scans: DataFrame) -> DataFrame:
    """The newest scan of each track, ties to the smaller id."""
    newest = F.max_by(F.struct("id", "created_on", "plate", "spot_name", "conf", "is_processed"), F.struct("created_on", -F.col("id")))
    rows = scans.filter("track_id is not null").groupBy("track_id").agg(newest.alias("s"))
    return rows.select(F.concat(F.lit("T"), F.col("track_id").cast("string")).alias("track"), "s.*")


def inventory(scans: DataFrame) -> DataFrame:
    """One row for each track: parked if its newest scan is processed or has a spot."""
    parked = F.col("is_processed") | known_spot().isNotNull()
    return latest_per_track(scans).select("track", "plate", F.coalesce(known_spot(), F.lit("N/A")).alias("spot"), F.when(parked, "Parked").otherwise("In Transit").alias("status"), F.round("conf", 6).alias("conf"))


def inventory_stats(scans: DataFrame) -> DataFrame:
    """Totals of the inventory; anomalies count over all scans."""
    rows = inventory(scans).agg(F.count("*").alias("tracks"), F.count_if(F.col("status") == "Parked").alias("parked"), F.count_if(F.col("status") == "In Transit").alias("in_transit"))
    low = scans.agg(F.count_if(_conf() < LOW).alias("anomalies"))
    return rows.join(F.broadcast(low))  # one row each


def period_report(scans: DataFrame, now: dt.datetime, per_period: bool = False) -> DataFrame:
    """Rows of the last day, 7 and 30 days; text rate and anomalies over all rows, or of each period with per_period."""
    at, text = F.lit(now).cast("timestamp_ntz"), nz("plate").isNotNull()
    periods = [("daily", 1), ("weekly", 7), ("monthly", 30)]
    inside = lambda d: (F.col("created_on") > at - F.expr(f"interval {d} days")) & (F.col("created_on") <= at)
    aggs = []
    for name, days in periods:
        base = inside(days) if per_period else F.lit(True)
        aggs.append(F.struct(F.lit(name).alias("period"), F.count_if(inside(days)).alias("detections"), _rate(F.count_if(base & text), F.count_if(base)).alias("ocr_rate"), F.count_if(base & (_conf() < LOW)).alias("anomalies")))
    return scans.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def hourly_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "created_on").cast("timestamp_ntz").alias("hour"), "camera_id", "spot_name").agg(F.count("*").alias("event_count"), F.round(F.avg("conf"), 6).alias("avg_confidence"))


def lanes(scans: DataFrame, default: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """Distinct lanes (the text before '-') in order; the default list if there is none."""
    found = scans.select(F.split(known_spot(), "-")[0].alias("lane")).filter("lane is not null").distinct()
    return found.unionByName(_only_if_empty(found, scans.sparkSession.createDataFrame([(x,) for x in default], "lane string"))).orderBy("lane")


def _only_if_empty(first: DataFrame, second: DataFrame) -> DataFrame:
    some = first.limit(1).agg(F.count("*").alias("_n"))
    return second.join(F.broadcast(some)).filter("_n = 0").drop("_n")


def first_non_empty(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first table, or the second where the first has no row."""
    return first.unionByName(_only_if_empty(first, second))


def camera_health(cameras: DataFrame) -> DataFrame:
    """cameras: camera_id, status, fps, latency."""
    return cameras.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("fps"), 0).alias("fps"), F.round(F.avg("latency"), 0).alias("latency"))


def yard_view(scans: DataFrame) -> DataFrame:
    """The newest scan of each spot, with its lane."""
    rows = scans.withColumn("spot", known_spot()).filter("spot is not null")
    newest = F.max_by(F.struct("id", "track_id", "plate", "created_on"), F.struct("created_on", -F.col("id")))
    out = rows.groupBy("spot").agg(newest.alias("s")).select("spot", F.split("spot", "-")[0].alias("lane"), F.lit(True).alias("occupied"), "s.*")
    return out.select("spot", "lane", "occupied", F.concat(F.lit("T"), F.col("track_id").cast("string")).alias("trailer"), nz("plate").alias("plate"), "created_on")


def page(df: DataFrame, limit: int, offset: int = 0, stamp: str = "created_on", key: str = "id") -> DataFrame:
    """Newest first, rows without a time last, then by id."""
    return df.orderBy(F.col(stamp).desc_nulls_last(), key).offset(offset).limit(limit)


def recent_events(scans: DataFrame, limit: int, date: str | None, newest: int = 2000) -> DataFrame:
    """The newest rows first, then the day's among them, in time order: the cut comes before the filter."""
    return page(filter_by_date(page(scans, newest), date) if date else page(scans, newest), limit)


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows by a position column, in its order."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def unprocessed(scans: DataFrame, now: dt.datetime, limit: int = 50, settle_s: int = 10, camera: str | None = None) -> DataFrame:
    """Newest rows that wait for a spot and have settled."""
    rows = scans.filter(~F.col("is_processed") & (F.col("created_on") <= F.lit(now - dt.timedelta(seconds=settle_s)).cast("timestamp_ntz")))
    return page(rows.filter(F.col("camera_id") == camera) if camera else rows, limit)


def event_view(scans: DataFrame) -> DataFrame:
    conf = _conf()
    return scans.select(
        "id", F.coalesce("camera_id", F.lit("unknown")).alias("camera_id"), F.coalesce(F.concat(F.lit("T"), F.col("track_id").cast("string")), F.lit("N/A")).alias("track"),
        F.coalesce(nz("plate"), F.lit("")).alias("text"), F.round(conf, 6).alias("conf"), F.coalesce(known_spot(), F.lit("unknown")).alias("spot"),
    )


def classify_events(events: DataFrame) -> DataFrame:
    """Text makes an event OCR; else a low confidence that is not 0 an Anomaly; else it is a Detection."""
    low = (F.col("conf") != 0) & (F.col("conf") < LOW)
    return events.withColumn("type", F.when(nz("text").isNotNull(), "OCR").when(low, "Anomaly").otherwise("Detection"))


def confidence_pct(conf: Column) -> Column:
    """Values above 1 are percent already; null is 0."""
    c = F.coalesce(conf, F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(c > 1, c).otherwise(c * 100)))


def position_quality(conf: Column, method: Column) -> Column:
    good = method.isin("polygon", "calibration", "point-in-polygon")
    return F.when(good, F.least(F.lit(0.99), conf + 0.1)).otherwise(conf)


def scan_view(scans: DataFrame) -> DataFrame:
    """The row that clients get: numbers as doubles, confidence and frame number 0 and processed false where missing,
    times as ISO text, the timestamp by created_on where missing. Columns that the table lacks are null."""
    have = lambda c, kind: F.col(c).cast(kind) if c in scans.columns else F.lit(None).cast(kind)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    created = have("created_on", "timestamp_ntz")
    strings = {c: have(c, "string") for c in ("licence_plate_trailer", "image_path", "camera_id", "video_path", "assigned_spot_id", "assigned_spot_name", "processed_comment", "image_url")}
    numbers = {c: have(c, "double") for c in ("latitude", "longitude", "speed", "barrier", "assigned_distance_ft")}
    out = {"id": have("id", "long")} | strings | numbers | {
        "confidence": F.coalesce(have("confidence", "double"), F.lit(0.0)), "frame_number": F.coalesce(have("frame_number", "int"), F.lit(0)), "track_id": have("track_id", "int"),
        "is_processed": F.coalesce(have("is_processed", "boolean"), F.lit(False)), "created_on": iso(created), "timestamp": iso(F.coalesce(have("timestamp", "timestamp_ntz"), created)),
    }
    return scans.select(*[c.alias(k) for k, c in out.items()])


def filter_scans(scans: DataFrame, is_processed: bool | None = None, camera_id: str | None = None) -> DataFrame:
    if is_processed is not None:
        scans = scans.filter(F.col("is_processed") == is_processed)
    return scans.filter(F.col("camera_id") == camera_id) if camera_id else scans


def normalise_scans(batch: DataFrame, now: dt.datetime) -> DataFrame:
    """Blank strings become null, numbers get 0, times fall back to created_on and then to now; processed by default."""
    at = F.lit(now).cast("timestamp")
    stamp = lambda c: F.try_to_timestamp(nz(F.col(c).cast("string")))
    missing = lambda c, kind: F.col(c) if c in batch.columns else F.lit(None).cast(kind)
    batch = batch.withColumns({c: missing(c, k) for c, k in (("timestamp", "string"), ("created_on", "string"), ("confidence", "double"), ("frame_number", "int"), ("is_processed", "boolean"))})
    strings = {c: nz(c) for c, k in batch.dtypes if k == "string" and c not in ("timestamp", "created_on")}
    return batch.withColumns(strings | {
        "timestamp": F.coalesce(stamp("timestamp"), stamp("created_on"), at), "created_on": F.coalesce(stamp("created_on"), stamp("timestamp"), at),
        "confidence": F.coalesce("confidence", F.lit(0.0)), "frame_number": F.coalesce("frame_number", F.lit(0)), "is_processed": F.coalesce("is_processed", F.lit(True)),
    })


def remove_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def keep_last(df: DataFrame, n: int, group: str = "camera_id", stamp: str = "created_on", key: str = "id") -> DataFrame:
    """Every row with whether it is among the newest n of its group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(stamp).desc(), key))
    return df.withColumn("kept", rank <= n)
