"""Writers and maintenance of the yard's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.functions.text import nz
from yardspark.operators.dashboard import normalise_scans

#: The columns of an event file, in order.
EVENT_COLUMNS = ["ts_iso", "camera_id", "track_id", "bbox", "text", "conf", "x_world", "y_world", "spot", "method"]


def write_event_csv(events: DataFrame, path: str) -> None:
    """The ten columns with blanks for what is missing, one folder a day; box lists are joined by commas."""
    kinds = dict(events.dtypes)
    text = lambda c: F.array_join(c, ",") if kinds[c].startswith("array") else F.col(c).cast("string")
    day = F.to_date(F.substring("ts_iso", 1, 10))
    rows = events.select(*[F.coalesce(text(c), F.lit("")).alias(c) if c in kinds else F.lit("").alias(c) for c in EVENT_COLUMNS], day.alias("date"))
    rows.write.mode("append").partitionBy("date").option("header", True).option("emptyValue", "").csv(path)


def ingest_scans(batch: DataFrame, device_id: str, target: str, now) -> int:
    """Appends a normalised batch; returns its number of rows as the write itself counted them."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = normalise_scans(batch, now).withColumn("device_id", F.lit(device_id)).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").parquet(target)
    return seen.get["n"]


def ingest_events(batch: DataFrame, target: str) -> None:
    """Appends events with readable times; one that cannot be read fails the whole batch before anything is kept."""
    stamp = F.to_timestamp("ts_iso")
    sound = F.when(stamp.isNotNull() & nz("camera_id").isNotNull(), stamp).otherwise(F.raise_error(F.lit("event without time or camera")).cast("timestamp"))
    batch.withColumn("ts", sound).drop("ts_iso").write.mode("append").parquet(target)


def export_dated(df: DataFrame, root: str, kind: str, stamp: str = "ts") -> None:
    """Parquet under root/kind by year, month and day."""
    c = F.col(stamp)
    df.withColumns({"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)}).write.mode("append").partitionBy("year", "month", "day").parquet(f"{root}/{kind}")


def drain_processed(scans: DataFrame, sink: Callable[[DataFrame], None], most: int = 100) -> DataFrame:
    """Gives the newest processed rows to the sink and returns the rows that stay; if the sink fails nothing is removed.

    The rows (200 at most) are held by the driver, so that exactly those that the sink gets are removed, whatever
    arrives meanwhile.
    """
    taken = scans.filter("is_processed").orderBy(F.col("created_on").desc(), "id").limit(min(most, 200)).collect()
    out = scans.sparkSession.createDataFrame(taken, scans.schema)
    sink(out)
    return scans.join(F.broadcast(out.select("id")), "id", "left_anti")


def write_readings(readings: DataFrame, path: str) -> None:
    """One JSON folder a video."""
    readings.write.mode("overwrite").partitionBy("video").json(path)


def write_combined(combined: DataFrame, path: str) -> None:
    """The combined crop records, one JSON folder a video, blanks and zeros for what was not read."""
    filled = combined.withColumns({"ocr_text": F.coalesce("ocr_text", F.lit("")), "ocr_conf": F.coalesce("ocr_conf", F.lit(0.0))})
    filled.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("video").json(path)


def readings_to_scans(combined: DataFrame) -> DataFrame:
    """Rows with text and a position as waiting scans. A position is one source's pair: lat and lon, else the world
    coordinates, else x_world and y_world. The heading stands in where barrier is missing or 0."""
    have = lambda c, kind="double": F.col(c) if c in combined.columns else F.lit(None).cast(kind)
    world = have("world_coords", "array<double>")
    pair = lambda lat, lon: F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))
    at = F.coalesce(pair(have("lat"), have("lon")), pair(F.get(world, F.lit(0)), F.get(world, F.lit(1))), pair(have("x_world"), have("y_world")))
    rows = combined.withColumn("_at", at).filter(F.col("_at").isNotNull() & nz("ocr_text").isNotNull())
    barrier = F.coalesce(F.nullif(have("barrier"), F.lit(0.0)), have("heading"))
    return rows.withColumns({"latitude": F.col("_at.lat"), "longitude": F.col("_at.lon"), "licence_plate_trailer": nz("ocr_text"), "barrier": barrier, "confidence": have("ocr_conf"), "is_processed": F.lit(False)}).drop("_at")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's missing columns as nulls; the same again if repeated."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def write_ocr_labels(labels: DataFrame, path: str) -> None:
    """Sorted lines of filename and label, one folder a split."""
    labels.select("split", F.concat_ws(" ", "filename", "label").alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def register_functions(spark: SparkSession) -> None:
    from yardspark.functions.geo import register_sql

    register_sql(spark)
