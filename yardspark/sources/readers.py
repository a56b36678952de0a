"""Readers of the yard's tables and files. Files are listed and read by Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardspark.functions.geo import ring_centroid
from yardspark.functions.text import nz

SCANS = "id long, licence_plate_trailer string, latitude double, longitude double, speed double, barrier double, confidence double, image_path string, camera_id string, video_path string, frame_number int, track_id int, timestamp timestamp, created_on timestamp, updated_on timestamp, is_processed boolean, assigned_spot_id string, assigned_spot_name string, assigned_distance_ft double, processed_comment string, device_id string, image_url string"
EVENTS = "id long, ts timestamp, camera_id string, track_id int, bbox string, text string, conf float, x_world float, y_world float, spot string, method string"
EVENT_CSV = "ts_iso string, camera_id string, track_id string, bbox string, text string, conf string, x_world string, y_world string, spot string, method string"
FIX = "struct<lat: double, lon: double, timestamp: string, heading: double, speed: double>"
CROP = "struct<crop_path: string, crop_filename: string, frame_count: int, track_id: int, bbox: array<double>, bbox_original: array<double>, bbox_display: array<double>, det_conf: double, width: int, height: int, area: int, image_coords: array<double>, spot: string, lat: double, lon: double, gps_source: string, track_key: string, bbox_hash: string, timestamp: string, camera_id: string, heading: double, speed: double, ocr_text: string, ocr_conf: double, ocr_method: string, world_coords: array<double>>"
#: Header aliases of spot tables, in order of preference.
SPOT_HEADERS = {"lat5": ["latitude 5", "lat5", "latitude5"], "lon5": ["longitude 5", "lon5", "longitude5"], "lat": ["latitude", "lat"], "lon": ["longitude", "lon", "lng"], "name": ["name", "spot", "spot_name"], "id": ["id", "spot_id"]}


def read_scans(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.schema(SCANS).load(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(path).withColumns({c: F.col(c).cast("double") for c in ("conf", "x_world", "y_world")})


def _number(c: str) -> Column:
    """A double, 0 where blank, unreadable, NaN or infinite."""
    v = F.expr(f"try_cast(trim({c}) as double)")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema(EVENT_CSV).csv(path)
    numbers = {c: _number(c) for c in ("conf", "x_world", "y_world")} | {"track_id": F.coalesce(F.expr("try_cast(trim(track_id) as int)"), F.lit(0))}
    return rows.withColumns(numbers | {c: F.coalesce(F.trim(c), F.lit("")) for c in ("ts_iso", "camera_id", "bbox", "text", "spot", "method")})


def resolve_header(columns: list[str], key: str) -> str | None:
    """The column of a key: an exact alias first, else one that holds an alias or is held by one."""
    low = {c: c.strip().lower() for c in columns}
    for alias in SPOT_HEADERS[key]:
        for c, name in low.items():
            if name == alias:
                return c
    for alias in SPOT_HEADERS[key]:
        for c, name in low.items():
            if name and (alias in name or name in alias):
                return c
    return None


def read_spots_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, latitude, longitude) of a table of points or of geofences, whose fifth point is the centre."""
    rows = spark.read.option("header", True).csv(path)
    at = {k: resolve_header(rows.columns, k) for k in SPOT_HEADERS}
    value = lambda k: F.expr(f"try_cast(trim(`{at[k]}`) as double)") if at[k] else F.lit(None).cast("double")
    text = lambda k: nz(F.col(f"`{at[k]}`")) if at[k] else F.lit(None).cast("string")
    out = rows.select(F.coalesce(text("id"), text("name")).alias("id"), text("name").alias("name"), F.coalesce(value("lat5"), value("lat")).alias("latitude"), F.coalesce(value("lon5"), value("lon")).alias("longitude"))
    return out.filter("latitude is not null and longitude is not null and name is not null")


def _features(spark: SparkSession, path: str, kind: str, shape: str) -> DataFrame:
    schema = f"struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: {shape}>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", schema)["features"]).alias("ord", "f"))
    return rows.filter(F.col("f.geometry.type") == kind).select("ord", F.coalesce(F.col("f.properties")["name"], F.col("f.properties")["id"]).alias("name"), F.col("f.properties")["id"].alias("id"), F.col("f.geometry.coordinates").alias("c"))


def read_spot_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features of GeoJSON, whose coordinates are longitude, latitude."""
    rows = _features(spark, path, "Point", "array<double>")
    return rows.select("ord", F.coalesce("id", "name").alias("id"), "name", F.col("c")[1].alias("latitude"), F.col("c")[0].alias("longitude"))


def read_spot_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon features: the outer ring without its closing point, and its centroid."""
    rows = _features(spark, path, "Polygon", "array<array<array<double>>>")
    outer = F.col("c")[0]
    closed = (F.size(outer) > 1) & (F.element_at(outer, 1) == F.element_at(outer, -1))
    ring = F.transform(F.slice(outer, F.lit(1), F.size(outer) - closed.cast("int")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = rows.withColumn("ring", ring)
    x, y = ring_centroid(F.col("ring"))
    return rows.select("name", "ord", "ring", x.alias("cx"), y.alias("cy"))


def read_gps_logs(spark: SparkSession, path: str) -> DataFrame:
    """(log, ts, lat, lon, heading, speed) of logs that map times to fixes; unreadable times are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("log"), F.explode(F.from_json("value", f"map<string, {FIX}>")).alias("k", "f"))
    return rows.select("log", F.try_to_timestamp(F.regexp_replace("k", "Z$", "")).alias("ts"), "f.lat", "f.lon", "f.heading", "f.speed").filter("ts is not null")


def read_crop_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(crops, rejects) of metadata files in any shape: a list, a marker `info` (empty), a list under crops, metadata or
    data, or crops by file name. Entries without crop_path or crop_filename are rejects."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    listed = lambda e: F.from_json(e, f"array<{CROP}>")
    inner = F.coalesce(*[F.get_json_object("v", f"$.{k}") for k in ("crops", "metadata", "data")])
    named = F.transform(F.map_entries(F.from_json("v", f"map<string, {CROP}>")), lambda e: e["value"].withField("crop_filename", F.coalesce(e["value"]["crop_filename"], e["key"])))
    empty = F.array().cast(f"array<{CROP}>")
    crops = F.when(F.col("v").startswith("["), listed("v")).when(F.get_json_object("v", "$.info").isNotNull(), empty).when(inner.isNotNull(), listed(inner)).otherwise(named)
    rows = raw.select("file", F.explode(F.coalesce(crops, empty)).alias("c")).select("file", "c.*")
    good = F.col("crop_path").isNotNull() & F.col("crop_filename").isNotNull()
    return rows.filter(good), rows.filter(~good)


def read_combined_results(spark: SparkSession, path: str) -> DataFrame:
    """The lists of all result files; a file that cannot be read gives nothing."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<{CROP}>").alias("a"))
    return rows.select("file", F.explode("a").alias("c")).filter("c is not null").select("file", "c.*")


def read_cameras(rows: DataFrame) -> DataFrame:
    """A registry of cameras (camera_id, source, ...) with defaults and the kind of their source."""
    have = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v)
    kind = F.when(F.col("source").rlike("^[0-9]+$"), "USB").when(F.lower("source").startswith("rtsp"), "RTSP").otherwise("Unknown")
    return rows.select("camera_id", "source", have("width", 1920).alias("width"), have("height", 1080).alias("height"), have("fps", 30).alias("fps"), kind.alias("type"))


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, cls, cx, cy, w, h) of label lines; shorter lines and the list of classes are left out.

    The split is the folder that holds the folder `labels`, or else the file's own folder.
    """
    near = lambda n: F.substring_index(F.substring_index("_metadata.file_path", "/", -n), "/", 1)
    folder = F.when((near(2) == "labels") & (near(3) != ""), near(3)).otherwise(near(2))
    # blanks of one kind are split without a pattern; exploding holds the parts, so that a line is split once for all columns
    parts = F.array_remove(F.split(F.translate("value", "\t\n\x0b\f\r", "     "), " "), "")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), folder.alias("split"), F.explode(F.array(parts)).alias("p"))
    rows = rows.filter((F.col("file") != "classes.txt") & (F.size("p") >= 5))
    return rows.select("file", "split", F.expr("try_cast(p[0] as int)").alias("cls"), *[F.expr(f"try_cast(p[{i}] as double)").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])


def read_ocr_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label) of lines; the label may hold blanks or be empty."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+", 2).alias("p"))
    return rows.select(F.col("p")[0].alias("filename"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("label"))


def parse_nmea(lines: DataFrame, text: str = "value") -> DataFrame:
    """Position sentences of any line table, also a stream: (lat, lon, mph, heading, date, time, reject).

    Only RMC sentences are read. ddmm.mmmm becomes degrees, S and W are negative; (0, 0) and void fixes are rejects.
    """
    p = F.split(F.split(F.trim(text), r"\*")[0], ",")
    part = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    number = lambda i: F.expr("1").cast("double") * part(i).try_cast("double")

    def degrees(value: int, side: int, minus: str) -> Column:
        v = number(value)
        whole = F.floor(v / 100)
        d = whole + (v - whole * 100) / 60
        return F.when(part(side) == minus, -d).otherwise(d)

    rows = lines.filter(F.get(p, F.lit(0)).rlike(r"^\$G[PN]RMC$"))
    rows = rows.select(degrees(3, 4, "S").alias("lat"), degrees(5, 6, "W").alias("lon"), (number(7) * 1.15078).alias("mph"), number(8).alias("heading"), part(9).alias("date"), part(1).alias("time"), part(2).alias("_ok"))
    reject = F.when(F.col("_ok").isNull() | (F.col("_ok") != "A"), "void").when(F.col("lat").isNull() | F.col("lon").isNull(), "unreadable").when((F.col("lat") == 0) & (F.col("lon") == 0), "zero")
    return rows.withColumn("reject", reject).drop("_ok")


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    return parse_nmea(spark.read.text(path))


def index_recordings(files: DataFrame, name: str = "name") -> DataFrame:
    """(video_id, camera_id, date, time) from file names: the first part of 8 digits is the date, what stands before it
    the camera, the next part of 6 digits the time."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(name), "/"), -1), r"\.[^.]*$", "")
    part = lambda i: F.nullif(F.regexp_extract(stem, r"^(?:(.*?)_)?([0-9]{8})(?:_([0-9]{6}))?(?:_|$)", i), F.lit(""))
    return files.withColumns({"video_id": stem, "camera_id": part(1), "date": part(2), "time": part(3)})


def read_expected_coords(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim("Parking Spot").alias("spot"), F.expr("try_cast(`Image X` as double)").alias("px"), F.expr("try_cast(`Image Y` as double)").alias("py")).filter("spot is not null and px is not null and py is not null")


def read_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(calibration, pairs): each file's plane matrix and error or camera matrices, and image points with their world points."""
    matrix, size = "array<array<double>>", "struct<width: int, height: int>"
    camera = f"intrinsic_matrix: {matrix}, rotation_matrix: {matrix}, translation_vector: array<double>, distortion_coefficients: array<double>"
    schema = f"struct<H: {matrix}, rmse: double, image_points: {matrix}, world_points: {matrix}, gps_reference: struct<lat: double, lon: double>, image_size: {size}, {camera}>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("c")).select("c.*")
    pairs = rows.select(F.posexplode(F.arrays_zip("image_points", "world_points")).alias("n", "p"))
    return rows, pairs.select("n", F.col("p.image_points")[0].alias("px"), F.col("p.image_points")[1].alias("py"), F.col("p.world_points")[0].alias("x"), F.col("p.world_points")[1].alias("y"))
