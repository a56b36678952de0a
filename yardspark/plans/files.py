"""Queries of the readers, writers, inference hooks and SQL functions: each writes data derived from the given tables to
the shared folder in the reader's format and reads it back, or returns what a writer wrote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.functions import geo
from yardspark.operators import dashboard as D
from yardspark.operators import infer as I
from yardspark.plans.views import LAT0, LON0, derive, sql, view
from yardspark.sources import readers as R
from yardspark.sources import sinks as K
from yardspark.sources.folders import shared_folder
from yardspark.streaming import streams

_NOW = dt.datetime(2024, 1, 1)


def _scans(s, d):
    return view(s, d, "scans")


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _read_scans(s, d):
    path = shared_folder(s, "scans")
    rows = _scans(s, d).select("id", F.col("plate").alias("licence_plate_trailer"), "latitude", "longitude", "speed", F.col("conf").alias("confidence"), "camera_id", F.col("track_id").cast("int").alias("track_id"), F.col("created_on").cast("timestamp").alias("created_on"), "is_processed")
    rows.write.parquet(path)
    return _ntz(R.read_scans(s, path), "created_on").select("id", "licence_plate_trailer", "latitude", "longitude", "speed", "confidence", "camera_id", "track_id", "created_on", "is_processed", "assigned_spot_name")


def _read_events(s, d):
    path = shared_folder(s, "events")
    rows = _scans(s, d).select("id", F.col("created_on").cast("timestamp").alias("ts"), "camera_id", F.col("track_id").cast("int").alias("track_id"), F.col("plate").alias("text"), F.col("conf").cast("float").alias("conf"), F.col("x_world").cast("float").alias("x_world"), F.col("y_world").cast("float").alias("y_world"), F.col("spot_name").alias("spot"))
    rows.write.parquet(path)
    return _ntz(R.read_events(s, path), "ts").select("id", "ts", "camera_id", "track_id", "text", "conf", "x_world", "y_world", "spot", "method")


def _event_rows(s, d):
    """Events as the writer takes them; some fields are missing."""
    return _scans(s, d).select(F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), "camera_id", "track_id", F.array("k", F.col("k") + 1, F.col("k") + 20, F.col("k") + 30).alias("bbox"), F.col("plate").alias("text"), F.col("id").alias("conf"), "spot_name", F.col("k").alias("x_world")).withColumnRenamed("spot_name", "spot")


def _write_event_csv(s, d):
    path = shared_folder(s, "csv")
    K.write_event_csv(_event_rows(s, d), path)
    rows = s.read.option("header", True).schema(R.EVENT_CSV + ", date date").csv(path)
    return rows.select("date", *[F.coalesce(c, F.lit("")).alias(c) for c in K.EVENT_COLUMNS])


_WRITTEN = """select cast(created_on as date) as date, strftime(created_on, '%Y-%m-%dT%H:%M:%S') as ts_iso, camera_id, coalesce(cast(track_id as varchar), '') as track_id, concat_ws(',', k, k + 1, k + 20, k + 30) as bbox, plate as text,
  cast(id as varchar) as conf, cast(k as varchar) as x_world, '' as y_world, coalesce(spot_name, '') as spot, '' as method from scans"""


def _read_event_csv(s, d):
    """Numbers that are blank, unreadable or not finite become 0."""
    path = shared_folder(s, "csv")
    k = F.col("k") % 6
    number = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("abc")).when(k == 2, F.lit("NaN")).when(k == 3, F.lit("Infinity")).otherwise(F.concat(F.lit(" "), (F.col("id") * 0.5).cast("string"), F.lit(" ")))
    rows = _scans(s, d).select(F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), "camera_id", F.when(k == 5, "x").otherwise(F.col("id").cast("string")).alias("track_id"), F.lit("1,2,3,4").alias("bbox"), F.col("plate").alias("text"), number.alias("conf"), number.alias("x_world"), F.lit(None).cast("string").alias("y_world"), F.col("spot_name").alias("spot"), F.lit("m").alias("method"))
    rows.write.option("header", True).csv(path)
    return R.read_event_csv(s, path)


_READ_CSV = """select strftime(created_on, '%Y-%m-%dT%H:%M:%S') as ts_iso, camera_id, case when k % 6 = 5 then 0 else cast(id as int) end as track_id, '1,2,3,4' as bbox, plate as text,
  case when k % 6 >= 4 then id * 0.5 else 0 end as conf, case when k % 6 >= 4 then id * 0.5 else 0 end as x_world, 0.0::double as y_world, coalesce(spot_name, '') as spot, 'm' as method from scans"""


def _suppliers(s, d):
    """Spots around the yard, one for each supplier; some lack a name or a position."""
    key = F.col("s_suppkey")
    return _table(s, d, "supplier").select("s_nationkey", key.alias("ord"), F.when(key % 11 > 0, F.col("s_name")).alias("name"), F.concat(F.lit("S"), key.cast("string")).alias("id"), (F.lit(LAT0) + key * 1e-5).alias("lat"), (F.lit(LON0) - key * 1e-5).alias("lon"))


_SUP = f"sup as (select s_nationkey, s_suppkey as ord, case when s_suppkey % 11 > 0 then s_name end as name, 'S' || s_suppkey as id, {LAT0}::double + s_suppkey * 1e-5::double as lat, {LON0}::double - s_suppkey * 1e-5::double as lon from supplier)"


def _read_spots_csv(s, d):
    path = shared_folder(s, "spots")
    c = lambda x: F.col(x).cast("string")
    fifth = F.col("ord") % 3 == 0  # geofences: the fifth point is the centre
    rows = _suppliers(s, d).select(F.col("name").alias(" Name "), F.when(fifth, c("lat")).alias("Latitude 5"), F.when(fifth, c("lon")).alias("Longitude 5"), F.when(F.col("ord") % 7 == 0, "n/a").otherwise(c("lat")).alias("Latitude"), c("lon").alias("Longitude"))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_spots_csv(s, path)


def _geojson(s, d, name, kind, coordinates):
    """One collection of features for each nation's suppliers, a file each; every fifth feature is of another kind."""
    path = shared_folder(s, name)
    other = F.when(F.col("ord") % 5 == 0, "LineString").otherwise(kind)
    geometry = F.struct(other.alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("name"), "name", F.lit("id"), "id").alias("properties"), geometry.alias("geometry"))
    rows = _suppliers(s, d).filter("lat is not null").groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    rows.write.partitionBy("s_nationkey").text(path)
    return path


def _read_spot_points(s, d):
    return R.read_spot_points(s, _geojson(s, d, "points", "Point", F.array("lon", "lat"))).select("id", "name", "latitude", "longitude")


def _read_spot_polygons(s, d):
    """Squares around the spots; the outer ring is closed, an inner ring does not count."""
    p = lambda x, y: F.array(F.col("ord") * 1.0 + x, F.col("ord") % 50 + F.lit(y))
    rings = F.array(F.array(p(0.0, 0.0), p(2.0, 0.0), p(2.0, 4.0), p(0.0, 4.0), p(0.0, 0.0)), F.array(p(0.5, 0.5), p(1.0, 0.5), p(1.0, 1.0), p(0.5, 0.5)))
    got = R.read_spot_polygons(s, _geojson(s, d, "polygons", "Polygon", rings))
    return got.select("name", F.size("ring").alias("points"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def _read_gps_logs(s, d):
    """One log for each device and day, a JSON map of times and fixes; unreadable times are skipped."""
    path = shared_folder(s, "logs")
    fixes = view(s, d, "fixes").withColumn("sec", F.date_trunc("second", "ts"))
    key = F.concat(F.date_format("sec", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 10 == 0, "Z").otherwise(""))
    last = fixes.groupBy("device", "sec").agg(F.max(F.struct("event_id", "lat", "lon")).alias("f")).select("device", "sec", "f.*")
    fix = F.struct("lat", "lon", F.date_format("sec", "yyyy").alias("timestamp"), F.lit(90.0).alias("heading"), (F.col("event_id") % 50).cast("double").alias("speed"))
    entry = F.struct(F.when(F.col("event_id") % 14 == 0, F.concat(F.lit("bad"), "event_id")).otherwise(key).alias("k"), fix.alias("v"))
    logs = last.groupBy("device", F.to_date("sec").alias("day")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    logs.write.partitionBy("device", "day").text(path)
    got = R.read_gps_logs(s, path)
    return _ntz(got, "ts").select("ts", "lat", "lon", "heading", "speed")


_LOGS = """with f as (select device, date_trunc('second', ts) as ts, max_by(lat, event_id) as lat, max_by(lon, event_id) as lon, max(event_id) as e from fixes group by 1, 2)
select ts, lat, lon, 90.0::double as heading, cast(e % 50 as double) as speed from f where e % 14 <> 0"""


def _crop(*, path=True):
    named = F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(".jpg"))
    return F.struct(F.when(F.col("k") % 9 > 0, F.concat(F.lit("/crops/"), named)).alias("crop_path"), named.alias("crop_filename"), F.col("track_id").cast("int").alias("track_id"), "lat", F.col("spot_name").alias("spot"))


def _crop_files(s, d, root):
    """Metadata files of all shapes: one for each camera and day, by the day."""
    rows = _scans(s, d).withColumn("lat", F.col("k").cast("double")).groupBy("camera_id", F.to_date("created_on").alias("day")).agg(F.collect_list(_crop()).alias("c"))
    shape = F.dayofyear("day") % 5
    by_name = F.map_from_entries(F.transform("c", lambda x: F.struct(x["crop_filename"].alias("k"), x.dropFields("crop_filename").alias("v"))))
    wrapped = lambda k: F.to_json(F.struct(F.col("c").alias(k)))
    value = F.when(shape == 0, F.to_json("c")).when(shape == 1, wrapped("crops")).when(shape == 2, wrapped("metadata")).when(shape == 3, F.to_json(by_name)).otherwise(F.lit('{"info": "no crops"}'))
    rows.select("camera_id", "day", value.alias("value")).write.partitionBy("camera_id", "day").text(root)
    return root


def _read_crop_metadata(s, d):
    good, rejects = R.read_crop_metadata(s, _crop_files(s, d, shared_folder(s, "crops")))
    keep = lambda df, ok: df.select("crop_filename", "track_id", "lat", "spot", F.lit(ok).alias("good"))
    return keep(good, True).unionByName(keep(rejects, False))


_CROPS = "select 'c' || id || '.jpg' as crop_filename, cast(track_id as int) as track_id, cast(k as double) as lat, spot_name as spot, k % 9 > 0 as good from scans where dayofyear(created_on) % 5 < 4"


def _read_combined(s, d):
    """Result lists of each camera and day; every seventh file is cut off and gives nothing."""
    root = shared_folder(s, "combined")
    rows = _scans(s, d).withColumn("lat", F.col("k").cast("double")).groupBy("camera_id", F.to_date("created_on").alias("day")).agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("id").cast("string")).alias("crop_filename"), F.col("plate").alias("ocr_text"), F.col("conf").alias("ocr_conf"), "lat"))).alias("value"))
    cut = F.when(F.dayofyear("day") % 7 == 0, F.lit('[{"crop_filename": ')).otherwise(F.col("value"))
    rows.select("camera_id", "day", cut.alias("value")).write.partitionBy("camera_id", "day").text(root)
    return R.read_combined_results(s, root).select("crop_filename", "ocr_text", "ocr_conf", "lat")


def _read_cameras(s, d):
    rows = _scans(s, d).groupBy("camera_id", (F.col("k") % 3).alias("r")).agg(F.count("*").alias("n"))
    source = F.when(F.col("r") == 0, "0").when(F.col("r") == 1, "rtsp://yard/live").otherwise("file.mp4")
    return R.read_cameras(rows.select("camera_id", source.alias("source"), F.when(F.col("r") == 1, 25).alias("fps"), F.when(F.col("r") == 0, F.col("n").cast("int")).alias("width")))


def _labels(s, d, root):
    """Label files of the splits; every thirteenth line is too short."""
    b = view(s, d, "boxes").select(F.when(F.col("frame") % 5 == 0, "valid").otherwise("train").alias("split"), (F.col("box_id") % 3).alias("cls"), "x1", "y1", "frame", "l_partkey")
    line = F.when(F.col("l_partkey") % 13 == 0, "0 1").otherwise(F.concat_ws(" ", F.col("cls").cast("string"), F.col("x1").cast("string"), F.col("y1").cast("string"), F.lit("0.5"), F.lit("0.25")))
    for split in ("train", "valid"):
        b.filter(F.col("split") == split).select(line.alias("value")).write.text(f"{root}/{split}/labels")
    return f"{root}/*/labels"


def _read_yolo_labels(s, d):
    got = R.read_yolo_labels(s, _labels(s, d, shared_folder(s, "yolo")))
    return got.groupBy("split", "cls").agg(F.count("*").alias("n"), F.sum("cx").alias("cx"), F.sum("cy").alias("cy"), F.sum("w").alias("w"), F.sum("h").alias("h"))


def _ocr_rows(s, d):
    return _scans(s, d).select(F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("i"), F.col("id").cast("string"), F.lit(".png")).alias("filename"), F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, F.concat(F.lit("TRL "), F.col("k").cast("string"))).otherwise(F.col("plate")).alias("label"))


_OCR = "select case when id % 5 = 0 then 'val' else 'train' end as split, 'i' || id || '.png' as filename, case k % 4 when 0 then '' when 1 then 'TRL ' || k else plate end as label from scans"


def _write_ocr_labels(s, d):
    root = shared_folder(s, "ocr")
    K.write_ocr_labels(_ocr_rows(s, d), root)
    return s.read.text(root)


def _read_ocr_labels(s, d):
    root = shared_folder(s, "ocr")
    _ocr_rows(s, d).select(F.concat_ws(" ", "filename", "label").alias("value")).write.text(root)
    return R.read_ocr_labels(s, root)


def _read_nmea(s, d):
    """Position sentences of the fixes: other sentences, void fixes, and a fix at (0, 0) among them."""
    root = shared_folder(s, "nmea")
    k, e = F.col("k"), F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minute = lambda c, f: F.concat(two(c % 60), F.lit("."), F.lpad((f % 10000).cast("string"), 4, "0"))
    zero = e % 26 == 0
    lat = F.when(zero, "0000.0000").otherwise(F.concat(two(k % 90), minute(k, e)))
    lon = F.when(zero, "00000.0000").otherwise(F.concat(F.lpad((k % 180).cast("string"), 3, "0"), minute(k + 7, e)))
    body = F.concat_ws(",", F.when(e % 22 == 0, "$GPGGA").when(e % 4 == 0, "$GNRMC").otherwise("$GPRMC"), F.date_format("ts", "HHmmss"), F.when(e % 34 == 0, "V").otherwise("A"), lat, F.when(k % 2 == 0, "S").otherwise("N"), lon, F.when(k % 3 == 0, "E").otherwise("W"), (k % 30).cast("string"), F.when(k % 5 == 0, "").otherwise((k % 360).cast("string")), F.date_format("ts", "ddMMyy"), F.lit(""))
    view(s, d, "fixes").select(F.concat(body, F.lit("*6A")).alias("value")).write.text(root)
    return R.read_nmea(s, root).withColumns({c: F.round(c, 7) for c in ("lat", "lon", "mph")})


_NMEA = """with n as (select *, event_id % 26 = 0 as zero, (k % 60) + (event_id % 10000) / 10000.0 as ma, ((k + 7) % 60) + (event_id % 10000) / 10000.0 as mo from fixes where event_id % 22 <> 0),
p as (select *, case when zero then 0 else (k % 90) + ma / 60 end * case when k % 2 = 0 then -1 else 1 end as la, case when zero then 0 else (k % 180) + mo / 60 end * case when k % 3 = 0 then 1 else -1 end as lo from n)
select round(la::double, 7) as lat, round(lo::double, 7) as lon, round((k % 30) * 1.15078::double, 7) as mph, case when k % 5 = 0 then null else cast(k % 360 as double) end as heading,
  strftime(ts, '%d%m%y') as date, strftime(ts, '%H%M%S') as time, case when event_id % 34 = 0 then 'void' when la = 0 and lo = 0 then 'zero' end as reject from p"""


def _index_recordings(s, d):
    """Names as recorders give them, with and without a time and with more parts behind."""
    stamp = F.when(F.col("k") % 3 == 0, F.date_format("created_on", "yyyyMMdd")).otherwise(F.date_format("created_on", "yyyyMMdd_HHmmss"))
    name = F.concat(F.lit("/rec/"), "camera_id", F.lit("_front_"), stamp, F.when(F.col("k") % 4 == 0, "_part2").otherwise(""), F.lit(".mp4"))
    return R.index_recordings(_scans(s, d).select("id", name.alias("name"))).select("id", "camera_id", "date", "time")


def _read_expected(s, d):
    root = shared_folder(s, "expected")
    key = F.col("s_suppkey")
    rows = _table(s, d, "supplier").select(F.concat(F.lit(" "), "s_name").alias("Parking Spot"), F.when(key % 4 == 0, "?").otherwise((key * 1.5).cast("string")).alias("Image X"), (key % 300).cast("string").alias("Image Y"))
    rows.write.option("header", True).csv(root)
    return R.read_expected_coords(s, root)


def _calibrations(s, d, root):
    """A calibration file for each nation: point pairs of its suppliers, a plane matrix, and a camera's matrices."""
    key = F.col("s_suppkey").cast("double")
    pairs = _table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.array(key, key * 2).alias("i"), F.array(key * 3, key * 4).alias("w")))).alias("p"))
    n = F.col("s_nationkey").cast("double")
    row = lambda *v: F.array(*[x if not isinstance(x, int | float) else F.lit(float(x)) for x in v])
    body = F.struct(
        F.array(row(n, 0, 0), row(0, 1, 0), row(0, 0, 1)).alias("H"), (n / 4).alias("rmse"), F.transform("p", lambda x: x["i"]).alias("image_points"), F.transform("p", lambda x: x["w"]).alias("world_points"),
        F.struct(F.lit(1280).alias("width"), F.lit(720).alias("height")).alias("image_size"), F.struct(F.lit(LAT0).alias("lat"), F.lit(LON0).alias("lon")).alias("gps_reference"),
        F.array(row(900, 0, n), row(0, 900, 360), row(0, 0, 1)).alias("intrinsic_matrix"), F.array(row(1, 0, 0), row(0, 1, 0), row(0, 0, 1)).alias("rotation_matrix"), row(0, n, 5).alias("translation_vector"),
    )
    pairs.select("s_nationkey", F.to_json(body).alias("value")).write.partitionBy("s_nationkey").text(root)
    return root


def _read_calibration(s, d):
    rows, pairs = R.read_calibration(s, _calibrations(s, d, shared_folder(s, "calibration")))
    whole = rows.select(F.lit("file").alias("kind"), "rmse", F.col("image_size.width").cast("double").alias("a"), F.col("gps_reference.lat").alias("b"), F.col("intrinsic_matrix")[0][2].alias("c"), F.col("translation_vector")[1].alias("e"))
    return whole.unionByName(pairs.select(F.lit("pair").alias("kind"), F.lit(None).cast("double").alias("rmse"), F.col("px").alias("a"), F.col("py").alias("b"), F.col("x").alias("c"), F.col("y").alias("e")))


_CALIBRATION = f"""select 'file' as kind, n / 4 as rmse, 1280.0::double as a, {LAT0}::double as b, n as c, n as e from (select distinct cast(s_nationkey as double) as n from supplier)
union all select 'pair', null, k, k * 2, k * 3, k * 4 from (select cast(s_suppkey as double) as k from supplier)"""


def _ingest_scans(s, d):
    """A batch with blanks and missing times, as devices send them."""
    root = shared_folder(s, "ingest")
    batch = _scans(s, d).select("id", F.when(F.col("k") % 3 == 0, "  ").otherwise(F.col("plate")).alias("licence_plate_trailer"), F.when(F.col("k") % 4 > 0, F.col("conf")).alias("confidence"), F.when(F.col("k") % 5 == 0, "soon").otherwise(F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_on"), F.when(F.col("k") % 2 == 0, F.col("is_processed")).alias("is_processed"))
    n = K.ingest_scans(batch, "dev-1", root, _NOW)
    rows = _ntz(s.read.parquet(root), "created_on", "timestamp")
    return rows.select("id", "licence_plate_trailer", "confidence", "created_on", "timestamp", "is_processed", "device_id", F.lit(n).cast("long").alias("ingested"))


_INGEST = """select id, case when k % 3 = 0 or trim(plate) = '' then null else plate end as licence_plate_trailer, case when k % 4 > 0 then conf else 0 end as confidence,
  case when k % 5 = 0 then timestamp '2024-01-01' else date_trunc('second', created_on) end as created_on, case when k % 5 = 0 then timestamp '2024-01-01' else date_trunc('second', created_on) end as timestamp,
  case when k % 2 = 0 then is_processed else true end as is_processed, 'dev-1' as device_id, (select count(*) from scans) as ingested from scans"""


def _ingest_events(s, d):
    root = shared_folder(s, "events")
    for part in (0, 1):
        K.ingest_events(_scans(s, d).filter(F.col("id") % 2 == part).select("id", "camera_id", F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), F.col("plate").alias("text")), root)
    return _ntz(s.read.parquet(root), "ts")


def _export_dated(s, d):
    root = shared_folder(s, "export")
    K.export_dated(_scans(s, d).select("id", "plate", F.col("created_on").alias("ts")), root, "scans")
    return s.read.parquet(f"{root}/scans").groupBy("year", "month", "day").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _drain_processed(s, d):
    """Which rows the sink got and which stay."""
    root = shared_folder(s, "drain")
    stay = K.drain_processed(_scans(s, d).select("id", "created_on", "is_processed"), lambda out: out.write.parquet(root), 150)
    return s.read.parquet(root).select("id", F.lit(True).alias("sent")).unionByName(stay.select("id", F.lit(False).alias("sent")))


def _results(s, d):
    k = F.col("k")
    return _scans(s, d).select(F.col("camera_id").alias("video"), F.col("id").alias("crop"), F.when(k % 7 == 0, " ").when(k % 7 > 1, F.col("plate")).alias("ocr_text"), F.when(k % 7 > 1, F.col("conf")).alias("ocr_conf"), F.when(k % 3 == 0, F.col("latitude")).alias("lat"), F.when(k % 2 == 0, F.col("longitude")).alias("lon"), F.when(k % 5 > 0, F.array("latitude", "longitude")).alias("world_coords"), "x_world", F.when(k % 4 > 0, F.col("y_world")).alias("y_world"), (k % 2).cast("double").alias("barrier"), "heading")


def _write_readings(s, d):
    root = shared_folder(s, "readings")
    K.write_readings(_results(s, d).select("video", "crop", "ocr_text", "ocr_conf"), root)
    return s.read.schema("video string, crop long, ocr_text string, ocr_conf double").json(root)


def _write_combined(s, d):
    root = shared_folder(s, "combined")
    K.write_combined(_results(s, d).select("video", "crop", "ocr_text", "ocr_conf", "lat"), root)
    return s.read.schema("video string, crop long, ocr_text string, ocr_conf double, lat double").json(root)


_RESULT = """res as (select camera_id as video, id as crop, case when k % 7 = 0 then ' ' when k % 7 > 1 then plate end as ocr_text, case when k % 7 > 1 then conf end as ocr_conf, case when k % 3 = 0 then latitude end as lat, case when k % 2 = 0 then longitude end as lon,
  k % 5 > 0 as w, latitude, longitude, x_world, case when k % 4 > 0 then y_world end as y_world, k % 2 as barrier, heading from scans)"""
_WAITING = f"""with {_RESULT}, p as (select *, case when lat is not null and lon is not null then [lat, lon] when w then [latitude, longitude] when x_world is not null and y_world is not null then [x_world, y_world] end as pos from res)
select crop, trim(ocr_text) as licence_plate_trailer, pos[1] as latitude, pos[2] as longitude, case when barrier <> 0 then cast(barrier as double) else heading end as barrier, ocr_conf as confidence, false as is_processed from p where pos is not null and trim(ocr_text) <> ''"""


def _ensure_columns(s, d):
    wanted = T.StructType([T.StructField("id", T.LongType()), T.StructField("image_url", T.StringType()), T.StructField("angle", T.DoubleType())])
    rows = _scans(s, d).select("id", "camera_id")
    return K.ensure_columns(K.ensure_columns(rows, wanted), wanted)


def _scan_view(s, d):
    k = F.col("k")
    rows = _scans(s, d).select("id", F.when(k % 2 == 0, F.col("plate")).alias("licence_plate_trailer"), F.when(k % 3 > 0, F.col("latitude").cast("string")).alias("latitude"), F.when(k % 4 > 0, F.col("conf")).alias("confidence"), F.when(k % 5 > 0, k).alias("frame_number"), F.when(k % 6 > 0, F.col("is_processed")).alias("is_processed"), "created_on", F.when(k % 7 > 0, F.col("created_on") + F.expr("interval 1 hour")).alias("timestamp"))
    return D.scan_view(rows).select("id", "licence_plate_trailer", "latitude", "confidence", "frame_number", "is_processed", "created_on", "timestamp", "image_url")


_VIEW = """select id, case when k % 2 = 0 then plate end as licence_plate_trailer, case when k % 3 > 0 then latitude end as latitude, case when k % 4 > 0 then conf else 0 end as confidence, case when k % 5 > 0 then cast(k as int) else 0 end as frame_number,
  case when k % 6 > 0 then is_processed else false end as is_processed, strftime(created_on, '%Y-%m-%dT%H:%M:%S') as created_on, strftime(case when k % 7 > 0 then created_on + interval 1 hour else created_on end, '%Y-%m-%dT%H:%M:%S') as timestamp, cast(null as varchar) as image_url from scans"""


def _valid_coords(s, d):
    k = F.col("k")
    lat, lon = F.when(k % 4 == 0, F.col("latitude") * 3).when(k % 4 < 3, F.col("latitude")), F.when(k % 5 == 0, F.col("longitude") * 3).otherwise(F.col("longitude"))
    return _scans(s, d).select("id", geo.valid_coords(lat, lon).alias("valid"))


def _images(s, d):
    return _scans(s, d).select(F.col("id").alias("path"), F.encode("plate", "UTF-8").alias("content"))


def _read_plate():
    def read(data: bytes) -> tuple[str, float]:
        if not data:
            raise ValueError("no image")
        return data.decode(), len(data) / 16

    return read


def _infer_detections(s, d):
    """A detector that finds a box for every three signs, and fails on odd frames without signs."""

    def factory():
        return lambda data: [((i, i, i + 10, i + 20), i % 2, 0.5) for i in range(len(data) // 3)] if data else [][1]

    frames = _scans(s, d).select(F.col("id").alias("frame"), F.encode("plate", "UTF-8").alias("content"))
    return I.infer_detections(frames, factory)


def _best_of_attempts(s, d):
    return I.best_of_attempts(_images(s, d), {"rotated": lambda data: bytes(data)[::-1]}, lambda: lambda data: (bytes(data).decode(), 0.5 if data else 0.0))


def _on_batch(s, d):
    """Two hooks see every batch: one keeps its rows, one its number of rows."""
    root = shared_folder(s, "hooks")
    rows = derive(streams.read_table(s, d, "events"), "scans").select("id", "camera_id")
    hooks = [lambda b, n: b.write.mode("overwrite").parquet(f"{root}/rows/batch={n}"), lambda b, n: b.groupBy("camera_id").count().write.mode("overwrite").parquet(f"{root}/counts/batch={n}")]
    I.on_batch(rows, hooks).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    counts = s.read.parquet(f"{root}/counts").groupBy("camera_id").agg(F.sum("count").alias("counted"))
    return s.read.parquet(f"{root}/rows").groupBy("camera_id").agg(F.count("*").alias("kept")).join(counts, "camera_id")


def _sql_functions(s, d):
    geo.register_sql(s)
    return s.sql(
        f"""select id, round(haversine_ft(latitude, longitude, {LAT0}D, {LON0}D), 4) as feet, round(iou(x_world, y_world, x_world + 2, y_world + 2, 0D, 0D, 3D, 3D), 9) as iou,
        point_in_polygon(x_world, y_world, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 7D), named_struct('x', 0D, 'y', 7D))) as inside,
        ground_point(x_world, y_world, x_world + 2, y_world + 3)[1] as ground_y from {{scans}}""",
        scans=_scans(s, d),
    )


_SQL = f"""with o as (select id, x_world as x, y_world as y, latitude as la, longitude as lo, greatest(0, least(x_world + 2, 3) - greatest(x_world, 0)) * greatest(0, least(y_world + 2, 3) - greatest(y_world, 0)) as o from scans),
h as (select *, pow(sin(radians({LAT0} - la) / 2), 2) + cos(radians(la)) * cos(radians({LAT0})) * pow(sin(radians({LON0} - lo) / 2), 2) as a from o)
select id, round(2 * 6371000.0 * 3.28084 * asin(sqrt(least(1, a))), 4) as feet, round(o / (4 + 9 - o), 9) as iou, x > 0 and x < 2 and y > 0 and y < 7 as inside, y + 3 as ground_y from h"""


QUERIES = {
    "read_scans": (_read_scans, sql("select id, plate as licence_plate_trailer, latitude, longitude, speed, conf as confidence, camera_id, cast(track_id as int) as track_id, created_on, is_processed, cast(null as varchar) as assigned_spot_name from scans", "scans")),
    "read_events": (_read_events, sql("select id, created_on as ts, camera_id, cast(track_id as int) as track_id, plate as text, cast(cast(conf as float) as double) as conf, cast(cast(x_world as float) as double) as x_world, cast(cast(y_world as float) as double) as y_world, spot_name as spot, cast(null as varchar) as method from scans", "scans")),
    "write_event_csv": (_write_event_csv, sql(_WRITTEN, "scans")),
    "read_event_csv": (_read_event_csv, sql(_READ_CSV, "scans")),
    "read_spots_csv": (_read_spots_csv, f"with {_SUP} select name as id, name, lat as latitude, lon as longitude from sup where name is not null and (ord % 3 = 0 or ord % 7 <> 0)"),
    "read_spot_points": (_read_spot_points, f"with {_SUP} select id, coalesce(name, id) as name, lat as latitude, lon as longitude from sup where ord % 5 <> 0"),
    "read_spot_polygons": (_read_spot_polygons, f"with {_SUP} select coalesce(name, id) as name, 4 as points, round(ord + 1.0::double, 6) as cx, round(ord % 50 + 2.0::double, 6) as cy from sup where ord % 5 <> 0"),
    "read_gps_logs": (_read_gps_logs, sql(_LOGS, "fixes")),
    "read_crop_metadata": (_read_crop_metadata, sql(_CROPS, "scans")),
    "read_combined_results": (_read_combined, sql("select 'c' || id as crop_filename, plate as ocr_text, conf as ocr_conf, cast(k as double) as lat from scans where dayofyear(created_on) % 7 <> 0", "scans")),
    "read_cameras": (_read_cameras, sql("select camera_id, case k % 3 when 0 then '0' when 1 then 'rtsp://yard/live' else 'file.mp4' end as source, case when k % 3 = 0 then cast(count(*) as int) else 1920 end as width, 1080 as height, case when k % 3 = 1 then 25 else 30 end as fps, case k % 3 when 0 then 'USB' when 1 then 'RTSP' else 'Unknown' end as type from scans group by camera_id, k % 3", "scans")),
    "read_yolo_labels": (_read_yolo_labels, sql("select case when frame % 5 = 0 then 'valid' else 'train' end as split, cast(box_id % 3 as int) as cls, count(*) as n, sum(x1) as cx, sum(y1) as cy, count(*) * 0.5::double as w, count(*) * 0.25::double as h from boxes where l_partkey % 13 <> 0 group by 1, 2", "boxes")),
    "write_ocr_labels": (_write_ocr_labels, sql(f"select split, filename || ' ' || label as value from ({_OCR})", "scans")),
    "read_ocr_labels": (_read_ocr_labels, sql(f"select filename, label from ({_OCR})", "scans")),
    "parse_nmea": (_read_nmea, sql(_NMEA, "fixes")),
    "index_recordings": (_index_recordings, sql("select id, camera_id || '_front' as camera_id, strftime(created_on, '%Y%m%d') as date, case when k % 3 > 0 then strftime(created_on, '%H%M%S') end as time from scans", "scans")),
    "read_expected_coords": (_read_expected, "select s_name as spot, s_suppkey * 1.5::double as px, cast(s_suppkey % 300 as double) as py from supplier where s_suppkey % 4 <> 0"),
    "read_calibration": (_read_calibration, _CALIBRATION),
    "ingest_scans": (_ingest_scans, sql(_INGEST, "scans")),
    "ingest_events": (_ingest_events, sql("select id, camera_id, date_trunc('second', created_on) as ts, plate as text from scans", "scans")),
    "export_dated": (_export_dated, sql("select cast(year(created_on) as int) as year, cast(month(created_on) as int) as month, cast(day(created_on) as int) as day, count(*) as n, cast(sum(id) as bigint) as ids from scans group by 1, 2, 3", "scans")),
    "drain_processed": (_drain_processed, sql("with t as (select id from scans where is_processed order by created_on desc, id limit 150) select id, id in (select id from t) as sent from scans", "scans")),
    "write_readings": (_write_readings, sql(f"with {_RESULT} select video, crop, ocr_text, ocr_conf from res", "scans")),
    "write_combined": (_write_combined, sql(f"with {_RESULT} select video, crop, coalesce(ocr_text, '') as ocr_text, coalesce(ocr_conf, 0) as ocr_conf, lat from res", "scans")),
    "readings_to_scans": (lambda s, d: K.readings_to_scans(_results(s, d)).select("crop", "licence_plate_trailer", "latitude", "longitude", "barrier", "confidence", "is_processed"), sql(_WAITING, "scans")),
    "ensure_columns": (_ensure_columns, sql("select id, camera_id, cast(null as varchar) as image_url, cast(null as double) as angle from scans", "scans")),
    "scan_view": (_scan_view, sql(_VIEW, "scans")),
    "valid_coords": (_valid_coords, sql("select id, case when k % 4 = 3 then null else k % 4 <> 0 end and k % 5 <> 0 as valid from scans", "scans")),
    "infer_readings": (lambda s, d: I.infer_readings(_images(s, d), _read_plate), sql("select id as path, plate as text, length(plate) / 16 as conf, case when plate = '' then 'error' else 'model' end as method from scans", "scans")),
    "infer_detections": (_infer_detections, sql("with b as (select id, unnest(range(length(plate) // 3)) as i from scans) select id as frame, cast(i as int) as box_id, cast(i as double) as x1, cast(i as double) as y1, cast(i + 10 as double) as x2, cast(i + 20 as double) as y2, cast(i % 2 as int) as cls, 0.5::double as conf from b", "scans")),
    "best_of_attempts": (_best_of_attempts, sql("select id as path, reverse(plate) as text, case when plate = '' then 0 else 0.5 end::double as conf, case when plate = '' then 'none' else 'rotated' end as method from scans", "scans")),
    "on_batch": (_on_batch, sql("select camera_id, count(*) as kept, cast(count(*) as bigint) as counted from scans group by 1", "scans")),
    "sql_functions": (_sql_functions, sql(_SQL, "scans")),
}
