import json

import pytest

from yardspark.functions.text import nz
from yardspark.sources import readers as R
from yardspark.sources import sinks as K


def test_spots_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID, LAT ,Longitude,spot_name\n7,41.5,-89.1,A1\n8,bad,-89.1,A2\n")
    assert [tuple(r) for r in R.read_spots_csv(spark, str(tmp_path / "a.csv")).collect()] == [("7", "A1", 41.5, -89.1)]
    (tmp_path / "g.csv").write_text("Name,Latitude 1,Longitude 1,Latitude 5,Longitude 5\nB1,1,2,41.0,-89.0\n")
    assert [tuple(r) for r in R.read_spots_csv(spark, str(tmp_path / "g.csv")).select("name", "latitude", "longitude").collect()] == [("B1", 41.0, -89.0)]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 4], [0, 4], [0, 0]]
    doc = {"features": [{"properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "Q"}, "geometry": {"type": "Point", "coordinates": [-89.0, 41.0]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(doc))
    p = R.read_spot_polygons(spark, str(tmp_path / "s.geojson")).collect()
    assert [(r.name, len(r.ring), r.cx, r.cy) for r in p] == [("P", 4, 1.0, 2.0)]
    q = R.read_spot_points(spark, str(tmp_path / "s.geojson")).collect()
    assert [(r.name, r.latitude, r.longitude) for r in q] == [("Q", 41.0, -89.0)]


def test_gps_logs(spark, tmp_path):
    log = {"2024-01-01T00:00:01": {"lat": 1.0, "lon": 2.0}, "2024-01-01T00:00:02Z": {"lat": 3.0, "lon": 4.0, "speed": 5.0}, "no time": {"lat": 0}}
    (tmp_path / "v.json").write_text(json.dumps(log))
    assert [r.lat for r in R.read_gps_logs(spark, str(tmp_path / "v.json")).orderBy("ts").collect()] == [1.0, 3.0]


@pytest.mark.parametrize("shape", ["list", "info", "named", "wrapped"])
def test_crop_metadata_shapes(spark, tmp_path, shape):
    crop = {"crop_path": "p/a.jpg", "crop_filename": "a.jpg", "track_id": 1}
    doc = {"list": [crop, {"track_id": 2}], "info": {"info": "none"}, "named": {"a.jpg": {"crop_path": "p/a.jpg"}}, "wrapped": {"crops": [crop]}}[shape]
    (tmp_path / "m.json").write_text(json.dumps(doc))
    good, bad = R.read_crop_metadata(spark, str(tmp_path / "m.json"))
    assert [r.crop_filename for r in good.collect()] == ([] if shape == "info" else ["a.jpg"])
    assert bad.count() == (1 if shape == "list" else 0)


def test_nmea(spark):
    lines = ["$GPRMC,123519,A,4807.038,N,01131.000,W,022.4,084.4,230394,003.1,W*6A", "$GPRMC,123519,V,,,,,,,230394,,*00", "$GPGGA,1", "$GNRMC,1,A,0000.0,N,00000.0,E,1,,230394"]
    rows = R.parse_nmea(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.reject for r in rows] == [None, "void", "zero"]
    assert abs(rows[0].lat - 48.1173) < 1e-4 and abs(rows[0].lon + 11.516667) < 1e-4 and abs(rows[0].mph - 25.7775) < 1e-3


def test_labels_and_names(spark, tmp_path):
    (tmp_path / "x.txt").write_text("0 .1 .2 .3 .4\n1 2 3\n")
    (tmp_path / "classes.txt").write_text("0 1 2 3 4\n")
    assert R.read_yolo_labels(spark, str(tmp_path / "*.txt")).count() == 1
    (tmp_path / "l.lst").write_text("a.jpg AB 12\nb.jpg\n")
    assert [tuple(r) for r in R.read_ocr_labels(spark, str(tmp_path / "l.lst")).collect()] == [("a.jpg", "AB 12"), ("b.jpg", "")]
    names = spark.createDataFrame([("/v/gate_cam_20240102_030405.mp4",), ("/v/20240102.mp4",), ("/v/none.mp4",)], "name string")
    assert [(r.camera_id, r.date, r.time) for r in R.index_recordings(names).collect()] == [("gate_cam", "20240102", "030405"), (None, "20240102", None), (None, None, None)]


def test_event_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02T03:04:05", "c", 3, [1, 2, 3, 4], None, 0.5)], "ts_iso string, camera_id string, track_id int, bbox array<int>, text string, conf double")
    K.write_event_csv(rows, str(tmp_path / "e"))
    back = R.read_event_csv(spark, str(tmp_path / "e")).collect()
    assert [(r.camera_id, r.track_id, r.bbox, r.text, r.conf, r.x_world) for r in back] == [("c", 3, "1,2,3,4", "", 0.5, 0.0)]


def test_ingest_and_drain(spark, tmp_path):
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, " ", "x", None), (2, "P", None, "2024-01-01T01:00:00")], "id long, licence_plate_trailer string, timestamp string, created_on string")
    assert K.ingest_scans(batch, "d", str(tmp_path / "t"), now) == 2
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.id, r.licence_plate_trailer, r.confidence, r.is_processed) for r in rows.collect()} == {(1, None, 0.0, True), (2, "P", 0.0, True)}
    taken = []
    assert K.drain_processed(rows, lambda d: taken.extend(r.id for r in d.collect()), 1).count() == 1 and taken == [2]
    with pytest.raises(Exception, match="event without time"):
        K.ingest_events(spark.createDataFrame([("2024-01-01T00:00:00", " ")], "ts_iso string, camera_id string"), str(tmp_path / "e"))


def test_blank_equals_missing(spark):
    rows = spark.createDataFrame([("\t x ",), ("  \n",), (None,)], "t string").select(nz("t").alias("t")).collect()
    assert [r.t for r in rows] == ["x", None, None]


def test_label_lines_are_split_once(spark, tmp_path):
    """blanks of any kind and number part a line, which is split once for all of its columns."""
    for folder in ("train/labels", "valid"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.txt").write_text("\t1  0.5\t0.25 2 3\n1 2 3 4\t\n 2 1 1 1 1 9 \n")
    got = R.read_yolo_labels(spark, [str(tmp_path / "train/labels"), str(tmp_path / "valid")])
    rows = {("a.txt", split, *row) for split in ("train", "valid") for row in ((1, 0.5, 0.25, 2.0, 3.0), (2, 1.0, 1.0, 1.0, 1.0))}
    assert {tuple(r) for r in got.collect()} == rows and got.count() == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
