"""Streams over several batches: rows out of order, late rows, state that ends, restarts."""

import datetime as dt
import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from yardspark.streaming import streams

ZERO = dt.datetime(2024, 1, 1)
T0 = int(ZERO.replace(tzinfo=dt.UTC).timestamp())


def at(seconds):
    return ZERO + dt.timedelta(seconds=seconds)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream that gets one of the batches after another; each call gives it anew."""

    def make(batches, kind):
        root = str(tmp_path / f"in{random.random()}")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/batch={i:03d}")
        schema = spark.createDataFrame([], kind).schema
        return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")

    return make


def states(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def run(stream, spark, tmp_path):
    """The rows of a stream, and its state's size after each batch."""
    rows = []
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / f"state{random.random()}")).trigger(availableNow=True).foreachBatch(lambda b, n: rows.extend(b.collect())).start()
    query.awaitTermination()
    return rows, states(query)


def test_liveness(spark, arriving):
    """Silence for good is reported once the watermark is past it."""
    batches = ([("a", at(0)), ("b", at(5))], [("b", at(40)), ("b", at(41))], [("b", at(300)), ("b", at(301))], [("b", at(310)), ("b", at(900))])
    read = arriving(batches, "camera_id string, ts timestamp")
    live = {(r.camera_id, r.online, r["at"] - T0) for r in streams.run_available(streams.liveness(read(), 60, "1 second")).collect()}
    assert live >= {("a", True, 0), ("a", False, 60), ("b", True, 5), ("b", False, 101), ("b", True, 300), ("b", False, 370), ("b", True, 900)} and len(live) == 7


def test_a_plate_is_placed_once_it_settles(spark, arriving):
    """The newest row of the wait counts, in whatever batch it came; a handled plate rests, and comes back later."""
    batches = (
        [(1, "a", at(0)), (2, "b", at(20))],
        [(4, "a", at(9)), (3, "a", at(9)), (5, "a", at(3)), (6, "b", at(31)), (7, None, at(32)), (8, " ", at(33))],
        [(9, "a", at(60)), (10, "a", at(10)), (11, "c", at(5))],  # 10 comes late, but not beyond the watermark; 11 does
        [(12, "a", at(400)), (13, "d", at(401))],
        [(14, None, at(5000))],  # a clock's row
    )
    read = arriving(batches, "id long, plate string, ts timestamp")
    got = streams.assign(read(), lambda batch: batch.select("id", "plate", "ts"), settle_s=10, keep_s=100, late="25 seconds").collect()
    assert {(r.id, r.plate, (r.ts - ZERO).seconds) for r in got} == {(10, "a", 10), (2, "b", 20), (12, "a", 400), (13, "d", 401)}


def test_observations_are_forgotten(spark, arriving, tmp_path):
    """A tag is reported once and rests; then it is counted anew. What the stream keeps falls again."""
    batches = [[(i, f"t{i % 7}", at(i)) for i in range(60)], [(100, "t0", at(100)), (101, "t0", at(3000)), (102, "t0", at(3001)), (103, "t0", at(3002))], [(104, "z", at(9000))], [(105, "z", at(9100))]]
    rows, size = run(streams.observations(arriving(batches, "id long, tag string, ts timestamp")(), 60, 3, keep_s=600, late="10 seconds"), spark, tmp_path)
    want = {(f"t{i}", 14 + i, 3) for i in range(7)} | {("t0", 3002, 3)}
    assert {(r.tag, r["at"] - T0, r.n) for r in rows} == want and len(rows) == len(want)
    assert max(size) > 10 and size[-1] <= 4


def test_an_observation_in_the_last_second_of_a_rest_does_not_count(spark, arriving):
    """times are whole seconds, so a reported tag rests to the end of the last one, as in the SQL."""
    batches = [[(i, "a", at(i)) for i in range(3)] + [(3, "a", at(602.5)), (4, "a", at(603)), (5, "a", at(604)), (6, "a", at(605))], [(7, "z", at(9000))]]
    got = streams.run_available(streams.observations(arriving(batches, "id long, tag string, ts timestamp")(), 60, 3, keep_s=600, late="10 seconds")).collect()
    assert sorted((r.tag, r["at"] - T0, r.n) for r in got) == [("a", 2, 3), ("a", 605, 3)]


def brute_cache(rows, stale, often, low, idle):
    out, held = [], {}
    for c, t, frame, text, conf, s in sorted(rows, key=lambda r: (r[5], r[2])):
        old = held.get((c, t))
        if old and (s - old[3]).total_seconds() > idle:
            old = None
        again = not old or not old[0] or frame - old[2] >= stale or (old[1] < low and frame - old[2] >= often)
        kept = (text or "", conf, frame) if again else old[:3]
        held[c, t] = (*kept, s)
        out.append((c, t, frame, kept[0], again))
    return sorted(out)


def test_reading_cache_ends_and_expires(spark, arriving, tmp_path):
    rng = random.Random(3)
    rows = [(f"c{i % 3}", i % 5, i, rng.choice(["", "TRL1", "TRL2", None]), rng.choice([0.2, 0.9]), at(i * 2 if i < 200 else i * 2 + 5000)) for i in range(300)]
    late = sorted(rows, key=lambda r: r[5] + dt.timedelta(seconds=rng.choice([0, 20])))
    batches = [late[i : i + 60] for i in range(0, 300, 60)] + [[(None, 1, 900, "clock", 0.0, at(20_000))]]
    got, size = run(streams.reading_cache(arriving(batches, "camera_id string, track_id long, frame long, text string, conf double, ts timestamp")(), 30, 10, 0.5, 60, "2 minutes"), spark, tmp_path)
    assert sorted(tuple(r) for r in got) == brute_cache(rows, 30, 10, 0.5, 60)
    assert max(size) > 10 and size[-1] == 0


def test_rates_equal_the_batch_operator(spark, arriving, tmp_path):
    """The increases of counter_rate, summed over windows; neighbours in time count over batches."""
    from yardspark.operators.boxes import counter_rate

    rng = random.Random(4)
    rows = [(i, f"c{i % 2}", at(i * 7), float(rng.choice([i, i, i, 0]))) for i in range(200)]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.choice([0, 25])))
    batches = [late[i : i + 50] for i in range(0, 200, 50)] + [[(900, None, at(90_000), 0.0)]]
    got, size = run(streams.rates(arriving(batches, "id long, camera_id string, ts timestamp, value double")(), 300, 60, "1 minute"), spark, tmp_path)
    metrics = spark.createDataFrame([(i, c, int((s - ZERO).total_seconds()), v) for i, c, s, v in rows], "id long, camera_id string, ts_s long, value double")
    rate = {(r.camera_id, r.ts_s): r.rate for r in counter_rate(metrics, 300).collect()}
    seen = {(r.camera_id, int((r.start - ZERO).total_seconds())): r.rate for r in got}
    assert len(seen) == len(got) > 20 and size[-1] <= 4
    # a window's increase is that of its last row's window, less what lies before its start
    up, last = {}, {}
    for _, c, s, v in sorted(rows, key=lambda r: r[2]):
        before = last.get(c)
        up[c, int((s - ZERO).total_seconds())] = 0.0 if before is None else v if v < before else v - before
        last[c] = v
    for (c, start), r in seen.items():
        assert abs(r - sum(u for (k, t), u in up.items() if k == c and start <= t < start + 300) / 300) < 1e-9
    for (c, t), r in rate.items():
        assert abs(r - sum(u for (k, x), u in up.items() if k == c and t - 300 <= x <= t) / 300) < 1e-9


def test_stream_tracks_equal_batch_linking(spark, tmp_path):
    """Keyed state gives what the batch operator gives; a video that is over leaves nothing."""
    from yardspark.operators.tracking import link_detections
    from yardspark.plans.streams import _boxes

    b = _boxes(spark, DATA).withColumns({"box_id": F.col("box_id").cast("long"), "ts": F.timestamp_millis(1000 + F.col("frame") * 40)})
    clock = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema.fields if f.name != "ts"], F.timestamp_seconds(F.lit(10_000_000)).alias("ts"))
    parts = [b.filter("frame < 70"), b.filter("frame >= 70"), clock]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / "b" / f"{i}"))
    source = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b" / "*"))
    rows, size = run(streams.tracks(source, idle_s=3600), spark, tmp_path)
    batch = {tuple(map(int, r)) for r in link_detections(b).select("video", "frame", "box_id", "track_id").collect()}
    assert {tuple(map(int, r)) for r in rows} == batch and len(rows) == len(batch)
    assert len({(v, f, t) for v, f, _, t in batch}) == len(batch)  # a track takes one detection of a frame at most
    assert max(size) > 0 and size[-1] == 0


def test_the_stream_query_of_tracks_equals_the_batch_operator(spark):
    from yardspark.operators.tracking import link_detections
    from yardspark.plans.streams import QUERIES
    from yardspark.plans.views import view

    b = view(spark, DATA, "boxes").select((F.col("frame") % 40).alias("video"), F.floor(F.col("frame") / 40).alias("frame"), (F.col("box_id") * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("box_id"), "x1", "y1", "x2", "y2", (0.2 + F.col("conf") * 0.8).alias("conf"))
    rows = lambda df: sorted(tuple(map(int, r)) for r in df.select("video", "frame", "box_id", "track_id").collect())
    assert rows(QUERIES["stream_tracks"][0](spark, DATA)) == rows(link_detections(b))


def test_frames_that_come_due_together_are_linked_side_by_side(spark, arriving, tmp_path):
    """in whatever batches rows come, tracks are those of one pass; late rows are left out, a video that comes back
    after its rest begins anew."""
    from test_tracking import one_pass, walk

    from yardspark.operators import lanes

    rows = walk(random.Random(7), "a", lanes.WARM + lanes.LEAST * lanes.OWN + 300, 3) + walk(random.Random(8), "b", 400, 2)
    back = [("a", f + 10_000, *r) for _, f, *r in walk(random.Random(9), "a", 60, 3)] + [("b", 10_000, 99, 0.0, 0.0, 9.0, 9.0, 0.9)]
    late = [("a", 3, 99, 0.0, 0.0, 9.0, 9.0, 0.9), ("b", 5000, 99, 0.0, 0.0, 9.0, 9.0, 0.9), ("b", 10_001, 99, 0.0, 0.0, 9.0, 9.0, 0.9)]
    stamped = lambda part: [(*r, at(r[1])) for r in part]
    batches = [*[stamped(r for i, r in enumerate(rows) if i % 2 == n) for n in (0, 1)], stamped(back), stamped(late), [(*[None] * 8, at(90_000))]]
    read = arriving(batches, "video string, frame long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double, ts timestamp")
    got, size = run(streams.tracks(read(), idle_s=1000, late="5000 seconds"), spark, tmp_path)
    want = one_pass(rows) | one_pass(back) | {("b", 10_001, 99): 1}
    assert {(r.video, r.frame, r.box_id): r.track_id for r in got} == want and len(got) == len(want)
    assert max(size) > 0 and size[-1] == 0


def test_rollup_drops_late_rows(spark, arriving, tmp_path):
    """Rows up to three hours late are counted, later ones are not, and windows leave the state."""
    hours = lambda h: at(3600 * h)
    batches = [[(1, hours(0.5), "c", "s", 0.5)], [(2, hours(8), "c", "s", 0.5), (3, hours(0.6), "c", "s", 1.0)], [(4, hours(8.5), "c", "s", 0.5), (5, hours(6), "c", "s", 0.5)], [(6, hours(0.7), "c", "s", 0.5), (7, hours(30), "c", "s", 0.5)]]
    rows, size = run(streams.hourly_rollup(arriving(batches, "id long, ts timestamp, camera_id string, spot_name string, conf double")()), spark, tmp_path)
    assert {((r.hour - ZERO).total_seconds() / 3600, r.event_count) for r in rows} == {(0, 2), (6, 1), (8, 2)} and size[-1] == 1


def test_rows_without_a_track_move_the_watermark_of_sessions(spark, arriving):
    """a visit is over by the newest row of all, as in the SQL, also where that row has no track."""
    read = arriving([[("a", at(0)), ("a", at(60))], [(None, at(36_000))]], "track_id string, ts timestamp")
    got = streams.run_available(streams.sessions(read(), "30 minutes", "1 hour")).collect()
    assert [(r.track_id, r.start, r.end, r.n) for r in got] == [("a", at(0), at(60 + 1800), 2)]


def test_drain_goes_on_behind_a_failed_sink(spark, arriving, tmp_path):
    """A batch whose sink failed is sent again as it was; one that was sent but not removed is only removed."""
    kind = "id long, camera_id string, created_on timestamp, is_processed boolean"
    read = arriving([[(i, "c", at(i), i % 2 == 0) for i in range(10)], [(i, "c", at(i), True) for i in range(10, 13)]], kind)
    sent, gone, faults = {}, {}, {("sink", 0), ("remove", 1)}

    def fail(what, number):
        if (what, number) in faults:
            faults.discard((what, number))
            raise RuntimeError(what)

    def sink(rows, number):
        fail("sink", number)
        assert number not in sent
        sent[number] = {(r.id, r.drain_group) for r in rows.collect()}

    def remove(keys, number):
        fail("remove", number)
        gone[number] = {r.id for r in keys.collect()}

    for _ in range(2):
        with pytest.raises(Exception, match="sink|remove"):
            streams.drain(read(), sink, str(tmp_path / "state"), 2, remove=remove)
    streams.drain(read(), sink, str(tmp_path / "state"), 2, remove=remove)
    assert gone == {0: {0, 2, 4, 6, 8}, 1: {10, 11, 12}} and {n: {i for i, _ in v} for n, v in sent.items()} == gone
    assert {g for i, g in sent[0] if i in (8, 6)} == {0} and (0, 2) in sent[0]


def test_a_frame_gets_one_fix_however_many_are_near(spark, arriving):
    """the join gives a frame's latest fix and no pairs; fixes at both ends of the tolerance count."""
    kind = "device string, event_id long, is_fix boolean, ts timestamp"
    dense = [("a", i, i % 10 > 0, at(i / 10)) for i in range(300)]
    ends = [("b", 1000, True, at(0)), ("b", 1001, False, at(5)), ("b", 1002, True, at(9)), ("b", 1003, False, at(14)), ("b", 1004, True, at(19)), ("b", 1005, True, at(19)), ("b", 1006, False, at(24.5)), ("b", 1007, False, at(4))]
    read = arriving([dense[150:] + ends, dense[:150], [(None, None, None, at(90_000))]], kind)
    rows = read()
    near = streams.gps_join(rows.filter("not coalesce(is_fix, false)"), rows.filter("is_fix or device is null").withColumnRenamed("event_id", "fix_id"), 5)
    got = [(r.device, r.event_id, r.fix_id, r.g_ts) for r in streams.run_available(near).collect()]
    want = set()
    for d, e, is_fix, t in dense + ends:
        near = [(u, f) for k, f, x, u in dense + ends if x and k == d and abs(u - t) <= dt.timedelta(seconds=5)]
        if not is_fix and near:
            want.add((d, e, max(near)[1], max(near)[0]))
    assert set(got) == want and len(got) == len(want)


def test_a_stream_keeps_its_state_in_few_parts(spark):
    """a part costs files and a worker in every batch, so there are two for each core at most; the session's setting stays."""
    name, held = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for asked, given in (("200", str(2 * spark.sparkContext.defaultParallelism)), ("3", "3")):
            spark.conf.set(name, asked)
            with streams.state_partitions(spark):
                assert spark.conf.get(name) == given
            assert spark.conf.get(name) == asked
    finally:
        spark.conf.set(name, held)


def test_batches_of_tracks_grow_with_the_frames(spark, monkeypatch):
    """however many frames there are, they come in a bounded number of batches, and each batch reads its own rows."""
    from yardspark.plans import streams as plans

    seen = []
    monkeypatch.setattr(plans.T, "run_available", lambda stream: stream)
    monkeypatch.setattr(plans.T, "tracks", lambda stream: stream)
    monkeypatch.setattr(plans, "_batched", lambda s, rows, clock=False: seen.append(rows.select("batch").distinct().count()))
    few = plans.view(spark, DATA, "boxes").limit(50)
    monkeypatch.setattr(plans, "view", lambda s, d, name: few.withColumn("frame", F.col("frame") * 10_000))
    plans._tracks(spark, DATA)
    assert 1 < seen[0] <= plans._BATCHES
