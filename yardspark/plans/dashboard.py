"""Dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from yardspark.operators import dashboard as D
from yardspark.operators import dataset as S
from yardspark.plans.views import sql, view

DAY, NOW = "2024-01-15", dt.datetime(2024, 1, 20, 12)
_KNOWN = "case when lower(nullif(trim(spot_name), '')) <> 'unknown' then nullif(trim(spot_name), '') end"
_DAY = f"created_on >= timestamp '{DAY}' and created_on < timestamp '{DAY}' + interval 1 day"
_KPIS = f"""select count(distinct track_id) as tracks, count(distinct {_KNOWN}) as spots, count(*) as detections,
  case when count(*) > 0 then round(100.0::double * coalesce(sum(case when nullif(trim(plate), '') is not null then 1 else 0 end), 0) / count(*), 1) else 0 end as ocr_rate,
  coalesce(sum(case when coalesce(conf, 0) < 0.5 then 1 else 0 end), 0) as anomalies from scans"""
_LATEST = """select 'T' || track_id as track, s.id, s.created_on, s.plate, s.spot_name, s.conf, s.is_processed
  from (select track_id, arg_max({'id': id, 'created_on': created_on, 'plate': plate, 'spot_name': spot_name, 'conf': conf, 'is_processed': is_processed}, {'c': created_on, 'i': -id}) as s
        from scans where track_id is not null group by track_id)"""
_INVENTORY = f"""with latest as ({_LATEST})
select track, plate, coalesce({_KNOWN}, 'N/A') as spot, case when is_processed or {_KNOWN} is not null then 'Parked' else 'In Transit' end as status, round(conf, 6) as conf from latest"""


def _scans(spark, d):
    return view(spark, d, "scans")


def _combined(spark, d):
    s = _scans(spark, d)
    return s.select(F.col("created_on").alias("ts"), F.when(F.col("k") % 7 > 0, F.col("conf")).alias("det_conf"), F.when(F.col("k") % 3 > 0, F.col("conf") / 2).alias("ocr_conf"), F.col("plate").alias("text"))


_COMBINED = "combined as (select created_on as ts, case when k % 7 > 0 then conf end as det_conf, case when k % 3 > 0 then conf / 2 end as ocr_conf, plate as text from scans)"


def _cameras(spark, d):
    status = F.when(F.avg("conf") > 0.39, "online").otherwise("offline")
    return _scans(spark, d).groupBy("camera_id").agg(status.alias("status"), F.avg("speed").alias("fps"), F.avg("heading").alias("latency"))


_HOURS = "select cast(range as int) as hour, round(coalesce(d, 0) * 100, 1) as detection, round(coalesce(o, 0) * 100, 1) as ocr from range(24) left join h on h.hour = range"


def _period_sql(per_period: bool) -> str:
    rows = []
    for name, days in (("daily", 1), ("weekly", 7), ("monthly", 30)):
        inside = f"(created_on > timestamp '{NOW}' - interval {days} day and created_on <= timestamp '{NOW}')"
        base = inside if per_period else "true"
        rows.append(f"select '{name}' as period, count(*) filter ({inside}) as detections, case when count(*) filter ({base}) > 0 then round(100.0::double * count(*) filter ({base} and nullif(trim(plate), '') is not null) / count(*) filter ({base}), 1) else 0 end as ocr_rate, count(*) filter ({base} and coalesce(conf, 0) < 0.5) as anomalies from scans")
    return " union all ".join(rows)


def _raw_scans(s, d):
    """Scans as a device sends them: times as text, blanks, missing values."""
    v = _scans(s, d)
    stamp = F.col("created_on").cast("string")
    return v.select("id", F.concat(F.lit(" "), "plate", F.lit("\t")).alias("licence_plate_trailer"), F.when(F.col("k") % 4 > 0, stamp).otherwise("not a time").alias("timestamp"), F.when(F.col("k") % 2 == 0, stamp).alias("created_on"), F.when(F.col("k") % 3 > 0, F.col("conf")).alias("confidence"), F.when(F.col("k") % 5 > 0, F.col("is_processed")).alias("is_processed"))


_RAW = f"""select id, nullif(plate, '') as licence_plate_trailer, case when k % 4 > 0 or k % 2 = 0 then created_on else timestamp '{NOW}' end as timestamp,
  case when k % 4 > 0 or k % 2 = 0 then created_on else timestamp '{NOW}' end as created_on, case when k % 3 > 0 then conf else 0 end as confidence, case when k % 5 > 0 then is_processed else true end as is_processed, 0 as frame_number from scans"""
QUERIES = {
    "normalise_scans": (lambda s, d: D.normalise_scans(_raw_scans(s, d), NOW).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "created_on")}), sql(_RAW, "scans")),
    "scan_stats": (lambda s, d: D.scan_stats(_scans(s, d)), sql("select count(*) as total, sum(case when is_processed then 0 else 1 end) as unprocessed, sum(case when is_processed then 1 else 0 end) as processed from scans", "scans")),
    "filter_by_date": (lambda s, d: D.filter_by_date(_scans(s, d), DAY).select("id", "created_on", "plate"), sql(f"select id, created_on, plate from scans where {_DAY}", "scans")),
    "kpis": (lambda s, d: D.kpis(_scans(s, d)), sql(_KPIS, "scans")),
    "kpis_of_day": (lambda s, d: D.kpis(D.filter_by_date(_scans(s, d), DAY)), sql(f"{_KPIS} where {_DAY}", "scans")),
    "hourly_accuracy": (lambda s, d: D.hourly_accuracy(_scans(s, d)), sql("with h as (select hour(created_on) as hour, avg(coalesce(conf, 0)) as d, avg(case when nullif(trim(plate), '') is not null then coalesce(conf, 0) end) as o from scans group by 1)\n" + _HOURS, "scans")),
    "hourly_accuracy_readings": (lambda s, d: D.hourly_accuracy_readings(_combined(s, d)), sql(f"with {_COMBINED}, h as (select hour(ts) as hour, avg(coalesce(det_conf, 1)) as d, avg(case when coalesce(ocr_conf, 0) > 0 or nullif(trim(text), '') is not null then coalesce(ocr_conf, 0) end) as o from combined group by 1)\n" + _HOURS, "scans")),
    "spot_utilisation": (lambda s, d: D.spot_utilisation(_scans(s, d)), sql(f"select {_KNOWN} as spot, count(*) as n from scans where {_KNOWN} is not null group by 1", "scans")),
    "latest_per_track": (lambda s, d: D.latest_per_track(_scans(s, d)), sql(_LATEST, "scans")),
    "inventory": (lambda s, d: D.inventory(_scans(s, d)), sql(_INVENTORY, "scans")),
    "inventory_stats": (lambda s, d: D.inventory_stats(_scans(s, d)), sql(_INVENTORY.replace("with latest", "with latest").replace("\nselect track", ", inv as (select track") + ") select count(*) as tracks, count(*) filter (status = 'Parked') as parked, count(*) filter (status = 'In Transit') as in_transit, (select count(*) from scans where coalesce(conf, 0) < 0.5) as anomalies from inv", "scans")),
    "period_report": (lambda s, d: D.period_report(_scans(s, d), NOW), sql(_period_sql(False), "scans")),
    "period_report_own": (lambda s, d: D.period_report(_scans(s, d), NOW, per_period=True), sql(_period_sql(True), "scans")),
    "hourly_rollup": (lambda s, d: D.hourly_rollup(_scans(s, d)), sql("select date_trunc('hour', created_on) as hour, camera_id, spot_name, count(*) as event_count, round(avg(conf), 6) as avg_confidence from scans group by 1, 2, 3", "scans")),
    "lanes": (lambda s, d: D.lanes(_scans(s, d)), sql(f"select distinct split_part({_KNOWN}, '-', 1) as lane from scans where {_KNOWN} is not null", "scans")),
    "camera_health": (lambda s, d: D.camera_health(_cameras(s, d)), sql("with cams as (select camera_id, case when avg(conf) > 0.39 then 'online' else 'offline' end as status, avg(speed) as fps, avg(heading) as latency from scans group by 1) select status, count(*) as n, round(avg(fps), 0) as fps, round(avg(latency), 0) as latency from cams group by 1", "scans")),
    "yard_view": (lambda s, d: D.yard_view(_scans(s, d)), sql(f"with k as (select *, {_KNOWN} as spot from scans where {_KNOWN} is not null), l as (select spot, arg_max({{'t': track_id, 'p': plate, 'c': created_on}}, {{'c': created_on, 'i': -id}}) as s from k group by 1) select spot, split_part(spot, '-', 1) as lane, true as occupied, 'T' || s.t as trailer, nullif(trim(s.p), '') as plate, s.c as created_on from l", "scans")),
    "page": (lambda s, d: D.page(_scans(s, d), 100, 200).select("id", "created_on"), sql("select id, created_on from scans order by created_on desc nulls last, id limit 100 offset 200", "scans")),
    "list_events": (lambda s, d: D.page(D.filter_scans(_scans(s, d), camera_id="cam-02"), 50).select("id", "camera_id", "created_on"), sql("select id, camera_id, created_on from scans where camera_id = 'cam-02' order by created_on desc nulls last, id limit 50", "scans")),
    "recent_events": (lambda s, d: D.recent_events(_scans(s, d), 500, "2024-01-29").select("id", "created_on"), sql("with n as (select * from scans order by created_on desc nulls last, id limit 2000) select id, created_on from n where created_on >= timestamp '2024-01-29' and created_on < timestamp '2024-01-30' order by created_on desc, id limit 500", "scans")),
    "tail": (lambda s, d: D.tail(_scans(s, d), 100, "id").select("id", "plate"), sql("select id, plate from (select * from scans order by id desc limit 100)", "scans")),
    "unprocessed": (lambda s, d: D.unprocessed(_scans(s, d), NOW).select("id", "created_on"), sql(f"select id, created_on from scans where not is_processed and created_on <= timestamp '{NOW}' - interval 10 second order by created_on desc nulls last, id limit 50", "scans")),
    "event_view": (lambda s, d: D.event_view(_scans(s, d)), sql(f"select id, coalesce(camera_id, 'unknown') as camera_id, coalesce('T' || track_id, 'N/A') as track, coalesce(nullif(trim(plate), ''), '') as text, round(coalesce(conf, 0), 6) as conf, coalesce({_KNOWN}, 'unknown') as spot from scans", "scans")),
    "classify_events": (lambda s, d: D.classify_events(D.event_view(_scans(s, d))).groupBy("camera_id", "type").agg(F.count("*").alias("n")), sql("select coalesce(camera_id, 'unknown') as camera_id, case when nullif(trim(plate), '') is not null then 'OCR' when coalesce(conf, 0) <> 0 and conf < 0.5 then 'Anomaly' else 'Detection' end as type, count(*) as n from scans group by 1, 2", "scans")),
    "confidence_pct": (lambda s, d: _scans(s, d).select("id", F.round(D.confidence_pct(F.when(F.col("k") > 5, F.col("conf") * 1.5)), 8).alias("pct")), sql("select id, round(least(100, greatest(0, case when c > 1 then c else c * 100 end)), 8) as pct from (select id, coalesce(case when k > 5 then conf * 1.5 end, 0) as c from scans)", "scans")),
    "position_quality": (lambda s, d: _scans(s, d).select("id", F.round(D.position_quality(F.col("conf"), F.when(F.col("k") % 2 == 0, "polygon").otherwise("nearest")), 6).alias("quality")), sql("select id, round(case when k % 2 = 0 then least(0.99, conf + 0.1) else conf end, 6) as quality from scans", "scans")),
    "filter_scans": (lambda s, d: D.filter_scans(_scans(s, d), True, "cam-01").select("id"), sql("select id from scans where is_processed and camera_id = 'cam-01'", "scans")),
    "first_non_empty": (lambda s, d: D.first_non_empty(D.filter_by_date(_scans(s, d), "2030-01-01"), D.page(_scans(s, d), 500)).select("id"), sql("select id from scans order by created_on desc nulls last, id limit 500", "scans")),
    "remove_ids": (lambda s, d: D.remove_ids(_scans(s, d), _scans(s, d).filter("is_processed")).groupBy("camera_id").agg(F.count("*").alias("n")), sql("select camera_id, count(*) as n from scans where not is_processed group by 1", "scans")),
    "keep_last": (lambda s, d: D.keep_last(_scans(s, d), 200).select("id", "kept"), sql("select id, row_number() over (partition by camera_id order by created_on desc, id) <= 200 as kept from scans", "scans")),
    "union_results": (lambda s, d: S.union_results(_scans(s, d).filter("camera_id = 'cam-01'").select("id", "plate"), _scans(s, d).filter("camera_id = 'cam-02'").select("id", "speed")).withColumn("speed", F.round("speed", 4)), sql("select id, plate, null::double as speed from scans where camera_id = 'cam-01' union all select id, null, round(speed, 4) from scans where camera_id = 'cam-02'", "scans")),
}
