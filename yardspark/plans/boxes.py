"""Box, crop, calibration and time-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardspark.operators import boxes as B
from yardspark.operators import calibrate as C
from yardspark.plans.views import sql, view

KEY = ["box_id", "l_partkey", "l_suppkey"]
_K = ", ".join(KEY)
FRAME = (1280, 720)


def _boxes(s, d):
    """Boxes with a unique key in each frame; of rows with equal keys the least stays."""
    rest = ["conf", "x1", "y1", "x2", "y2"]
    return view(s, d, "boxes").groupBy("frame", *KEY).agg(F.min(F.struct(*rest)).alias("m")).select("frame", *KEY, "m.*")


def _crops(s, d):
    return _boxes(s, d).withColumns({"x1": F.col("x1") * 1.5, "x2": F.col("x2") * 2.0, "y1": F.col("y1") * 2.0, "y2": F.col("y2") * 2.2})


_BX = "bx as (select distinct on (frame, box_id, l_partkey, l_suppkey) * from boxes order by conf, x1, y1, x2, y2)"
_CR = f"{_BX}, cr as (select * replace (x1 * 1.5 as x1, x2 * 2.0 as x2, y1 * 2.0 as y1, y2 * 2.2 as y2) from bx)"
_V = f"""{_CR}, v as (select *, x2 - x1 as w, y2 - y1 as h, least(1280, cast(trunc(x2) as int)) - greatest(0, cast(trunc(x1) as int)) as cw, least(720, cast(trunc(y2) as int)) - greatest(0, cast(trunc(y1) as int)) as ch from cr),
u as (select *, cw * ch / nullif(w * h, 0) as vis, cw / nullif(w, 0) as wide, ch / nullif(h, 0) as high, case when ch > 0 then cw / ch else 0 end as asp from v)"""
_SMALL = "(w < 200 or h < 150 or w * h < 30000)"
_REASON = f"case when {_SMALL} then 'too_small' when vis < 0.9 or wide < 0.9 or high < 0.9 then 'clipped' when asp > 1.8 then 'aspect_ratio' when abs((x1 + x2) / 2 - 640) >= 1280 * 0.3 or abs((y1 + y2) / 2 - 360) >= 720 * 0.3 then 'not_centered' end"


def _fallback_sql(fallback):
    left, right, top, bottom = "x1 < 100", "x2 > 1280 - 100", "y1 < 100", "y2 > 720 - 100"
    edges = " + ".join(f"cast({e} as int)" for e in (left, right, top, bottom))
    beyond, cut = "(x1 < 0 or x2 >= 1280 or y1 < 0 or y2 >= 720)", "(vis < 0.9 or wide < 0.9 or high < 0.9)"
    bad = f"case when vis >= 0.99 and wide >= 0.99 and high >= 0.99 then asp > 3.0 else asp > 2.5 or ({edges} >= 2 and (wide < 0.95 or high < 0.95)) end" if fallback else f"asp > 1.8 or {left} or {right} or {edges} >= 2 or (({top} or {bottom}) and high < 0.95)"
    return sql(f"with {_V} select frame, {_K}, not ({_SMALL} or {beyond} or {cut} or ({bad})) as valid from u", "boxes")


_GROUND = {
    "bottom_center": ("(x1 + x2) / 2", "y2"), "right_bottom": ("x2", "y2"),
    "adaptive_percentage": ("x2 + w * case when w > 800 then 0.15 when w > 600 then 0.13 else 0.12 end", "y1 + h * case when h > 900 then 0.39 when h > 700 then 0.385 else 0.38 end"),
    "fixed_offset": ("x2 + 100", "y2 - 200"), "from_left_percentage": ("x1 + w", "y1 + h * 0.38"), "bottom_intersection": ("(x1 + x2) / 2", "y1 + h * 0.64"),
    "learned_features": ("0.3 * (x1 + x2) / 2 + 0.4 * (x2 + w * case when w > 800 then 0.16 else 0.12 end) + 0.3 * ((x1 + x2) / 2 + w * 0.1 * case when h > 0 then w / h else 1 end)", "y1 + h * 0.64"),
    "perspective_corrected": ("x2 + w * 0.16 * (1 + (1 - least(w * h / 1e6, 1)) * 0.5)", "y1 + h * 0.64"), "dimension_based": ("x2 + w * (0.16 + (w / 1000 - 0.8) * 0.05)", "y1 + h * 0.64"),
}


def _ground(s, d):
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(B.ground_point(m)[0], 8).alias("gx"), F.round(B.ground_point(m)[1], 8).alias("gy")) for m in B.METHODS])
    return _boxes(s, d).select("frame", *KEY, F.explode(each).alias("g")).select("frame", *KEY, "g.*")


def _expected(s, d):
    """Boxes with an expected ground pixel, from their own table."""
    return _boxes(s, d).withColumns({"ex": F.col("x2") + F.col("l_partkey") % 50, "ey": F.col("y1") + F.col("l_suppkey") % 90})


#: Published weights of the linear model for x and y, on the features in their order.
WEIGHTS_X = [3148.9156599833327, -0.08731209524505641, -1.20860201891938, 1.0339790344477215, -2.2425810639480455, 0.5927818912862506, 0.00048089777048848236]
WEIGHTS_Y = [719.7714909558778, -0.002032391489059302, -0.00719517551286619, 0.003130668203440871, -0.010325846134873232, 0.06980402090902021, -6.044961722364233e-05]


def _dot(w):
    return f"round({w[0]}::double + {w[1]}::double * ((x1 + x2) / 2) + {w[2]}::double * x2 + {w[3]}::double * x1 + {w[4]}::double * w + {w[5]}::double * h + {w[6]}::double * (w * h), 4)"


def _fit(s, d):
    """How far the residuals of the fitted model are from standing upright on each feature: least squares leave nothing."""
    boxes = _expected(s, d)
    w = C.fit_linear_model(boxes)
    rows = C.apply_linear_model(boxes, w)
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(t).alias("target"), (f * (F.col(t) - F.col(g))).alias("r"), F.abs(f * F.col(t)).alias("size")) for n, f in zip(C.FEATURES, C.features(), strict=True) for t, g in (("ex", "gx"), ("ey", "gy"))])
    sums = rows.select(F.explode(each).alias("x")).select("x.*").groupBy("feature", "target").agg(F.sum("r").alias("r"), F.sum("size").alias("s"), F.count("*").alias("n"))
    return sums.select("feature", "target", F.abs(F.round(F.col("r") / F.col("s"), 6)).alias("residual"), "n")


_EX = f"{_BX}, ex as (select *, x2 - x1 as w, y2 - y1 as h, x2 + l_partkey % 50 as ex, y1 + l_suppkey % 90 as ey from bx)"
_ERRORS = " union all ".join(f"select '{m}' as method, sqrt(pow({x} - ex, 2) + pow({y} - ey, 2)) as e from ex" for m, (x, y) in _GROUND.items())
_GRID = """, g as (select x.range * 10 as x_pct, y.range * 10 as y_pct, r.r as reference from range(-3, 4) x, range(3, 8) y, (values ('left_edge'), ('right_edge'), ('center')) r(r)),
e as (select x_pct, y_pct, reference, sqrt(pow(case reference when 'left_edge' then x1 when 'right_edge' then x2 else (x1 + x2) / 2 end + w * (x_pct / 100) - ex, 2) + pow(y1 + h * (y_pct / 100) - ey, 2)) as e from ex, g)
select cast(x_pct as int) as x_pct, cast(y_pct as int) as y_pct, reference, round(avg(e), 4) as mean, round(max(e), 4) as max, round(min(e), 4) as min from e group by 1, 2, 3 order by avg(e), x_pct, y_pct, reference limit 10"""
_IOU = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_OVERLAP = f"""with {_BX}, p as (select a.frame, [a.box_id, a.l_partkey, a.l_suppkey] as ka, [b.box_id, b.l_partkey, b.l_suppkey] as kb, {_IOU} as i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as t
  from bx a join bx b on a.frame = b.frame and (a.box_id, a.l_partkey, a.l_suppkey) < (b.box_id, b.l_partkey, b.l_suppkey))
select frame, count(*) as pairs, round(sum(i / (t - i)), 6) as total from p where i > 0 group by 1"""


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _suppress_sql(limit, op):
    """Greedy suppression by a recursive walk over each frame's boxes in order of confidence."""
    over = f"list_any_value(list_filter(kept, lambda k: (greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))) / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))) {op} {limit})) is not null"
    heads = f"o as (select *, row_number() over (partition by frame order by conf desc, {_K}) as rn from (select distinct on (frame, box_id, l_partkey, l_suppkey) * from boxes order by conf, x1, y1, x2, y2))"
    body = f""",
w as (select frame, 1::bigint as rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept, true as keep from o where rn = 1
  union all select r.frame, r.rn, case when {over} then kept else list_append(kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) end, not ({over}) from w join o r on r.frame = w.frame and r.rn = w.rn + 1)
select o.frame, {", ".join("o." + k for k in KEY)}, x1, y1, x2, y2, conf from o join w on o.frame = w.frame and o.rn = w.rn and w.keep"""
    return sql("with " + heads + body, "boxes").replace("with boxes as", "with recursive boxes as", 1)


def _metrics(s, d):
    return view(s, d, "scans").select("id", "camera_id", F.unix_timestamp(F.col("created_on").cast("timestamp")).alias("ts_s"), F.to_date("created_on").alias("day"), F.col("speed").alias("value"), (F.col("id") % 500).cast("double").alias("counter"))


_RATE = """with m as (select id, camera_id, cast(floor(epoch(created_on)) as bigint) as ts_s, cast(id % 500 as double) as value from scans),
s as (select *, lag(value) over (partition by camera_id order by ts_s, value) as b from m), u as (select *, case when b is null then 0 when value < b then value else value - b end as up from s)
select id, round(sum(up) over (partition by camera_id order by ts_s range between 3600 preceding and current row) / 3600, 6) as rate from u"""
_EMA = """with recursive_ as (select 1), m as (select camera_id, cast(created_on as date) as day, list(speed order by cast(floor(epoch(created_on)) as bigint), id) as v from scans group by 1, 2)
select camera_id, day, round(list_reduce(v, lambda a, x: 0.9 * a + 0.1 * x), 6) as ema, cast(len(v) as int) as n from m""".replace("recursive_ as (select 1), ", "")


QUERIES = {
    "filter_detections": (lambda s, d: B.filter_detections(_boxes(s, d).withColumn("cls", F.col("box_id") % 3), "car", 1).select("frame", *KEY), sql(f"with {_BX} select frame, {_K} from bx where conf >= 0.4 and box_id % 3 = 1", "boxes")),
    "clean_boxes": (lambda s, d: B.clean_boxes(_boxes(s, d), (640, 640), (1280, 720)).select("frame", *KEY, "x1", "y1", "x2", "y2"), sql(f"with {_BX}, c as (select frame, {_K}, least(greatest(cast(trunc(x1 * 2.0) as int), 0), 1279) as x1, least(greatest(cast(trunc(y1 * 1.125) as int), 0), 719) as y1, least(greatest(cast(trunc(x2 * 2.0) as int), 0), 1279) as x2, least(greatest(cast(trunc(y2 * 1.125) as int), 0), 719) as y2 from bx where conf >= 0.25) select * from c where x1 < x2 and y1 < y2", "boxes")),
    "filter_tracks": (lambda s, d: B.filter_tracks(_boxes(s, d), "car").select("frame", *KEY), sql(f"with {_BX} select frame, {_K} from bx where x2 - x1 >= 100 and y2 - y1 >= 40 and (x2 - x1) * (y2 - y1) >= 5000 and (x2 - x1) / (y2 - y1) between 0.6 and 2.5", "boxes")),
    "rear_face": (lambda s, d: _rounded(B.rear_face(_boxes(s, d), 1280).select("frame", *KEY, "x1", "x2"), 4, "x1", "x2"), sql(f"with {_BX} select frame, {_K}, round(case when (x2 - x1) / (y2 - y1) > 1.5 then greatest(0, (x1 + x2) / 2 - (x2 - x1) * 0.65 / 2) else x1 end, 4) as x1, round(case when (x2 - x1) / (y2 - y1) > 1.5 then least(1280, (x1 + x2) / 2 + (x2 - x1) * 0.65 / 2) else x2 end, 4) as x2 from bx", "boxes")),
    "crop_gate": (lambda s, d: B.crop_gate(_crops(s, d), FRAME).select("frame", *KEY, "reject_reason"), sql(f"with {_V} select frame, {_K}, {_REASON} as reject_reason from u", "boxes")),
    "fallback_crop_gate": (lambda s, d: B.fallback_crop_gate(_crops(s, d), FRAME).select("frame", *KEY, "valid"), _fallback_sql(False)),
    "fallback_crop_gate_last": (lambda s, d: B.fallback_crop_gate(_crops(s, d), FRAME, True).select("frame", *KEY, "valid"), _fallback_sql(True)),
    "crop_funnel": (lambda s, d: B.crop_funnel(B.crop_gate(_crops(s, d), FRAME)), sql(f"with {_V}, r as (select {_REASON} as r from u), c as (select count(*) filter (r is null) as ok, count(*) filter (r = 'not_centered') as nc, count(*) filter (r = 'too_small') as ts, count(*) filter (r = 'clipped') as cl, count(*) filter (r = 'aspect_ratio') as ar from r) select ok + nc as detected, ok as centered, nc as not_centered, ts as too_small, cl as clipped, ar as aspect_ratio, case when ok + nc > 0 then round(100.0::double * ok / (ok + nc), 1) else 0 end as capture_rate from c", "boxes")),
    "middle_region": (lambda s, d: B.middle_region(_boxes(s, d), 640).select("frame", *KEY), sql(f"with {_BX} select frame, {_K} from bx where (x1 + x2) / 2 / 640 > 0.3 and (x1 + x2) / 2 / 640 < 0.7", "boxes")),
    "ground_point": (_ground, sql(f"with {_BX}, ex as (select *, x2 - x1 as w, y2 - y1 as h from bx) " + " union all ".join(f"select frame, {_K}, '{m}' as method, round({x}, 8) as gx, round({y}, 8) as gy from ex" for m, (x, y) in _GROUND.items()), "boxes")),
    "overlaps": (lambda s, d: B.overlaps(_boxes(s, d), ["frame"], KEY).groupBy("frame").agg(F.count("*").alias("pairs"), F.round(F.sum("iou"), 6).alias("total")), sql(_OVERLAP, "boxes")),
    "suppress_boxes": (lambda s, d: B.suppress_boxes(_boxes(s, d), ["frame"], KEY), _suppress_sql(0.45, ">=")),
    "dedupe_tracks": (lambda s, d: B.dedupe_tracks(_boxes(s, d), ["frame"], KEY), _suppress_sql(0.70, ">")),
    "nearest_in_frame": (lambda s, d: B.nearest_in_frame(_boxes(s, d), ["frame"], KEY), sql(f"with {_BX} select frame, {_K}, y2 from (select *, row_number() over (partition by frame order by y2 desc, {_K}) as rn from bx) where rn = 1", "boxes")),
    "best_crop": (lambda s, d: B.best_crop(_boxes(s, d), "l_suppkey", ["frame", "box_id", "l_partkey"]), sql(f"with {_BX} select l_suppkey, frame, box_id, l_partkey, (x2 - x1) * (y2 - y1) as area, conf from (select *, row_number() over (partition by l_suppkey order by (x2 - x1) * (y2 - y1) desc, conf desc, frame, box_id, l_partkey) as rn from bx) where rn = 1", "boxes")),
    "replace_crop": (lambda s, d: B.replace_crop(_boxes(s, d), "l_suppkey", ["frame", "box_id", "l_partkey"]), sql(f"with {_BX}, v as (select l_suppkey, list({{'frame': frame, 'box_id': box_id, 'l_partkey': l_partkey, 'a': (x2 - x1) * (y2 - y1), 'c': conf}} order by frame, box_id, l_partkey) as v from bx group by 1), k as (select l_suppkey, list_reduce(v, lambda k, x: case when x.a > 1.2 * k.a or (x.a >= 0.9 * k.a and x.c > k.c + 0.15) then x else k end) as k from v) select l_suppkey, k.frame, k.box_id, k.l_partkey, k.a, k.c from k", "boxes")),
    "bbox_key": (lambda s, d: B.bbox_key(_boxes(s, d).withColumn("track_id", F.col("l_suppkey"))).select("frame", *KEY, "bbox_hash", "crop_filename"), sql(f"with {_BX}, h as (select *, substr(md5(concat_ws('_', cast(trunc(x1) as int), cast(trunc(y1) as int), cast(trunc(x2) as int), cast(trunc(y2) as int))), 1, 8) as h from bx) select frame, {_K}, h as bbox_hash, printf('crop_%06d_track%03d_%s.jpg', frame, l_suppkey, h) as crop_filename from h", "boxes")),
    "sample_every": (lambda s, d: B.sample_every(_boxes(s, d), 20).select("frame", *KEY), sql(f"with {_BX} select frame, {_K} from bx where frame % 20 = 0", "boxes")),
    "chunk_frames": (lambda s, d: B.chunk_frames(_boxes(s, d).select("frame", *KEY)), sql(f"with {_BX} select frame, {_K}, cast(floor(frame / 1500) as bigint) as chunk, frame % 1500 as chunk_frame, frame - frame % 1500 as chunk_offset from bx", "boxes")),
    "first_and_latest": (lambda s, d: B.first_and_latest(view(s, d, "scans")), sql("select track_id, arg_min(id, {'c': created_on, 'i': id}) as first_id, arg_max(id, {'c': created_on, 'i': -id}) as latest_id, count(*) as events from scans where track_id is not null group by 1", "scans")),
    "tracks_without_crop": (lambda s, d: B.tracks_without_crop(view(s, d, "scans"), view(s, d, "scans").filter("k = 7")), sql("select distinct track_id from scans where track_id is not null and track_id not in (select track_id from scans where k = 7 and track_id is not null)", "scans")),
    "video_summary": (lambda s, d: B.video_summary(view(s, d, "scans")), sql("select camera_id, count(*) as detections, count(distinct track_id) as tracks, count(distinct case when nullif(trim(plate), '') is not null then track_id end) as tracks_with_text, count(distinct created_on) as frames from scans group by 1", "scans")),
    "video_events": (lambda s, d: B.video_events(view(s, d, "scans")).select("camera_id", "track_id", "id", "rank"), sql("with n as (select camera_id, track_id, max_by(id, {'c': created_on, 'i': id}) as id, max(created_on) as c from scans group by 1, 2) select camera_id, track_id, id, cast(row_number() over (partition by camera_id order by c desc, id desc) as int) as rank from n qualify rank <= 100", "scans")),
    "counter_rate": (lambda s, d: _rounded(B.counter_rate(_metrics(s, d).withColumn("value", F.col("counter")), 3600).select("id", "rate"), 6, "rate"), sql(_RATE, "scans")),
    "ema": (lambda s, d: _rounded(B.ema(_metrics(s, d)), 6, "ema"), sql(_EMA, "scans")),
    "observation_count": (lambda s, d: B.observation_count(_metrics(s, d).withColumn("tag", F.col("camera_id")), 1800, 10).select("id", "n", "moves"), sql("with m as (select id, camera_id, cast(floor(epoch(created_on)) as bigint) as t from scans), c as (select id, count(*) over (partition by camera_id order by t range between 1800 preceding and current row) as n from m) select id, n, n >= 10 as moves from c", "scans")),
    "method_errors": (lambda s, d: _rounded(C.method_errors(_expected(s, d)), 4, "mean", "max", "min", "std"), sql(f"with {_EX}, e as ({_ERRORS}) select method, round(avg(e), 4) as mean, round(max(e), 4) as max, round(min(e), 4) as min, round(stddev_pop(e), 4) as std from e group by 1", "boxes")),
    "grid_search_offsets": (lambda s, d: _rounded(C.grid_search_offsets(_expected(s, d)), 4, "mean", "max", "min"), sql(f"with {_EX}{_GRID}", "boxes")),
    "apply_linear_model": (lambda s, d: _rounded(C.apply_linear_model(_expected(s, d), {"ex": WEIGHTS_X, "ey": WEIGHTS_Y}).select("frame", *KEY, "gx", "gy"), 4, "gx", "gy"), sql(f"with {_EX} select frame, {_K}, {_dot(WEIGHTS_X)} as gx, {_dot(WEIGHTS_Y)} as gy from ex", "boxes")),
    "fit_linear_model": (_fit, sql(f"with {_EX}, f as (select unnest([" + ", ".join(f"'{f}'" for f in C.FEATURES) + "]) as feature) select feature, target, 0.0::double as residual, (select count(*) from ex) as n from f, (values ('ex'), ('ey')) t(target)", "boxes")),
    "lookup_or_bottom_center": (lambda s, d: C.lookup_or_bottom_center(_boxes(s, d).withColumn("spot", F.col("l_suppkey") % 30), s.read.parquet(f"{d}/supplier.parquet").filter("s_suppkey < 20").select(F.col("s_suppkey").alias("spot"), (F.col("s_suppkey") * 10.0).alias("px"), (F.col("s_suppkey") * 5.0).alias("py"))).select("frame", *KEY, "gx", "gy"), sql(f"with {_BX} select frame, {_K}, coalesce(s_suppkey * 10.0::double, (x1 + x2) / 2) as gx, coalesce(s_suppkey * 5.0::double, y2) as gy from bx left join (select * from supplier where s_suppkey < 20) on s_suppkey = l_suppkey % 30", "boxes")),
    "match_calibration": (lambda s, d: C.match_calibration(_boxes(s, d).withColumn("track_id", F.col("l_partkey")).select("frame", *KEY, "track_id", "x1", "y1", "x2", "y2"), s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("spot"), (F.col("n_nationkey") * 170 % 600).cast("double").alias("ex"), (F.col("n_nationkey") * 31 % 300).cast("double").alias("ey")), s.read.parquet(f"{d}/part.parquet").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("track_id"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("spot"))).select("frame", *KEY, "spot", "how"),
        sql(f"with {_BX}, e as (select n_name as spot, cast(n_nationkey * 170 % 600 as double) as ex, cast(n_nationkey * 31 % 300 as double) as ey from nation), n as (select frame, {_K}, spot, sqrt(pow((x1 + x2) / 2 - ex, 2) + pow(y2 - ey, 2)) as dd from bx, e), b as (select * from (select *, row_number() over (partition by frame, {_K} order by dd, spot) as rn from n) where rn = 1) select frame, {_K}, case when l_partkey % 10 = 0 and l_partkey in (select p_partkey from part) then 'M' || l_partkey else spot end as spot, case when l_partkey % 10 = 0 and l_partkey in (select p_partkey from part) then 'manual' else 'nearest' end as how from b where dd < 500 or (l_partkey % 10 = 0 and l_partkey in (select p_partkey from part))", "boxes")),
}
