"""Placement, time-join and position queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yardspark.functions.geo import FEET, EARTH_M, to_local
from yardspark.operators import assign as A
from yardspark.operators import gps as G
from yardspark.operators import timejoin as T
from yardspark.plans.views import LAT0, LON0, spot_polygons, spots, sql, view

_FT = f"(2 * {EARTH_M} * {FEET} * atan2(sqrt({{a}}), sqrt(1 - {{a}})))"


def _feet(lat1, lon1, lat2, lon2):
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _FT.format(a=a)


def _scans(s, d):
    return view(s, d, "scans")


def _spot_points(s, d):
    """Spots as points: the mean position of each lane and row of the scans themselves."""
    return _scans(s, d).filter("spot_name is not null").groupBy(F.col("spot_name").alias("spot")).agg(F.avg("latitude").alias("spot_lat"), F.avg("longitude").alias("spot_lon"), F.min("k").alias("ord"))


_SPOT_POINTS = "sp as (select spot_name as spot, avg(latitude) as spot_lat, avg(longitude) as spot_lon, min(k) as ord from scans where spot_name is not null group by 1)"
_LIMIT = 15.0
_PAIRS = f"{_SPOT_POINTS}, pairs as (select * from (select scans.*, sp.*, {_feet('latitude', 'longitude', 'spot_lat', 'spot_lon')} as distance from scans, sp) where distance < {_LIMIT})"
_WAITING = "waiting as (select * from (select *, row_number() over (partition by plate order by created_on desc, id) as rn from scans where not is_processed and nullif(trim(plate), '') is not null and speed between 0 and 60) where rn = 1)"


def _points(s, d):
    return _scans(s, d).select("id", F.col("x_world").alias("x"), F.col("y_world").alias("y"))


_RESOLVE = """with b as (select id, x_world as x, y_world as y, name, ord, (x_world > x1 and x_world < x2 and y_world > y1 and y_world < y2) as ins,
  pow(x_world - (x1 + x2) / 2, 2) + pow(y_world - (y1 + y2) / 2, 2) as dd from scans, spots),
r as (select *, row_number() over (partition by id order by case when ins then 0 else 1 end, case when ins then 0 else dd end, ord) as rn from b)
select id, name as spot, case when ins then 'point-in-polygon' else 'nearest-centroid' end as method from r where rn = 1"""


def _sites(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site"))


def _flags(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("site_id"), (F.col("n_regionkey") != 1).alias("allow"))


def _settings(s, d):
    supplier = s.read.parquet(f"{d}/supplier.parquet").filter("s_nationkey % 5 <> 2")
    return supplier.select(F.col("s_suppkey").alias("setting_id"), F.col("s_nationkey").alias("site_id"), (F.col("s_suppkey") % 7).cast("double").alias("min_speed"), F.lit(80.0).alias("max_speed"), (F.col("s_suppkey") % 11 + 5).cast("double").alias("max_slot_distance"))


_SETTINGS = "st as (select s_suppkey as setting_id, s_nationkey as site_id, cast(s_suppkey % 7 as double) as min_speed, 80.0::double as max_speed, cast(s_suppkey % 11 + 5 as double) as max_slot_distance from supplier where s_nationkey % 5 <> 2)"
_SITE_SETTINGS = f"{_SETTINGS}, ss as (select n_nationkey as site_id, n_name as site, setting_id, min_speed, max_speed, max_slot_distance from nation join (select site_id, min(setting_id) as setting_id from st group by 1) using_ on using_.site_id = n_nationkey join (select setting_id as sid, min_speed, max_speed, max_slot_distance from st) x on x.sid = using_.setting_id where n_regionkey <> 1)"


def _by_site(s, d):
    scans = _scans(s, d).withColumn("site_id", F.col("k") % 25).withColumn("plate", F.when(F.col("k") % 9 == 0, F.col("plate")).otherwise(F.concat("plate", F.lit("-0123456789-ABCDEFGHI"))))
    points = _spot_points(s, d).withColumn("site_id", F.explode(F.sequence(F.lit(0), F.lit(24)))).filter((F.col("ord") + F.col("site_id")) % 3 != 0)
    settings = A.site_settings(_sites(s, d), _flags(s, d), _settings(s, d)).select("site_id", "min_speed", "max_speed", "max_slot_distance", (F.col("site_id") % 6).alias("max_slots"))
    moved = scans.filter("k % 13 = 0 and is_processed").select("plate")
    return A.assign_spots_by_site(scans, points, settings, moved).select("id", "site_id", "spot", F.round("distance", 4).alias("distance"), "verdict")


def _until_moved(s, d):
    scans = _scans(s, d).withColumn("site_id", F.col("k") % 25).withColumn("plate", F.when(F.col("k") % 9 == 0, F.col("plate")).otherwise(F.concat("plate", F.lit("-0123456789-ABCDEFGHI"))))
    points = _spot_points(s, d).withColumn("site_id", F.explode(F.sequence(F.lit(0), F.lit(24)))).filter((F.col("ord") + F.col("site_id")) % 3 != 0)
    settings = A.site_settings(_sites(s, d), _flags(s, d), _settings(s, d))
    settings = settings.select("site_id", "min_speed", "max_speed", "max_slot_distance", (F.col("site_id") % 6).alias("max_slots"), (F.col("site_id") % 3 + 1).alias("observations_count"), ((F.col("site_id") % 5) * 2880).alias("observation_cutoff_minutes"))
    return A.assign_until_moved(scans, points, settings).select("id", "site_id", "spot", "verdict")


_BEARING = "((degrees(atan2(sin(radians(spot_lon - longitude)) * cos(radians(spot_lat)), cos(radians(latitude)) * sin(radians(spot_lat)) - sin(radians(latitude)) * cos(radians(spot_lat)) * cos(radians(spot_lon - longitude)))) + 360) % 360)"
_BY_SITE = f"""with {_SPOT_POINTS}, {_SITE_SETTINGS},
sc as (select * replace (case when k % 9 = 0 then plate else plate || '-0123456789-ABCDEFGHI' end as plate), k % 25 as site_id from scans),
w as (select sc.*, min_speed, max_speed, max_slot_distance from sc join ss using (site_id)),
p as (select w.id, w.site_id, spot, ord, {_feet('latitude', 'longitude', 'spot_lat', 'spot_lon')} as distance, max_slot_distance,
        abs((({_BEARING} - (heading + 90) + 180 + 720) % 360) - 180) as off
      from w join (select sp.*, n_nationkey as site_id from sp, nation where (ord + n_nationkey) % 3 <> 0) q using (site_id)),
b as (select id, spot, distance from (select *, row_number() over (partition by id order by distance, ord) as rn from p where distance < max_slot_distance and off <= 90 and site_id % 6 > 0) where rn = 1)
select w.id, site_id, spot, round(distance, 4) as distance,
  case when length(coalesce(plate, '')) <= 20 then 'Ignore Inventory - Invalid Tag' when not coalesce(speed between min_speed and max_speed, false) then 'Ignore Inventory - Speed is not valid'
       when plate in (select plate from sc where k % 13 = 0 and is_processed) then 'Ignore Inventory - Already Moved' when spot is null then 'Ignore Inventory - Unable to pick the location' else 'Location Updated: ' || spot end as verdict
from w left join b using (id)"""

_UNTIL_MOVED = f"""with base as ({_BY_SITE.replace("plate in (select plate from sc where k % 13 = 0 and is_processed)", "false").replace("select w.id, site_id, spot,", "select w.id, site_id, w.plate, w.created_on, spot,")}),
o as (select *, site_id % 3 + 1 as least_, to_minutes((site_id % 5) * 2880) as cutoff from base where verdict like 'Location Updated: %' and site_id % 5 > 0),
n as (select a.id, a.plate, a.created_on from o a join o b on a.site_id = b.site_id and a.plate = b.plate and b.created_on >= a.created_on - a.cutoff and (b.created_on, b.id) <= (a.created_on, a.id) group by a.id, a.plate, a.created_on, a.least_ having count(*) >= a.least_),
m as (select plate, min({{'t': created_on, 'i': id}}) as moved from n group by 1),
z as (select base.*, moved, {{'t': created_on, 'i': id}} as now_ from base left join m using (plate))
select id, site_id, case when now_ > moved then null else spot end as spot,
  case when verdict in ('Ignore Inventory - Invalid Tag', 'Ignore Inventory - Speed is not valid') then verdict when now_ > moved then 'Ignore Inventory - Already Moved' when spot is null or now_ = moved then verdict end as verdict from z"""


_H = [[0.002, 0.0001, -0.4], [0.0002, 0.01, -0.2], [0.00001, 0.00002, 1.0]]
_HX, _HY = ("(({0} * px + {1} * py + {2}) / ({3} * px + {4} * py + {5}))".format(*_H[r], *_H[2]) for r in (0, 1))


def _pixels(s, d):
    """Pixels of spots: the mean box corner of each part, one row a part."""
    b = view(s, d, "boxes")
    return b.groupBy(F.col("l_suppkey").alias("ord")).agg(F.avg("x2").alias("px"), F.avg("y2").alias("py")).withColumn("name", F.concat(F.lit("S"), F.col("ord").cast("string")))


_PIXELS = "pix as (select l_suppkey as ord, avg(x2) as px, avg(y2) as py, 'S' || l_suppkey as name from boxes group by 1)"


def _logs(s, d, table, number, camera, ts):
    """Every row of a table as a video or a log; a tenth is without time."""
    return view(s, d, table).select(F.concat(F.lit("v"), F.col(number).cast("string")).alias("name"), F.col(camera).alias("camera"), F.to_date(ts).alias("date"), F.when(F.col("k") % 10 > 0, F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("int").alias("time_s"), F.concat(F.lit("s"), F.floor(F.col(number) / 200).cast("string")).alias("stem"))


def _match(s, d):
    return T.match_gps_log(_logs(s, d, "scans", "id", "camera_id", "created_on"), _logs(s, d, "fixes", "event_id", "device", "ts"))


def _logs_sql(name, table, number, camera, ts):
    return f"{name} as (select 'v' || {number} as name, {camera} as camera, cast({ts} as date) as date, case when k % 10 > 0 then cast(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}) as int) end as time_s, 's' || cast(floor({number} / 200) as bigint) as stem from {table})"


_MATCH = f"""with {_logs_sql('v', 'scans', 'id', 'camera_id', 'created_on')}, {_logs_sql('l', 'fixes', 'event_id', 'device', 'ts')},
f as (select v.name, l.name as log, abs(v.time_s - l.time_s) as gap, l.time_s is null or v.time_s is null as untimed from v join l using (camera, date)),
u as (select name, log, case when gap = 0 then 1 when gap <= 300 then 2 when untimed then 3 else 5 end as step, coalesce(gap, 0) as gap from f
      union all select v.name, l.name, 4, 0 from v join l using (stem))
select name, log, step, gap from (select *, row_number() over (partition by name order by step, gap, log) as rn from u) where rn = 1"""

_AVG = """with r as (select *, row_number() over (partition by device order by ts desc, event_id desc) as r, count(*) over (partition by device) as n from fixes),
g as (select * from r where r <= 120 and n >= 20 and fix_quality >= 1 and hdop < 10),
s as (select device, count(*) as m, list_sort(list(lat)) as la, list_sort(list(lon)) as lo from g group by 1),
f as (select device, m, la[cast(floor(m / 4) as int) + 1] as a1, la[cast(floor(3 * m / 4) as int) + 1] as a3, lo[cast(floor(m / 4) as int) + 1] as o1, lo[cast(floor(3 * m / 4) as int) + 1] as o3 from s where m >= 3),
i as (select g.*, m, lat between a1 - 1.5 * (a3 - a1) and a3 + 1.5 * (a3 - a1) and lon between o1 - 1.5 * (o3 - o1) and o3 + 1.5 * (o3 - o1) as ins from g join f using (device)),
k as (select *, case when hdop < 2 then 3.0 when hdop < 5 then 2.0 when hdop < 10 then 1.0 else 0.5 end as w, count(*) filter (ins) over (partition by device) as c from i)
select device, round(sum(w * lat) / sum(w), 8) as lat, round(sum(w * lon) / sum(w), 8) as lon, cast(count(*) as int) as samples from k where not (m >= 5 and c >= 3) or ins group by 1"""


def _rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _estimates(s, d):
    b = view(s, d, "fixes").filter("k % 4 > 0")
    return b.select((F.col("event_id") / 20).cast("long").alias("id"), F.col("fix_quality").alias("method"), F.when(F.col("k") % 11 > 0, F.col("lat")).alias("lat"), "lon", (F.col("k") % 5).cast("double").alias("weight"))


_HYBRID = """with e as (select cast(floor(event_id / 20) as bigint) as id, case when k % 11 > 0 then lat end as lat, lon, cast(k % 5 as double) as weight from fixes where k % 4 > 0),
g as (select *, lat is not null and lon is not null and weight > 0 as ok from e)
select id, round(sum(weight * lat) filter (ok) / sum(weight) filter (ok), 8) as lat, round(sum(weight * lon) filter (ok) / sum(weight) filter (ok), 8) as lon, count(*) filter (ok) as methods,
  round(case when count(*) filter (ok) = 0 then 0 when count(*) filter (ok) = 1 then 0.5 else 1 / (1 + 1000 * (stddev_pop(lat) filter (ok) + stddev_pop(lon) filter (ok))) end, 6) as confidence from g group by 1"""


def _calib(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") % 7).cast("double").alias("x"), (F.col("n_nationkey") % 11).cast("double").alias("y"))


_CALIB = "cal as (select cast(n_nationkey % 7 as double) as x, cast(n_nationkey % 11 as double) as y, n_nationkey as n from nation)"
_REGION = f"{_CALIB}, reg as (select (select min(x) from cal) as x1, (select max(x) from cal) as x2, (select min(y) from cal) as y1, (select max(y) from cal) as y2, coalesce(avg(d), 10) as mean_distance, coalesce(max(d), 20) as max_distance, 1.5 * coalesce(max(d), 20) as trusted_radius from (select sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from cal a join cal b on a.n < b.n))"


def _landmarks(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") % 5).cast("double").alias("lx"), (F.col("n_nationkey") % 19).cast("double").alias("ly"), (LAT0 + F.col("n_nationkey") / 1e4).alias("lat"), (LON0 - F.col("n_nationkey") / 1e4).alias("lon"))


_LAND = f"lm as (select n_nationkey as ord, cast(n_nationkey % 5 as double) as lx, cast(n_nationkey % 19 as double) as ly, {LAT0} + n_nationkey / 1e4 as lat, {LON0} - n_nationkey / 1e4 as lon from nation)"
_LPAIR = f"with {_LAND}, p as (select id, lm.*, sqrt(pow(x_world - lx, 2) + pow(y_world - ly, 2)) as d from scans, lm)"
_E2, _A = 0.0066943799901413165, 6378137.0
_MID = f"radians((latitude + {LAT0}) / 2)"
_LOCAL = f"""with g as (select id, {_MID} as m, radians(latitude - {LAT0}) as dla, radians(longitude - {LON0}) as dlo from scans),
h as (select id, {_A} / sqrt(1 - {_E2} * pow(sin(m), 2)) * cos(m) * dlo as e, {_A} * (1 - {_E2}) / pow(sqrt(1 - {_E2} * pow(sin(m), 2)), 3) * dla as n, dlo * sin(m) / 2 as t from g)
select id, round(e * cos(t) - n * sin(t), 4) as east, round(n * cos(t) + e * sin(t), 4) as north from h"""


def _to_local(s, d):
    e, n = to_local(F.col("latitude"), F.col("longitude"), LAT0, LON0)
    return _scans(s, d).select("id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"))


_CAMERA = {"K": [[800.0, 0.0, 640.0], [0.0, 800.0, 360.0], [0.0, 0.0, 1.0]], "R": [[1.0, 0.0, 0.0], [0.0, -0.6, -0.8], [0.0, 0.8, -0.6]], "t": [0.5, 2.0, 6.0]}
# the same camera, worked out: the ray's parts and the camera's centre
_RAY = ["((px - 640) / 800)", "(-0.6 * ((py - 360) / 800) + 0.8)", "(-0.8 * ((py - 360) / 800) - 0.6)"]
_CENTRE = (-0.5, 0.6 * 2.0 - 0.8 * 6.0, 0.8 * 2.0 + 0.6 * 6.0)


def _sides(s, d):
    """Positions that are given, in world coordinates, or swapped there."""
    f = view(s, d, "fixes")
    swap = F.when(F.col("k") % 3 == 0, F.array("lat", "lon")).when(F.col("k") % 3 == 1, F.array(F.col("lon") - 30, F.col("lat"))).otherwise(F.array(F.lit(500.0), F.col("lat")))
    return f.select("event_id", swap.alias("world_coords"), F.when(F.col("k") % 5 == 0, F.col("lat")).alias("lat"), F.when(F.col("k") % 5 == 0, F.col("lon")).alias("lon"))


def _offsets(s, d):
    """The positions, carried back into metres from the camera, which SQL knows without the ellipsoid."""
    found = G.offset_position(view(s, d, "boxes"), LAT0, LON0, (1280, 720), (50.0, 30.0))
    east, north = to_local(F.col("latitude"), F.col("longitude"), LAT0, LON0)
    return found.select("frame", "box_id", "l_partkey", "l_suppkey", F.round(east + 1e-5, 3).alias("east_m"), F.round(north + 1e-5, 3).alias("north_m"))


def _grounds(s, d):
    """Both methods; rounded a little above, as many points lie halfway between two roundings."""
    boxes, camera = view(s, d, "boxes"), {**_CAMERA, "size": (1280, 720)}
    ways = [G.ground_of_boxes(boxes, camera, m, frame=(640, 360)).select("frame", "box_id", "l_partkey", "l_suppkey", F.lit(m).alias("method"), F.round(F.col("wx") + 1e-7, 5).alias("wx"), F.round(F.col("wy") + 1e-7, 5).alias("wy")) for m in ("bottom_center", "backside_projection")]
    return ways[0].unionByName(ways[1])


_GROUNDS = " union all ".join(f"select frame, box_id, l_partkey, l_suppkey, '{m}' as method, round({_CENTRE[0]} + ({z} - {_CENTRE[2]}) / {_RAY[2]} * {_RAY[0]} + 1e-7, 5) as wx, round({_CENTRE[1]} + ({z} - {_CENTRE[2]}) / {_RAY[2]} * {_RAY[1]} + 1e-7, 5) as wy from (select *, (x1 + x2) / 2 * 2 as px, {y} * 2 as py from boxes)" for m, z, y in (("bottom_center", "0.0::double", "y2"), ("backside_projection", "2.6::double", "(y1 + y2) / 2")))


QUERIES = {
    "resolve_position": (lambda s, d: _rounded(G.resolve_position(_sides(s, d)).select("event_id", "latitude", "longitude"), 7, "latitude", "longitude"), sql("select event_id, case when k % 5 = 0 or k % 3 < 2 then round(lat, 7) end as latitude, case when k % 5 = 0 or k % 3 = 0 then round(lon, 7) when k % 3 = 1 then round(lon - 30, 7) end as longitude from fixes", "fixes")),
    "check_position": (lambda s, d: _rounded(G.check_position(_scans(s, d), LAT0, LON0, 0.01).select("id", "distance_km", "valid"), 6, "distance_km"), sql(f"with f as (select id, {_feet('latitude', 'longitude', LAT0, LON0)} / 3.28084 / 1000 as km from scans) select id, round(km, 6) as distance_km, km <= 0.01 as valid from f", "scans")),
    "offset_position": (_offsets, sql("select frame, box_id, l_partkey, l_suppkey, round(((x1 + x2) / 2 - 640) / 640 * 50 + 1e-5, 3) as east_m, round(-((y1 + y2) / 2 - 360) / 360 * 30 + 1e-5, 3) as north_m from boxes", "boxes")),
    "project_plane": (lambda s, d: _rounded(G.project_plane(_pixels(s, d), _CAMERA).select("name", "wx", "wy"), 6, "wx", "wy"), sql(f"with {_PIXELS} select name, round({_CENTRE[0]} + (0 - {_CENTRE[2]}) / {_RAY[2]} * {_RAY[0]}, 6) as wx, round({_CENTRE[1]} + (0 - {_CENTRE[2]}) / {_RAY[2]} * {_RAY[1]}, 6) as wy from pix", "boxes")),
    "ground_of_boxes": (_grounds, sql(_GROUNDS, "boxes")),
    "project_pixel": (lambda s, d: _rounded(G.project_pixel(G.project_plane(_pixels(s, d), _CAMERA).select("name", "wx", "wy"), _CAMERA), 3, "px", "py").select("name", "px", "py"), sql(f"with {_PIXELS} select name, round(px, 3) as px, round(py, 3) as py from pix", "boxes")),
    "valid_scan": (lambda s, d: A.valid_scan(_scans(s, d), 5, 60).select("id", "plate"), sql("select id, plate from scans where nullif(trim(plate), '') is not null and speed between 5 and 60", "scans")),
    "latest_per_plate": (lambda s, d: A.latest_per_plate(_scans(s, d)).select("id", "plate", "created_on"), sql("select id, plate, created_on from (select *, row_number() over (partition by plate order by created_on desc, id) as rn from scans where nullif(trim(plate), '') is not null) where rn = 1", "scans")),
    "latest_per_tag_mark_rest": (lambda s, d: A.latest_per_tag_mark_rest(_scans(s, d)).select("id", "chosen", "is_processed", "comment"), sql("with r as (select *, row_number() over (partition by plate order by created_on desc, id) as rn from scans), t as (select id from r where rn = 1 order by id limit 50) select id, id in (select id from t) as chosen, is_processed or id not in (select id from t) as is_processed, case when id not in (select id from t) then 'Ignored duplicated RFID' end as comment from scans", "scans")),
    "nearest_spots": (lambda s, d: A.nearest_spots(_scans(s, d), _spot_points(s, d), _LIMIT).select("id", "spot", "rank", F.round("distance", 4).alias("distance")), sql(f"with {_PAIRS} select id, spot, rank, round(distance, 4) as distance from (select *, cast(row_number() over (partition by id order by distance, ord) as int) as rank from pairs) where rank <= 5", "scans")),
    "nearest_any": (lambda s, d: A.nearest_any(_scans(s, d), _spot_points(s, d)).select("id", "spot", F.round("distance", 4).alias("distance")), sql(f"with {_SPOT_POINTS}, q as (select id, spot, ord, {_feet('latitude', 'longitude', 'spot_lat', 'spot_lon')} as distance from scans, sp) select id, spot, round(distance, 4) as distance from (select *, row_number() over (partition by id order by distance, ord) as rn from q) where rn = 1", "scans")),
    "assign_spots": (lambda s, d: A.assign_spots(_scans(s, d), _spot_points(s, d), limit_ft=_LIMIT).withColumn("distance", F.round("distance", 4)), sql(f"with {_SPOT_POINTS}, {_WAITING}, q as (select id, plate, spot, ord, {_feet('latitude', 'longitude', 'spot_lat', 'spot_lon')} as distance from waiting, sp) select id, plate, spot, round(distance, 4) as distance from (select *, row_number() over (partition by id order by distance, ord) as rn from q where distance < {_LIMIT}) where rn = 1", "scans")),
    "mark_assigned": (lambda s, d: A.mark_assigned(_scans(s, d), A.assign_spots(_scans(s, d), _spot_points(s, d).withColumn("spot_id", F.concat(F.lit("S"), F.col("ord").cast("string"))), limit_ft=_LIMIT), F.lit("2024-03-01").cast("timestamp_ntz")).select("id", "is_processed", "assigned_spot_id", "assigned_spot_name", "processed_comment", "updated_on"), sql(f"with {_SPOT_POINTS}, {_WAITING}, q as (select id, spot, ord, {_feet('latitude', 'longitude', 'spot_lat', 'spot_lon')} as distance from waiting, sp), b as (select id, spot, ord from (select *, row_number() over (partition by id order by distance, ord) as rn from q where distance < {_LIMIT}) where rn = 1) select scans.id, is_processed or spot is not null as is_processed, 'S' || ord as assigned_spot_id, spot as assigned_spot_name, 'Location Updated: ' || spot as processed_comment, case when spot is not null then timestamp '2024-03-01' end as updated_on from scans left join b using (id)", "scans")),
    "site_settings": (lambda s, d: A.site_settings(_sites(s, d), _flags(s, d), _settings(s, d)), f"with {_SITE_SETTINGS} select * from ss"),
    "assign_until_moved": (_until_moved, sql(_UNTIL_MOVED, "scans")),
    "assign_spots_by_site": (_by_site, sql(_BY_SITE, "scans")),
    "latest_coordinate": (lambda s, d: A.latest_coordinate(view(s, d, "coordinates")).select("location_id", "id"), sql("select location_id, max(id) as id from coordinates where not is_deleted group by 1", "coordinates")),
    "parking_spots": (lambda s, d: A.parking_spots(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("site_id")), view(s, d, "coordinates")).select("location_id", "name", "site_id", "id"), sql("select s_suppkey as location_id, s_name as name, s_nationkey as site_id, id from supplier join (select location_id, max(id) as id from coordinates where not is_deleted group by 1) on s_suppkey = location_id", "coordinates")),
    "skip_seen": (lambda s, d: A.skip_seen(_scans(s, d), _scans(s, d).filter("is_processed and k < 50")).select("id", "plate"), sql("select id, plate from scans where plate not in (select plate from scans where is_processed and k < 50)", "scans")),
    "resolve_spot": (lambda s, d: A.resolve_spot(_points(s, d), spot_polygons(s)).select("id", "spot", "method"), sql(_RESOLVE, "scans", "spots")),
    "closest_projected_spot": (lambda s, d: _rounded(A.closest_projected_spot(_points(s, d), _pixels(s, d), _H, 2.0).select("id", "spot", "distance"), 6, "distance"), sql(f"with {_PIXELS}, q as (select id, name, ord, sqrt(pow(x_world - {_HX}, 2) + pow(y_world - {_HY}, 2)) as dd from scans, pix) select id, name as spot, round(dd, 6) as distance from (select *, row_number() over (partition by id order by dd, ord) as rn from q) where rn = 1 and dd < 2", "scans", "boxes")),
    "gps_at": (lambda s, d: T.gps_at(view(s, d, "frames"), view(s, d, "fixes"), 600).select("event_id", "fix_id"), sql("select frames.event_id, f.event_id as fix_id from frames left join (select a.event_id as fr, max_by(b.event_id, {'t': b.ts, 'e': b.event_id}) as event_id from frames a join fixes b on a.device = b.device and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 group by 1) f on fr = frames.event_id", "frames", "fixes")),
    "gps_nearest": (lambda s, d: _rounded(T.gps_nearest(view(s, d, "frames"), view(s, d, "fixes")), 3, "gap_s"), sql("with p as (select a.event_id, b.event_id as fix_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) as g, row_number() over (partition by a.event_id order by abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) as rn from frames a join fixes b using (device)) select event_id, fix_id, round(g / 1e6, 3) as gap_s from p where rn = 1", "frames", "fixes")),
    "frame_time": (lambda s, d: T.frame_time(view(s, d, "frames").select(F.col("device").alias("video"), F.col("event_id").alias("frame"), F.lit(20000).alias("total")), view(s, d, "fixes").select(F.col("device").alias("video"), "ts")), sql("with sp as (select device, epoch_us(min(ts)) as a, epoch_us(max(ts)) as z from fixes group by 1) select device as video, event_id as frame, 20000 as total, a + cast(floor(event_id / 20000 * (z - a)) as bigint) as micros from frames join sp using (device)", "frames", "fixes")),
    "match_gps_log": (_match, sql(_MATCH, "scans", "fixes")),
    "match_gps_log_all": (_match, sql(_MATCH, "scans", "fixes")),
    "average_position": (lambda s, d: _rounded(G.average_position(view(s, d, "fixes")), 8, "lat", "lon"), sql(_AVG, "fixes")),
    "position_accuracy": (lambda s, d: _rounded(G.position_accuracy(view(s, d, "fixes"), LAT0, LON0).select("event_id", "error_m", "band"), 3, "error_m"), sql(f"with e as (select event_id, {_feet('lat', 'lon', LAT0, LON0)} / 3.28084 as e from fixes) select event_id, round(e, 3) as error_m, case when e < 5 then 'excellent' when e < 10 then 'good' when e < 20 then 'fair' when e < 50 then 'poor' else 'bad' end as band from e", "fixes")),
    "to_local": (_to_local, sql(_LOCAL, "scans")),
    "round_trip_report": (lambda s, d: _rounded(G.round_trip_report(_scans(s, d), LAT0, LON0).select("id", "east", "north", (F.col("error_m") < 0.001).alias("back")), 4, "east", "north"), sql(_LOCAL.replace("as north from h", "as north, true as back from h"), "scans")),
    "reprojection_report": (lambda s, d: _rounded(G.reprojection_report(_pixels(s, d).withColumns({"x": F.col("px") / 500, "y": F.col("py") / 100}), _H), 6, "rmse", "max", "min", "mean"), sql(f"with {_PIXELS}, e as (select sqrt(pow({_HX} - px / 500, 2) + pow({_HY} - py / 100, 2)) as e from pix) select count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(max(e), 6) as max, round(min(e), 6) as min, round(avg(e), 6) as mean from e", "boxes")),
    "calibration_region": (lambda s, d: _rounded(G.calibration_region(_calib(s, d)), 6, "mean_distance", "max_distance", "trusted_radius"), f"with {_REGION} select x1, x2, y1, y2, round(mean_distance, 6) as mean_distance, round(max_distance, 6) as max_distance, round(trusted_radius, 6) as trusted_radius from reg"),
    "position_confidence": (lambda s, d: _rounded(G.position_confidence(_points(s, d).withColumns({"x": F.col("x") * 9, "y": F.col("y") * 3}), _calib(s, d)).select("id", "distance", "score", "trusted", "use"), 6, "distance", "score"), sql(f"""with {_REGION}, q as (select id, x_world * 9 as x, y_world * 3 as y from scans), n as (select id, min(q.x) as x, min(q.y) as y, min(sqrt(pow(q.x - cal.x, 2) + pow(q.y - cal.y, 2))) as d from q, cal group by 1),
z as (select *, case when d <= mean_distance then 1 - 0.2 * d / mean_distance when d <= max_distance then 0.8 - 0.3 * (d - mean_distance) / (max_distance - mean_distance) when d <= trusted_radius then 0.5 - 0.3 * (d - max_distance) / (trusted_radius - max_distance) else 0 end as sc from n, reg)
select id, round(d, 6) as distance, round(sc, 6) as score, (x between x1 and x2 and y between y1 and y2) or d <= trusted_radius as trusted, sc >= 0.5 as use from z""", "scans")),
    "hybrid_position": (lambda s, d: _rounded(_rounded(G.hybrid_position(_estimates(s, d)), 8, "lat", "lon"), 6, "confidence"), sql(_HYBRID, "fixes")),
    "landmark_position": (lambda s, d: _rounded(G.landmark_position(_points(s, d), _landmarks(s, d)).select("id", "lat", "lon"), 6, "lat", "lon"), sql(f"{_LPAIR} select id, round(lat, 6) as lat, round(lon, 6) as lon from (select *, row_number() over (partition by id order by d, ord) as rn from p) where rn = 1", "scans")),
    "landmark_mean": (lambda s, d: _rounded(G.landmark_position(_points(s, d), _landmarks(s, d), "weighted").select("id", "lat", "lon"), 6, "lat", "lon"), sql(f"{_LPAIR}, w as (select *, case when d < 1e-6 then 1e6 else 1 / pow(d, 2) end as w from p) select id, round(sum(w * lat) / sum(w), 6) as lat, round(sum(w * lon) / sum(w), 6) as lon from w group by 1", "scans")),
    "nearest_reference_offset": (lambda s, d: _rounded(G.nearest_reference_offset(view(s, d, "fixes").select("event_id", "lat", "lon"), _landmarks(s, d).select("ord", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), (F.col("ord") / 1e5).alias("dlat"), (F.col("ord") / 1e6).alias("dlon")), 20), 7, "lat", "lon"), sql(f"with {_LAND}, p as (select event_id, fixes.lat, fixes.lon, lm.ord, {_feet('fixes.lat', 'fixes.lon', 'lm.lat', 'lm.lon')} / 3.28084 as dd from fixes, lm), b as (select *, row_number() over (partition by event_id order by dd, ord) as rn from p) select event_id, round(lat + case when dd <= 20 then ord / 1e5 else 0 end, 7) as lat, round(lon + case when dd <= 20 then ord / 1e6 else 0 end, 7) as lon, dd <= 20 as corrected from b where rn = 1", "fixes")),
    "blend_positions": (lambda s, d: _rounded(G.blend_positions(_points(s, d).filter("id % 3 > 0"), _points(s, d).filter("id % 5 > 0").withColumns({"x": F.col("x") + 1})), 6, "x", "y"), sql("with a as (select id, x_world as x, y_world as y from scans where id % 3 > 0), b as (select id, x_world + 1 as x, y_world as y from scans where id % 5 > 0) select id, round(coalesce(0.7 * a.x + 0.3 * b.x, a.x, b.x), 6) as x, round(coalesce(0.7 * a.y + 0.3 * b.y, a.y, b.y), 6) as y from a full join b using (id)", "scans")),
}
