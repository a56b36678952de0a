"""Yard tables derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference point of the yard and degrees-to-metres divisors of the derived positions.
LAT0, LON0 = 41.9125436, -89.04487889
#: Spot rectangles as (name, x1, x2, y1, y2, order).
SPOTS = [
    ("A1", -0.5, 1.5, 0.0, 5.0, 1), ("A2", 1.5, 3.5, 0.0, 5.0, 2), ("B1", -0.5, 1.5, 5.0, 10.0, 3), ("B2", 1.5, 3.5, 5.0, 10.0, 4),
    ("C1", -0.5, 1.5, 10.0, 15.0, 5), ("C2", 1.5, 3.5, 10.0, 15.0, 6), ("D1", -0.5, 1.5, 15.0, 20.0, 7), ("D2", 1.5, 3.5, 15.0, 20.0, 8),
]
_K = {"spark": "cast(get_json_object(props, '$.k') as int)", "duck": "cast(json_extract_string(props, '$.k') as int)"}
_BY = {
    "scans": """select event_id as id, ts as created_on, concat('cam-0', cast(user_id % 6 as {s})) as camera_id,
  cast(case when event_type = 'signup' then null else user_id end as bigint) as track_id,
  case when event_type = 'error' then '' else concat('TRL', lpad(cast(user_id as {s}), 6, '0')) end as plate,
  case when value >= 100 then cast(1 as double) else value / cast(100 as double) end as conf,
  cast({k} % 10 as double) * cast(0.4 as double) - cast(0.5 as double) as x_world,
  cast(floor({k} / 10.0) as double) * cast(2 as double) as y_world,
  cast(41.9125436 as double) + cast(floor({k} / 10.0) as double) * cast(2 as double) / cast(111320 as double) as latitude,
  cast(-89.04487889 as double) + (cast({k} % 10 as double) * cast(0.4 as double) - cast(0.5 as double)) / cast(82850 as double) as longitude,
  value / cast(5 as double) as speed, cast(({k} * 37) % 360 as double) as heading,
  case when event_type = 'view' then null else concat(chr(cast(65 + floor({k} / 25.0) as int)), '-', cast({k} % 8 as {s})) end as spot_name,
  event_type = 'purchase' as is_processed, {k} as k
from events""",
    "fixes": """select event_id, concat('cam-0', cast(user_id % 6 as {s})) as device, ts,
  cast({k} % 12 as double) / cast(2 as double) as hdop, {k} % 3 as fix_quality, {k} as k,
  cast(41.9125436 as double) + cast({k} as double) / cast(100000 as double) as lat,
  cast(-89.04487889 as double) - cast({k} as double) / cast(100000 as double) as lon
from events where event_id % 2 = 0""",
    "frames": """select event_id, concat('cam-0', cast(user_id % 6 as {s})) as device, ts from events where event_id % 2 = 1""",
    "boxes": """select l_orderkey as frame, l_linenumber as box_id, l_partkey, l_suppkey,
  l_quantity * cast(10 as double) as x1, cast(l_linenumber * 20 as double) as y1,
  l_quantity * cast(10 as double) + cast(80 + (l_partkey % 200) as double) as x2,
  cast(l_linenumber * 20 + 60 + (l_suppkey % 150) as double) as y2, l_discount * cast(10 as double) as conf
from lineitem""",
    "readings": """select event_id, user_id as track,
  case when event_id % 4 = 0 then concat('TRL', lpad(cast(user_id as {s}), 6, '0'))
       when event_id % 4 = 1 then concat('TRL', lpad(cast(user_id as {s}), 5, '0'))
       when event_id % 4 = 2 then concat('JBHU ', cast(249000 + {k} as {s})) else '' end as text,
  case when value >= 100 then cast(1 as double) else value / cast(100 as double) end as conf
from events""",
    "coordinates": """select l_suppkey as location_id, l_orderkey * 10 + l_linenumber as id,
  cast(l_partkey as double) / 1000 as latitude, cast(l_quantity as double) as longitude, l_discount > 0.05 as is_deleted from lineitem""",
}


def _text(name: str, engine: str) -> str:
    return _BY[name].format(k=_K[engine], s="string" if engine == "spark" else "varchar")


def source(name: str) -> str:
    return "lineitem" if name in ("boxes", "coordinates") else "events"


def derive(table: DataFrame, name: str) -> DataFrame:
    """A derived table over its source, which may be a stream; its columns and filters reach the scan."""
    return table.sparkSession.sql(_text(name, "spark").replace(f"from {source(name)}", "from {table}"), table=table)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/{source(name)}.parquet"), name)


def spots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPOTS, "name string, x1 double, x2 double, y1 double, y2 double, ord int")


def spot_polygons(spark: SparkSession) -> DataFrame:
    """The rectangles as rings with their centroids."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    return spots(spark).select("name", "ord", ring.alias("ring"))


def sql(body: str, *names: str) -> str:
    """DuckDB SQL with the named derived tables in front."""
    values = ", ".join(f"('{n}', {x1}::double, {x2}::double, {y1}::double, {y2}::double, {o})" for n, x1, x2, y1, y2, o in SPOTS)
    tables = {n: _text(n, "duck") for n in _BY} | {"spots": f"select * from (values {values}) s(name, x1, x2, y1, y2, ord)"}
    heads = ",\n".join(f"{n} as ({tables[n]})" for n in names)
    if not names:
        return body
    text = body.strip()
    start = next((w for w in ("with recursive ", "with ") if text.lower().startswith(w)), "")
    return f"{start or 'with '}{heads}" + (",\n" + text[len(start) :] if start else "\n" + body)
