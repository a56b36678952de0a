"""Placement of scans on spots: validity, latest readings, nearest spots, polygons, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardspark.functions.geo import haversine_ft, homography, in_ring, ring_centroid
from yardspark.functions.text import nz
from yardspark.sources.folders import shared_folder

#: Lists up to so many rows are folded in each row from one broadcast row; larger ones are searched by cells.
BROADCAST_ROWS = 20_000
#: Rows of a list that is folded in one row, about.
LIST_ROWS = 4096
#: Half the way around the sphere in feet, rounded up.
_HALF_WAY = 66_000_000.0
#: Feet in a degree of latitude, rounded down so that a cell is never smaller than the limit.
_FEET_A_DEGREE = 364_000.0


def valid_scan(scans: DataFrame, min_speed: float, max_speed: float) -> DataFrame:
    return scans.filter(nz("plate").isNotNull() & F.col("speed").between(min_speed, max_speed))


def latest_per_plate(scans: DataFrame) -> DataFrame:
    """The newest scan of each plate; of equal times the one with the smaller id."""
    newest = F.max_by(F.struct(*scans.columns), F.struct("created_on", -F.col("id")))
    return scans.filter(nz("plate").isNotNull()).groupBy(nz("plate").alias("_p")).agg(newest.alias("s")).select("s.*")


def latest_per_tag_mark_rest(scans: DataFrame, most: int = 50) -> DataFrame:
    """The newest of each tag, the first `most` by id; every other row is processed as a duplicate. A blank tag is one too."""
    newest = F.max_by("id", F.struct("created_on", -F.col("id"))).alias("id")  # combined before the shuffle, so hot tags do not matter
    top = scans.groupBy("plate").agg(newest).orderBy("id").limit(most).select("id", F.lit(True).alias("chosen"))
    out = scans.join(F.broadcast(top), "id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return out.withColumns({"is_processed": F.col("is_processed") | ~F.col("chosen"), "comment": F.when(~F.col("chosen"), "Ignored duplicated RFID")})


def near_pairs(scans: DataFrame, spots: DataFrame, limit_ft: float | str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of scans and spots nearer than the limit (strictly), with `distance`; equal in the columns `on`.

    Spots are repeated in the cells around their own (cells are as wide as the limit), so that an equi-join by cell
    leaves only neighbours to measure; few spots, which are counted, are broadcast. The limit may be a column of both
    sides that is equal where they meet: then each group has cells of its own width. Without a positive limit no pair is.
    """
    limit = F.col(limit_ft) if isinstance(limit_ft, str) else F.lit(float(limit_ft))
    placed = scans.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (limit > 0))
    held = spots.filter(F.col("spot_lat").isNotNull() & F.col("spot_lon").isNotNull() & (limit > 0))
    distance = haversine_ft(F.col("latitude"), F.col("longitude"), F.col("spot_lat"), F.col("spot_lon"))
    known = held.agg(F.max(F.abs("spot_lat")).alias("high"), F.count("*").alias("n")).first()
    high = known["high"] or 0.0
    size = limit / _FEET_A_DEGREE
    wide = size / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), high + 2 * size))))
    turns = F.greatest(F.floor(F.lit(360.0) / wide), F.lit(1))
    cell = lambda lat, lon: (F.floor(F.col(lat) / size), F.pmod(F.floor((F.col(lon) + 180) / (360.0 / turns)), turns))
    y, x = cell("spot_lat", "spot_lon")
    around = held.withColumns({"_y": F.explode(F.sequence(y - 1, y + 1)), "_x0": x, "_n": turns})
    around = around.withColumn("_x", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_x0") + d, F.col("_n")))))).drop("_x0", "_n")
    around = around.drop(limit_ft) if isinstance(limit_ft, str) else around
    around = F.broadcast(around) if known["n"] <= BROADCAST_ROWS else around
    y, x = cell("latitude", "longitude")
    return placed.withColumns({"_y": y, "_x": x}).join(around, [*on, "_y", "_x"]).drop("_y", "_x").withColumn("distance", distance).filter(F.col("distance") < limit)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that rounds do not compute those before them again."""
    path = shared_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def nearest_spots(scans: DataFrame, spots: DataFrame, limit_ft: float = 100.0, k: int = 5) -> DataFrame:
    """The k nearest spots of each scan nearer than the limit, with their rank; ties by the spots' order.

    spots: spot, spot_lat, spot_lon, ord.
    """
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "ord"))
    return near_pairs(scans, spots, limit_ft).withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_any(scans: DataFrame, spots: DataFrame, start_ft: float = 100.0) -> DataFrame:
    """The nearest spot of each placed scan (by its id and place) without a limit.

    Few spots are folded in each scan's row. Many are searched by cells in widening rounds: a round finds the nearest
    spot of every scan that has one within its limit, and only the others go on to the next.
    """
    held = spots.filter("spot_lat is not null and spot_lon is not null")
    placed = scans.filter("latitude is not null and longitude is not null")
    if few_rows(held):
        row = held.agg(F.array_sort(F.collect_list(F.struct("ord", "spot", "spot_lat", "spot_lon"))).alias("_all"))
        measured = F.transform("_all", lambda s: F.struct(haversine_ft(F.col("latitude"), F.col("longitude"), s["spot_lat"], s["spot_lon"]).alias("distance"), s["ord"].alias("ord"), s["spot"].alias("spot")))
        out = placed.join(F.broadcast(row)).withColumn("_best", F.array_min(measured))
        return out.select(*scans.columns, F.col("_best.spot").alias("spot"), F.col("_best.distance").alias("distance"))
    keys = ["id", "latitude", "longitude"]
    rest, found, limit = written(placed.select(keys).distinct()), None, start_ft
    while True:
        near = near_pairs(rest, held.select("spot", "spot_lat", "spot_lon", "ord"), limit)
        best = written(near.groupBy(keys).agg(F.min_by(F.struct("spot", "distance"), F.struct("distance", "ord")).alias("b")).select(*keys, "b.spot", "b.distance"))
        found = best if found is None else found.unionByName(best)
        if limit > _HALF_WAY:
            break
        rest, limit = rest.join(best, keys, "left_anti"), limit * 32
    return placed.join(found, keys).select(*scans.columns, "spot", "distance")


def assign_spots(scans: DataFrame, spots: DataFrame, min_speed: float = 0.0, max_speed: float = 60.0, limit_ft: float = 100.0) -> DataFrame:
    """The newest valid scan of each plate with its nearest spot; scans without one are left out and stay unprocessed."""
    waiting = latest_per_plate(valid_scan(scans.filter(~F.col("is_processed")), min_speed, max_speed))
    return place_scans(waiting, spots, limit_ft)


def place_scans(scans: DataFrame, spots: DataFrame, limit_ft: float = 100.0) -> DataFrame:
    """Each scan (by its id) with its nearest spot nearer than the limit; scans without one are left out."""
    near = near_pairs(scans, spots, limit_ft)
    own = ["spot_id"] if "spot_id" in spots.columns else []
    best = near.groupBy("id").agg(F.min_by(F.struct("plate", "spot", *own, "distance"), F.struct("distance", "ord")).alias("b"))
    return best.select("id", "b.plate", "b.spot", *[f"b.{c}" for c in own], "b.distance")


def mark_assigned(scans: DataFrame, assignments: DataFrame, now: Column | None = None) -> DataFrame:
    """scans with the assigned spot (id, name, distance) and a comment; processed and updated (at `now`) where assigned."""
    spot_id = F.col("spot_id").cast("string") if "spot_id" in assignments.columns else F.lit(None).cast("string")
    found = assignments.select("id", spot_id.alias("assigned_spot_id"), F.col("spot").alias("assigned_spot_name"), F.col("distance").alias("assigned_distance_ft"))
    updated = F.col("updated_on") if "updated_on" in scans.columns else F.lit(None).cast("timestamp_ntz")
    out = scans.withColumn("updated_on", updated).drop("assigned_spot_id", "assigned_spot_name", "assigned_distance_ft").join(found, "id", "left")
    hit = F.col("assigned_spot_name").isNotNull()
    return out.withColumns({
        "is_processed": F.col("is_processed") | hit, "processed_comment": F.when(hit, F.concat(F.lit("Location Updated: "), "assigned_spot_name")),
        "updated_on": F.when(hit, F.localtimestamp() if now is None else now).otherwise(F.col("updated_on")),
    })


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def heading_valid(heading: Column, to_spot: Column, tolerance: float = 90.0) -> Column:
    """Whether a spot lies to the right of the heading within the tolerance; a missing heading allows all."""
    off = F.abs(F.pmod(to_spot - (heading + 90.0) + 180.0, F.lit(360.0)) - 180.0)
    return heading.isNull() | (off <= tolerance)


def site_settings(sites: DataFrame, flags: DataFrame, settings: DataFrame) -> DataFrame:
    """Active sites that have the capability, with their first settings; sites without settings are left out."""
    allowed = flags.filter("allow").select("site_id").distinct()
    first = settings.groupBy("site_id").agg(F.min_by(F.struct(*[c for c in settings.columns if c != "site_id"]), F.col("setting_id")).alias("s")).select("site_id", "s.*")
    return sites.join(allowed, "site_id").join(first, "site_id")


def latest_coordinate(coordinates: DataFrame) -> DataFrame:
    """The coordinate with the highest id of each location, among those not deleted."""
    best = F.max_by(F.struct("id", "latitude", "longitude"), F.col("id"))
    return coordinates.filter(~F.col("is_deleted")).groupBy("location_id").agg(best.alias("c")).select("location_id", "c.*")


def parking_spots(locations: DataFrame, coordinates: DataFrame) -> DataFrame:
    """locations (location_id, name, site_id) with their latest coordinates."""
    return locations.join(latest_coordinate(coordinates), "location_id")


def skip_seen(scans: DataFrame, seen: DataFrame) -> DataFrame:
    return scans.join(seen.select("plate").distinct(), "plate", "left_anti")


#: The verdicts of a scan.
INVALID_TAG = "Ignore Inventory - Invalid Tag"
INVALID_SPEED = "Ignore Inventory - Speed is not valid"
ALREADY_MOVED = "Ignore Inventory - Already Moved"
NO_LOCATION = "Ignore Inventory - Unable to pick the location"
UPDATED = "Location Updated: "


def scan_verdict(min_speed: Column, max_speed: Column, moved: Column, spot: Column, least_tag: int = 20) -> Column:
    """The first reason that applies, else the spot. Tags of `least_tag` signs or fewer are invalid."""
    tag = F.char_length(F.coalesce("plate", F.lit("")))
    valid = F.coalesce(F.col("speed").between(min_speed, max_speed), F.lit(False))
    return F.when(tag <= least_tag, INVALID_TAG).when(~valid, INVALID_SPEED).when(moved, ALREADY_MOVED).when(spot.isNull(), NO_LOCATION).otherwise(F.concat(F.lit(UPDATED), spot))


def assign_spots_by_site(scans: DataFrame, spots: DataFrame, settings: DataFrame, moved: DataFrame | None = None, least_tag: int = 20, tolerance: float = 90.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every scan's verdict by its site's settings, with the scan's columns `keep`.

    spots: site_id, spot, spot_lat, spot_lon, ord; settings: site_id, min_speed, max_speed, max_slot_distance and perhaps
    max_slots (how many spots are considered; none with 0); moved: tags (plate) that were moved before. Scans of sites
    without settings are left out. Of spots at equal distance the first counts. A scan meets the spots of its site in the
    cells around it, which are as wide as the site's distance, so a site of many scans is spread over tasks by place.
    """
    with_site = scans.join(settings, "site_id")
    if moved is not None:
        with_site = with_site.join(moved.select("plate", F.lit(True).alias("_moved")).distinct(), "plate", "left")
    limited = spots.join(settings.select("site_id", "max_slot_distance"), "site_id")
    pairs = near_pairs(with_site.select("id", "site_id", "latitude", "longitude", "heading", "max_slot_distance"), limited, "max_slot_distance", ("site_id",))
    pairs = pairs.filter(heading_valid(F.col("heading"), bearing(F.col("latitude"), F.col("longitude"), F.col("spot_lat"), F.col("spot_lon")), tolerance))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("spot", "distance"), F.struct("distance", "ord")).alias("b"))
    out = with_site.join(best, "id", "left")
    some = F.col("max_slots") > 0 if "max_slots" in settings.columns else F.lit(True)
    out = out.withColumn("b", F.when(F.coalesce(some, F.lit(True)), F.col("b"))).withColumns({"spot": F.col("b.spot"), "distance": F.col("b.distance")})
    before = F.coalesce("_moved", F.lit(False)) if moved is not None else F.lit(False)
    verdict = scan_verdict(F.col("min_speed"), F.col("max_speed"), before, F.col("spot"), least_tag)
    return out.select("id", "site_id", "plate", "spot", "distance", verdict.alias("verdict"), *keep)


def assign_until_moved(scans: DataFrame, spots: DataFrame, settings: DataFrame, least_tag: int = 20, tolerance: float = 90.0) -> DataFrame:
    """The scans' verdicts as they come one after another (by created_on, then id): a placed scan is an observation of
    its tag; the tag moves with the first scan at which its site has seen it observations_count times within
    observation_cutoff_minutes, and its later scans, of any site, are already moved. Placed scans before that wait: they
    have a spot and no verdict.

    settings: as in assign_spots_by_site, with these two. Observations are counted in buckets as wide as the site's
    cutoff, each with the bucket before it, so no tag's whole history meets in one task.
    """
    placed = assign_spots_by_site(scans, spots, settings, None, least_tag, tolerance, ("created_on",))
    placed = placed.withColumn("_t", F.unix_micros(F.col("created_on").cast("timestamp")))
    rule = settings.select("site_id", F.col("observations_count").cast("int").alias("_least"), (F.col("observation_cutoff_minutes").cast("long") * 60_000_000).alias("_cutoff"))
    most = rule.agg(F.max("_least")).first()[0] or 1
    seen = placed.filter(F.col("verdict").startswith(UPDATED)).select("id", "site_id", "plate", "_t").join(rule.filter("_cutoff > 0"), "site_id")
    bucket = F.floor(F.col("_t") / F.col("_cutoff"))
    seen = seen.withColumn("_in", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))))
    last = F.collect_list("_t").over(Window.partitionBy("site_id", "plate", "_in.b").orderBy("_t", "id").rowsBetween(1 - most, 0))
    first = F.get(last, F.size(last) - F.greatest(F.col("_least"), F.lit(1)))  # the time of the earliest of the `_least` last ones
    moves = seen.withColumn("_first", first).filter(F.col("_in.own") & (F.col("_first") >= F.col("_t") - F.col("_cutoff")))
    moved = moves.groupBy("plate").agg(F.min(F.struct("_t", "id")).alias("_moved"))
    rows = placed.join(moved, "plate", "left").withColumn("_now", F.struct("_t", "id"))
    verdict = F.when(F.col("verdict").isin(INVALID_TAG, INVALID_SPEED), F.col("verdict")).when(F.col("_now") > F.col("_moved"), ALREADY_MOVED)
    verdict = verdict.when(F.col("spot").isNull() | (F.col("_now") == F.col("_moved")), F.col("verdict"))
    return rows.select("id", "site_id", "plate", F.when(F.coalesce(F.col("_now") > F.col("_moved"), F.lit(False)), None).otherwise(F.col("spot")).alias("spot"), verdict.alias("verdict"))


def nearest_centre(points: DataFrame, centres: DataFrame, size: float) -> DataFrame:
    """(id, x, y, name, d): the centre (ord, name, sx, sy) at the least distance of each point, by cells that widen from
    `size`: a round settles the points whose nearest centre in the cells around theirs is within a cell's width."""
    low = lambda c: F.min(c)
    spans = [df.agg(low(x).alias("x0"), F.max(x).alias("x1"), low(y).alias("y0"), F.max(y).alias("y1")).first() for df, x, y in ((points, "x", "y"), (centres, "sx", "sy"))]
    if any(r["x0"] is None for r in spans):
        return points.select("id", "x", "y").limit(0).withColumns({"name": F.lit(None).cast(centres.schema["name"].dataType), "d": F.lit(0.0)})
    far = max(max(r["x1"] for r in spans) - min(r["x0"] for r in spans), max(r["y1"] for r in spans) - min(r["y0"] for r in spans))
    keys = ["id", "x", "y"]
    rest, found = written(points.select(keys).distinct()), None
    while True:
        near_by = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        around = centres.withColumn("o", F.explode(near_by)).select("ord", "name", "sx", "sy", (F.floor(F.col("sx") / size) + F.col("o.i")).alias("_x"), (F.floor(F.col("sy") / size) + F.col("o.j")).alias("_y"))
        pairs = rest.withColumns({"_x": F.floor(F.col("x") / size), "_y": F.floor(F.col("y") / size)}).join(around, ["_x", "_y"])
        pairs = pairs.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)))
        last = size > far  # then every centre stands in the cells around a point
        best = pairs.groupBy(keys).agg(F.min_by(F.struct("name", "d"), F.struct("d", "ord")).alias("b")).select(*keys, "b.name", "b.d")
        best = written(best if last else best.filter(F.col("d") <= size))
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        rest, size = rest.join(best, keys, "left_anti"), size * 8


def resolve_spot(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (id, x, y, ...) with `spot` and `method`: the first polygon that contains the point strictly, else the nearest centroid.

    Polygons (name, ord, ring) stand in the cells that their boxes touch, four at most: cells are as wide as the box
    rounded up to a power of two, so polygons of each size have cells of their own, and a point meets the few of its cell
    in one equi-join for each size there is. Only points outside all of them are measured against the centroids: a
    bounded list is folded in the point's row, a longer one is searched by cells.
    """
    cx, cy = ring_centroid(F.col("ring"))
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    held = polygons.filter(F.size("ring") > 0).select("ord", "name", "ring", cx.alias("sx"), cy.alias("sy"), *[edge(f, c).alias(f"{c}{n}") for c in ("x", "y") for n, f in ((0, F.array_min), (1, F.array_max))])
    width = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    held = held.withColumn("_level", F.ceil(F.log2(width)).cast("int"))
    few = few_rows(held)
    levels = [r[0] for r in held.select("_level").distinct().collect() if r[0] is not None]  # powers of two of widths
    out, near = points, []
    for i, level in enumerate(sorted(levels)):
        w = 2.0**level
        span = lambda a, b, w=w: F.sequence(F.floor(F.col(a) / w), F.floor(F.col(b) / w))
        cells = held.filter(F.col("_level") == level).withColumn("_x", F.explode(span("x0", "x1"))).withColumn("_y", F.explode(span("y0", "y1")))
        cells = cells.groupBy("_x", "_y").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "ring"))).alias(f"_near{i}"))
        out = out.withColumns({"_x": F.floor(F.col("x") / w), "_y": F.floor(F.col("y") / w)}).join(F.broadcast(cells) if few else cells, ["_x", "_y"], "left").drop("_x", "_y")
        # of each size the first that holds the point
        out = out.withColumn(f"_near{i}", F.get(F.filter(f"_near{i}", lambda s: in_ring(F.col("x"), F.col("y"), s["ring"])), F.lit(0)))
        near.append(F.when(F.col(f"_near{i}").isNotNull(), F.struct(F.col(f"_near{i}.ord").alias("ord"), F.col(f"_near{i}.name").alias("name"))))
    first = F.array_min(F.array_compact(F.array(*near)))["name"] if near else F.lit(None).cast("string")
    out = out.withColumn("_in", first).drop(*[f"_near{i}" for i in range(len(near))])
    centres = held.select("ord", "name", "sx", "sy").filter("sx is not null and sy is not null")
    if few:
        row = centres.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "sx", "sy"))).alias("_all"))
        apart = F.array_min(F.transform("_all", lambda s: F.struct((F.pow(F.col("x") - s["sx"], 2) + F.pow(F.col("y") - s["sy"], 2)).alias("d"), s["ord"].alias("ord"), s["name"].alias("name"))))["name"]
        out = out.join(F.broadcast(row)).withColumn("_c", F.when(F.col("_in").isNull(), apart))
    else:
        near = nearest_centre(out.filter("_in is null"), centres, 2.0 ** min(levels)).select("id", "x", "y", F.col("name").alias("_c"))
        out = out.join(near, ["id", "x", "y"], "left")
    method = F.when(F.col("_in").isNotNull(), "point-in-polygon").when(F.col("_c").isNotNull(), "nearest-centroid").otherwise("no-spots")
    return out.select(*points.columns, F.coalesce("_in", "_c", F.lit("unknown")).alias("spot"), method.alias("method"))


def closest_projected_spot(points: DataFrame, coords: DataFrame, h: list[list[float]], limit: float = 10.0) -> DataFrame:
    """points with the nearest spot among pixels projected by a homography, where nearer than the limit (strictly).

    Spots stand in the cells around their own; cells are as wide as the limit, so one equi-join finds all that count.
    Each place is measured once, however many points stand on it, against the lists of its cell, which are cut into parts
    of a bounded length.
    """
    x, y = homography(F.col("px"), F.col("py"), h)
    near_by = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / limit)
    spots = written(coords.select("ord", "name", x.alias("sx"), y.alias("sy")).filter("sx is not null and sy is not null"))
    parts = 1 + spots.count() // LIST_ROWS
    held = spots.withColumns({"o": F.explode(near_by), "_part": F.pmod(F.hash("ord", "name"), F.lit(parts))})
    held = held.select("ord", "name", "sx", "sy", "_part", (cell("sx") + F.col("o.i")).alias("_x"), (cell("sy") + F.col("o.j")).alias("_y"))
    held = held.groupBy("_x", "_y", "_part").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "sx", "sy"))).alias("_near"))
    measured = F.transform("_near", lambda s: F.struct(F.sqrt(F.pow(F.col("x") - s["sx"], 2) + F.pow(F.col("y") - s["sy"], 2)).alias("d"), s["ord"].alias("ord"), s["name"].alias("name")))
    places = points.select("x", "y").distinct().withColumns({"_x": cell("x"), "_y": cell("y")})
    found = places.join(held, ["_x", "_y"]).select("x", "y", F.array_min(measured).alias("_b"))
    best = found.groupBy("x", "y").agg(F.min("_b").alias("_b")).filter(F.col("_b.d") < limit)
    return points.join(best, ["x", "y"]).select(*points.columns, F.col("_b.name").alias("spot"), F.col("_b.d").alias("distance"))
