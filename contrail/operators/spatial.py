"""Spatial joins on a grid of cells, alignment with runways and beacons, and clustering.

A point meets the places in its own and the eight cells around it by an equi-join on the cell, so neither side is
broadcast or crossed; the exact test follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.geo import bearing_deg, destination, haversine_km, haversine_m, smallest_angle_deg
from ..sources.store import written
from .tracks import cut

NM_KM = 1.852


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def near_cells(places: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``places`` once in each of nine cells: (cy, cx) of size ``size`` degrees."""
    around = F.array(*(F.struct((_cell(F.col(lat), size) + i).alias("cy"), (_cell(F.col(lon), size) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return places.select("*", F.explode(around).alias("_c")).select(*places.columns, "_c.cy", "_c.cx")


def nearby(points: DataFrame, places: DataFrame, delta: float, lat: str = "lat", lon: str = "lon", key: list[str] | None = None) -> DataFrame:
    """Pairs within ``delta`` degrees on both axes, with km, and of equal ``key``. ``places``: p_ columns with p_lat and p_lon."""
    size = delta * 1.001  # so that no rounding puts two that are just within it two cells apart
    left = points.withColumns({"cy": _cell(F.col(lat), size), "cx": _cell(F.col(lon), size)})
    met = left.join(near_cells(places, size, "p_lat", "p_lon"), [*(key or []), "cy", "cx"]).drop("cy", "cx")
    box = (F.abs(F.col(lat) - F.col("p_lat")) <= delta) & (F.abs(F.col(lon) - F.col("p_lon")) <= delta)
    return met.where(box).withColumn("km", haversine_km(F.col(lat), F.col(lon), F.col("p_lat"), F.col("p_lon")))


def prefixed(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).alias(f"p_{c}") for c in df.columns))


def alike(places: DataFrame, *name: str) -> tuple[DataFrame, DataFrame]:
    """``places`` of which one stands for all that differ by ``name`` alone, and the names: (p_as and p_ columns, p_as and p_ names).

    What is found of one place is found of all at its coordinates, so that rows grow with distinct places until the names are joined
    at the end. Rows of one name belong together.
    """
    rest = [c for c in places.columns if c not in name]
    shapes = places.groupBy(*name).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("shape"))
    known = shapes.withColumn("as", F.min(F.struct(*name)).over(Window.partitionBy("shape")))
    one = known.where(F.struct(*name).eqNullSafe(F.col("as"))).select("as", F.inline("shape"))
    return prefixed(one), prefixed(known.select("as", *name))


def nearest(points: DataFrame, places: DataFrame, key: list[str], deltas: tuple[float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """For each ``key``: the nearest place in the small box, or in the large box if the small one holds none at all. Ties: least ident.

    Distinct coordinates are compared, and the large box is looked through only around those whose small one is empty.
    """
    rows = written(points.select(*key, F.col(lat).alias("lat"), F.col(lon).alias("lon")).where("lat is not null and lon is not null"), "asked")
    one = prefixed(places.groupBy("lat", "lon").agg(F.min("ident").alias("ident")))
    sites, found = rows.select("lat", "lon").distinct(), []
    for delta in sorted(set(deltas)):
        best = nearby(sites, one, delta).groupBy("lat", "lon").agg(F.min(F.struct(F.lit(delta).alias("far"), "km", F.col("p_ident").alias("ident"))).alias("b"))
        found.append(written(best, "nearest"))
        sites = sites.join(found[-1].select("lat", "lon"), ["lat", "lon"], "left_anti")
    at = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    return rows.join(at, ["lat", "lon"]).groupBy(*key).agg(F.min("b").alias("b")).select(*key, F.col("b.ident").alias("ident"), F.col("b.km").alias("km"))


def airport_match(legs: DataFrame, airports: DataFrame, end: str, c: Config = DEFAULT) -> DataFrame:
    """The airport at one end (takeoff or landing) of each leg: on the field within ``on_field_km``, else near within ``match_km``."""
    found = nearest(legs, airports, ["icao", "session"], (0.15, 0.5), f"{end}_lat", f"{end}_lon").where(F.col("km") <= c.match_km)
    on = F.col("km") <= c.on_field_km
    return found.select("icao", "session", F.when(on, F.col("ident")).alias("airport"), F.when(~on, F.col("ident")).alias("near_airport"), F.round("km", 2).alias("km"))


def probable_destination(landings: DataFrame, anchors: DataFrame, airports: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Where a leg whose end was not seen may have been going: the nearest airport to its anchor, with a confidence.

    landings: landing_type, descent and seen_alt by session; anchors: lat and lon by session. Height, distance and descent count
    0.4, 0.4 and 0.2; an unknown height, or none, counts as 5,000 ft.
    """
    lost = landings.where(F.col("landing_type").isin("signal_lost", "dropped")).join(anchors.select("icao", "session", "lat", "lon"), ["icao", "session"])
    found = nearest(lost, airports, ["icao", "session"], (0.5, 0.5)).where(F.col("km") <= c.probable_km)
    alt = F.coalesce(F.nullif("seen_alt", F.lit(0)), F.lit(5000))
    low, close = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (5000 - alt) / 4500)), F.greatest(F.lit(0.0), 1 - F.col("km") / c.probable_km)
    joined = found.join(landings.select("icao", "session", "seen_alt", "descent"), ["icao", "session"])
    return joined.select("icao", "session", F.col("ident").alias("probable"), F.round("km", 2).alias("km"), F.round(0.4 * low + 0.4 * close + 0.2 * F.col("descent"), 2).alias("confidence"))


def split_on_gaps(kept: DataFrame, key: list[str], gap_s: float, min_s: float, **measures: tuple[Callable[[str], Column], str]) -> DataFrame:
    """Segments of kept points no more than ``gap_s`` apart that span ``min_s`` at least, with least or greatest values of columns.

    Points within half of ``gap_s`` are never parted: they are summed unsorted, before they are dealt by ``key``, and the sums are cut.
    """
    half = F.floor(F.col("ts") / (gap_s / 2)).alias("_half")
    sums = (F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))
    parts = kept.where(F.col("ts").isNotNull()).groupBy(*key, half).agg(*sums, *(f(c).alias(x) for x, (f, c) in measures.items()))
    w = Window.partitionBy(*key).orderBy("_half")
    since = F.col("start_ts") - F.lag("end_ts").over(w)
    cut = parts.withColumn("_seg", F.sum(F.when(since.isNull() | (since > gap_s), 1).otherwise(0)).over(w))
    sums = (F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n"))
    rows = cut.groupBy(*key, "_seg").agg(*sums, *(f(x).alias(x) for x, (f, _) in measures.items()))
    return rows.where(F.col("end_ts") - F.col("start_ts") >= min_s).drop("_seg")


def runway_alignment(points: DataFrame, ends: DataFrame, gap_s: float = 20, min_s: float = 30, offset_m: float = 100, above_ft: float = 5000, delta: float = 0.5, asked: DataFrame | None = None) -> DataFrame:
    """Segments in line with a runway end: low enough, heading towards it, within ``offset_m`` of its centre line.

    The distance and the centre line are those of coordinates: distinct ones are compared, and points then meet the ends that
    lie right. asked (icao, p_ident): the airports at which an aircraft's segments are wanted, if not all.
    """
    tracked = points.where(F.col("track_deg").isNotNull())
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    offset = F.col("km") * 1000 * F.radians(smallest_angle_deg(F.col("bearing"), F.col("p_heading")))
    in_line = lambda pairs: pairs.withColumn("bearing", bearing).withColumn("offset_m", offset).where(F.col("offset_m") < offset_m)
    ends = ends.select("ident", "runway", "lat", "lon", "elevation_ft", "heading")
    if asked is None:
        one, names = alike(ends, "ident", "runway")
        sites = in_line(nearby(tracked.select("lat", "lon").distinct(), one, delta))
        pairs, key = tracked.join(sites, ["lat", "lon"]), ["icao", "p_as"]
    else:
        places = asked.select("icao", "p_ident").distinct().join(prefixed(ends), "p_ident")
        pairs, key = in_line(nearby(tracked, places, delta, key=["icao"])), ["icao", "p_ident", "p_runway"]
    ahead = F.cos(F.radians(F.col("bearing") - F.col("track_deg"))) > 0
    alt = F.coalesce(F.col("baro_ft"), F.lit(0))
    kept = pairs.where((alt <= F.col("p_elevation_ft") + above_ft) & ahead)
    segments = split_on_gaps(kept, key, gap_s, min_s, offset_m=(F.min, "offset_m"), km=(F.min, "km"))
    named = segments.join(names, "p_as") if asked is None else segments
    return named.select("icao", "p_ident", "p_runway", "start_ts", "end_ts", "n", F.round("offset_m", 1).alias("offset_m"), F.round("km", 1).alias("km"))


def navaid_alignment(points: DataFrame, navaids: DataFrame, tolerance_deg: float = 1, gap_s: float = 120, min_s: float = 30, max_nm: float = 500, pass_nm: float = 80) -> DataFrame:
    """Segments flown towards a beacon within ``tolerance_deg``, keyed by its ident, that pass it within ``pass_nm``.

    A segment lies within a stretch of points at most ``gap_s`` apart, and so a point meets only the beacons that its own stretch
    passes within ``pass_nm``, which are found on a grid first: rows are points times beacons along their stretch, whatever
    else the aircraft flew. Beacons at one place are one until the end, and a square's are looked up once for all that crossed it.
    """
    asked = cut(points.where("track_deg is not null").select("icao", "ts", "seq", "lat", "lon", "track_deg"), gap_s, "stretch")
    beacons, names = alike(navaids.select("ident", "lat", "lon").distinct(), "ident")
    # middles of half-degree squares stand for all points in them, at most 22 nm away
    squares = asked.select("icao", "stretch", *((F.floor(F.col(x) * 2) / 2 + 0.25).alias(x) for x in ("lat", "lon"))).distinct()
    around = _within_nm(squares.select("lat", "lon").distinct(), beacons, pass_nm + 22).select("lat", "lon", "p_as", "p_lat", "p_lon")
    passed = squares.join(around, ["lat", "lon"]).select("icao", "stretch", "p_as", "p_lat", "p_lon").distinct()
    # sines and cosines once a point and once a beacon; a pair then takes a few products to see that it is not headed for
    turn = lambda c: (F.sin(F.radians(c)), F.cos(F.radians(c)))
    (sa, ca), (so, co), (st, ct) = (turn(F.col(c)) for c in ("lat", "lon", "track_deg"))
    left = asked.withColumns({"sa": sa, "ca": ca, "so": so, "co": co, "st": st, "ct": ct})
    (sb, cb), (sp, cp) = (turn(F.col(c)) for c in ("p_lat", "p_lon"))
    right = passed.withColumns({"sb": sb, "cb": cb, "sp": sp, "cp": cp})
    c = F.col
    east = (c("sp") * c("co") - c("cp") * c("so")) * c("cb")
    north = c("ca") * c("sb") - c("sa") * c("cb") * (c("cp") * c("co") + c("sp") * c("so"))
    ahead = east * c("st") + north * c("ct") >= math.cos(math.radians(min(180.0, tolerance_deg + 0.01))) * F.sqrt(east * east + north * north) - 1e-12
    pairs = left.join(right.repartition("icao", "stretch"), (left["icao"] == right["icao"]) & (left["stretch"] == right["stretch"]) & ahead).select(left["icao"], "ts", "seq", "lat", "lon", "track_deg", "p_as", "p_lat", "p_lon")
    nm = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) / NM_KM
    bearing = bearing_deg(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    kept = pairs.where(smallest_angle_deg(bearing, F.col("track_deg")) < tolerance_deg).withColumn("nm", nm).where(F.col("nm") <= max_nm)
    segments = split_on_gaps(kept, ["icao", "p_as"], gap_s, min_s, nm=(F.min, "nm")).withColumn("nm", F.round("nm", 2)).where(F.col("nm") < pass_nm)
    return segments.join(names, "p_as").select("icao", "p_ident", "start_ts", "end_ts", "n", "nm")


def _within_nm(points: DataFrame, places: DataFrame, nm: float) -> DataFrame:
    """Pairs within ``nm`` nautical miles, on a grid as high as that and, at its latitude, as wide."""
    step = nm / 60 * 1.01
    row = lambda lat: F.floor(lat / step).cast("long")
    # a row of cells is as wide as its end that is farther from the equator needs
    wide = lambda cy: step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.4), F.greatest(F.abs(cy), F.abs(cy + 1)) * step))))
    left = points.withColumn("cy", row(F.col("lat"))).withColumn("cx", F.floor(F.col("lon") / wide(F.col("cy"))).cast("long"))
    rows = places.select("*", F.explode(F.array(*(row(F.col("p_lat")) + i for i in (-1, 0, 1)))).alias("cy"))
    right = rows.select("*", F.explode(F.array(*((F.floor(F.col("p_lon") / wide(F.col("cy"))) + i).cast("long") for i in (-1, 0, 1)))).alias("cx"))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= nm * NM_KM
    return left.join(right, ["cy", "cx"]).where(near)


def takeoff_runway(points: DataFrame, ends: DataFrame, gap_s: float = 20, min_gs: float = 80, zone_m: float = 6000, near_half_m: float = 25, opening_deg: float = 5, above_ft: float = 2000) -> DataFrame:
    """Per aircraft and airport: the runway whose departure wedge holds the longest run of climbing points; the first name on ties.

    The wedge is a trapezoid from the threshold outwards; a point is in it by its distances along and across the
    runway's heading. Distinct coordinates are looked up, and airports that differ by name alone are one until the end.
    """
    one, names = alike(ends.select("ident", "runway", "lat", "lon", "elevation_ft", "heading"), "ident")
    pairs = nearby(points.select("lat", "lon").distinct(), one, 0.1)
    bearing = bearing_deg(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    turn = F.radians(bearing - F.col("p_heading"))
    along, across = F.col("km") * 1000 * F.cos(turn), F.abs(F.col("km") * 1000 * F.sin(turn))
    climbing = (F.coalesce(F.col("rate_fpm"), F.lit(0)) > 256) | (F.col("gs_kt") > min_gs)
    inside = along.between(0, zone_m) & (across <= near_half_m + along * math.tan(math.radians(opening_deg)))
    rising = points.where(climbing & F.col("track_deg").isNotNull()).join(pairs.where(inside), ["lat", "lon"])
    kept = rising.where(F.coalesce(F.col("baro_ft"), F.lit(0)) <= F.col("p_elevation_ft") + above_ft)
    runs = split_on_gaps(kept, ["icao", "p_as", "p_runway"], gap_s, 0, gs=(F.max, "gs_kt")).where(F.col("gs") >= min_gs)
    longest = F.struct((F.col("start_ts") - F.col("end_ts")).alias("d"), F.col("p_runway").alias("runway"))
    best = runs.groupBy("icao", "p_as").agg(F.min(longest).alias("b")).join(names, "p_as")
    return best.select("icao", "p_ident", F.col("b.runway").alias("runway"), (-F.col("b.d")).alias("run_s"))


def wedge(ends: DataFrame, zone_m: float = 6000, near_half_m: float = 25, opening_deg: float = 5) -> DataFrame:
    """The four corners of each departure wedge."""
    far = near_half_m + zone_m * math.tan(math.radians(opening_deg))
    out = {}
    lat, lon, h = F.col("lat"), F.col("lon"), F.col("heading")
    end = destination(lat, lon, h, F.lit(zone_m))
    for name, (y, x), side, half in (("near_left", (lat, lon), -90, near_half_m), ("near_right", (lat, lon), 90, near_half_m), ("far_right", end, 90, far), ("far_left", end, -90, far)):
        a, b = destination(y, x, h + side, F.lit(half))
        out[name] = F.struct(a.alias("lat"), b.alias("lon"))
    return ends.withColumns(out)


def closest_approach(points: DataFrame, lat: float, lon: float) -> DataFrame:
    """Per aircraft: its nearest point to a place, the first on ties."""
    d = haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    best = points.withColumn("_m", d).groupBy("icao").agg(F.min(F.struct(F.col("_m").alias("m"), "ts", "seq", "baro_ft")).alias("b"))
    return best.select("icao", F.round("b.m", 1).alias("metres"), "b.ts", "b.baro_ft")


DEGREE_KM = 111.19  # a little less than a degree of a great circle
PAIRS = 4096  # pairs of points that two cells may have to be compared one by one


def _row_width(cy: Column, step: float) -> Column:
    """Degrees of longitude of a row's cells: as wide as its end nearer to the equator allows; near the poles they stop growing."""
    near = F.least(F.abs(cy), F.abs(cy + 1)) * step
    return step / F.greatest(F.lit(0.02), F.cos(F.radians(F.least(near, F.lit(90.0)))))


def _reach(boxes: DataFrame, eps_km: float, step: float) -> DataFrame:
    """``boxes`` (lat0, lat1, lon0, lon1) once in every cell that may hold a point within ``eps_km``: (cy, cx)."""
    up = eps_km / DEGREE_KM
    high = F.least(F.lit(89.9), F.greatest(F.abs("lat0"), F.abs("lat1")) + up)
    side = up / F.greatest(F.lit(0.0017), F.cos(F.radians(high))) * 1.001
    rows = F.sequence(F.floor((F.col("lat0") - up) / step), F.floor((F.col("lat1") + up) / step))
    wide = boxes.withColumns({"_side": side, "cy": F.explode(rows)}).withColumn("_w", _row_width(F.col("cy"), step))
    columns = F.sequence(F.floor((F.col("lon0") - F.col("_side")) / F.col("_w")), F.floor((F.col("lon1") + F.col("_side")) / F.col("_w")))
    return wide.withColumn("cx", F.explode(columns)).drop("_side", "_w")


def _box_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Kilometres that points of two boxes are apart: at least, at most."""
    x = lambda side, name: F.col(f"{side}_{name}")
    gap = lambda u, v: F.greatest(F.lit(0.0), x(a, u) - x(b, v), x(b, u) - x(a, v))
    most = lambda u, v: F.greatest(F.abs(x(a, v) - x(b, u)), F.abs(x(b, v) - x(a, u)))
    far = F.greatest(*(F.abs(x(s, n)) for s in (a, b) for n in ("lat0", "lat1")))
    flat = F.when((x(a, "lat0") < 0) & (x(a, "lat1") > 0), 0.0).otherwise(F.least(*(F.abs(x(s, n)) for s in (a, b) for n in ("lat0", "lat1"))))
    low = F.greatest(gap("lat0", "lat1"), gap("lon0", "lon1") * F.cos(F.radians(far))) * DEGREE_KM * 0.999
    up = F.hypot(most("lat0", "lat1"), most("lon0", "lon1") * F.cos(F.radians(flat))) * 111.2 * 1.001
    return low, up


def _boxes(nodes: DataFrame, *key: str) -> DataFrame:
    sides = (F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    return nodes.groupBy(*key).agg(F.count("*").alias("places"), *sides)


def _linked_cells(nodes: DataFrame, eps_km: float, step: float) -> DataFrame:
    """(u, v) of dense cells of which two points are within ``eps_km``. nodes: cell, node, lat, lon.

    Cells are compared by the boxes of their points: some are surely near, some surely not. The rest are cut in four, and their
    quarters are compared, until the points of two boxes are so few that they are compared themselves.
    """
    cells = _boxes(nodes, "cell")
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))
    home = cells.select(F.col("cell").alias("v"), F.col("cell.cy").alias("cy"), F.col("cell.cx").alias("cx"))
    pairs = _reach(cells, eps_km, step).join(home, ["cy", "cx"]).where(F.col("cell") < F.col("v")).select(F.col("cell").alias("u"), "v").distinct()
    parts, found, level = nodes.withColumn("part", F.lit(0).cast("long")), [], 0
    todo = pairs.select("u", "v", F.lit(0).cast("long").alias("a_part"), F.lit(0).cast("long").alias("b_part"))
    while True:
        boxes = _boxes(parts, "cell", "part")
        a, b = side(boxes, "a").withColumnRenamed("a_cell", "u"), side(boxes, "b").withColumnRenamed("b_cell", "v")
        low, up = _box_bounds("a", "b")
        met = checkpointed(todo.join(a, ["u", "a_part"]).join(b, ["v", "b_part"]).where(low <= eps_km).withColumn("near", up <= eps_km))
        near = met.where("near").select("u", "v").distinct()
        found.append(near)
        rest = met.where("not near").join(near, ["u", "v"], "left_anti")
        few = F.col("a_places") * F.col("b_places") <= PAIRS
        points = lambda s, cell: parts.select(F.col("cell").alias(cell), F.col("part").alias(f"{s}_part"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
        each = rest.where(few).select("u", "v", "a_part", "b_part").join(points("a", "u"), ["u", "a_part"]).join(points("b", "v"), ["v", "b_part"])
        within = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= eps_km
        found.append(each.where(within).select("u", "v").distinct())
        todo = checkpointed(rest.where(~few).select("u", "v", "a_part", "b_part"))
        level += 1
        if not todo.take(1) or level > 40:
            break
        quarter = (F.floor(F.col("lat") / step * (1 << level)) % 2).cast("long") * 2 + (F.floor(F.col("lon") / step * (1 << level)) % 2).cast("long")
        parts = parts.withColumn("part", F.col("part") * 4 + F.pmod(quarter, F.lit(4)))
        todo = todo.select("u", "v", F.explode(F.sequence(F.col("a_part") * 4, F.col("a_part") * 4 + 3)).alias("a_part"), "b_part")
        todo = todo.select("u", "v", "a_part", F.explode(F.sequence(F.col("b_part") * 4, F.col("b_part") * 4 + 3)).alias("b_part"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def dbscan(points: DataFrame, eps_km: float = DEFAULT.helipad_eps_km, min_points: int = DEFAULT.helipad_min_points) -> DataFrame:
    """Clusters of (id, lat, lon): rows (id, cluster), cluster the least id of its core points; noise is left out.

    Any two points of a cell of side eps / sqrt 2 are near, so that a cell of ``min_points`` points is core as a whole and
    one node of the graph, whatever it holds: no pairs are made in it, and two such cells are linked by one near pair. Only
    points of thinner cells, fewer than ``min_points`` each, are compared with the points around them, so that rows grow as the points do. A border
    point goes to its least neighbouring cluster. Clusters do not go around the antimeridian.
    """
    # points of one place are one node with their count
    step = eps_km / math.sqrt(2) / 111.2 * 0.998
    places = points.groupBy("lat", "lon").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    cy = F.floor(F.col("lat") / step)
    celled = places.withColumn("cell", F.struct(cy.alias("cy"), F.floor(F.col("lon") / _row_width(cy, step)).alias("cx")))
    counts = celled.groupBy("cell").agg(F.sum("n").alias("all"), F.min("node").alias("least"))
    nodes = checkpointed(celled.join(counts, "cell").withColumn("dense", F.col("all") >= min_points).select("node", "lat", "lon", "n", "cell", "dense", F.when(F.col("dense"), F.col("least")).alias("hub")))
    thin = nodes.where("not dense")
    asked = thin.select(F.col("node").alias("u"), F.col("lat").alias("ulat"), F.col("lon").alias("ulon"), *(F.col(c).alias(f"{c}{i}") for c in ("lat", "lon") for i in (0, 1)))
    home = nodes.select(F.col("node").alias("v"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"), F.col("n").alias("vn"), "hub", F.col("cell.cy").alias("cy"), F.col("cell.cx").alias("cx"))
    within = haversine_km(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")) <= eps_km
    met = _reach(asked, eps_km, step).join(home, ["cy", "cx"]).where(within)
    # a dense cell's points are summed: its hub stands for them
    near = checkpointed(met.groupBy("u", F.coalesce("hub", "v").alias("v"), F.col("hub").isNotNull().alias("dense")).agg(F.sum("vn").alias("vn")))
    core = near.groupBy("u").agg(F.sum("vn").alias("n")).where(F.col("n") >= min_points).select("u")
    sure = near.join(core, "u")
    thick = sure.where("dense").select("u", "v").unionByName(sure.where("not dense").join(core.select(F.col("u").alias("v")), "v").select("u", "v"))
    hubs = nodes.where("dense").select("cell", "hub").distinct()
    cells = _linked_cells(nodes.where("dense").select("cell", "node", "lat", "lon"), eps_km, step)
    across = cells.join(hubs.select(F.col("cell").alias("u"), F.col("hub").alias("a")), "u").join(hubs.select(F.col("cell").alias("v"), F.col("hub").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    one_way = thick.unionByName(across)
    own = core.unionByName(hubs.select(F.col("hub").alias("u"))).select("u", F.col("u").alias("v"))
    links = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(own).distinct()
    label = least_reachable(links)
    border = near.join(label.select(F.col("u").alias("v"), "cluster"), "v").groupBy("u").agg(F.min("cluster").alias("b"))
    of = nodes.select("lat", "lon", F.coalesce("hub", "node").alias("u")).join(label, "u", "left").join(border, "u", "left")
    return points.join(of.select("lat", "lon", F.coalesce("cluster", "b").alias("cluster")), ["lat", "lon"]).where("cluster is not null").select("id", "cluster")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a table in the shared folder, which cuts its lineage durably."""
    return written(df, "spatial")


def backfilled(flights: DataFrame, pads: DataFrame, key: list[str], eps_km: float = DEFAULT.helipad_eps_km) -> DataFrame:
    """``flights`` with origin_pad and destination_pad: the nearest of ``pads`` (pad, lat, lon) within ``eps_km`` of where each took
    off and landed; of pads as near as each other the last. A flight that was not seen to land has no destination."""
    places = pads.select(F.col("pad").alias("p_pad"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    for end, name in (("takeoff", "origin_pad"), ("landing", "destination_pad")):
        at = flights.select(*key, F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lon").alias("lon")).where("lat is not null and lon is not null")
        km = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
        best = _within_nm(at, places, eps_km / NM_KM).groupBy(*key).agg(F.min(F.struct(km.alias("km"), (-F.col("p_pad")).alias("last"))).alias("b"))
        flights = flights.join(best.select(*key, (-F.col("b.last")).alias(name)), key, "left")
    return flights


def least_reachable(links: DataFrame) -> DataFrame:
    """(u, cluster): the least node reachable over symmetric ``links`` that hold (u, u); by minima over neighbours and jumps."""
    links = checkpointed(links)
    label = links.groupBy("u").agg(F.min("v").alias("cluster"))
    before = None
    while True:
        label = checkpointed(label)
        now = label.agg(F.bit_xor(F.xxhash64("u", "cluster"))).first()[0]
        if now == before:
            return label
        before = now
        spread = links.join(label.select(F.col("u").alias("v"), "cluster"), "v").groupBy("u").agg(F.min("cluster").alias("cluster"))
        jump = label.select(F.col("u").alias("cluster"), F.col("cluster").alias("root"))
        label = spread.join(jump, "cluster", "left").select("u", F.least("cluster", F.coalesce("root", "cluster")).alias("cluster"))


def helipads(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Centre, count and time span of each cluster."""
    rows = points.join(labels, "id").groupBy("cluster")
    return rows.agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("landings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
