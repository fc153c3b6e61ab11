"""Ordered operators over an aircraft's points: sessions, gaps, runs and rolling measures.

All windows are partitioned by aircraft, and by session or fragment once those are known, so that a long history
spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.geo import haversine_km
from .points import classified

ORDER = ["ts", "seq"]
CHUNK_S = 86400  # seconds of an aircraft's points that one task takes in order


def over(*key: str, order: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*(order or ORDER))


def numbered(points: DataFrame, starts: Column, name: str, *key: str) -> DataFrame:
    """Adds a number that grows where ``starts`` holds."""
    return points.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(over(*key)))


def cut(points: DataFrame, gap_s: float, name: str, spread: bool = True) -> DataFrame:
    """Adds ``name``, a number within each aircraft that grows after more than ``gap_s`` without a point.

    A segmented scan: chunks of an aircraft's days are numbered by themselves, and a window over one row a chunk carries the last
    time and the count so far from chunk to chunk, so that an aircraft with a third of all points is many tasks' work. Without
    ``spread`` it is one window by aircraft, which a table that is dealt by aircraft plans without an exchange.
    """
    if not spread:
        since = F.col("ts") - F.lag("ts").over(over("icao"))
        return numbered(points, since.isNull() | (since > gap_s), name, "icao")
    key = ["icao", "_chunk"]
    w = over(*key)
    rows = points.withColumn("_chunk", F.coalesce(F.floor(F.col("ts") / CHUNK_S), F.lit(-1)))
    starts = F.when(F.col("ts") - F.lag("ts").over(w) > gap_s, 1).otherwise(0)
    marked = rows.withColumn("_starts", starts).withColumn("_inner", F.sum("_starts").over(w))
    parts = marked.groupBy(*key).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max("_inner").alias("_all"))
    v = Window.partitionBy("icao").orderBy("_chunk")
    quiet = F.col("_first") - F.lag("_last").over(v)
    opened = parts.withColumn("_opens", F.when(quiet.isNull() | (quiet > gap_s), 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_opens") + F.col("_all")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_opens")
    carried = opened.select(*key, before.alias("_before"))
    return marked.join(carried, key).withColumn(name, F.col("_before") + F.col("_inner")).select(*points.columns, name)


def sessions(points: DataFrame, c: Config = DEFAULT, spread: bool = True) -> DataFrame:
    """``session`` within each aircraft: a new one after more than ``session_gap_min``. Points that have one, as those of flights do, keep it."""
    if "session" in points.columns:
        return points
    return cut(points, c.session_gap_min * 60, "session", spread)


def legs(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row a session: ends, duration, heights, speeds, path and registration facts."""
    w = over("icao", "session")
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    away = haversine_km(F.first("lat").over(w), F.first("lon").over(w), F.col("lat"), F.col("lon"))
    moved = sessions(points, c).withColumns({"step_km": step, "away_km": away})
    at = F.struct("ts", "seq")
    return moved.groupBy("icao", "session").agg(
        F.min("ts").alias("takeoff_ts"),
        F.max("ts").alias("landing_ts"),
        F.count("*").alias("n_points"),
        F.min_by("lat", at).alias("takeoff_lat"),
        F.min_by("lon", at).alias("takeoff_lon"),
        F.max_by("lat", at).alias("landing_lat"),
        F.max_by("lon", at).alias("landing_lon"),
        F.max("baro_ft").alias("max_alt_ft"),
        F.max("gs_kt").alias("max_gs_kt"),
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("path_km"),
        F.max("away_km").alias("max_km"),
        F.array_join(F.array_sort(F.collect_set("callsign")), ",").alias("callsigns"),
        F.max(F.when(F.col("squawk").isin("7500", "7600", "7700"), F.col("squawk"))).alias("emergency_squawk"),
    )


def path_metrics(legs: DataFrame) -> DataFrame:
    loiter = F.when(F.col("max_km") > 0, F.round(F.col("path_km") / (2 * F.col("max_km")), 3))
    efficiency = F.when(F.col("path_km") > 1, F.round(F.least(F.lit(1.0), F.col("max_km") / F.col("path_km")), 3))
    return legs.select("icao", "session", F.round("path_km", 3).alias("path_km"), F.round("max_km", 3).alias("max_km"), loiter.alias("loiter"), efficiency.alias("efficiency"))


def gaps(points: DataFrame, c: Config = DEFAULT, spread: bool = True) -> DataFrame:
    """Signal gaps of ``gap_min_s`` to ``gap_max_s`` between consecutive distinct points, with the source mix on both sides."""
    k, key = c.gap_context, ["icao", "_chunk"]
    place = F.struct("ts", F.round("lat", 5), F.round("lon", 5))
    adsb = F.coalesce(F.col("src").startswith("adsb").cast("int"), F.lit(0))
    seen = F.struct("ts", "lat", "lon", F.when(~F.col("surface"), F.col("baro_ft")).alias("alt_ft"), adsb.alias("adsb"))
    rows = points.select("icao", "ts", "seq", place.alias("_place"), seen.alias("_seen"), (F.coalesce(F.floor(F.col("ts") / CHUNK_S), F.lit(-1)) if spread else F.lit(0)).alias("_chunk"))
    w = over(*key) if spread else over("icao")
    # repeated points have one time, and so lie in one chunk
    distinct = rows.withColumn("_same", F.col("_place").eqNullSafe(F.lag("_place").over(w))).where("not _same").drop("_same", "_place")
    near = lambda frame: F.struct(F.sum("_seen.adsb").over(frame).alias("adsb"), F.count("*").over(frame).alias("n"))
    framed = distinct.withColumns({"_last": F.lag("_seen").over(w), "_pre": near(w.rowsBetween(-k, -1)), "_post": near(w.rowsBetween(0, k - 1))})
    asked = lambda: (F.col("ts") - F.col("_last.ts")).between(c.gap_min_s, c.gap_max_s)
    if spread:
        framed = _with_neighbours(distinct, framed.where(asked() | F.col("_last").isNull()), k, key, w)
    share = lambda x: F.col(f"{x}.adsb") / F.col(f"{x}.n")
    gap = (F.col("ts") - F.col("_last.ts")).alias("gap_s")
    return framed.where(asked()).select("icao", F.col("_last.ts").alias("start_ts"), F.col("ts").alias("end_ts"), gap, "_last.lat", "_last.lon", "_last.alt_ft", share("_pre").alias("pre_adsb"), share("_post").alias("post_adsb"))


def _with_neighbours(distinct: DataFrame, framed: DataFrame, k: int, key: list[str], w: WindowSpec) -> DataFrame:
    """``framed`` with what lies beyond a chunk's ends: its frames of ``k`` rows and its first row's last one take up rows of other chunks.

    A chunk gives its first and last ``k`` rows; as each has a row at least, ``k`` chunks on either side are enough.
    """
    back, v = over(*key, order=[F.desc("ts"), F.desc("seq")]), Window.partitionBy("icao").orderBy("_chunk")
    numbered_ = distinct.select(*key, "ts", "seq", "_seen", F.row_number().over(w).alias("_i"), F.row_number().over(back).alias("_j"))
    some = lambda at: F.array_sort(F.collect_list(F.when(F.col(at) <= k, F.struct("ts", "seq", "_seen"))))
    ends = numbered_.where((F.col("_i") <= k) | (F.col("_j") <= k)).groupBy(*key).agg(some("_i").alias("_head"), some("_j").alias("_tail"))
    flat = lambda x, low, high: F.flatten(F.collect_list(x).over(v.rowsBetween(low, high)))["_seen"]
    sides = ends.select(*key, flat("_tail", -k, -1).alias("_before"), flat("_head", 1, k).alias("_after"))
    both = framed.join(sides, key)
    lacking, none = (lambda x: k - F.col(f"{x}.n")), F.array().cast("array<int>")
    size = F.size("_before")
    before = F.when((lacking("_pre") > 0) & (size > 0), F.slice(F.col("_before")["adsb"], F.greatest(F.lit(1), size - lacking("_pre") + 1).cast("int"), lacking("_pre").cast("int"))).otherwise(none)
    after = F.when(lacking("_post") > 0, F.slice(F.col("_after")["adsb"], 1, lacking("_post").cast("int"))).otherwise(none)
    more = lambda x, far: F.struct((F.coalesce(F.col(f"{x}.adsb"), F.lit(0)) + F.aggregate(far, F.lit(0), lambda s, y: s + y)).alias("adsb"), (F.col(f"{x}.n") + F.size(far)).alias("n"))
    last = F.coalesce("_last", F.try_element_at("_before", F.lit(-1)))
    return both.withColumns({"_last": last, "_pre": more("_pre", before), "_post": more("_post", after)})


def classify_gaps(gaps: DataFrame) -> DataFrame:
    """Adds gap_class. Columns: alt_ft, nearest_nm, pre_adsb, post_adsb."""
    alt, nm, pre, post = F.col("alt_ft"), F.col("nearest_nm"), F.col("pre_adsb"), F.col("post_adsb")
    kind = (
        F.when(alt.isNull(), "unknown")
        .when((alt < 3000) | nm.isNull() | (nm > 300) | ((pre < 0.3) & (post < 0.3)), "coverage_hole")
        .when((alt >= 15000) & (pre >= 0.7) & (post >= 0.7) & (nm <= 200), "likely_transponder_off")
        .otherwise("unknown")
    )
    return gaps.withColumn("gap_class", kind)


def fragments(points: DataFrame, c: Config = DEFAULT, spread: bool = True) -> DataFrame:
    """Per (aircraft, fragment): extent, heights with ground as zero, speeds, integrity counts and source counts."""
    cut_ = cut(points, c.fragment_gap_s, "fragment", spread)
    at = F.struct("ts", "seq")
    v2 = F.col("version") == 2
    return cut_.groupBy("icao", "fragment").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.min_by("lat", at).alias("first_lat"),
        F.max_by("lat", at).alias("last_lat"),
        F.min(F.when(F.col("surface"), 0).otherwise(F.col("baro_ft"))).alias("alt_min"),
        F.max(F.when(~F.col("surface"), F.col("baro_ft"))).alias("alt_max"),
        F.min("gs_kt").alias("gs_min"),
        F.max("gs_kt").alias("gs_max"),
        F.count_if(v2).alias("v2"),
        F.count_if(v2 & (F.col("sil") == 0)).alias("v2_sil0"),
        F.count_if(v2 & (F.col("nic") == 0)).alias("v2_nic0"),
        F.array_join(F.array_sort(F.collect_set("squawk")), ",").alias("squawks"),
        F.count_if(F.col("src") == "mlat").alias("mlat"),
    )


def changes(points: DataFrame, column: str, *key: str) -> DataFrame:
    """Rows where ``column`` differs from its last known value, with the seconds it was then held."""
    w = over(*key)
    known = points.where(F.col(column).isNotNull())
    turned = known.withColumn("_old", F.lag(column).over(w)).where(F.col("_old").isNull() | (F.col("_old") != F.col(column)))
    end = known.groupBy(*key).agg(F.max("ts").alias("_end"))
    held = F.coalesce(F.lead("ts").over(w), F.col("_end")) - F.col("ts")
    return turned.join(end, list(key)).select(*key, "ts", F.col(column).alias("value"), held.alias("held_s"))


def squawk_summary(points: DataFrame) -> DataFrame:
    """Per aircraft and session: codes, the one held longest (least code on ties), and whether visual rules held 80 %."""
    runs = changes(sessions(points), "squawk", "icao", "session")
    by_code = runs.groupBy("icao", "session", "value").agg(F.sum("held_s").alias("s"), F.count("*").alias("runs"))
    ranked = by_code.groupBy("icao", "session").agg(
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("squawks"),
        F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "value")))[0]["value"].alias("primary_squawk"),
        F.sum("s").alias("total_s"),
        F.sum(F.when(F.col("value") == "1200", F.col("s")).otherwise(0)).alias("vfr_s"),
        (F.sum("runs") - 1).alias("changes"),
    )
    return ranked.withColumn("vfr", (F.col("total_s") > 0) & (F.col("vfr_s") >= 0.8 * F.col("total_s")))


def persisted_maxima(points: DataFrame, c: Config = DEFAULT, window_s: float | None = None) -> DataFrame:
    """Per session: the greatest height and speed kept up by ``persist_points`` samples within the window; else the raw ones.

    Only airborne heights that the selected altitude agrees with, within ``agree_ft``, can be kept up.
    """
    s = window_s or c.persist_s
    w = Window.partitionBy("icao", "session").orderBy("ts").rangeBetween(-int(s), 0)
    held = lambda x: F.when(F.count(x).over(w) >= c.persist_points, F.min(x).over(w))
    rows = classified(sessions(points, c), c)
    alt = F.when(F.col("state") == "airborne", F.coalesce("baro_ft", "geom_ft"))
    rows = rows.withColumns({"_raw": alt, "_sure": F.when(F.abs(alt - F.col("mcp_ft")) <= c.agree_ft, alt)})
    kept = rows.withColumns({"_alt": held("_sure"), "_gs": held("gs_kt")})
    return kept.groupBy("icao", "session").agg(F.coalesce(F.max("_alt"), F.max("_raw")).alias("alt_ft"), F.coalesce(F.max("_gs"), F.max("gs_kt")).alias("gs_kt"))


def phase_seconds(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Per session: seconds climbing, descending and level, and gaps, by the vertical rate of airborne points."""
    dt = F.col("ts") - F.lag("ts").over(over("icao", "session"))
    rows = classified(sessions(points, c), c).withColumn("dt", dt).where((F.col("state") == "airborne") & (F.col("dt") > 0))
    near, rate = F.col("dt") <= c.phase_gap_s, F.coalesce("rate_fpm", F.lit(0.0))
    total = lambda cond, x=F.col("dt"): F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    capped = F.when(near, F.col("dt")).otherwise(F.least("dt", F.lit(int(c.phase_gap_cap_s))))
    return rows.groupBy("icao", "session").agg(
        total(near & (rate > c.phase_rate_fpm)).alias("climb_s"),
        total(near & (rate < -c.phase_rate_fpm)).alias("descent_s"),
        total(~near | (F.abs(rate) <= c.phase_rate_fpm), capped).alias("level_s"),
        F.count_if(~near).alias("gaps"),
    )


def islands(points: DataFrame, holds: Column, *key: str) -> DataFrame:
    """Runs of consecutive points where ``holds``: start, end and count."""
    w = over(*key)
    flagged = points.withColumn("_in", F.coalesce(holds, F.lit(False)))
    marked = flagged.withColumn("_run", F.sum(F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    return marked.where("_in").groupBy(*key, "_run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")).drop("_run")


def hovers(points: DataFrame, c: Config = DEFAULT, min_s: float | None = None) -> DataFrame:
    slow = (F.col("gs_kt") < c.hover_gs_kt) & (F.abs("rate_fpm") < c.hover_rate_fpm)
    return islands(points, slow, "icao").where(F.col("end_ts") - F.col("start_ts") >= (c.hover_min_s if min_s is None else min_s))


def last_known(rows: DataFrame, column: str, name: str, key: str = "icao", ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the last value of ``column`` that is not null, of this row and those before it by ``ts`` and ``order``.

    Chunks of a key's days run by themselves; where a chunk has no value yet, the last one of the chunks before stands, which a
    window over one row a chunk carries on.
    """
    order = order or ["seq"]
    parts, at = [key, "_chunk"], F.struct(ts, *order)
    chunked = rows.withColumn("_chunk", F.coalesce(F.floor(F.col(ts) / CHUNK_S), F.lit(-1)))
    here = F.last(column, ignorenulls=True).over(Window.partitionBy(*parts).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0))
    ends = chunked.where(F.col(column).isNotNull()).groupBy(*parts).agg(F.max_by(column, at).alias("_end"))
    all_ = chunked.select(*parts).distinct().join(ends, parts, "left")
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_.select(*parts, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return chunked.withColumn("_here", here).join(carried, parts).withColumn(name, F.coalesce("_here", "_carried")).drop("_chunk", "_here", "_carried")


def carried_callsign(points: DataFrame) -> DataFrame:
    """Each point with the last callsign its aircraft has said."""
    return last_known(points.select("icao", "ts", "seq", "callsign"), "callsign", "_said").select("icao", "ts", "seq", F.col("_said").alias("callsign"))


def turnarounds(legs: DataFrame, max_min: float = 4320) -> DataFrame:
    """Minutes on the ground before each leg, their category, and first and last flags."""
    w = Window.partitionBy("icao").orderBy("takeoff_ts", "session")
    minutes = (F.col("takeoff_ts") - F.lag("landing_ts").over(w)) / 60
    timed = legs.select(
        "icao", "session", "takeoff_ts",
        F.when((minutes >= 0) & (minutes <= max_min), F.round(minutes, 1)).alias("turn_min"),
        (F.row_number().over(w) == 1).alias("first"),
        F.lead("session").over(w).isNull().alias("last"),
    )
    m = F.col("turn_min")
    kind = F.when(F.col("first"), "first_observed").when(m.isNull(), "extended_gap").when(m < 30, "quick").when(m < 240, "medium").when(m < 1080, "overnight").otherwise("multi_day")
    return timed.withColumn("category", kind)


def category_mode(points: DataFrame) -> DataFrame:
    """The most frequent emitter category of each aircraft; the least one on ties."""
    counts = points.where("category is not null").groupBy("icao", "category").count()
    return counts.groupBy("icao").agg(F.min_by("category", F.struct(-F.col("count"), "category")).alias("category"))


def safe_boundary(days: DataFrame, since: str, c: Config = DEFAULT, types: DataFrame | None = None) -> DataFrame:
    """Per aircraft with a day from ``since`` on: the last day, up to the first of those, that no earlier day can reach across.

    A gap of days is safe if it resets the state and is too long for a stitch of that type (types: icao, type_code).
    """
    from .scoring import endurance

    typed = days.join(types.select("icao", "type_code"), "icao", "left") if types is not None else days.withColumn("type_code", F.lit(None).cast("string"))
    w = Window.partitionBy("icao").orderBy("day")
    gap = F.datediff("day", F.lag("day").over(w))
    reach = F.greatest(F.lit(float(c.stitch_gap_min)), endurance(c=c) * c.stitch_endurance_ratio)
    safe = gap.isNull() | ((gap > c.day_gap_days) & ((gap - 1) * 1440 > reach))
    first = F.min(F.when(F.col("day") >= F.lit(since).cast("date"), F.col("day"))).over(Window.partitionBy("icao"))
    starts = typed.withColumns({"_cut": safe, "_first": first})
    return starts.where(F.col("_cut") & (F.col("day") <= F.col("_first"))).groupBy("icao").agg(F.max("day").alias("boundary"))
