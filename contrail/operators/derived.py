"""Derived measures of a session: peak rates, go-arounds, phases, headings, speeds, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.geo import bearing_deg, direction_deg, exact_turn, haversine_km, haversine_m
from .points import classified
from .tracks import over, sessions

KEY = ["icao", "session"]


def peak_rates(points: DataFrame, window_s: int = 60, min_n: int = 4, min_span_s: int = 30, cap: float = 10_000) -> DataFrame:
    """Greatest mean climb and descent rate of any window, after a median filter; null where none climbs or sinks."""
    rated = classified(sessions(points)).where((F.col("state") == "airborne") & F.col("rate_fpm").isNotNull())
    w = Window.partitionBy(*KEY).orderBy("ts").rangeBetween(-window_s, 0)
    rows = rated.select(*KEY, F.array_sort(F.collect_list("rate_fpm").over(w)).alias("r"), (F.col("ts") - F.min("ts").over(w)).alias("span"))
    rows = rows.where((F.size("r") >= min_n) & (F.col("span") >= min_span_s))
    n = F.size("r")
    median = (F.get("r", F.floor((n - 1) / 2).cast("int")) + F.get("r", F.floor(n / 2).cast("int"))) / 2
    rows = rows.withColumn("m", median)
    kept = F.filter("r", lambda x: F.abs(x - F.col("m")) <= 3 * F.greatest(F.lit(1.0), F.abs("m")) + 500)
    rows = rows.withColumn("k", kept).where(F.size("k") >= min_n)
    mean = F.aggregate("k", F.lit(0.0), lambda a, x: a + x) / F.size("k")
    best = rows.select(*KEY, mean.alias("mean")).groupBy(*KEY).agg(F.max("mean").alias("up"), F.min("mean").alias("down"))
    return best.select(*KEY, F.when(F.col("up") > 0, F.round(F.least("up", F.lit(cap)))).alias("peak_climb"), F.when(F.col("down") < 0, F.round(F.greatest("down", F.lit(-cap)))).alias("peak_descent"))


def go_arounds(points: DataFrame, last_s: int = 600, near_s: int = 30, dip_ft: float = 50, rebound_ft: float = 400, min_n: int = 6) -> DataFrame:
    """Per session: climbs back of ``rebound_ft`` from a low to the next high, among the last ``last_s`` seconds.

    Lows and highs are extremes of their neighbourhood, told apart by ``dip_ft``; a run of lows or highs counts as its first.
    """
    whole = Window.partitionBy(*KEY)
    tail = sessions(points).where(F.col("baro_ft").isNotNull()).withColumn("end", F.max("ts").over(whole)).where(F.col("end") - F.col("ts") <= last_s)
    near = Window.partitionBy(*KEY).orderBy("ts").rangeBetween(-near_s, near_s)
    low, high = F.min("baro_ft").over(near), F.max("baro_ft").over(near)
    kind = F.when((F.col("baro_ft") == low) & (high - low >= dip_ft), "low").when((F.col("baro_ft") == high) & (high - low >= dip_ft), "high")
    marked = tail.withColumns({"kind": kind, "n": F.count("*").over(whole)}).where(F.col("kind").isNotNull() & (F.col("n") >= min_n))
    w = over(*KEY)
    firsts = marked.withColumn("before", F.lag("kind").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("kind")))
    climb = (F.lead("baro_ft").over(w) - F.col("baro_ft")) >= rebound_ft
    return firsts.withColumn("up", (F.col("kind") == "low") & climb).groupBy(*KEY).agg(F.count_if("up").alias("go_arounds"))


def phase_budget(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Whole seconds of climb, descent, level and cruise, scaled to the session's duration, with cruise height and speed.

    Level time counts as cruise from 0.7 of the greatest height on. Cruise height is the time-weighted mean, cruise
    speed the time-weighted median of what lies within two deviations.
    """
    whole = Window.partitionBy(*KEY)
    dt = F.col("ts") - F.lag("ts").over(over(*KEY))
    rows = classified(sessions(points, c), c).withColumns({"dt": dt, "top": F.max("baro_ft").over(whole), "fast": F.max("gs_kt").over(whole), "len": F.max("ts").over(whole) - F.min("ts").over(whole)})
    air = rows.where((F.col("state") == "airborne") & (F.col("dt") > 0))
    rate, near = F.coalesce("rate_fpm", F.lit(0.0)), F.col("dt") <= c.phase_gap_s
    phase = F.when(near & (rate > c.phase_rate_fpm), "climb").when(near & (rate < -c.phase_rate_fpm), "descent").when(F.col("baro_ft") >= 0.7 * F.col("top"), "cruise").otherwise("level")
    s = F.when(near, F.col("dt")).otherwise(F.least("dt", F.lit(int(c.phase_gap_cap_s))))
    air = air.withColumns({"phase": phase, "s": s})
    cruise = F.col("phase") == "cruise"
    stats = Window.partitionBy(*KEY)
    gs = F.when(cruise, F.col("gs_kt"))
    air = air.withColumns({"mean_gs": F.avg(gs).over(stats), "dev_gs": F.greatest(F.lit(5.0), F.stddev_samp(gs).over(stats))})
    steady = cruise & (F.col("dev_gs").isNull() | (F.abs(F.col("gs_kt") - F.col("mean_gs")) <= 2 * F.col("dev_gs")))
    total = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("s"))), F.lit(0))
    sums = air.groupBy(*KEY).agg(
        *(total(p).alias(p) for p in ("climb", "descent", "level", "cruise")),
        F.max("len").alias("len"),
        F.max("top").alias("top"),
        (F.sum(F.when(cruise, F.col("baro_ft") * F.col("s"))) / F.sum(F.when(cruise & F.col("baro_ft").isNotNull(), F.col("s")))).alias("cruise_alt"),
        F.max("fast").alias("max_gs"),
        F.percentile(F.when(steady, F.col("gs_kt")), F.lit(0.5), F.greatest(F.lit(1), F.col("s")).cast("long")).alias("cruise_gs"),
    )
    # short and low flights, and those never level, have no cruise
    enough = (F.col("top") >= 500) & (F.col("len") >= 120) & (F.col("level") + F.col("cruise") > 0)
    all_s = F.col("climb") + F.col("descent") + F.col("level") + F.col("cruise")
    active = F.when(F.col("len") > 0, F.least(all_s, F.col("len"))).otherwise(all_s)
    bins = ("climb", "descent", "level", "cruise")
    scaled = [F.col(p) * active / F.nullif(all_s, F.lit(0)) for p in bins]
    whole = [F.floor(x) for x in scaled]
    # what the whole seconds lack goes to the bins with the largest remainders, the later bin first on ties
    left = F.rint(active) - sum(whole)
    rests = [x - w for x, w in zip(scaled, whole, strict=True)]
    rank = [sum((F.when((rests[j] > rests[i]) | ((rests[j] == rests[i]) & F.lit(j > i)), 1).otherwise(0) for j in range(4)), F.lit(0)) for i in range(4)]
    dripped = [(w + F.when(r < F.abs(left), F.signum(left)).otherwise(0)).cast("long") for w, r in zip(whole, rank, strict=True)]
    plain = [F.col("climb"), F.col("descent"), F.col("level") + F.col("cruise"), F.lit(None).cast("long")]
    seconds = [F.when(enough & (all_s > 0), d).otherwise(x).alias(f"{p}_s") for p, d, x in zip(bins, dripped, plain, strict=True)]
    return sums.select(*KEY, *seconds, F.when(enough, F.least(F.rint("cruise_alt"), F.col("top").cast("double"))).alias("cruise_alt"), F.when(enough, F.least(F.rint("cruise_gs"), F.col("max_gs"))).alias("cruise_gs"))


def headings(points: DataFrame) -> DataFrame:
    """Takeoff and landing directions: circular means over windows that widen until one has enough points, else by position."""
    whole, w = Window.partitionBy(*KEY), over(*KEY)
    rows = sessions(points).withColumns({"since": F.col("ts") - F.min("ts").over(whole), "left": F.max("ts").over(whole) - F.col("ts"), "blat": F.lag("lat").over(w), "blon": F.lag("lon").over(w)}).withColumn("turn", exact_turn(F.col("track_deg")))
    far = haversine_m(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon")) > 50
    at = F.struct("ts", "seq")
    gs = F.coalesce("gs_kt", F.lit(0.0))
    windows = [(60, 40, 3), (120, 10, 3), (240, 10, 3), (600, 10, 3), (600, 0, 1)]

    def mean(held: Column, n: int) -> Column:
        y, x = (F.sum(F.when(held, F.col(f"turn.{c}"))) for c in ("sin", "cos"))
        return F.when(F.count(F.when(held, F.col("track_deg"))) >= n, direction_deg(y, x))

    takeoff = mean((F.col("since") <= 60) & (F.col("gs_kt").isNull() | (F.col("gs_kt") > 40)), 1)
    landing = [mean((F.col("left") <= s) & (gs >= kt), n) for s, kt, n in windows]
    moved = F.max_by(bearing_deg(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon")), F.when(far, at))
    return rows.groupBy(*KEY).agg(F.round(takeoff, 1).alias("takeoff_deg"), F.round(F.coalesce(*landing, moved), 1).alias("landing_deg"))


def implied_speeds(points: DataFrame) -> DataFrame:
    """Per session: the greatest speed that its positions imply over ten seconds or more, and callsign changes."""
    w = over(*KEY)
    dt = F.col("ts") - F.lag("ts").over(w)
    said = F.last("callsign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = sessions(points).withColumns({"kt": F.when(dt >= 10, haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 1.852 / (dt / 3600)), "said": said})
    return rows.groupBy(*KEY).agg(F.round(F.max("kt"), 1).alias("implied_kt"), F.count_if(F.col("callsign") != F.col("said")).alias("callsign_changes"))


def landing_anchor(points: DataFrame, tail_points: int = 240, window_s: int = 600) -> DataFrame:
    """Per session: the lowest point of its last ten minutes, the latest on ties; else the last point seen."""
    back = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("seq"))
    rows = sessions(points).withColumn("back", F.row_number().over(back)).where(F.col("back") <= tail_points)
    rows = rows.withColumn("end", F.max("ts").over(Window.partitionBy(*KEY))).where(F.col("end") - F.col("ts") <= window_s)
    best = rows.groupBy(*KEY).agg(F.min(F.struct(F.coalesce("baro_ft", F.lit(1 << 30)).alias("alt"), "back", "lat", "lon")).alias("b"))
    return best.select(*KEY, "b.lat", "b.lon", F.when(F.col("b.alt") < 1 << 30, F.col("b.alt")).alias("alt_ft"))


def night_flags(legs: DataFrame, night: Column, night_end: Column) -> DataFrame:
    return legs.select(*KEY, night.alias("takeoff_night"), night_end.alias("landing_night"), (night | night_end).alias("night"))


def route(stops: DataFrame) -> DataFrame:
    """Per aircraft: its stops in order with the minutes between, as one line. stops: icao, ts, airport, minutes."""
    label = F.concat("airport", F.lit(" ("), F.when(F.col("minutes") < 1, "<1m").otherwise(F.concat(F.floor("minutes").cast("string"), F.lit("m"))), F.lit(")"))
    each = F.array_sort(F.collect_list(F.struct("ts", "session", label.alias("l"))))
    return stops.groupBy("icao").agg(F.array_join(F.transform(each, lambda s: s["l"]), " -> ").alias("route"))


def status(legs: DataFrame) -> DataFrame:
    """Per aircraft: emergencies by code, days seen, and what its legs add up to."""
    codes = F.array_join(F.array_sort(F.collect_set("emergency_squawk")), ",")
    day = F.floor(F.col("takeoff_ts") / 86400)
    return legs.groupBy("icao").agg(F.count("*").alias("legs"), F.count_distinct(day).alias("days"), F.count("emergency_squawk").alias("emergencies"), codes.alias("codes"), F.max("max_alt_ft").alias("max_alt_ft"), F.sum("n_points").alias("points"))


def search(legs: DataFrame, needle: str) -> DataFrame:
    """Aircraft whose address or callsigns hold the needle, with their last leg."""
    hit = F.contains(F.col("icao"), F.lit(needle.lower())) | F.contains(F.lower("callsigns"), F.lit(needle.lower()))
    return legs.where(hit).groupBy("icao").agg(F.max("takeoff_ts").alias("last_takeoff"), F.count("*").alias("legs"))


def badges(stats: DataFrame) -> DataFrame:
    """Flags shown by an aircraft. stats: icao, military, spoofs, hovers, overridden."""
    return stats.select("icao", F.concat_ws(" ", F.when(F.col("military"), "MIL"), F.when(F.col("spoofs") > 0, "SPF"), F.when(F.col("hovers") > 0, "HOVER"), F.when(F.col("overridden"), "TYP")).alias("flags"))


def snapshot(legs: DataFrame) -> DataFrame:
    """One JSON document an aircraft, its legs newest first: for a static export."""
    each = F.reverse(F.array_sort(F.collect_list(F.struct("takeoff_ts", "session", "n_points", "callsigns"))))
    return legs.groupBy("icao").agg(F.to_json(each).alias("legs"))


def autopilot_target(points: DataFrame) -> DataFrame:
    """Per session: the last selected altitude while near the greatest height so far, before any marked descent."""
    w = over(*KEY)
    air, rate = F.col("state") == "airborne", F.col("rate_fpm")
    rows = classified(sessions(points)).withColumns(
        {"top": F.max("baro_ft").over(w), "sank": F.coalesce(F.max(F.when(air & (rate < -500), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    level = (F.col("baro_ft") >= 0.85 * F.col("top")) & (F.abs(F.col("mcp_ft") - F.col("baro_ft")) < 500) & (rate.isNull() | (rate > -250))
    held = rows.where(F.col("mcp_ft").isNotNull() & air & (F.col("sank") == 0) & level)
    return held.groupBy(*KEY).agg(F.max_by("mcp_ft", F.struct("ts", "seq")).alias("target_ft"))


def emergency_flags(points: DataFrame) -> DataFrame:
    """Per session: the last emergency said that is not none; null if there was none. points: session and emergency."""
    said = F.when(F.col("emergency") != "none", F.col("emergency"))
    return points.groupBy(*KEY).agg(F.max_by(said, F.when(said.isNotNull(), F.struct("ts", "seq"))).alias("emergency_flag"))
