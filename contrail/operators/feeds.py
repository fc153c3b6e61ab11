"""The read surface: lists, pages, reports and summaries over legs and aircraft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..fixed import HELICOPTERS, LANDING_LABEL, MISSION_LABEL
from ..functions.geo import haversine_km
from .joins import within_intervals
from .scoring import literal_map
from .spatial import nearest

KEY = ["icao", "session"]


def trips(legs: DataFrame, messages: DataFrame, squawks: DataFrame) -> DataFrame:
    """Legs as a list shows them: ends, duration, mission, confidence, landing, messages and squawk.

    legs: what ``enrich.enriched`` gives. messages: icao, ts, oooi (whether a block time could be read). squawks: primary_squawk by session.
    """
    place = lambda lat, lon: F.format_string("(%.2f, %.2f)", lat, lon)
    lost = F.col("landing_type").isin("dropped", "signal_lost") & F.col("probable").isNotNull()
    origin = F.coalesce("origin", F.concat(F.lit("~"), "near_origin"), place("takeoff_lat", "takeoff_lon"))
    dest = F.when(F.col("destination").isNotNull(), F.col("destination")).when(lost, F.concat(F.lit("~"), "probable")).when(F.col("landing_type") == "signal_lost", "signal lost").otherwise(place("landing_lat", "landing_lon"))
    h, m = F.floor(F.col("minutes") / 60), F.floor(F.col("minutes") % 60)
    took = F.when(F.col("minutes") > 0, F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))).otherwise("")
    said = within_intervals(messages, legs.select(*KEY, "takeoff_ts", "landing_ts"), "icao", "ts", "takeoff_ts", "landing_ts").groupBy(*KEY).agg(F.count("*").alias("said"), F.max("oooi").alias("oooi"))
    rows = legs.join(said, KEY, "left").join(squawks, KEY, "left")
    acars = F.when(F.col("oooi"), F.concat(F.col("said").cast("string"), F.lit(" OOOI"))).otherwise(F.coalesce(F.col("said").cast("string"), F.lit("--")))
    label = lambda table, x: F.coalesce(F.try_element_at(literal_map(table), F.col(x)), F.lit("--"))
    return rows.select(
        *KEY,
        F.date_from_unix_date(F.floor(F.col("takeoff_ts") / 86400).cast("int")).alias("date"),
        origin.alias("from"), dest.alias("to"), took.alias("duration"), F.coalesce("callsign", F.lit("")).alias("callsign"),
        label(MISSION_LABEL, "mission").alias("mission"), F.concat(F.floor(F.col("confidence") * 100).cast("string"), F.lit("%")).alias("conf"), label(LANDING_LABEL, "landing_type").alias("landing"),
        acars.alias("acars"), "primary_squawk",
    )


def aircraft_list(stats: DataFrame, registry: DataFrame, crossref: DataFrame, spoofs: DataFrame, hovers: DataFrame) -> DataFrame:
    """Aircraft with names and types from the registry, else the cross-reference, and their flags. spoofs: icao by event; hovers: icao."""
    r = registry.select("icao", F.col("registration").alias("_rr"), F.col("type_code").alias("_rt"), F.col("description").alias("_rd"))
    x = crossref.select("icao", F.col("registration").alias("_xr"), F.col("type_code").alias("_xt"), F.col("military"))
    rows = stats.join(r, "icao", "left").join(x, "icao", "left").join(spoofs.groupBy("icao").agg(F.count("*").alias("_n")), "icao", "left").join(hovers.select("icao").distinct().withColumn("_h", F.lit(True)), "icao", "left")
    spoofed, other = F.coalesce("_n", F.lit(0)), F.coalesce(F.col("_xt") != F.col("_rt"), F.lit(False))
    flags = F.concat_ws(" ", F.when(F.col("military"), "MIL"), F.when(spoofed > 0, "SPF"), F.when(F.col("_h"), "HOVER"), F.when(other, "TYP"))
    return rows.select("icao", F.coalesce("_rr", "_xr").alias("registration"), F.coalesce("_rt", "_xt").alias("type_code"), F.col("_rd").alias("description"), "flights", "hours", "home", "last_day", spoofed.alias("spoofs"), F.coalesce("military", F.lit(False)).alias("military"), flags.alias("flags"))


def search_aircraft(listed: DataFrame, needle: str) -> DataFrame:
    """Aircraft whose address, registration, type or description hold the needle, in any case."""
    hit = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.strip().lower())) for c in ("icao", "registration", "type_code", "description")]
    return listed.where(hit[0] | hit[1] | hit[2] | hit[3]).select("icao", "registration", "type_code", "description")


def paged(rows: DataFrame, key: str, order: list[Column], limit: int = 50) -> DataFrame:
    """The first rows of each group, ``limit`` clamped to 1..200, with how many there are and whether some were left out."""
    n = max(1, min(limit, 200))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    page = ranked.where(F.col("_rank") <= n).drop("_rank").join(totals, key)
    return page.withColumns({"returned": F.least("total", F.lit(n)), "truncated": F.col("total") > n})


def source_rates(names: Column, rates: Column) -> Column:
    """``name NN%`` for each source, parted by dots."""
    return F.array_join(F.zip_with(names, rates, lambda n, r: F.format_string("%s %.0f%%", n, r)), " · ")


def block_times(messages: DataFrame, legs: DataFrame) -> DataFrame:
    """Out, off, on and in of each leg from the messages inside it: the earliest out and off, the latest on and in. messages: icao, ts, o."""
    met = within_intervals(messages, legs.select(*KEY, "takeoff_ts", "landing_ts"), "icao", "ts", "takeoff_ts", "landing_ts").groupBy(*KEY)
    found = met.agg(F.min("o.out").alias("out_ts"), F.min("o.off").alias("off_ts"), F.max("o.on").alias("on_ts"), F.max("o.in").alias("in_ts"))
    return found.where("coalesce(out_ts, off_ts, on_ts, in_ts) is not null")


def message_status(messages: DataFrame, legs: DataFrame, top: int = 6) -> DataFrame:
    """Per aircraft: messages, legs with block times, and the ``top`` labels with their counts. messages: icao, ts, label, o."""
    labels = messages.where("label is not null").groupBy("icao", "label").agg(F.count("*").alias("n"))
    ranked = labels.withColumn("_rank", F.row_number().over(Window.partitionBy("icao").orderBy(F.desc("n"), "label"))).where(F.col("_rank") <= top)
    best = ranked.groupBy("icao").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.format_string("%s(%d)", "label", "n").alias("l")))), lambda x: x["l"]), ", ").alias("top_labels"))
    timed = block_times(messages, legs).groupBy("icao").agg(F.count("*").alias("t"))
    whole = messages.groupBy("icao").agg(F.count("*").alias("messages")).join(timed, "icao", "left").join(best, "icao", "left")
    return whole.select("icao", "messages", F.coalesce("t", F.lit(0)).alias("timed_legs"), "top_labels")


def status_snapshot(legs: DataFrame, mix: DataFrame, spoofs: DataFrame, top: int = 6) -> DataFrame:
    """Per aircraft: indicators of its legs, weighted source mix, its ``top`` missions, and held-back broadcasts.

    legs: mission, emergency_squawk, go_arounds, hover_s, landing_type, destination.
    """
    n = F.count_if
    confirmed = F.col("landing_type") == "confirmed"
    signs = legs.groupBy("icao").agg(
        F.count("*").alias("legs"), F.count("emergency_squawk").alias("emergencies"), n(F.col("go_arounds") > 0).alias("go_arounds"), n(F.col("hover_s") >= 300).alias("long_hovers"),
        n(confirmed).alias("confirmed"), n(F.col("landing_type") == "signal_lost").alias("signal_lost"), n(confirmed & F.col("destination").isNull()).alias("off_airport"),
    )
    counts = legs.groupBy("icao", "mission").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("icao").orderBy(F.desc("n"), "mission"))).where(F.col("_rank") <= top)
    missions = ranked.groupBy("icao").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.format_string("%s %d", "mission", "n").alias("l")))), lambda x: x["l"]), ", ").alias("missions"))
    held = spoofs.groupBy("icao").agg(F.count("*").alias("_held"))
    return signs.join(missions, "icao").join(mix, "icao", "left").join(held, "icao", "left").withColumn("held_back", F.coalesce("_held", F.lit(0))).drop("_held")


def registry_metadata(vote: DataFrame, days: DataFrame) -> DataFrame:
    """Type of each aircraft: what the vote says, else its first trace day that names one. days: icao, at, type_code."""
    first = days.groupBy("icao").agg(F.min_by("type_code", F.when(F.col("type_code").isNotNull(), F.col("at"))).alias("_first"))
    return first.join(vote.select("icao", "type_code"), "icao", "left").select("icao", F.coalesce("type_code", "_first").alias("type_code"))


def drift_warnings(votes: DataFrame, vote: DataFrame, more_than: int = 20) -> DataFrame:
    """Aircraft whose trace days disagree with the vote more than ``more_than`` times, some on the type: with those types and counts."""
    drifted = vote.where(F.col("drift") > more_than).select("icao", F.col("type_code").alias("_voted"), "drift")
    odd = votes.where("type_code is not null").join(drifted, "icao").where(F.col("type_code") != F.col("_voted")).groupBy("icao", "_voted", "drift", "type_code").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_code", "n"))), lambda x: F.format_string("%s(%d)", x["type_code"], x["n"])), ", ")
    return odd.groupBy("icao", F.col("_voted").alias("type_code"), "drift").agg(listed.alias("conflicts"))


def hover_stats(legs: DataFrame, hovers: DataFrame, types: DataFrame, helicopters: tuple[str, ...] = HELICOPTERS) -> DataFrame:
    """Per leg of a helicopter: episodes and the longest hover in seconds; null for all other types. hovers: icao, start_ts, end_ts."""
    typed = legs.join(types.select("icao", "type_code"), "icao", "left")
    rows = hovers.select("icao", F.col("start_ts").alias("at"), (F.col("end_ts") - F.col("start_ts")).alias("s"))
    met = within_intervals(rows, legs.select(*KEY, "takeoff_ts", "landing_ts"), "icao", "at", "takeoff_ts", "landing_ts").groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("s").alias("_s"))
    rotor = F.coalesce(F.col("type_code").isin(*helicopters), F.lit(False))
    return typed.join(met, KEY, "left").select(*KEY, F.when(rotor, F.coalesce("_s", F.lit(0))).alias("max_hover_s"), F.when(rotor, F.coalesce("_n", F.lit(0))).alias("episodes"))


def signal_budget(phases: DataFrame, legs: DataFrame) -> DataFrame:
    """Per leg: minutes on signal, seconds without, and gaps. phases: climb_s, descent_s, level_s and gaps by session."""
    span = F.col("landing_ts") - F.col("takeoff_ts")
    active = F.least(F.col("climb_s") + F.col("descent_s") + F.col("level_s"), span)
    return phases.join(legs.select(*KEY, "takeoff_ts", "landing_ts"), KEY).select(*KEY, F.round(active / 60, 1).alias("active_min"), F.greatest(F.lit(0), span - active).alias("gap_s"), "gaps")


def bounding_box(points: DataFrame, key: list[str], buffer_nm: float = 50) -> DataFrame:
    """The box around each leg, wider by ``buffer_nm`` on all sides; null where it crosses the date line."""
    box = points.groupBy(*key).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    dy = F.lit(buffer_nm / 60)
    dx = dy / F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs("s"), F.abs("n")))))
    whole = F.col("e") - F.col("w") <= 180
    return box.select(*key, *(F.when(whole, F.round(x, 5)).alias(a) for a, x in (("min_lat", F.col("s") - dy), ("max_lat", F.col("n") + dy), ("min_lon", F.col("w") - dx), ("max_lon", F.col("e") + dx))))


def navaid_track(segments: DataFrame, legs: DataFrame) -> DataFrame:
    """Per leg: its beacons in order as a JSON array. segments: icao, p_ident, start_ts, end_ts, nm."""
    met = legs.select(*KEY, "takeoff_ts", "landing_ts").join(segments, "icao").where((F.col("start_ts") >= F.col("takeoff_ts")) & (F.col("end_ts") <= F.col("landing_ts")))
    each = F.transform(F.array_sort(F.collect_list(F.struct("start_ts", "p_ident", "end_ts", "nm"))), lambda x: F.struct(x["p_ident"].alias("navaid"), x["start_ts"].alias("start"), x["end_ts"].alias("end"), x["nm"].alias("nm")))
    return met.groupBy(*KEY).agg(F.to_json(each).alias("track"))


def named_helipads(pads: DataFrame, heliports: DataFrame, known: list[tuple[float, float, str]] = (), reach_km: float = 0.5) -> DataFrame:
    """Pads that only have a made-up name take that of the nearest heliport within ``reach_km``, else of a known place within 1 km.

    pads: ident, lat, lon, name. heliports: ident, lat, lon, name.
    """
    generic = F.col("name").isNull() | F.col("name").startswith("helipad_")
    near = nearest(pads.where(generic).withColumnRenamed("ident", "pad"), heliports, ["pad"], (0.01, 0.01)).where(F.col("km") < reach_km)
    names = near.join(heliports.select("ident", F.col("name").alias("_n")), "ident").select(F.col("pad").alias("ident"), "_n")
    by_hand = F.coalesce(*(F.when(haversine_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)) < 1, F.lit(n)) for a, b, n in known), F.lit(None).cast("string"))
    return pads.join(names, "ident", "left").withColumn("name", F.when(generic, F.coalesce("_n", by_hand, "name")).otherwise(F.col("name"))).drop("_n")


def offshore_names(pads: DataFrame) -> DataFrame:
    """Discovered pads named by where they lie (warm seas count as offshore) and by their cluster's number."""
    sea = (F.col("lat") < 20) | ((F.col("lon") < -85) & (F.col("lat") < 30))
    return pads.withColumn("name", F.concat(F.when(sea, "offshore_platform_").otherwise("helipad_"), F.col("cluster").cast("string")))


def refusals(aircraft: DataFrame, legs: DataFrame, version: str) -> DataFrame:
    """Why an aircraft cannot be extended window by window, or null. legs: icao, extractor_version."""
    held = legs.groupBy("icao").agg(F.count("*").alias("n"), F.count_if(~F.col("extractor_version").eqNullSafe(F.lit(version))).alias("stale"))
    why = F.when(F.col("icao").startswith("ae69"), "promotion votes across the whole history").when(F.col("n").isNull(), "no flights extracted yet").when(F.col("stale") > 0, F.concat(F.col("stale").cast("string"), F.lit(" flights from another extractor version")))
    return aircraft.select("icao").distinct().join(held, "icao", "left").select("icao", why.alias("why"))


def carried_state(points: DataFrame, legs: DataFrame, boundary: DataFrame) -> DataFrame:
    """What a full run holds when it reaches each aircraft's boundary: all sources, the last callsign before, the end of the last leg before."""
    sources = points.groupBy("icao").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))
    at = F.struct("ts", "seq")
    said = points.join(boundary, "icao").where(F.col("ts") < F.col("boundary_ts")).groupBy("icao").agg(F.max_by("callsign", F.when(F.col("callsign").isNotNull(), at)).alias("callsign"))
    ended = legs.join(boundary, "icao").where(F.col("takeoff_ts") < F.col("boundary_ts")).groupBy("icao").agg(F.max_by("landing_ts", "takeoff_ts").alias("prev_end_ts"))
    return boundary.select("icao").join(sources, "icao", "left").join(said, "icao", "left").join(ended, "icao", "left")


def buffers(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Points with session, state and which buffers they belong to: the takeoff's (first 240 within 600 s), the takeoff track (60 s,
    airborne), the landing track (last 240), and the touchdown with up to four ground points after it."""
    from .points import classified
    from .tracks import over, sessions

    whole = Window.partitionBy(*KEY)
    w, back = over(*KEY), over(*KEY, order=[F.desc("ts"), F.desc("seq")])
    at = F.struct("ts", "seq")
    ground, air = F.col("state") == "ground", F.col("state") == "airborne"
    rows = classified(sessions(points, c), c).withColumns({"n": F.row_number().over(w), "back": F.row_number().over(back), "since": F.col("ts") - F.min("ts").over(whole), "last_air": F.max(F.when(air, at)).over(whole)})
    down = ground & (at > F.col("last_air"))
    rows = rows.withColumn("down_n", F.when(down, F.row_number().over(Window.partitionBy(*KEY, down).orderBy("ts", "seq"))))
    return rows.withColumns({"takeoff_buffer": (F.col("n") <= 240) & (F.col("since") <= 600), "takeoff_track": air & (F.col("since") <= 60), "landing_track": F.col("back") <= 240, "touchdown": F.coalesce(F.col("down_n") <= 5, F.lit(False))})

