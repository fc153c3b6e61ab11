"""The registered queries: each applies one operator to the whole of its tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import circular_mean_deg
from ..functions.identity import hex_to_tail, octal_to_hex, tail_to_hex
from ..functions.solar import is_night, solar_altitude_deg
from ..functions.text import duration_label, oooi
from ..operators import derived, flights, joins, points, reports, rollups, scoring, spatial, tracks
from ..sources import adapter as a
from ..sources import traces
from ..sources.store import shared_folder, written
from ..streaming import flights as live_flights
from ..streaming import live, watch

#: Where the reference region's own thresholds would find nothing in the synthetic points, a query says so with its own.
REGISTERED = {}


def query(f):
    REGISTERED[f.__name__] = f
    return f


def _legs(spark: SparkSession, d: str) -> DataFrame:
    return tracks.legs(a.points(spark, d))


def _full_legs(spark: SparkSession, d: str) -> DataFrame:
    """Legs with both airports, landing type, and minutes."""
    legs, ports = _legs(spark, d), a.airports(spark, d)
    origin = spatial.airport_match(legs, ports, "takeoff").select("icao", "session", F.coalesce("airport", "near_airport").alias("origin"))
    dest = spatial.airport_match(legs, ports, "landing").select("icao", "session", F.coalesce("airport", "near_airport").alias("destination"))
    kinds = scoring.landings(a.points(spark, d)).select("icao", "session", "landing_type")
    key = ["icao", "session"]
    joined = legs.join(kinds, key).join(origin, key, "left").join(dest, key, "left")
    return joined.withColumn("minutes", (F.col("landing_ts") - F.col("takeoff_ts")) / 60).withColumn("callsign", F.nullif(F.element_at(F.split("callsigns", ","), 1), F.lit("")))


@query
def w01_sessions(spark, d):
    legs = _legs(spark, d)
    return legs.select("icao", "session", "takeoff_ts", "landing_ts", "n_points", "takeoff_lat", "landing_lon", "max_alt_ft", "max_gs_kt", "callsigns", "emergency_squawk")


@query
def w05_durations(spark, d):
    minutes = (F.col("landing_ts") - F.col("takeoff_ts")) / 60
    return _legs(spark, d).select("icao", "session", F.round(minutes, 1).alias("minutes"), duration_label(minutes).alias("label"))


@query
def w10_gaps(spark, d):
    """Signal gaps, the nearest airport to each, and their class."""
    found = written(tracks.gaps(a.points(spark, d)), "gaps")
    near = spatial.nearest(found, a.airports(spark, d), ["icao", "end_ts"], (0.5, 2.0)).select("icao", "end_ts", F.round(F.col("km") * 0.539957, 2).alias("nearest_nm"))
    rows = tracks.classify_gaps(found.join(near, ["icao", "end_ts"], "left"))
    return rows.select("icao", "start_ts", "end_ts", "gap_s", "alt_ft", F.round("pre_adsb", 3).alias("pre_adsb"), F.round("post_adsb", 3).alias("post_adsb"), "nearest_nm", "gap_class")


@query
def p03_ground_state(spark, d):
    return points.classified(a.points(spark, d)).groupBy("state", "reason", "kind").agg(F.count("*").alias("n"))


@query
def a02_source_mix(spark, d):
    return points.source_mix(a.points(spark, d), ["icao"])


@query
def a03_spoof_scores(spark, d):
    return rollups.spoof_scores(a.points(spark, d))


@query
def a06_fragments(spark, d):
    return tracks.fragments(a.points(spark, d))


@query
def a19_weighted_mix(spark, d):
    legs = points.source_mix(tracks.sessions(a.points(spark, d)), ["icao", "session"])
    return rollups.weighted_mix(legs, ["adsb_pct", "mlat_pct", "tisb_pct", "other_pct"], "n_points")


@query
def a27_squawk_summary(spark, d):
    return tracks.squawk_summary(a.points(spark, d))


@query
def a29_category_mode(spark, d):
    return tracks.category_mode(a.points(spark, d))


@query
def a35_mean_heading(spark, d):
    return a.points(spark, d).where("gs_kt > 40").groupBy("icao").agg(F.round(circular_mean_deg(F.col("track_deg")), 2).alias("heading"))


@query
def a37_path_metrics(spark, d):
    return tracks.path_metrics(_legs(spark, d))


@query
def w04_carried_callsign(spark, d):
    return tracks.carried_callsign(a.points(spark, d))


@query
def w08_turnarounds(spark, d):
    return tracks.turnarounds(_legs(spark, d))


@query
def w13_squawk_changes(spark, d):
    return tracks.changes(a.points(spark, d), "squawk", "icao")


@query
def w14_persisted_maxima(spark, d):
    return tracks.persisted_maxima(a.points(spark, d), window_s=3600)


@query
def w19_phase_seconds(spark, d):
    return tracks.phase_seconds(a.points(spark, d))


@query
def w26_slow_runs(spark, d):
    """Runs below 120 kt, as the synthetic points never hover."""
    return tracks.islands(a.points(spark, d), F.col("gs_kt") < 120, "icao")


@query
def w29_safe_boundary(spark, d):
    days = a.fetch_log(spark, d).select("icao", F.col("date").alias("day")).distinct()
    return tracks.safe_boundary(days, "1995-06-01")


@query
def w30_map_points(spark, d):
    """Trace points for a map: one a place and tenth of a second, the first, with gaps marked."""
    p = a.points(spark, d)
    key = ["icao", F.round("ts", 1).alias("t"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")]
    rows = p.groupBy(*key).agg(F.min_by("src", "seq").alias("src"), F.min("seq").alias("seq"))
    dashed = F.lead("t").over(tracks.over("icao", order=["t", "seq"])) - F.col("t") > 60
    return rows.withColumn("dashed", F.coalesce(dashed, F.lit(False)))


@query
def j04_nearest_airport(spark, d):
    return spatial.airport_match(_legs(spark, d), a.airports(spark, d), "takeoff")


@query
def j10_probable_destination(spark, d):
    p = a.points(spark, d)
    return spatial.probable_destination(scoring.landings(p), derived.landing_anchor(p), a.airports(spark, d))


@query
def j11_hex_ranges(spark, d):
    return joins.in_ranges(a.points(spark, d), a.hex_ranges(spark, d))


@query
def j14_interval_join(spark, d):
    """Messages (distress reports) inside legs of their aircraft."""
    said = a.points(spark, d).where("squawk = '7700'").select("icao", F.col("ts").alias("msg_ts"), "seq")
    return joins.within_intervals(said, _legs(spark, d).select("icao", "session", "takeoff_ts", "landing_ts"), "icao", "msg_ts", "takeoff_ts", "landing_ts").select("icao", "seq", "msg_ts", "session")


@query
def j15_shipments_in_window(spark, d):
    """An interval join over the larger tables: line items shipped within thirty days of their order."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    items = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", day("l_shipdate").alias("ship"))
    orders = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("low")).withColumn("high", F.col("low") + 30)
    met = joins.within_intervals(items, orders, "k", "ship", "low", "high", 30)
    return met.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.min(F.col("ship") - F.col("low")).alias("least"), F.max(F.col("ship") - F.col("low")).alias("most"))


@query
def j18_identity(spark, d):
    votes = a.registry_votes(spark, d)
    odd = votes.where("fetched_at % 2 = 1").groupBy("icao").agg(F.max("registration").alias("registration"), F.max("type_code").alias("type_code"))
    even = votes.where("fetched_at % 2 = 0").groupBy("icao").agg(F.max("registration").alias("registration"), F.max("type_code").alias("type_code"))
    return joins.merged_identity(votes, [("x", odd), ("y", even)], ["registration", "type_code"])


@query
def j20_missing_crossref(spark, d):
    return joins.missing(a.points(spark, d), a.registry_votes(spark, d), "icao")


@query
def j26_closest_approach(spark, d):
    return spatial.closest_approach(a.points(spark, d), 34.0, -90.0)


@query
def j27_squawk_as_of(spark, d):
    """Each leg with the squawk last heard in the two hours before it begins."""
    legs = _legs(spark, d).select("icao", "session", F.col("takeoff_ts").alias("ts"))
    heard = a.points(spark, d).where("squawk is not null").select("icao", "ts", "seq", "squawk")
    return joins.as_of(legs, heard, "icao", "ts", ["squawk"], ["seq"], within_s=7200, before=True)


@query
def j27_prior_end(spark, d):
    return joins.prior_end(_legs(spark, d), F.lit(28_420_000))


@query
def a07_registry_vote(spark, d):
    return rollups.registry_vote(a.registry_votes(spark, d))


@query
def a10_aircraft_stats(spark, d):
    return rollups.aircraft_stats(_full_legs(spark, d))


@query
def a12_quality_summary(spark, d):
    return c01_landings(spark, d).groupBy("landing_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"))


@query
def a13_top_airports(spark, d):
    return rollups.top_airports(_full_legs(spark, d))


@query
def a15_fetched_dates(spark, d):
    log = a.fetch_log(spark, d)
    seen = log.where("fetched_at % 97 = 0").select("icao", "source", "date")
    return rollups.fetched_dates(log, seen)


@query
def a16_resume_starts(spark, d):
    return rollups.resume_starts(a.fetch_log(spark, d))


@query
def p23_source_health(spark, d):
    return rollups.source_health(a.fetch_log(spark, d), failures=2)


@query
def a18_mission_breakdown(spark, d):
    legs = _missions(spark, d)
    return rollups.breakdown(legs, "mission")


def _missions(spark: SparkSession, d: str) -> DataFrame:
    legs = _full_legs(spark, d).withColumn("loiter", F.when(F.col("max_km") > 0, F.col("path_km") / (2 * F.col("max_km"))))
    kind = F.when(F.col("session") % 4 == 0, "C172").when(F.col("session") % 4 == 1, "GLF5")
    said = F.when(F.col("session") % 13 == 0, "nje12 ").when(F.col("session") % 17 == 0, "N911AB").when(F.col("session") % 19 == 0, "CX7MT").when(F.col("session") % 23 == 0, "CX7LMT").otherwise(F.col("callsign"))
    return legs.withColumns({"callsign": said, "cruise_gs": F.col("max_gs_kt"), "type_code": kind, "operator": F.when(F.col("session") % 29 == 0, "Bristow Group")}).withColumn("mission", scoring.mission())


@query
def c09_missions(spark, d):
    return _missions(spark, d).select("icao", "session", "mission")


@query
def a22_daily_activity(spark, d):
    return rollups.daily_activity(_legs(spark, d), rollups.spoof_scores(a.points(spark, d)), 325, 40)


@query
def a43_activity_ramp(spark, d):
    return rollups.activity_ramp(a22_daily_activity(spark, d))


@query
def c01_landings(spark, d):
    ends = spatial.airport_match(_legs(spark, d), a.airports(spark, d), "landing")
    return scoring.landings(a.points(spark, d), ports=ends)


def _event_legs(spark: SparkSession, d: str) -> DataFrame:
    legs = _full_legs(spark, d)
    made = {"hover_s": F.when(F.col("n_points") % 3 == 0, 400).otherwise(0), "go_arounds": F.col("n_points") % 4, "emergency_flag": F.when(F.col("n_points") % 11 == 0, "general")}
    return legs.withColumnRenamed("destination", "airport").withColumns(made)


@query
def c10_events(spark, d):
    return scoring.events(_event_legs(spark, d))


@query
def o04_events_per_aircraft(spark, d):
    return joins.top_per_group(scoring.events(_event_legs(spark, d)), "icao", [F.desc("ts"), F.col("session"), F.col("type")], 5)


@query
def p09_spoof_gate(spark, d):
    """Legs held back for their aircraft's integrity on the day, or for looking made up."""
    score = rollups.spoof_scores(a.points(spark, d)).select("icao", "day", "v2", "sil0")
    legs = _full_legs(spark, d).withColumns({"day": F.floor(F.col("takeoff_ts") / 86400).cast("long"), "speed_kt": F.col("max_gs_kt") * 2.2})
    return legs.join(score, ["icao", "day"]).withColumn("why", scoring.spoof_gate(scoring.DEFAULT.updated({"spoof_min_v2": 3}))).where("why is not null").select("icao", "session", "why", "v2", "sil0")


@query
def f01_tail_numbers(spark, d):
    """Every address of the points and a spread of others: to a tail number and back."""
    keys = a.table(spark, d, "orders").select(F.lower(F.hex(F.col("o_orderkey") * 7919 % 915_399 + 0xA00001)).alias("icao"))
    return keys.select("icao", hex_to_tail(F.col("icao")).alias("tail")).withColumn("back", tail_to_hex(F.col("tail")))


@query
def f04_octal_addresses(spark, d):
    return a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), octal_to_hex(F.conv((F.col("o_orderkey") + 10_485_760).cast("string"), 10, 8)).alias("icao"))


@query
def f05_oooi_times(spark, d):
    """Block times from message texts, anchored to the message's day and merged: earliest out and off, latest on and in."""
    p = a.points(spark, d).select("icao", "seq", "ts", F.element_at(F.array(*map(F.lit, ("14", "44", "4T", "H1", "QQ"))), (F.col("seq") % 5 + 1).cast("int")).alias("label"))
    hhmm = lambda k: F.lpad((F.pmod(F.floor(F.col("ts") / 3600) + k, F.lit(24)) * 100 + F.col("seq") % 60).cast("string"), 4, "0")
    text = F.when(F.col("label") == "4T", F.concat(F.lit("AGFSR X/"), F.concat_ws("/", hhmm(0), hhmm(1), hhmm(2), hhmm(23)))).otherwise(F.concat(F.lit("OUT "), hhmm(0), F.lit(" off: "), hhmm(22), F.lit(" in "), hhmm(3)))
    t = p.withColumn("o", oooi(F.col("label"), text, F.col("ts"))).groupBy("icao")
    return t.agg(F.min("o.out").alias("out_ts"), F.min("o.off").alias("off_ts"), F.max("o.on").alias("on_ts"), F.max("o.in").alias("in_ts"))


@query
def g21_solar(spark, d):
    legs = _legs(spark, d)
    return legs.select("icao", "session", F.round(solar_altitude_deg(F.col("takeoff_ts"), F.col("takeoff_lat"), F.col("takeoff_lon")), 3).alias("altitude"), (is_night(F.col("takeoff_ts"), F.col("takeoff_lat"), F.col("takeoff_lon")) | is_night(F.col("landing_ts"), F.col("landing_lat"), F.col("landing_lon"))).alias("night"))


@query
def g06_runway_alignment(spark, d):
    """Wider limits than for real approaches, as the synthetic points jump."""
    return spatial.runway_alignment(a.points(spark, d), a.runway_ends(spark, d), gap_s=200_000, min_s=30, offset_m=6000, above_ft=30_000)


@query
def g09_navaid_alignment(spark, d):
    return spatial.navaid_alignment(a.points(spark, d), a.navaids(spark, d), tolerance_deg=5, gap_s=200_000)


@query
def g15_takeoff_runway(spark, d):
    return spatial.takeoff_runway(a.points(spark, d), a.runway_ends(spark, d), gap_s=200_000, above_ft=60_000, opening_deg=40)


@query
def g12_departure_wedges(spark, d):
    rows = spatial.wedge(a.runway_ends(spark, d))
    corners = ("near_left", "near_right", "far_right", "far_left")
    return rows.select("ident", "runway", *(F.round(F.col(c)[x], 5).alias(f"{c}_{x}") for c in corners for x in ("lat", "lon")))


@query
def g17_helipads(spark, d):
    """Clusters of surface points."""
    p = a.points(spark, d).where("surface").select(F.col("seq").alias("id"), "lat", "lon", "ts")
    return spatial.helipads(p, spatial.dbscan(p, eps_km=1.2, min_points=4))


@query
def t03_reactivations(spark, d):
    log = a.fetch_log(spark, d)
    days = log.where("status = 200").select("icao", F.col("date").alias("day")).distinct()
    before = watch.snapshot(days.where("day < date '1997-01-01'"), _legs(spark, d)).select("icao", "last_day")
    return watch.reactivations(before.where("last_day is not null"), days, log.where("status = 404"), 5)


@query
def t04_new_emergencies(spark, d):
    legs = _legs(spark, d)
    before = legs.where("takeoff_ts < 28420000").groupBy("icao").agg(F.max("takeoff_ts").alias("last_takeoff"))
    return watch.new_emergencies(before, legs)


@query
def t05_new_spoofs(spark, d):
    scores = rollups.spoof_scores(a.points(spark, d)).where("sil0_pct >= 10").select("icao", "day")
    return watch.new_spoofs(scores.where("day < 329"), scores, ["icao", "day"])


@query
def t09_hourly_windows(spark, d):
    rows = a.points(spark, d).withColumn("event_time", F.timestamp_seconds("ts"))
    return live.windowed_counts(rows).select("icao", F.unix_seconds("start").alias("start_ts"), "n", "gs")


@query
def t09_live_flights(spark, d):
    """The batch's flights from a stream: points arrive in four parts and out of order by up to an hour, then a clock that ends them."""
    folder, parts = f"{shared_folder(spark)}/live-flights-{uuid.uuid4().hex}", 4
    rows = a.points(spark, d).withColumn("event_time", F.timestamp_seconds("ts"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    sent = F.floor((F.col("ts") - low + F.pmod(F.xxhash64("seq"), F.lit(3600))) * parts / (high - low + 3600))
    clock = spark.createDataFrame([("~", -1, high + 10 * 86400)], "icao string, seq long, ts long").withColumn("event_time", F.timestamp_seconds("ts"))
    for batch in [*(rows.where(sent == k) for k in range(parts)), rows.limit(0).unionByName(clock, allowMissingColumns=True)]:
        batch.write.mode("append").parquet(f"{folder}/points")
        live_flights.run_to_end(spark.readStream.schema(rows.schema).parquet(f"{folder}/points"), f"{folder}/flights", f"{folder}/progress")
    return live_flights.settled_flights(spark.read.parquet(f"{folder}/flights"))


@query
def t10_live_sessions(spark, d):
    rows = a.points(spark, d).withColumn("event_time", F.timestamp_seconds("ts"))
    return live.live_sessions(rows).select("icao", F.unix_seconds("start").alias("start_ts"), F.unix_seconds("end").alias("end_ts"), "n", "max_alt_ft")


@query
def s06_latest_wins(spark, d):
    """Upsert of trace days by (aircraft, date, source): the newest row wins."""
    return traces.latest(a.fetch_log(spark, d), ["icao", "date", "source"], [F.col("fetched_at")])


@query
def o02_newest_legs(spark, d):
    """A top-k report: the fifty newest legs."""
    return _legs(spark, d).select("icao", "session", "takeoff_ts", "n_points").orderBy(F.desc("takeoff_ts"), "icao", "session").limit(50)


@query
def w02_deduplicated(spark, d):
    kept = flights.deduplicated(a.points(spark, d))
    return kept.groupBy("icao").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query
def w03_flights(spark, d):
    return flights.flights(a.points(spark, d))


@query
def w20_peak_rates(spark, d):
    """Windows of an hour, as the synthetic points are minutes apart."""
    return derived.peak_rates(a.points(spark, d), window_s=3600)


@query
def a34_go_arounds(spark, d):
    return derived.go_arounds(a.points(spark, d), last_s=7200, near_s=600, min_n=3)


@query
def a31_phase_budget(spark, d):
    return derived.phase_budget(a.points(spark, d))


@query
def a36_headings(spark, d):
    return derived.headings(a.points(spark, d))


@query
def w16_implied_speeds(spark, d):
    return derived.implied_speeds(a.points(spark, d))


@query
def g16_landing_anchor(spark, d):
    return derived.landing_anchor(a.points(spark, d))


@query
def p22_routes(spark, d):
    legs = _full_legs(spark, d).where("destination is not null")
    return derived.route(legs.select("icao", "session", F.col("takeoff_ts").alias("ts"), F.col("destination").alias("airport"), "minutes"))


@query
def a17_status(spark, d):
    return derived.status(_legs(spark, d))


@query
def p16_aircraft_search(spark, d):
    return derived.search(_legs(spark, d), "N51")


@query
def p18_badges(spark, d):
    scores = rollups.spoof_scores(a.points(spark, d)).groupBy("icao").agg(F.count_if("flagged").alias("spoofs"))
    slow = tracks.islands(a.points(spark, d), F.col("gs_kt") < 30, "icao").groupBy("icao").agg(F.count("*").alias("hovers"))
    held = joins.in_ranges(a.points(spark, d), a.hex_ranges(spark, d)).select("icao", F.col("country").isin("NATION_3", "NATION_4").alias("military"))
    stats = held.join(scores, "icao").join(slow, "icao", "left").select("icao", F.coalesce("military", F.lit(False)).alias("military"), "spoofs", F.coalesce("hovers", F.lit(0)).alias("hovers"), F.col("icao").endswith("f").alias("overridden"))
    return derived.badges(stats)


@query
def s34_snapshot(spark, d):
    return derived.snapshot(_legs(spark, d))


@query
def a26_global_counts(spark, d):
    """Totals by network: aircraft, points and days."""
    p = a.points(spark, d)
    return p.groupBy("src").agg(F.count_distinct("icao").alias("aircraft"), F.count("*").alias("points"), F.count_distinct(F.floor(F.col("ts") / 86400)).alias("days"))


@query
def a24_long_gaps(spark, d):
    """A top-k report: the fifty longest gaps over ten minutes."""
    return tracks.gaps(a.points(spark, d)).where("gap_s > 600").select("icao", "start_ts", "gap_s").orderBy(F.desc("gap_s"), "icao", "start_ts").limit(50)


@query
def a23_off_airport(spark, d):
    """A top-k report: aircraft by confirmed landings away from any airport."""
    legs = _full_legs(spark, d).where("landing_type = 'confirmed' and destination is null")
    return legs.groupBy("icao").agg(F.count("*").alias("n")).where("n > 0").orderBy(F.desc("n"), "icao").limit(20)


@query
def j16_helipad_backfill(spark, d):
    """Flights with the clusters of surface points that both of their ends lie in."""
    pads = g17_helipads(spark, d).select(F.col("cluster").alias("pad"), "lat", "lon")
    rows = written(flights.flights(a.points(spark, d)).select("icao", "first_ts", "takeoff_lat", "takeoff_lon", "landing_lat", "landing_lon"), "flights")
    return spatial.backfilled(rows, pads, ["icao", "first_ts"]).select("icao", "first_ts", "origin_pad", "destination_pad")


@query
def t07_incremental_legs(spark, d):
    """Legs recomputed from each aircraft's safe boundary on, with all earlier ones kept: equal to a full run."""
    p = a.points(spark, d)
    full = tracks.legs(p)
    cut = full.where("takeoff_ts < 28420000").groupBy("icao").agg(F.max("landing_ts").alias("until"))
    old = full.join(cut, "icao").where("landing_ts <= until").select(*full.columns)
    fresh = tracks.legs(p.join(cut, "icao", "left").where("until is null or ts > until").select(*p.columns))
    before = old.groupBy("icao").agg(F.max("session").alias("last"))
    shifted = fresh.join(before, "icao", "left").withColumn("session", F.col("session") + F.coalesce("last", F.lit(0))).select(*full.columns)
    return old.unionByName(shifted).select("icao", "session", "takeoff_ts", "landing_ts", "n_points", "max_alt_ft")


@query
def p13_legs_between(spark, d):
    return reports.legs_between(_full_legs(spark, d), 328, 328).select("icao", "session", "takeoff_ts", "origin", "destination")


@query
def p19_shown_ends(spark, d):
    legs, ports = _full_legs(spark, d).drop("origin", "destination"), a.airports(spark, d)
    for end, name in (("takeoff", "origin"), ("landing", "destination")):
        legs = legs.join(spatial.airport_match(legs, ports, end).select("icao", "session", F.col("airport").alias(name), F.col("near_airport").alias(f"near_{name}")), ["icao", "session"], "left")
    return reports.shown_ends(legs)


@query
def p11_type_caps(spark, d):
    p = a.points(spark, d)
    typed = reports.with_type(_legs(spark, d), rollups.registry_vote(a.registry_votes(spark, d)), _even_votes(spark, d))
    key = ["icao", "session"]
    legs = typed.join(derived.autopilot_target(p), key, "left").join(derived.phase_budget(p).select(*key, "cruise_alt", "cruise_gs"), key, "left")
    capped = reports.type_caps(legs, {"T0": 2000, "T1": 30000}, {"T0": 200, "T1": 400})
    return capped.select(*key, "type_code", "max_alt_ft", "max_gs_kt", "cruise_alt", "cruise_gs")


def _even_votes(spark: SparkSession, d: str) -> DataFrame:
    return a.registry_votes(spark, d).where("fetched_at % 2 = 0").groupBy("icao").agg(F.max("type_code").alias("type_code"))


@query
def j22_resolve_tails(spark, d):
    votes = a.registry_votes(spark, d)
    return reports.resolve_tail(votes.select(F.col("registration").alias("tail")).distinct(), votes.withColumn("registration", F.concat(F.lit("X"), "registration")))


@query
def p21_links(spark, d):
    return reports.links(a.points(spark, d).select("icao").distinct(), {"map": "https://map.example/?icao=", "photo": "https://photo.example/"})


@query
def f12_mix_labels(spark, d):
    mix = points.classified(a.points(spark, d)).groupBy("icao").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("adsb", "mlat", "other")))
    return reports.mix_label(mix)


@query
def a42_layers(spark, d):
    counts = a.points(spark, d).groupBy("icao", F.coalesce("src", F.lit("none")).alias("group")).agg(F.count("*").alias("n"))
    return reports.layers(counts, ["adsb_icao", "mlat"])


@query
def f19_retention(spark, d):
    return reports.retention_warnings(rollups.resume_starts(a.fetch_log(spark, d)), {"net_a": 30, "net_b": 3650}, F.lit("2002-01-01").cast("date"))


@query
def w33_refused_sources(spark, d):
    log = a.fetch_log(spark, d)
    return reports.refused_sources(log.withColumn("source", F.concat("source", F.lit("-"), "icao")), 2)


@query
def g08_climbs_between(spark, d):
    """Climbs between consecutive slow runs."""
    p = a.points(spark, d)
    runs = tracks.islands(p, F.col("gs_kt") < 120, "icao").withColumn("end_alt_ft", F.lit(1000))
    return reports.climbs_between(runs, p)


@query
def a39_promoted_types(spark, d):
    legs = _legs(spark, d).select("icao", "session", (F.col("n_points") > 12).alias("overridden"))
    return reports.overridden_types(legs, "a0000").where("promoted")


@query
def o07_all_aircraft(spark, d):
    return a.points(spark, d).select("icao").union(a.fetch_log(spark, d).select("icao")).distinct()


@query
def w21_autopilot_target(spark, d):
    return derived.autopilot_target(a.points(spark, d))


@query
def c02_takeoff_confidence(spark, d):
    near = spatial.nearest(_legs(spark, d), a.airports(spark, d), ["icao", "session"], (0.15, 0.5), "takeoff_lat", "takeoff_lon").where("km <= 10")
    return scoring.takeoff_confidence(a.points(spark, d), near.select("icao", "session", "km"))


from . import read_queries  # noqa: E402, F401  registers its own
