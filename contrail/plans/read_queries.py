"""The registered queries, continued: enrichment and the read surface, each over the whole of its tables."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import oooi
from ..operators import derived, enrich, extract, feeds, joins, rollups, scoring, spatial, tracks
from ..sources import adapter as a
from ..sources import backfill, registry, traces
from ..sources.store import TraceStore, day_of, shared_folder
from ..streaming import watch
from .queries import _even_votes, _full_legs, _legs, a10_aircraft_stats, query

#: Wider limits than for real approaches, as the synthetic points jump.
ALIGNMENT = {"gap_s": 1800, "min_s": 30, "offset_m": 6000, "above_ft": 30_000}


def _types(spark: SparkSession, d: str) -> DataFrame:
    """A type for each aircraft, by the last digit of its address."""
    last = F.substring("icao", 6, 1)
    return a.points(spark, d).select("icao").distinct().withColumn("type_code", F.when(last.isin(*"0123"), "C172").when(last.isin(*"4567"), "GLF5"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enriched(a.points(spark, d), a.airports(spark, d), a.runway_ends(spark, d), _types(spark, d), **ALIGNMENT)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Points as messages whose text holds times: icao, ts, label, o (its block times)."""
    p = a.points(spark, d).where("seq % 3 = 0")
    label = F.element_at(F.array(*map(F.lit, ("14", "44", "H1", "QQ"))), (F.col("seq") % 4 + 1).cast("int"))
    hhmm = lambda k: F.lpad((F.pmod(F.floor(F.col("ts") / 3600) + k, F.lit(24)) * 100 + F.col("seq") % 60).cast("string"), 4, "0")
    rows = p.select("icao", "ts", "seq", label.alias("label"), F.concat(F.lit("OUT "), hhmm(0), F.lit(" in "), hhmm(3)).alias("text"))
    return rows.withColumn("o", oooi(F.col("label"), F.col("text"), F.col("ts")))


def _trace_days(spark: SparkSession, d: str) -> DataFrame:
    return a.fetch_log(spark, d).where("status = 200")


@query
def a38_enriched(spark, d):
    rows = _enriched(spark, d)
    return rows.select("icao", "session", "takeoff_ts", "minutes", "origin", "near_origin", "destination", "near_destination", "landing_type", "confidence", "mission", "max_alt_ft", "max_gs_kt", "cruise_alt", "cruise_gs", "probable", "aligned_runway", "aligned_s", "pattern_cycles")


@query
def c14_enriched_flights(spark, d):
    """All that is derived of a flight, from its takeoff and landing on."""
    rows = enrich.enriched_flights(a.points(spark, d), a.airports(spark, d), a.runway_ends(spark, d), _types(spark, d), **ALIGNMENT)
    shown = "icao session takeoff_ts landing_ts minutes mid_air fragments signal_gaps landed origin near_origin destination near_destination landing_type confidence mission max_alt_ft max_gs_kt cruise_alt cruise_gs probable aligned_runway aligned_s pattern_cycles"
    return rows.select(*shown.split())


@query
def p24_trips(spark, d):
    said = _messages(spark, d).select("icao", "ts", F.coalesce(F.col("o.out"), F.col("o.in")).isNotNull().alias("oooi"))
    squawks = tracks.squawk_summary(a.points(spark, d)).select("icao", "session", "primary_squawk")
    return feeds.trips(_enriched(spark, d), said, squawks)


def _crossref(spark: SparkSession, d: str) -> DataFrame:
    names = a.registry_votes(spark, d).where("fetched_at % 2 = 0").groupBy("icao").agg(F.max("registration").alias("registration"), F.max("type_code").alias("type_code"))
    return names.withColumn("military", F.col("icao").endswith("3"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    spoofs = rollups.spoof_scores(a.points(spark, d)).where("sil0_pct >= 10 and v2 >= 3")
    slow = tracks.islands(a.points(spark, d), F.col("gs_kt") < 30, "icao")
    return feeds.aircraft_list(a10_aircraft_stats(spark, d), rollups.registry_vote(a.registry_votes(spark, d).where("fetched_at % 3 = 0")), _crossref(spark, d), spoofs, slow)


@query
def j01_aircraft_list(spark, d):
    return _listed(spark, d)


@query
def p16_search_listed(spark, d):
    return feeds.search_aircraft(_listed(spark, d), " N10")


@query
def o02_paged_legs(spark, d):
    """A page of each aircraft's newest legs, with totals."""
    return feeds.paged(_legs(spark, d).select("icao", "session", "takeoff_ts"), "icao", [F.desc("takeoff_ts"), F.col("session")], 3)


def _spoofed(spark: SparkSession, d: str) -> DataFrame:
    score = rollups.spoof_scores(a.points(spark, d)).select("icao", "day", "v2", "sil0")
    legs = _full_legs(spark, d).withColumns({"day": F.floor(F.col("takeoff_ts") / 86400).cast("long"), "speed_kt": F.col("max_gs_kt") * 2.2})
    return legs.join(score, ["icao", "day"], "left").withColumn("why", scoring.spoof_gate(scoring.DEFAULT.updated({"spoof_min_v2": 3})))


@query
def p10_spoof_split(spark, d):
    """The two sinks: legs that are kept, and broadcasts that are held back with their reason."""
    return _spoofed(spark, d).groupBy(F.coalesce("why", F.lit("kept")).alias("sink")).agg(F.count("*").alias("n"), F.sum("n_points").alias("points"))


@query
def o03_spoof_list(spark, d):
    """A top-k report: the newest 500 broadcasts held back, with their stored detail read again."""
    stored = _spoofed(spark, d).where("why is not null").withColumn("detail", F.to_json(F.struct("v2", "sil0")))
    newest = stored.orderBy(F.desc("takeoff_ts"), "icao", "session").limit(500)
    read = newest.withColumn("r", F.from_json("detail", "v2 long, sil0 long"))
    return read.select("icao", "session", "takeoff_ts", "why", F.col("r.v2").alias("v2"), F.col("r.sil0").alias("sil0"))


def _event_legs(spark: SparkSession, d: str) -> DataFrame:
    from .queries import _event_legs as made

    return made(spark, d)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return rollups.spoof_scores(a.points(spark, d), scoring.DEFAULT.updated({"spoof_min_v2": 3}))


@query
def c11_unusual_events(spark, d):
    return scoring.event_feed(_event_legs(spark, d), _scores(spark, d), 28_400_000, "unusual")


@query
def c13_event_feed(spark, d):
    """A top-k report: the newest 500 events of all aircraft."""
    return scoring.event_feed(_event_legs(spark, d), _scores(spark, d)).orderBy(F.desc("ts"), "icao", "type", F.asc_nulls_last("session")).limit(500)


@query
def a05_spoof_events(spark, d):
    return scoring.spoof_events(_scores(spark, d)).drop("session")


@query
def a08_registry_metadata(spark, d):
    votes = a.registry_votes(spark, d)
    vote = rollups.registry_vote(votes.where("fetched_at % 5 = 0")).select("icao", F.when(~F.col("icao").endswith("5"), F.col("type_code")).alias("type_code"))
    return feeds.registry_metadata(vote, votes.withColumnRenamed("fetched_at", "at"))


@query
def a09_drift_warnings(spark, d):
    votes = a.registry_votes(spark, d)
    return feeds.drift_warnings(votes, rollups.registry_vote(votes), 3)


@query
def a16_clamped_starts(spark, d):
    end = F.lit("1998-08-01").cast("date")
    starts = rollups.resume_starts(a.fetch_log(spark, d))
    return starts.withColumn("start", F.greatest("start", F.date_sub(end, scoring.DEFAULT.resume_days)))


@query
def a17_behaviour(spark, d):
    """Per aircraft: mean squawk changes, legs with go-arounds, and emergencies by code."""
    key = ["icao", "session"]
    rows = _legs(spark, d).join(tracks.squawk_summary(a.points(spark, d)).select(*key, "changes"), key, "left").join(derived.go_arounds(a.points(spark, d), last_s=7200, near_s=600, min_n=3), key, "left")
    codes = rows.where("emergency_squawk is not null").groupBy("icao", "emergency_squawk").agg(F.count("*").alias("n"))
    listed = codes.groupBy("icao").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("emergency_squawk", "n"))), lambda x: F.format_string("%d (%s)", x["n"], x["emergency_squawk"])), ", ").alias("emergencies"))
    return rows.groupBy("icao").agg(F.round(F.avg("changes"), 2).alias("squawk_changes"), F.count_if(F.col("go_arounds") > 0).alias("go_around_legs")).join(listed, "icao", "left")


@query
def j15_block_times(spark, d):
    return feeds.block_times(_messages(spark, d), _legs(spark, d))


@query
def a20_message_status(spark, d):
    return feeds.message_status(_messages(spark, d), _legs(spark, d))


@query
def a21_status_snapshot(spark, d):
    key = ["icao", "session"]
    legs = _enriched(spark, d).join(derived.go_arounds(a.points(spark, d), last_s=7200, near_s=600, min_n=3), key, "left").withColumn("hover_s", F.when(F.col("n_points") % 3 == 0, 400).otherwise(0))
    return feeds.status_snapshot(legs, _mix(spark, d), _spoofed(spark, d).where("why is not null"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    from .queries import a19_weighted_mix

    return a19_weighted_mix(spark, d)


@query
def a25_emergency_legs(spark, d):
    """A top-k report: the newest hundred legs with an emergency code or flag."""
    rows = _event_legs(spark, d).where("emergency_squawk is not null or emergency_flag is not null")
    return rows.select("icao", "session", "takeoff_ts", "emergency_squawk", "emergency_flag", F.round("minutes", 1).alias("minutes")).orderBy(F.desc("takeoff_ts"), "icao", "session").limit(100)


@query
def a28_callsigns(spark, d):
    """Per leg: its callsigns as a JSON list, and changes, capped at one less than there are."""
    key = ["icao", "session"]
    seen = tracks.sessions(a.points(spark, d)).groupBy(*key).agg(F.array_sort(F.collect_set("callsign")).alias("c")).where(F.size("c") > 0)
    met = seen.join(derived.implied_speeds(a.points(spark, d)).select(*key, "callsign_changes"), key)
    return met.select(*key, F.to_json("c").alias("callsigns"), F.least("callsign_changes", F.greatest(F.lit(0), F.size("c") - 1)).cast("long").alias("changes"))


@query
def a30_signal_budget(spark, d):
    return feeds.signal_budget(tracks.phase_seconds(a.points(spark, d)), _legs(spark, d))


@query
def a33_hover_stats(spark, d):
    """Slow runs of aircraft of one type, as the synthetic points never hover."""
    slow = tracks.islands(tracks.sessions(a.points(spark, d)), F.col("gs_kt") < 120, "icao", "session")
    return feeds.hover_stats(_legs(spark, d), slow, _types(spark, d), ("C172",))


@query
def j12_military_activity(spark, d):
    """Per aircraft in a held range: legs, and the last one."""
    held = joins.in_ranges(a.points(spark, d), a.hex_ranges(spark, d)).where("country is not null")
    return _legs(spark, d).where("takeoff_ts >= 28400000").join(held, "icao").groupBy("icao", "country").agg(F.count("*").alias("legs"), F.max("takeoff_ts").alias("last_takeoff"))


@query
def j13_top_aircraft(spark, d):
    """A top-k report: the ten aircraft with most legs, with names where the registry has them."""
    names = rollups.registry_vote(a.registry_votes(spark, d)).select("icao", "registration", "type_code")
    day = F.floor(F.col("takeoff_ts") / 86400)
    counts = _legs(spark, d).groupBy("icao").agg(F.count("*").alias("legs"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return counts.orderBy(F.desc("legs"), "icao").limit(10).join(names, "icao", "left")


@query
def j17_named_helipads(spark, d):
    pads = a.navaids(spark, d).withColumn("name", F.when(F.substring("ident", -1, 1) == "0", "a known place").otherwise(F.concat(F.lit("helipad_"), "ident")))
    ports = a.airports(spark, d).where("type = 'heliport'").withColumn("name", F.concat(F.lit("Heliport "), "ident"))
    return feeds.named_helipads(pads, ports, [(30.5, -99.5, "Place A"), (34.0, -90.0, "Place B")]).select("ident", "name")


@query
def j21_orphan_requests(spark, d):
    """Answered requests without a trace day."""
    log = a.fetch_log(spark, d)
    return log.where("status = 200").join(_trace_days(spark, d).where("fetched_at % 4 <> 1").select("icao", "date", "source"), ["icao", "date", "source"], "left_anti").select("icao", "source", "date", "fetched_at")


@query
def j23_registry_lookup(spark, d):
    votes = a.registry_votes(spark, d)
    reg, cross = rollups.registry_vote(votes.where("fetched_at % 3 = 0")), _crossref(spark, d)
    asked = votes.where("fetched_at % 7 = 0").select(F.lower("registration").alias("query")).union(votes.where("fetched_at % 11 = 0").select(F.upper("icao").alias("query"))).distinct()
    return registry.lookup(asked, reg, cross)


@query
def s07_days_since(spark, d):
    return traces.days_of(_trace_days(spark, d), since="1997-06-01").select("icao", "source", "date", "fetched_at")


@query
def s10_earliest_new_day(spark, d):
    return traces.earliest_new_day(_trace_days(spark, d), 5000)


@query
def s29_flights_sink(spark, d):
    """Legs as stored; single points land when they take off, and are left out."""
    return traces.flights_sink(_legs(spark, d).select("icao", "takeoff_ts", "landing_ts", "session", "n_points"), [F.col("session")])


@query
def s31_window_deleted(spark, d):
    days = _trace_days(spark, d).select("icao", F.col("date").alias("day")).distinct()
    return traces.without_window(days, tracks.safe_boundary(days, "1995-06-01"))


@query
def s32_flying_registry(spark, d):
    return traces.without_flightless(rollups.registry_vote(a.registry_votes(spark, d)), _legs(spark, d).where("session > 1"))


@query
def s04_path_points(spark, d):
    """Points as waypoints of the path network and back."""
    one = F.struct("seq", F.struct(F.col("ts").cast("double").alias("ts"), "lat", "lon", (F.col("baro_ft") / 2.0).alias("alt_m"), F.col("track_deg").alias("track"), F.col("surface").alias("ground")).alias("p"))
    tracks_ = a.points(spark, d).groupBy("icao").agg(F.min("ts").alias("start_ts"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["p"]).alias("path"))
    return traces.path_points(tracks_).drop("gs_kt")


def _raw_master(spark: SparkSession, d: str) -> DataFrame:
    """customer as the registry's own file."""
    c, k = a.table(spark, d, "customer"), F.col("c_custkey")
    octal = F.conv((k + 10_485_760).cast("string"), 10, 8)
    return c.select(k.cast("string").alias("N-NUMBER"), F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("NAME"), F.when(k % 4 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("CITY"), F.when(k % 5 != 0, octal).alias("MODE S CODE"), F.when(k % 3 == 0, F.upper(F.hex(k + 10_485_760))).alias("MODE S CODE HEX"))


@query
def s18_registered(spark, d):
    return registry.master(_raw_master(spark, d)).select("icao", "n_number", "name", "city", "street")


@query
def s19_deregistered(spark, d):
    c, k = a.table(spark, d, "customer"), F.col("c_custkey")
    raw = c.select(k.cast("string").alias("N-NUMBER"), F.when(k % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("CITY-PHYSICAL"), F.col("c_name").alias("CITY-MAIL"), F.lit("20200101").alias("CANCEL-DATE"), F.conv((k + 10_485_760).cast("string"), 10, 8).alias("MODE-S-CODE"))
    return registry.deregistered(raw).select("icao", "n_number", "city", "expiration_date", "unique_id")


@query
def s20_aircraft_reference(spark, d):
    p, k = a.table(spark, d, "part"), F.col("p_partkey")
    return registry.aircraft_reference(p.select(F.when(k % 9 != 0, k.cast("string")).otherwise("").alias("CODE"), F.col("p_brand").alias("MFR"), F.col("p_type").alias("MODEL")))


@query
def j24_by_number(spark, d):
    asked = a.table(spark, d, "orders").select(F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("tail")).distinct()
    return registry.by_number(registry.master(_raw_master(spark, d)).select("icao", "n_number", "name"), asked)


@query
def g10_boxes(spark, d):
    return feeds.bounding_box(tracks.sessions(a.points(spark, d)), ["icao", "session"])


@query
def w22_emergency_flags(spark, d):
    p = tracks.sessions(a.points(spark, d)).withColumn("emergency", F.when(F.col("seq") % 13 == 0, "general").when(F.col("seq") % 17 == 0, "nordo").otherwise("none"))
    return derived.emergency_flags(p)


@query
def w23_buffers(spark, d):
    b = feeds.buffers(a.points(spark, d))
    n = lambda c: F.count_if(F.col(c)).alias(c)
    return b.groupBy("icao", "session").agg(n("takeoff_buffer"), n("takeoff_track"), n("landing_track"), n("touchdown"))


@query
def f15_source_rates(spark, d):
    """Each aircraft's points by source, as one line."""
    shares = a.points(spark, d).where("src is not null").groupBy("icao", "src").agg(F.count("*").alias("n"))
    each = shares.groupBy("icao").agg(F.array_sort(F.collect_list(F.struct("src", "n"))).alias("e"), F.sum("n").alias("every"))
    return each.select("icao", feeds.source_rates(F.col("e.src"), F.transform("e", lambda x: F.floor(100 * x["n"] / F.col("every")).cast("double"))).alias("rates"))


@query
def t02_watch_baseline(spark, d):
    """What a watch run says of each aircraft: the first run only sets its baseline."""
    legs = _legs(spark, d)
    before = watch.snapshot(_trace_days(spark, d).select("icao", F.col("date").alias("day")).where("day < date '1996-01-01'"), legs.where("takeoff_ts < 28420000"))
    return watch.evaluated(legs, before)


@query
def t07_refusals(spark, d):
    legs = _legs(spark, d).where("session > 1").withColumn("extractor_version", F.when(F.col("session") % 5 == 0, "old").otherwise("new"))
    return feeds.refusals(a.points(spark, d), legs, "new")


def _store(spark: SparkSession, d: str) -> TraceStore:
    """An empty store for the points of ``adapter.spread_points``."""
    name = f"trace_{uuid.uuid4().hex}"
    return TraceStore(spark, name, f"{shared_folder(spark)}/{name}", 16).open(a.spread_points(spark, d).schema)


@query
def s06_trace_store(spark, d):
    """Trace days put in the store in two parts, then some of them again: the statistics kept beside the points, and their scores."""
    store, points = _store(spark, d), a.spread_points(spark, d)
    day = F.pmod(F.floor(F.col("ts") / 86400), F.lit(5))
    store.put(points.where(day < 3))
    store.put(points.where((day >= 3) & (F.col("seq") % 2 == 0)))
    store.put(points.where(day >= 3))
    return rollups.scores_of(store.days()).drop("last_callsign")


@query
def s13_backfill(spark, d):
    """Raw trace days as JSON, moved into the store batch by batch by two runs, the first of which stops early: the days stored."""
    store, points = _store(spark, d), a.spread_points(spark, d)
    kept = [c for c in points.columns if c != "icao"]
    row = F.array_sort(F.collect_list(F.struct("ts", "seq", *(c for c in kept if c not in ("ts", "seq")))))
    raw = points.groupBy("icao", day_of(F.col("ts")).alias("day")).agg(F.to_json(row).alias("body"))
    kind = f"array<{T.StructType([points.schema[c] for c in kept]).simpleString()}>"
    decoded = lambda rows: rows.select("icao", F.inline(F.from_json("body", kind)))
    for most in (2, None):
        backfill.backfill(raw, decoded, store, f"{store.folder}/progress", rows=300, most=most)
    return rollups.scores_of(store.days()).drop("last_callsign")


@query
def t07_incremental_extract(spark, d):
    """Flights kept as a table: a full run without the last third and one earlier day, then late and new days by increments."""
    points, store = a.spread_points(spark, d), _store(spark, d)
    table, spoofs = (extract.FlightTable(spark, f"{store.folder}/{x}", 4) for x in ("flights", "spoofs"))
    low, high = points.agg(F.min(F.floor(F.col("ts") / 86400)), F.max(F.floor(F.col("ts") / 86400))).first()
    day, cut, late = F.floor(F.col("ts") / 86400), low + (high - low) * 2 // 3, low + (high - low) // 3
    store.put(points.where((day < cut) & (day != late)))
    extract.full_extract(store, table, spoofs)
    for part, since in ((day == late, late), (day >= cut, cut)):
        store.put(points.where(part))
        extract.incremental_extract(store, table, spoofs, str(date(1970, 1, 1) + timedelta(days=since)))
    return table.read().drop("extractor_version")


@query
def t08_carried_state(spark, d):
    p = a.points(spark, d)
    return feeds.carried_state(p, _legs(spark, d), p.select("icao").distinct().withColumn("boundary_ts", F.lit(28_410_000)))


@query
def o06_dates_newest_first(spark, d):
    return _trace_days(spark, d).select("icao", "date").distinct().orderBy("icao", F.desc("date"))


@query
def o11_first_rows(spark, d):
    """The first trace row of each aircraft."""
    return joins.top_per_group(_trace_days(spark, d).select("icao", "date", "source", "fetched_at"), "icao", [F.col("date"), F.col("source"), F.col("fetched_at")], 1)


@query
def g18_discovered_pads(spark, d):
    """Both ends of legs, clustered and named."""
    legs = _legs(spark, d)
    number = lambda end: (F.conv("icao", 16, 10).cast("long") * 100_000 + F.col("session") * 2 + end).alias("id")
    ends = legs.select(number(0), F.col("takeoff_lat").alias("lat"), F.col("takeoff_lon").alias("lon"), F.col("takeoff_ts").alias("ts"))
    both = ends.unionAll(legs.select(number(1), "landing_lat", "landing_lon", "landing_ts"))
    return feeds.offshore_names(spatial.helipads(both, spatial.dbscan(both, eps_km=1.2, min_points=4)))
