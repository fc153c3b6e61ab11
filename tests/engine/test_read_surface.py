"""Sources, enrichment and read surface where no registered query holds them against SQL."""

import gzip
import json
import zlib

from contrail.config import DEFAULT
from contrail.operators import enrich, feeds, flights, reports, scoring
from contrail.sources import registry, traces


def test_bodies_are_read_whatever_their_packing(spark):
    text = json.dumps({"timestamp": 100.5, "trace": [[0, 1.0, 2.0, "ground"]], "r": "N1"})
    rows = [("a", gzip.compress(text.encode())), ("b", zlib.compress(text.encode())), ("c", text.encode()), ("d", b"\x1f\x8bnot gzip"), ("e", None), ("f", b"\xff\xfe")]
    found = {r.path: r.body for r in traces.bodies(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found == {"a": text, "b": text, "c": text, "d": None, "e": None, "f": None}
    fetched = spark.createDataFrame([("x", "2020-01-02", text), ("y", "2020-01-02", '{"trace": []}'), ("z", "2020-01-02", "no json")], "icao string, day string, body string").selectExpr("icao", "cast(day as date) as day", "body")
    parsed = {r.icao: (r.timestamp, r.registration) for r in traces.parsed_body(fetched).collect()}
    assert parsed == {"x": (100.5, "N1"), "y": (1577923200.0, None)}


def test_a_refresh_is_seen_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/registry"
    one, two = spark.createDataFrame([("a",)], "icao string"), spark.createDataFrame([("b",), ("c",)], "icao string")
    registry.refreshed({"master": one, "deregistered": one}, folder)
    registry.refreshed({"master": two, "deregistered": one}, folder)
    assert registry.current(spark, folder, "master").count() == 2 and registry.current(spark, folder, "deregistered").count() == 1


def test_payloads_of_the_lookup_service(spark):
    rows = [("AAA001", '{"Registration": "N1", "ICAOTypeCode": "", "Manufacturer": "Bell"}'), ("AAA002", '{"status": "404", "error": "none"}'), ("AAA003", "broken")]
    found = registry.service_payloads(spark.createDataFrame(rows, "icao string, json string")).collect()
    assert [(r.icao, r.registration, r.type_code, r.type_description) for r in found if r.registration] == [("aaa001", "N1", None, "Bell")]
    assert "aaa002" not in {r.icao for r in found}


def test_flight_records_take_their_times_from_messages(spark):
    rows = [(json.dumps({"id": "1", "flight": " AB1 ", "createdAt": "c", "updatedAt": "u", "messages": [{"timestamp": "2020-02"}, {"timestamp": "2020-01"}, {"timestamp": ""}]}),), (json.dumps({"id": "2", "createdAt": "c", "updatedAt": "u"}),)]
    found = {r.flight_id: (r.first_seen, r.last_seen, r.messages) for r in registry.flattened_flights(spark.createDataFrame(rows, "json string")).collect()}
    assert found == {"1": ("2020-01", "2020-02", 3), "2": ("c", "u", 0)}


def test_types_and_military_ranges_overlay_identities(spark):
    names = spark.createDataFrame([("a", "B407"), ("b", None)], "icao string, type_code string")
    typed = registry.with_type_names(names, spark.createDataFrame([("B407", "Bell 407")], "type_code string, description string"))
    held = spark.createDataFrame([("b", "US"), ("a", None)], "icao string, country string")
    found = {r.icao: (r.type_description, r.mil_country, r.military) for r in registry.with_military(typed, held).collect()}
    assert found == {"a": ("Bell 407", None, False), "b": (None, "US", True)}


FRAGMENT = "icao string, session long, fragment long, first_ts long, last_ts long, landing_ts long, n_points long, takeoff_lat double, takeoff_lon double, last_lat double, last_lon double, last_alt_ft int, first_alt_ft int, peak_ft int, max_alt_ft int, seen_alt_ft int, max_gs_kt double, callsign string, mid_air boolean"


def fragment(icao, session, begin, end, first, peak, last, landing=None, lat=30.0):
    return (icao, session, 1, begin, end, landing, 10, lat, -90.0, lat, -90.0, last, first, peak, peak, last, 200.0, None, True)


def test_a_new_departure_is_not_stitched_to_the_flight_before(spark):
    rows = [
        fragment("hole", 1, 0, 1000, 20000, 30000, 30000), fragment("hole", 2, 4000, 5000, 30000, 31000, 31000),
        fragment("dep", 1, 0, 1000, 2000, 5000, 5000), fragment("dep", 2, 4000, 5000, 3000, 9000, 5500),
        fragment("low", 1, 0, 1000, 2000, 5000, 5000), fragment("low", 2, 4000, 5000, 3000, 4500, 4500),
        fragment("long", 1, 0, 1000, 20000, 30000, 30000), fragment("long", 2, 1000 + 7200, 9000, 30000, 31000, 31000),
        fragment("far", 1, 0, 1000, 20000, 30000, 30000), fragment("far", 2, 1000 + 7200, 9000, 30000, 31000, 31000),
    ]
    types = spark.createDataFrame([("far", "C17")], "icao string, type_code string")
    found = flights.stitched(spark.createDataFrame(rows, FRAGMENT), DEFAULT, types).groupBy("icao").agg({"flight.session": "max"}).collect()
    assert {r[0]: r[1] == 1 for r in found} == {"hole": True, "dep": False, "low": True, "long": False, "far": True}


def test_alignment_adds_confidence_and_finds_dropped_approaches(spark):
    legs = spark.createDataFrame(
        [("a", 1, 0, 1000, "K1", None, None, 0.5, "confirmed", 900), ("b", 1, 0, 1000, None, None, "K1", 0.0, "signal_lost", 900), ("c", 1, 0, 1000, None, "K1", None, 0.95, "confirmed", 900), ("d", 1, 0, 1000, None, None, None, 0.5, "confirmed", 900)],
        "icao string, session long, takeoff_ts long, landing_ts long, destination string, near_destination string, probable string, confidence double, landing_type string, last_alt int",
    )
    segments = spark.createDataFrame([("a", "K1", "A", 100, 140), ("a", "K1", "B", 300, 340), ("b", "K1", "A", 100, 170), ("c", "K1", "A", 100, 200), ("c", "K2", "A", 100, 900), ("c", "K1", "B", 900, 1100), ("d", "K1", "A", 1, 500)], "icao string, p_ident string, p_runway string, start_ts long, end_ts long")
    ports = spark.createDataFrame([("K1", 100)], "ident string, elevation_ft int")
    found = {r.icao: (r.aligned_runway, r.aligned_s, r.pattern_cycles, r.confidence, r.landing_type) for r in enrich.aligned(legs, segments, ports, 5000).collect()}
    assert found == {"a": ("A", 40, 2, 0.65, "confirmed"), "b": ("A", 70, 1, 0.25, "dropped"), "c": ("A", 100, 1, 1.0, "confirmed"), "d": (None, None, 0, 0.5, "confirmed")}


def test_caps_leave_a_tenth_only_where_the_autopilot_agrees(spark):
    legs = spark.createDataFrame([("B407", 30000, 19000, 170.0, 30000.0, 200.0), ("B407", 20000, 19000, 10.0, None, None), ("B407", 20000, None, None, None, None), (None, 90000, None, 2000.0, 90000.0, 900.0)], "type_code string, max_alt_ft int, target_ft int, max_gs_kt double, cruise_alt double, cruise_gs double")
    found = [tuple(r) for r in reports.type_caps(legs).select("max_alt_ft", "max_gs_kt", "cruise_alt", "cruise_gs").collect()]
    assert found == [(18500, 170.0, 18500.0, 176.0), (20000, 10.0, None, None), (18500, None, None, None), (60000, 880.0, 60000.0, 880.0)]


def test_beacons_of_a_leg_as_json(spark):
    legs = spark.createDataFrame([("a", 1, 0, 1000)], "icao string, session long, takeoff_ts long, landing_ts long")
    segments = spark.createDataFrame([("a", "V2", 500, 600, 3.25), ("a", "V1", 100, 200, 1.5), ("a", "V3", 900, 1100, 1.0)], "icao string, p_ident string, start_ts long, end_ts long, nm double")
    assert json.loads(feeds.navaid_track(segments, legs).first().track) == [{"navaid": "V1", "start": 100, "end": 200, "nm": 1.5}, {"navaid": "V2", "start": 500, "end": 600, "nm": 3.25}]


def test_endurance_by_type(spark):
    rows = spark.createDataFrame([("C17",), ("ZZZZ",), (None,)], "type_code string")
    assert [r[0] for r in rows.select(scoring.endurance()).collect()] == [720.0, 240.0, 240.0]
