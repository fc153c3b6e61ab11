import math
import random

import pytest

from pyspark.sql import functions as F

from contrail.config import DEFAULT
from contrail.operators import flights, joins, points, rollups, scoring, spatial, tracks
from contrail.sources import traces
from contrail.streaming import live, watch

POINT = "icao string, seq long, ts long, lat double, lon double, surface boolean, baro_ft int, geom_ft int, gs_kt double, track_deg double, rate_fpm double, squawk string, callsign string, src string, version int, sil int, nic int, category string"


def track(spark, rows):
    """Points from dicts; what is not said has a plain value."""
    base = {"icao": "a", "seq": 0, "ts": 0, "lat": 10.0, "lon": 20.0, "surface": False, "baro_ft": 1000, "geom_ft": 1000, "gs_kt": 100.0, "track_deg": 0.0, "rate_fpm": 0.0, "squawk": "1200", "callsign": None, "src": "adsb_icao", "version": 2, "sil": 3, "nic": 8, "category": "A1"}
    made = [base | {"seq": i} | r for i, r in enumerate(rows)]
    names = [f.strip().split()[0] for f in POINT.split(",")]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], POINT)


def test_ground_state_rules(spark):
    cases = [
        ((True, None, 301, 10.0), ("airborne", "baro_error")), ((True, None, None, 81.0), ("airborne", "speed_override")), ((True, None, 300, 80.0), ("ground", "surface")),
        ((False, 49, None, None), ("ground", "low")), ((False, 49, 199, None), ("ground", "low")), ((False, 49, 200, None), ("airborne", "geom")), ((False, 50, 0, None), ("airborne", "baro")),
        ((False, None, 199, None), ("ground", "geom")), ((None, None, None, None), ("unknown", "unknown")),
    ]
    df = track(spark, [dict(zip(("surface", "baro_ft", "geom_ft", "gs_kt"), c, strict=True)) for c, _ in cases])
    assert [(r.state, r.reason) for r in points.classified(df).orderBy("seq").collect()] == [e for _, e in cases]


def test_gap_classes(spark):
    cases = [
        ((None, 10.0, 1.0, 1.0), "unknown"), ((2999, 10.0, 1.0, 1.0), "coverage_hole"), ((20000, None, 1.0, 1.0), "coverage_hole"), ((20000, 301.0, 1.0, 1.0), "coverage_hole"), ((20000, 10.0, 0.29, 0.29), "coverage_hole"),
        ((15000, 200.0, 0.7, 0.7), "likely_transponder_off"), ((14999, 200.0, 0.7, 0.7), "unknown"), ((15000, 201.0, 0.7, 0.7), "unknown"), ((15000, 10.0, 0.69, 1.0), "unknown"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, alt_ft int, nearest_nm double, pre_adsb double, post_adsb double")
    assert [r.gap_class for r in tracks.classify_gaps(df).orderBy("i").collect()] == [e for _, e in cases]


def plain_dedupe(rows):
    kept, last = [], None
    for r in rows:
        if not (last and abs(r[0] - last[0]) < 1 and abs(r[1] - last[1]) < 0.001 and abs(r[2] - last[2]) < 0.001):
            kept.append(r)
            last = r
    return kept


def test_dedupe_compares_with_the_last_kept_point(spark):
    rng = random.Random(1)
    rows = [{"ts": rng.randint(0, 60), "lat": 10 + rng.randint(0, 4) * 0.0006} for _ in range(300)]
    found = flights.deduplicated(track(spark, rows)).collect()
    ordered = sorted((r["ts"], r["lat"], 20.0, i) for i, r in enumerate(rows))
    ordered.sort(key=lambda r: (r[0], r[3]))
    assert sorted(r.seq for r in found) == sorted(r[3] for r in plain_dedupe(ordered))


def test_state_machine_labels():
    c = DEFAULT
    label = lambda s, ts=None, null=None: flights.label(s, ts or [i * 10 for i in range(len(s))], null or [False] * len(s), c)
    g, a, u = "ground", "airborne", "unknown"
    assert [r for _, r in label([g, a, a, g, g, a, u])] == ["none", "airborne", "airborne", "landing", "post_ground", "airborne", "airborne"]
    assert [f for f, _ in label([g, a, a, g, g, a, u])] == [0, 1, 1, 1, 1, 2, 2]
    assert [r for _, r in label([a, g, g, g, g, g, g])] == ["airborne", "landing"] + ["post_ground"] * 4 + ["none"]
    assert [r for _, r in label([a, g, g, g], [0, 10, 71, 72])] == ["airborne", "landing", "post_ground", "none"]
    assert [r for _, r in label([a, g, a, g, g], null=[False, True, False, True, False])] == ["airborne", "airborne", "airborne", "airborne", "landing"]


def test_flights_of_a_simple_day(spark):
    up = [{"ts": i * 60, "surface": True, "baro_ft": None, "geom_ft": None, "gs_kt": 10.0} for i in range(2)]
    up += [{"ts": 120 + i * 60, "baro_ft": 5000, "lat": 10 + i * 0.1} for i in range(20)]
    down = [{"ts": 1320 + i * 10, "surface": True, "baro_ft": None, "geom_ft": None, "gs_kt": 20.0, "lat": 12.0} for i in range(3)]
    rows = flights.flights(track(spark, up + down)).collect()
    assert len(rows) == 1
    f = rows[0]
    assert (f.takeoff_ts, f.first_ts, f.landing_ts, f.mid_air, f.fragments, f.landed, f.max_alt_ft, f.n_points, f.minutes) == (60, 120, 1320, False, 1, True, 5000, 23, 20.3)


def test_stitching_is_pairwise(spark):
    rows = [{"ts": leg * 3000 + i * 60, "lat": 10 + (leg * 10 + i) * 0.05, "baro_ft": 20000} for leg in range(3) for i in range(10)]
    found = sorted(flights.flights(track(spark, rows)).collect(), key=lambda r: r.takeoff_ts)
    assert [(r.takeoff_ts, r.fragments, r.signal_gaps) for r in found] == [(0, 2, 1), (6000, 1, 0)]


def test_an_observed_takeoff_is_not_stitched(spark):
    lost = [{"ts": i * 60, "lat": 10 + i * 0.05, "baro_ft": 6000, "callsign": "AB1"} for i in range(12)]
    ground = [{"ts": 4260 + i * 60, "surface": True, "baro_ft": None, "geom_ft": None, "gs_kt": 8.0, "lat": 10.6} for i in range(3)]
    up = [{"ts": 4440 + i * 60, "lat": 10.6 + i * 0.05, "baro_ft": 500 + i * 500} for i in range(12)]
    first, second = sorted(flights.flights(track(spark, lost + ground + up)).collect(), key=lambda r: r.takeoff_ts)
    assert (first.mid_air, first.takeoff_ts, first.landed, first.fragments) == (True, 0, False, 1)
    assert (second.mid_air, second.takeoff_ts, second.takeoff_lat, second.first_ts, second.callsign) == (False, 4380, 10.6, 4440, "AB1")


def test_touch_and_go_shares_its_point(spark):
    up = [{"ts": i * 60, "lat": 10 + i * 0.05} for i in range(10)]
    touch = [{"ts": 600, "surface": True, "baro_ft": None, "geom_ft": None, "gs_kt": 60.0, "lat": 10.5}]
    again = [{"ts": 630 + i * 60, "lat": 10.5 + i * 0.05} for i in range(10)]
    first, second = sorted(flights.flights(track(spark, up + touch + again)).collect(), key=lambda r: r.takeoff_ts)
    assert (first.landing_ts, first.last_ts, first.n_points) == (600, 630, 12)
    assert (second.takeoff_ts, second.first_ts, second.n_points, second.mid_air) == (600, 630, 10, False)


def test_turnarounds(spark):
    legs = spark.createDataFrame([("a", i, t, t + 600) for i, t in enumerate([0, 1200, 20_000, 100_000, 500_000])], "icao string, session long, takeoff_ts long, landing_ts long")
    rows = tracks.turnarounds(legs).orderBy("session").collect()
    assert [r.category for r in rows] == ["first_observed", "quick", "overnight", "multi_day", "extended_gap"]
    assert [r.first for r in rows] == [True] + [False] * 4 and [r.last for r in rows] == [False] * 4 + [True]


def test_squawk_runs_are_credited_to_the_held_code(spark):
    codes = ["1200", "1200", "7700", "7700", "1200", None]
    rows = tracks.changes(track(spark, [{"ts": i * 10, "squawk": c} for i, c in enumerate(codes)]), "squawk", "icao").orderBy("ts").collect()
    assert [(r.value, r.held_s) for r in rows] == [("1200", 20), ("7700", 20), ("1200", 0)]


def test_hovers(spark):
    rows = [{"ts": i * 10, "gs_kt": 3.0 if 3 <= i <= 6 or i == 9 else 50.0} for i in range(12)]
    assert [(r.start_ts, r.end_ts, r.n) for r in tracks.hovers(track(spark, rows)).collect()] == [(30, 60, 4)]


def test_spoof_day(spark):
    rows = [{"ts": i, "sil": 0 if i >= 40 else 3, "nic": 0 if i >= 40 else 8} for i in range(60)] + [{"icao": "b", "ts": i, "sil": 0} for i in range(24)]
    found = {r.icao: r for r in rollups.spoof_scores(track(spark, rows)).collect()}
    assert (found["a"].v2, found["a"].sil0, found["a"].nic0, found["a"].flagged) == (60, 20, 20, True) and not found["b"].flagged


def test_registry_vote_ties_go_to_the_latest(spark):
    rows = [("a", "X", "x", "N1", 1), ("a", "Y", "y", "N2", 2), ("a", None, None, "N3", 3), ("b", None, None, "N4", 1)]
    found = {r.icao: tuple(r)[1:] for r in rollups.registry_vote(spark.createDataFrame(rows, "icao string, type_code string, description string, registration string, fetched_at long")).collect()}
    assert found == {"a": ("N3", "Y", "y", 1), "b": ("N4", None, None, 0)}


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742 * math.asin(math.sqrt(min(1, h)))


def clusters(pts, eps, least):
    near = [[j for j in range(len(pts)) if haversine(pts[i], pts[j]) <= eps] for i in range(len(pts))]
    core = {i for i in range(len(pts)) if len(near[i]) >= least}
    label = {i: i for i in core}
    while True:
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            break
        label = new
    return {i: label[i] if i in core else min(label[j] for j in near[i] if j in core) for i in range(len(pts)) if i in core or any(j in core for j in near[i])}


@pytest.mark.parametrize("eps, least, few", [(0.2, 3, 4096), (0.2, 9, 1), (0.35, 2, 30)])
def test_dbscan_against_brute_force(spark, monkeypatch, eps, least, few):
    monkeypatch.setattr(spatial, "PAIRS", few)
    rng = random.Random(20260417)
    centres = [(60.0, 10.0), (60.01, 10.0), (-33.0, 151.0), (0.0, 0.0), (-0.0021, 0.0003)]
    pts = [(la + rng.gauss(0, 0.00045), lo + rng.gauss(0, 0.0009)) for la, lo in centres for _ in range(40)]
    pts += [(rng.uniform(59, 61), rng.uniform(9, 11)) for _ in range(60)] + [pts[0]] * 3
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, lat double, lon double")
    assert {r.id: r.cluster for r in spatial.dbscan(df, eps, least).collect()} == clusters(pts, eps, least)


def test_a_pad_with_most_of_the_landings_takes_linear_rows(spark):
    n = 60_000
    df = spark.range(n).select("id", (45 + F.rand(1) * 0.0008).alias("lat"), (7 + F.rand(2) * 0.0011).alias("lon"))
    far = spark.createDataFrame([(n + 1, 45.0011, 7.0), (n + 2, 45.3, 7.0)], "id long, lat double, lon double")
    found = spatial.dbscan(df.unionByName(far)).groupBy("cluster").count().collect()
    assert [tuple(r) for r in found] == [(0, n + 1)]


def test_backfill_takes_both_ends_and_the_last_of_equal_pads(spark):
    pads = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.002), (3, 60.0, 20.0)], "pad long, lat double, lon double")
    rows = [("a", 10.0, 20.001, 60.0, 20.0035), ("b", 10.0, 20.0003, None, None), ("c", 10.01, 20.0, 60.0, 20.004)]
    df = spark.createDataFrame(rows, "k string, takeoff_lat double, takeoff_lon double, landing_lat double, landing_lon double")
    assert {r.k: (r.origin_pad, r.destination_pad) for r in spatial.backfilled(df, pads, ["k"]).collect()} == {"a": (2, 3), "b": (1, None), "c": (None, None)}


def test_nearest_prefers_the_small_box(spark):
    at = spark.createDataFrame([(1, 10.0, 20.0), (2, 50.0, 20.0), (3, -80.0, 0.0)], "k int, lat double, lon double")
    places = spark.createDataFrame([("near", 10.14, 20.14), ("far", 10.0, 20.2), ("other", 50.0, 20.4)], "ident string, lat double, lon double")
    found = {r.k: r.ident for r in spatial.nearest(at, places, ["k"], (0.15, 0.5)).collect()}
    assert found == {1: "near", 2: "other"}


def test_runway_alignment_of_an_approach(spark):
    rows = [{"ts": i * 5, "lat": 10 - (30 - i) * 0.002, "lon": 20.0, "track_deg": 0.0, "baro_ft": 2000 - i * 60} for i in range(30)]
    ends = spark.createDataFrame([("K", 10.0, 20.0, 0, "36", 0.0), ("K", 10.0, 20.0, 0, "18", 180.0)], "ident string, lat double, lon double, elevation_ft int, runway string, heading double")
    found = spatial.runway_alignment(track(spark, rows), ends).collect()
    assert [(r.p_runway, r.start_ts, r.end_ts) for r in found] == [("36", 0, 145)]


def test_takeoff_runway(spark):
    rows = [{"ts": i * 5, "lat": 10 + i * 0.002, "lon": 20.0, "gs_kt": 120.0, "rate_fpm": 900.0, "baro_ft": i * 60} for i in range(1, 25)]
    ends = spark.createDataFrame([("K", 10.0, 20.0, 0, r, h) for r, h in (("36", 0.0), ("18", 180.0), ("09", 90.0))], "ident string, lat double, lon double, elevation_ft int, runway string, heading double")
    assert [(r.runway, r.run_s) for r in spatial.takeoff_runway(track(spark, rows), ends).collect()] == [("36", 115)]


def pairs_of(monkeypatch, name: str) -> list[int]:
    """How many pairs each call of ``spatial.name`` makes, from now on."""
    made, inner = [], getattr(spatial, name)

    def counted(*args, **more):
        found = inner(*args, **more)
        made.append(found.count())
        return found

    monkeypatch.setattr(spatial, name, counted)
    return made


APPROACH = [{"icao": k, "ts": i * 5, "lat": 10 - (30 - i) * 0.002, "lon": 20.0, "track_deg": 0.0, "baro_ft": 2000 - i * 60} for i in range(30) for k in "abc"]
ENDS = "ident string, lat double, lon double, elevation_ft int, runway string, heading double"


def test_alignment_compares_distinct_places_and_runways(spark, monkeypatch):
    made = pairs_of(monkeypatch, "nearby")
    ends = spark.createDataFrame([(f"K{k:02}", 10.0, 20.0, 0, r, h) for k in range(20) for r, h in (("36", 0.0), ("18", 180.0))], ENDS)
    found = spatial.runway_alignment(track(spark, APPROACH), ends).collect()
    assert sorted((r.icao, r.p_ident, r.p_runway, r.start_ts, r.end_ts, r.n) for r in found) == [(a, f"K{k:02}", "36", 0, 145, 30) for a in "abc" for k in range(20)]
    assert made == [60]  # 30 places, two ends


def test_alignment_at_asked_airports_alone(spark, monkeypatch):
    ends = spark.createDataFrame([(f"K{k:02}", 10.0, 20.0, 0, r, h) for k in range(20) for r, h in (("36", 0.0), ("18", 180.0))], ENDS)
    asked = spark.createDataFrame([("a", "K03"), ("a", "K03"), ("b", "K07"), ("c", "none")], "icao string, p_ident string")
    every = spatial.runway_alignment(track(spark, APPROACH), ends).join(asked.distinct(), ["icao", "p_ident"])
    made = pairs_of(monkeypatch, "nearby")
    found = spatial.runway_alignment(track(spark, APPROACH), ends, asked=asked)
    assert found.columns == every.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))
    assert found.count() == 2 and made == [120]  # 30 points of two aircraft, two ends


@pytest.mark.parametrize("gap_s", [7, 20.0])
def test_segments_are_those_of_sorted_points(spark, gap_s):
    rng, t, rows = random.Random(4), -100.0, []
    for i in range(400):
        t += rng.choice([0, 1, gap_s / 2, gap_s, gap_s + 0.25, 3 * gap_s])
        rows.append((rng.choice("ab"), t, i, rng.random()))
    kept = spark.createDataFrame([*rows, ("a", None, 999, 0.5)], "icao string, ts double, seq long, x double")
    expected = []
    for k in "ab":
        runs = []
        for _, t, _, x in (r for r in rows if r[0] == k):
            if not runs or t - runs[-1][-1][0] > gap_s:
                runs.append([])
            runs[-1].append((t, x))
        expected += [(k, r[0][0], r[-1][0], len(r), min(x for _, x in r)) for r in runs if r[-1][0] - r[0][0] >= 3]
    found = spatial.split_on_gaps(kept, ["icao"], gap_s, 3, x=(F.min, "x")).collect()
    assert sorted((r.icao, r.start_ts, r.end_ts, r.n, r.x) for r in found) == sorted(expected)


def test_beacons_of_one_place_are_followed_once(spark, monkeypatch):
    made = pairs_of(monkeypatch, "_within_nm")
    beacons = spark.createDataFrame([(f"V{k:02}", 10.5, 20.0) for k in range(20)] + [("V03", 10.5, 20.0), ("W", 11.0, 20.0), ("W", 60.0, 20.0)], "ident string, lat double, lon double")
    found = spatial.navaid_alignment(track(spark, APPROACH), beacons).collect()
    assert sorted((r.icao, r.p_ident, r.start_ts, r.end_ts, r.n) for r in found) == [(a, v, 0, 145, 30) for a in "abc" for v in [*(f"V{k:02}" for k in range(20)), "W"]]
    assert made == [2]  # one square, two places


def test_nearest_compares_distinct_places(spark, monkeypatch):
    made = pairs_of(monkeypatch, "nearby")
    at = spark.createDataFrame([(k, 10.0, 20.0 + k % 2 * 5) for k in range(60)] + [(60, None, 20.0)], "k int, lat double, lon double")
    places = spark.createDataFrame([(f"K{k:02}", 10.1, 20.1) for k in range(9, -1, -1)] + [("far", 10.0, 25.4), ("A", 10.3, 20.3)], "ident string, lat double, lon double")
    found = {r.k: r.ident for r in spatial.nearest(at, places, ["k"], (0.15, 0.5)).collect()}
    assert found == {k: "far" if k % 2 else "K00" for k in range(60)}
    assert made == [1, 1]  # the large box is looked through only where the small one is empty


def test_takeoff_runways_of_airports_alike_are_found_once(spark, monkeypatch):
    made = pairs_of(monkeypatch, "nearby")
    rows = [{"icao": k, "ts": i * 5, "lat": 10 + i * 0.002, "lon": 20.0, "gs_kt": 120.0, "rate_fpm": 900.0, "baro_ft": i * 60} for i in range(1, 25) for k in "abc"]
    ends = spark.createDataFrame([(f"K{k:02}", 10.0, 20.0, 0, r, h) for k in range(20) for r, h in (("36", 0.0), ("18", 180.0))], ENDS)
    found = spatial.takeoff_runway(track(spark, rows), ends).collect()
    assert sorted(tuple(r) for r in found) == [(a, f"K{k:02}", "36", 115) for a in "abc" for k in range(20)]
    assert made == [48]  # 24 places, two ends


def test_ranges_prefer_the_narrowest(spark):
    a = spark.createDataFrame([("00000a",), ("000014",), ("0000ff",)], "icao string")
    r = spark.createDataFrame([("wide", 0, 100), ("narrow", 8, 12)], "country string, low long, high long")
    assert {x.icao: x.country for x in joins.in_ranges(a, r).collect()} == {"00000a": "narrow", "000014": "wide", "0000ff": None}


def test_interval_join_ends_are_inside(spark):
    m = spark.createDataFrame([("a", t) for t in (99, 100, 5000, 9000, 9001)] + [("b", 100)], "icao string, t long")
    i = spark.createDataFrame([("a", 100, 9000)], "icao string, s long, e long")
    assert sorted(r.t for r in joins.within_intervals(m, i, "icao", "t", "s", "e").collect()) == [100, 5000, 9000]


def test_landing_types(spark):
    landed = [{"ts": i * 10, "baro_ft": 3000 - i * 100, "rate_fpm": -800.0, "gs_kt": 120.0 - i * 4} for i in range(28)] + [{"ts": 280 + i * 5, "surface": True, "baro_ft": None, "geom_ft": None, "gs_kt": 15.0} for i in range(4)]
    lost = [{"icao": "b", "ts": i * 10, "baro_ft": 30000, "gs_kt": 400.0} for i in range(20)]
    dropped = [{"icao": "c", "ts": i * 10, "baro_ft": 4000 - i * 50, "rate_fpm": -600.0, "gs_kt": 150.0} for i in range(20)]
    error = [{"icao": "d", "ts": i * 10, "surface": True, "geom_ft": 5000} for i in range(12)]
    found = {r.icao: r for r in scoring.landings(track(spark, landed + lost + dropped + error)).collect()}
    assert {k: r.landing_type for k, r in found.items()} == {"a": "confirmed", "b": "signal_lost", "c": "dropped", "d": "altitude_error"}
    assert found["a"].confidence > 0.5 and found["b"].confidence == 0


def test_missions(spark):
    rows = [("N911AB", None, None, None, 9000, 1.0, 200.0, None), ("phi21 ", None, None, None, 9000, 1.0, 200.0, None), ("GXMT", None, None, None, 9000, 1.0, 100.0, None), (None, None, "K", "L", 9000, 1.0, 200.0, None), (None, None, "K", "K", 4000, 1.0, 90.0, "C172"), (None, None, "K", "K", 2000, 1.0, 200.0, None), (None, None, None, None, 9000, 4.0, 100.0, None), (None, "Bristow Group Ltd", None, None, 1, 1.0, 1.0, None), ("N1", None, "K", None, 9000, 1.0, 200.0, None), (None,) * 8]
    df = spark.createDataFrame(rows, "callsign string, operator string, origin string, destination string, max_alt_ft int, loiter double, cruise_gs double, type_code string")
    assert [r[0] for r in df.coalesce(1).select(scoring.mission()).collect()] == ["ems_hems", "offshore", "ems_hems", "transport", "training", "pattern", "survey", "offshore", "transport", "unknown"]


def test_trace_points_are_typed(spark):
    trace = '[[0,10.5,20.5,"ground",5.5,90,0,null,null],[1.5,10,20,1200,null,null,0,-64,{"flight":" AB1 ","squawk":"7700","alt_geom":1300,"type":"adsb_icao","version":2,"sil":0,"nic":"x"},"mlat",1250,128,null,null],[2]]'
    days = [("a", "2024-01-01", "net", None, None, None, None, None, 1000.0, t, 3, "x") for t in (trace, "not json", None)]
    rows = traces.typed(traces.decode(spark.createDataFrame(days, traces.TRACE_DAY))).orderBy("seq").collect()
    assert len(rows) == 3
    assert (rows[0].surface, rows[0].baro_ft, rows[0].gs_kt, rows[0].ts) == (True, None, 5.5, 1000.0)
    assert (rows[1].baro_ft, rows[1].geom_ft, rows[1].geom_rate_fpm, rows[1].callsign, rows[1].src, rows[1].version, rows[1].nic) == (1200, 1250, 128.0, "AB1", "mlat", 2, None)
    assert rows[2].lat is None


def test_csv_dimensions(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ident,type,name,latitude_deg,longitude_deg,elevation_ft\nKA,small_airport,A,1.5,2.5,12\nKB,closed,B,1,2,\nKC,heliport,C,x,2,3\n")
    assert [tuple(r) for r in traces.read_airports(spark, str(tmp_path / "a.csv"), ["small_airport", "heliport"]).collect()] == [("KA", "small_airport", "A", 1.5, 2.5, 12)]
    head = "airport_ident,le_ident,le_latitude_deg,le_longitude_deg,le_heading_degT,he_ident,he_latitude_deg,he_longitude_deg,he_heading_degT"
    (tmp_path / "r.csv").write_text(f"{head}\nKA,09,1,2,90,27,1,3,270\nKA,H1,,,,,,,\n")
    assert [r.runway for r in traces.read_runway_ends(spark, str(tmp_path / "r.csv")).collect()] == ["09", "27"]
    (tmp_path / "w.txt").write_text("# fleet\nA00001  # one\nzz\na00002\na00001\n")
    assert [r.icao for r in traces.read_watchlist(spark, str(tmp_path / "w.txt")).collect()] == ["a00001", "a00002"]


def test_reactivation_needs_a_look_inside_the_gap(spark):
    days = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-01"), ("b", "2024-01-01"), ("b", "2024-03-01")], "icao string, d string").select("icao", F.col("d").cast("date").alias("day"))
    before = days.where("day < date '2024-02-01'").groupBy("icao").agg(F.max("day").alias("last_day"))
    log = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-01-01")], "icao string, d string").select("icao", F.col("d").cast("date").alias("date"))
    assert [r.icao for r in watch.reactivations(before, days, log).collect()] == ["a"]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = track(spark, [{"ts": 1_700_000_000 + t} for t in (0, 60, 1000, 9000, 9100)]).withColumn("event_time", F.timestamp_seconds("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    for name, op in (("windows", live.windowed_counts), ("sessions", live.live_sessions)):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = op(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if name == "windows":
            assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, op(rows).collect()))
        assert op(rows).count() == 2


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, None)], "k string, at int, v string")
    assert {r.k: r.v for r in traces.latest(df, ["k"], [F.col("at")]).collect()} == {"a": "new", "b": None}
