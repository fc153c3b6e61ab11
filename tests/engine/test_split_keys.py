"""Scans of one aircraft in chunks against single windows."""

import random

import pytest

from contrail.operators import joins, tracks

from .test_operators import track


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = random.Random(9), []
    for icao, n in (("hot", 1200), ("b", 40), ("c", 1)):
        t = 1_000_000
        for _ in range(n):
            t += rng.choice([0, 1, 10, 60, 200, 299, 301, 310, 700, 1799, 1800, 1801, 5000])
            rows.append({"icao": icao, "ts": t, "lat": 10 + rng.randrange(3) * 0.1, "src": rng.choice(["adsb_icao", "mlat", None]), "surface": rng.random() < 0.1, "baro_ft": rng.choice([None, 1000, 20000])})
    return track(spark, [r | {"seq": i} for i, r in enumerate(rows)]).cache()


def shown(df):
    return sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("chunk", [300, 3600, 86400])
def test_chunks_give_what_one_window_gives(points, monkeypatch, chunk):
    monkeypatch.setattr(tracks, "CHUNK_S", chunk)
    for scan in (tracks.sessions, tracks.gaps, tracks.fragments):
        expected = shown(scan(points, spread=False))
        assert len(expected) > 100 and shown(scan(points)) == expected


def test_one_aircraft_is_spread_over_tasks(spark, points, monkeypatch):
    monkeypatch.setattr(tracks, "CHUNK_S", 20_000)
    one = points.where("icao = 'hot'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [len(p) for p in tracks.sessions(one).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 1200 and max(sizes) < 800 and sum(n > 0 for n in sizes) == 4


@pytest.mark.parametrize("chunk", [100, 86400])
def test_as_of_against_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(tracks, "CHUNK_S", chunk)
    rng = random.Random(3)
    told = [(k, rng.randrange(1000), i, rng.choice(["x", "y", None])) for k in "ab" for i in range(60)] + [("a", None, 99, "never")]
    asked = [(k, rng.randrange(-50, 1100), i) for i, k in enumerate("aab" * 30)] + [("a", None, 500), ("c", 10, 501)]
    right = spark.createDataFrame(told, "k string, ts long, n long, v string")
    left = spark.createDataFrame(asked, "k string, ts long, i long")
    for within, before in ((None, False), (None, True), (60, False)):
        expected = set()
        for k, ts, i in asked:
            fit = [(t, n, v) for key, t, n, v in told if key == k and t is not None and ts is not None and (t < ts if before else t <= ts)]
            t, _, v = max(fit, key=lambda x: x[:2], default=(None, None, None))
            expected.add((k, ts, i, *((t, v) if t is None or within is None or ts - t <= within else (None, None))))
        found = joins.as_of(left, right, "k", "ts", ["v"], ["n"], within, before).collect()
        assert len(found) == len(asked) and {tuple(r) for r in found} == expected


def test_long_intervals_take_few_rows(spark):
    rng = random.Random(4)
    year = 365 * 86400
    spans = [(k, i, s, s + rng.choice([-5, 0, 10, 4000, 90_000, 700_000, 3 * year, 40 * year])) for k in "abc" for i in range(30) for s in [rng.randrange(50 * year)]]
    spans += [("d", 0, -5, None), ("d", 1, 0, 20_000 * year)]
    said = [(rng.choice("abcd"), t) for s in spans for t in (s[2], (s[3] or 0), (s[3] or 0) + 1, rng.randrange(50 * year))]
    m, i = spark.createDataFrame(said, "k string, t long"), spark.createDataFrame(spans, "k string, i long, s long, e long")
    found = joins.within_intervals(m, i, "k", "t", "s", "e")
    expected = sorted((k, t, j) for k, t in said for key, j, s, e in spans if key == k and e is not None and s <= t <= e)
    assert sorted((r.k, r.t, r.i) for r in found.collect()) == expected
