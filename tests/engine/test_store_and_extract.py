"""The trace store's plans, and incremental extracts against full ones."""

import random
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from contrail.operators import extract, rollups, tracks
from contrail.sources import store as stores

from .test_operators import track


def fleet(seed):
    """Points of a few aircraft over weeks: days in a row, gaps of one to five days, flights over midnight, quiet callsigns."""
    rng, rows = random.Random(seed), []
    for icao in ("a00001", "a00002", "ae6901", "c00001"):
        day = 19_000
        while day < 19_030:
            t = day * 86400 + rng.choice([3600, 40_000, 80_000])
            for _ in range(rng.randint(1, 3)):
                ground, lat = rng.random() < 0.7, 10 + rng.random()
                for k in range(rng.randint(4, 25)):
                    t += rng.choice([60, 120, 240])
                    surface = ground and k in (0, 1) or rng.random() < 0.05
                    lat += 0.02
                    alt = None if surface else rng.choice([3000, 4000])
                    rows.append({"icao": icao, "ts": t, "lat": lat, "surface": surface, "baro_ft": alt, "geom_ft": alt, "gs_kt": 30.0 if surface else 150.0, "callsign": rng.choice([None] * 9 + ["AB1", "CD2"]), "sil": rng.choice([0, 3]), "src": rng.choice(["adsb_icao", "mlat"])})
                t += rng.choice([900, 2400, 4000, 20_000])
            day = t // 86400 + rng.choice([1, 1, 2, 3, 4, 6])
    return [r | {"seq": i} for i, r in enumerate(rows)]


def day_of(r):
    return r["ts"] // 86400


def opened(spark, tmp_path, rows, buckets=4):
    name = f"trace_{tmp_path.name.replace('-', '_')}_{random.randrange(1 << 40)}"
    return stores.TraceStore(spark, name, f"file://{tmp_path}/store", buckets).open(track(spark, rows[:1]).schema)


def shown(df):
    names = sorted(df.columns)
    return sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_increments_in_any_order_equal_a_full_run(spark, tmp_path):
    rows, rng = fleet(2), random.Random(2)
    types = spark.createDataFrame([("a00001", "C17")], "icao string, type_code string")
    days = sorted({day_of(r) for r in rows})
    store = opened(spark, tmp_path, rows)
    table, spoofs = (extract.FlightTable(spark, f"file://{tmp_path}/{x}", 3) for x in ("flights", "spoofs"))
    # a late day, and later a tail in two steps, one of which fetches a day again with fewer points before
    cut = rng.randrange(len(days) // 2, len(days) - 3)
    late = rng.choice(days[3:cut])
    again = days[cut]
    store.put(track(spark, [r for r in rows if day_of(r) < again and day_of(r) != late]))
    extract.full_extract(store, table, spoofs, types=types)
    for part, since in (([r for r in rows if day_of(r) == again][::2], again), ([r for r in rows if day_of(r) == late], late), ([r for r in rows if day_of(r) >= again], again)):
        before, old = files(tmp_path / "flights"), files(tmp_path / "store" / "points")
        store.put(track(spark, part))
        first = date(1970, 1, 1) + timedelta(days=since)
        bounds = {r.icao: r.boundary for r in extract.windows(store, table.read(), str(first), types=types).collect()}
        extract.incremental_extract(store, table, spoofs, str(first), types=types)
        earliest = min(bounds.values(), default=None)
        for name, written in before.items():
            if earliest and name.split("day=")[1][:10] < str(earliest):
                assert files(tmp_path / "flights").get(name) == written
        touched = {str(date(1970, 1, 1) + timedelta(days=day_of(r))) for r in part}
        assert all(files(tmp_path / "store" / "points").get(n) == t for n, t in old.items() if n.split("day=")[1][:10] not in touched)
    whole = track(spark, rows)
    expected = extract.extracted(whole, types=types)
    assert expected.count() > 40
    assert shown(table.read()) == shown(expected)
    flagged = rollups.spoof_scores(whole).where("flagged").count()
    assert spoofs.read().count() == flagged > 0
    assert bounds["ae6901"] == min(date(1970, 1, 1) + timedelta(days=day_of(r)) for r in rows if r["icao"] == "ae6901")


def test_flights_that_vanish_leave_no_rows(spark, tmp_path):
    rows = [{"icao": "a00001", "ts": d * 86400 + 60 * k, "lat": 10 + 0.05 * k, "seq": d * 100 + k} for d in (100, 110) for k in range(20)]
    store = opened(spark, tmp_path, rows)
    table, spoofs = (extract.FlightTable(spark, f"file://{tmp_path}/{x}", 2) for x in ("flights", "spoofs"))
    store.put(track(spark, rows))
    extract.full_extract(store, table, spoofs)
    assert table.read().count() == 2
    store.put(track(spark, rows[20:21]))
    extract.incremental_extract(store, table, spoofs, str(date(1970, 1, 1) + timedelta(days=110)))
    assert [r.day for r in table.read().collect()] == [date(1970, 1, 1) + timedelta(days=100)]
    extract.incremental_extract(store, table, spoofs, "2100-01-01")
    assert table.read().count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_store_plans_no_exchange_and_prunes_days(spark, tmp_path):
    rows = fleet(3)
    store = opened(spark, tmp_path, rows)
    store.put(track(spark, rows))
    points = store.points()
    for df in (tracks.sessions(points, spread=False), tracks.gaps(points, spread=False), rollups.spoof_scores(points)):
        assert "Exchange" not in plan(df) and "SelectedBucketsCount: 4 out of 4" in plan(df)
    assert "Exchange" in plan(tracks.sessions(track(spark, rows), spread=False))
    some = points.where("day >= date '2022-01-20'")
    assert "PartitionFilters: [isnotnull(day" in plan(some) and some.count() == sum(day_of(r) >= 19_012 for r in rows)
    # another session's view of the folder, and the statistics as they were written
    again = stores.TraceStore(spark, store.name + "_b", store.folder, 4).open(track(spark, rows[:1]).schema)
    assert again.points().count() == len(rows)
    assert shown(rollups.scores_of(store.days()).select("icao", "v2", "sil0", "nic0", "first_ts", "sil0_pct", "flagged", "sources", "callsign")) == shown(rollups.spoof_scores(track(spark, rows)).drop("day"))


def test_a_day_fetched_again_wins(spark, tmp_path):
    rows = [{"icao": i, "ts": 86400 * d + k, "seq": k, "lat": 1.0} for i in "ab" for d in (1, 2) for k in range(3)]
    store = opened(spark, tmp_path, rows)
    store.put(track(spark, rows))
    store.put(track(spark, [{"icao": "a", "ts": 86400, "seq": 9, "lat": 2.0}]))
    assert sorted((r.icao, r.day.day, r.n_points) for r in store.days().collect()) == [("a", 2, 1), ("a", 3, 3), ("b", 2, 3), ("b", 3, 3)]
    assert store.points().where("icao = 'a' and lat = 2.0").count() == 1 and store.points().count() == 10
    store.put(track(spark, rows[:1]).limit(0))
    assert store.points().count() == 10
    assert store.points().where(F.col("day").isNull()).count() == 0
