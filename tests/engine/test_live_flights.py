"""Live flights against the batch's: any cut of the stream, any order within the lateness, with restarts."""

import random

import pandas as pd
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.operators import flights
from contrail.streaming import flights as live

from .test_operators import track

LATE, CLOCK = 900, "~clock"


@pytest.fixture(scope="module")
def days(spark):
    rng, rows = random.Random(11), []
    for icao in ("a", "b", "c", "d"):
        t, lat = 1_700_000_000, 10.0
        while t < 1_700_000_000 + 90_000:
            t += rng.choice([5, 20, 60, 60, 300, 300, 2500, 6000, 9000] if rng.random() < 0.2 else [30, 60])
            lat += rng.choice([0.0, 0.01, 0.02])
            phase = (t // 1500) % 5
            ground = phase == 0 and rng.random() < 0.85
            alt = None if ground else rng.choice([2000, 2500, 4000, 9000])
            rows.append({"icao": icao, "ts": t, "lat": lat, "surface": ground, "baro_ft": alt, "geom_ft": alt, "gs_kt": None if rng.random() < 0.2 else 20.0 if ground else 200.0, "callsign": rng.choice([None, None, None, "AB1", "CD2"])})
    return [r | {"seq": i} for i, r in enumerate(rows)]


def shown(df, columns):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())


def ran(spark, tmp_path, name, batches, types=None):
    """Rows of the stream over the batches, each appended and then run to its end: a restart from the checkpoint each time."""
    folder = tmp_path / name
    for batch in batches:
        df = track(spark, batch).withColumn("event_time", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(folder / "in"))
        live.run_to_end(stream, str(folder / "out"), str(folder / "progress"), types=types, late_s=LATE, keep_s=3600)
    return spark.read.parquet(str(folder / "out"))


def cut(rows, rng, parts):
    """The points in order of time but for delays within the lateness, in batches, and a clock that ends them all."""
    order = sorted(rows, key=lambda r: r["ts"] + rng.randint(0, LATE - 1))
    ends = sorted(rng.sample(range(1, len(order)), parts - 1))
    batches = [order[i:j] for i, j in zip([0, *ends], [*ends, len(order)], strict=True)]
    return [*batches, [{"icao": CLOCK, "ts": 1_800_000_000, "seq": -1, "surface": None, "baro_ft": None, "geom_ft": None}]]


def test_a_cut_stream_gives_the_rows_of_the_batch(spark, tmp_path, days):
    types = spark.createDataFrame([("a", "C17"), ("b", "C172")], "icao string, type_code string")
    batch = flights.flights(track(spark, days), types=types)
    expected = shown(batch, batch.columns)
    assert len(expected) > 30 and any("2" == r[batch.columns.index("fragments")] for r in expected)
    found = ran(spark, tmp_path, "cut", cut(days, random.Random(1), 5), types)
    assert shown(live.settled_flights(found), batch.columns) == expected
    assert found.where("kind = 'late'").count() == 0


def test_points_behind_the_mark_come_out_as_late(spark, tmp_path, days):
    newest = max(r["ts"] for r in days)
    behind = [r | {"ts": newest - 1000 - i, "seq": 9000 + i} for i, r in enumerate(days[:5])]
    gone = [r | {"ts": newest - 9000, "seq": 9100} for r in days[:1]]
    *batches, clock = cut(days, random.Random(2), 2)
    found = ran(spark, tmp_path, "late", [*batches, [*behind, *gone], clock])
    assert sorted(r.seq for r in found.where("kind = 'late'").collect()) == [r["seq"] for r in behind]
    batch = flights.flights(track(spark, days))
    assert shown(live.settled_flights(found), batch.columns) == shown(batch, batch.columns)


def test_the_aircraft_alone_against_the_batch(spark, days):
    """The fold of one aircraft without Spark, its state dumped and read again after each point."""
    batch = flights.flights(track(spark, days))
    states = {r.seq: r.state for r in live.classified(track(spark, days)).select("seq", "state").collect()}
    rows = []
    for icao in ("a", "b", "c", "d"):
        a = live.Aircraft(live.DEFAULT)
        done = []
        for r in sorted((r for r in days if r["icao"] == icao), key=lambda r: (r["ts"], r["seq"])):
            p = {**r, "lon": 20.0, "state": states[r["seq"]], "height": r["baro_ft"], "stitch_s": 5760.0}
            a = live.Aircraft(live.DEFAULT, a.dumped())
            done += a.at(r["ts"] - 1) + a.point({c: p[c] for c in live.POINT})
        done += a.at(1 << 40) + a.at(1 << 40)
        rows += [{"icao": icao, "fragments": 1, **f} for f in done]
    names = ["icao", "fragments", *live.FIRST, "callsign", *live.LAST, "n_points", *live.GREATEST]
    assert sorted(tuple(str(r.get(c)) for c in names) for r in rows) == shown(batch, names)


class Kept:
    """A value, a list and timers, as a handle gives them, with their accesses counted."""

    def __init__(self):
        self.held, self.timers, self.asked = None, [], 0

    def getValueState(self, *_):
        self.value = Kept()
        return self.value

    def getListState(self, *_):
        self.list = Kept()
        return self.list

    def exists(self):
        return self.held is not None

    def get(self):
        self.asked += 1
        return self.held

    def update(self, x):
        self.asked, self.held = self.asked + 1, x

    put = update

    def clear(self):
        self.held = None

    def listTimers(self):
        return self.timers

    def deleteTimer(self, t):
        self.timers = [x for x in self.timers if x != t]

    def registerTimer(self, t):
        self.timers = [*self.timers, t]


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return int((self.mark - 86400) * 1000)


def test_aircraft_of_a_bucket_are_read_and_written_at_once():
    schema = T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "icao", "first_ts", "last_ts", "n_points", "seq")])
    processor, handle = live.LiveFlights(live.DEFAULT, 3600, 86400, schema, None), Kept()
    processor.init(handle)
    point = {"lat": 1.0, "lon": 2.0, "state": "airborne", "gs_kt": 200.0, "callsign": None, "baro_ft": 9000, "height": 9000, "stitch_s": 5400.0}
    rows = [{"icao": f"{k:02}", "ts": 1_000_000 + k + i * 60, "seq": i, **point} for k in range(50) for i in range(5)]
    assert list(processor.handleInputRows((0,), iter([pd.DataFrame(rows)]), Clock(1_000_000 - 3600))) == []
    assert (handle.value.asked, handle.list.asked, len(handle.timers)) == (1, 1, 1)
    assert list(processor.handleExpiredTimer((0,), Clock(1_001_000), None)) == []  # all in the air
    found = pd.concat(processor.handleExpiredTimer((0,), Clock(1_100_000), None))
    assert sorted(zip(found.icao, found.kind, found.first_ts, found.n_points)) == [(f"{k:02}", "flight", 1_000_000 + k, 5) for k in range(50)]
    assert (handle.value.asked, handle.timers) == (5, [])
