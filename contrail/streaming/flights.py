"""Live flights: the batch's state machine and stitching, kept as state by aircraft.

Points may come in any order within ``late_s`` of the newest one. Those ahead of that mark wait in the state; those up to it go
through the machine in order of time, so that a stream gives the rows of ``operators.flights.flights`` over the same points
however it is cut into batches. A point behind the mark can change what is already out: it comes out as it is, with
kind ``late``, for the incremental extract (``operators.extract``). Points over ``keep_s`` behind the mark are dropped by
Spark's watermark, which counts them.

State is kept by buckets of aircraft (``BUCKETS``), as each read and write of a state costs a round trip to it: a bucket's aircraft are
read and written at once. One event-time timer a bucket is set to the next moment at which something is due without a point: waiting
points, a session's end (which closes the flight) or the end of a stitching window (which lets a lone fragment go). What is
remembered of an aircraft is one fragment in the air, one held for stitching, and the waiting points.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.flights import Machine
from ..operators.points import classified
from ..operators.scoring import endurance

POINT = ["ts", "seq", "lat", "lon", "state", "gs_kt", "callsign", "baro_ft", "height", "stitch_s"]
KEPT = ["icao", *POINT]
FIRST = ["takeoff_ts", "takeoff_lat", "takeoff_lon", "mid_air", "first_ts", "first_alt_ft"]
LAST = ["last_ts", "landing_ts", "landing_lat", "landing_lon", "last_lat", "last_lon", "landing_points", "seen_alt_ft", "last_alt_ft"]
GREATEST = ["peak_ft", "max_alt_ft", "max_gs_kt"]
FEET = ["baro_ft", "height"]
WHOLE = ["takeoff_ts", "first_ts", "last_ts", "landing_ts"]
BUCKETS = 1024  # a running query keeps the number it began with


def kilometres(a: float, b: float, c: float, d: float) -> float:
    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 12742 * asin(sqrt(min(1.0, h)))


class Aircraft:
    """What is known of one aircraft: its machine, the fragment in the air and the one held for stitching."""

    def __init__(self, c: Config, known: str | None = None):
        self.c = c
        kept = json.loads(known) if known else {}
        machine = kept.get("machine")
        self.machine = Machine(c, tuple(machine) if machine else None)
        self.last, self.open, self.held, self.stitch_s = (kept.get(x) for x in ("last", "open", "held", "stitch_s"))

    def dumped(self) -> str:
        return json.dumps({"machine": self.machine.remembered(), "last": self.last, "open": self.open, "held": self.held, "stitch_s": self.stitch_s})

    def point(self, p: dict) -> list[dict]:
        """Takes the next point; gives the flights that are settled by it."""
        done = []
        if self.last is not None and p["ts"] - self.last > self.c.session_gap_min * 60:
            done += self.session_over()
        self.last, self.stitch_s = p["ts"], p["stitch_s"]
        _, role, shared, opened = self.machine.step(p["state"], p["ts"], p["lat"], p["lon"], p["gs_kt"], p["callsign"])
        if shared:
            self.record(p, role)
        if opened:
            done += self.close()
            ts, lat, lon, mid_air, said = opened
            self.open = {"takeoff_ts": ts, "takeoff_lat": lat, "takeoff_lon": lon, "mid_air": mid_air, "callsign": said, "n_points": 0, "landing_points": 0}
        if self.open is not None and role != "none":
            self.record(p, role)
            if self.machine.state == "ground":
                done += self.close()
        return done

    def record(self, p: dict, role: str) -> None:
        f = self.open
        f.setdefault("first_ts", p["ts"])
        f["last_ts"], f["last_lat"], f["last_lon"] = p["ts"], p["lat"], p["lon"]
        f["n_points"] += 1
        if role in ("landing", "post_ground"):
            f["landing_points"] += 1
        if role == "landing":
            f["landing_ts"], f["landing_lat"], f["landing_lon"] = p["ts"], p["lat"], p["lon"]
        if p["height"] is not None:
            f["seen_alt_ft"] = p["height"]
            if role == "airborne" and p["state"] == "airborne":
                f["last_alt_ft"] = p["height"]
                f.setdefault("first_alt_ft", p["height"])
                f["peak_ft"] = max(p["height"], f.get("peak_ft", p["height"]))
        for name, x in (("max_alt_ft", p["baro_ft"]), ("max_gs_kt", p["gs_kt"])):
            if x is not None:
                f[name] = max(x, f.get(name, x))

    def session_over(self) -> list[dict]:
        """Forgets all but the callsign, after a gap."""
        self.machine = Machine(self.c, (self.machine.fragment, "none", 0.0, 0, False, None, self.machine.said))
        self.last = None
        return self.close()

    def close(self) -> list[dict]:
        """The fragment in the air is over: noise goes, a pair is joined, one without a landing is held."""
        f, self.open = self.open, None
        if f is None or f["n_points"] < 2:
            return []
        landed = f.get("landing_ts") is not None
        if landed and round((f["last_ts"] - f["first_ts"]) / 60, 1) < self.c.min_flight_min:
            if kilometres(f["takeoff_lat"], f["takeoff_lon"], f["landing_lat"], f["landing_lon"]) < self.c.min_flight_km:
                return []
        held, self.held = self.held, None
        if held is not None and self.joins(held, f):
            both = {**{x: held.get(x) for x in FIRST}, **{x: f.get(x) for x in LAST}, "callsign": held["callsign"] or f["callsign"], "n_points": held["n_points"] + f["n_points"], "fragments": 2}
            return [both | {x: max((v for v in (held.get(x), f.get(x)) if v is not None), default=None) for x in GREATEST}]
        done = [held] if held is not None else []
        if landed:
            return [*done, f]
        self.held = f
        return done

    def joins(self, a: dict, b: dict) -> bool:
        c, gap = self.c, b["first_ts"] - a["last_ts"]
        if not b["mid_air"] or not 0 <= gap <= self.stitch_s:
            return False
        if kilometres(a["last_lat"], a["last_lon"], b["takeoff_lat"], b["takeoff_lon"]) > max(gap, 60) / 3600 * c.stitch_speed_kt * 1.852 * c.stitch_slack:
            return False
        seen, last, first = a.get("seen_alt_ft"), b.get("last_alt_ft"), b.get("first_alt_ft")
        if seen is not None and last is not None and abs(last - seen) > c.stitch_alt_ft:
            return False
        return not (gap > c.stitch_ground_s and first is not None and first < c.stitch_fresh_ft and b.get("peak_ft", 0) - first > c.stitch_climb_ft)

    def at(self, mark: float) -> list[dict]:
        """What is settled when all points up to ``mark`` are in."""
        done = []
        if self.last is not None and mark - self.last > self.c.session_gap_min * 60:
            done += self.session_over()
        if self.held is not None and self.open is None and mark - self.held["last_ts"] > self.stitch_s:
            done, self.held = [*done, self.held], None
        return done

    def due(self) -> float | None:
        """The mark at which something is settled without another point."""
        times = [self.last + self.c.session_gap_min * 60] if self.last is not None else []
        if self.held is not None and self.open is None:
            times.append(self.held["last_ts"] + self.stitch_s)
        return min(times) if times else None


class LiveFlights(StatefulProcessor):
    """Keeps each ``Aircraft`` of a bucket and their waiting points; rows of flights and of late points come out."""

    def __init__(self, c: Config, late_s: float, keep_s: float, schema: T.StructType, waiting: T.StructType):
        self.c, self.late_s, self.keep_s, self.schema, self.kind = c, late_s, keep_s, schema, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("aircraft", "state string")
        self.waiting = handle.getListState("waiting", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, new = self.mark(timerValues), [], []
        for frame in rows:
            # pandas holds whole numbers beside nulls as floats
            columns = ([None if pd.isna(v) else int(v) if c in FEET else v for v in frame[c].tolist()] for c in KEPT)
            for values in zip(*columns, strict=True):
                p = dict(zip(KEPT, values, strict=True))
                (late if mark is not None and p["ts"] <= mark else new).append(p)
        yield from self.settled(key, mark, new, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settled(key, self.mark(timerValues), [], [])

    def mark(self, timer_values) -> float | None:
        """Up to where all points are in, in seconds; None before the first watermark."""
        ms = timer_values.getCurrentWatermarkInMs()
        return ms / 1000 + self.keep_s if ms > 0 else None

    def settled(self, key, mark: float | None, new: list[dict], late: list[dict]) -> Iterator[pd.DataFrame]:
        kept = self.known.get() if self.known.exists() else None
        known, done = json.loads(kept[0]) if kept else {}, []  # by icao: what is known of it, and when that is due
        points = [dict(zip(KEPT, p, strict=True)) for p in self.waiting.get()] if self.waiting.exists() else []
        ready, left = defaultdict(list), []
        for p in points + new:
            (ready[p["icao"]] if mark is not None and p["ts"] <= mark else left).append(p)
        over = [x for x, (_, due) in known.items() if mark is not None and due is not None and due < mark]
        for icao in dict.fromkeys([*ready, *over]):
            a, settled = Aircraft(self.c, known[icao][0] if icao in known else None), []
            for p in sorted(ready.get(icao, []), key=lambda p: (p["ts"], p["seq"])):
                settled += a.point(p)
            settled += a.at(mark)
            done += [{"icao": icao, "kind": "flight", "fragments": 1, **f} for f in settled]
            known[icao] = a.dumped(), a.due()
        if ready or not points:
            self.waiting.clear()
            if left:
                self.waiting.put([tuple(p[c] for c in KEPT) for p in left])
        elif new:
            self.waiting.appendList([tuple(p[c] for c in KEPT) for p in new])
        self.known.update((json.dumps(known),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [p["ts"] for p in left] + [due for _, due in known.values() if due is not None]
        if times:
            self.handle.registerTimer(int((min(times) - self.keep_s) * 1000) + 1)
        rows = done + [{"icao": p["icao"], "kind": "late", "first_ts": p["ts"], "seq": p["seq"]} for p in late]
        if rows:
            yield pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in self.schema})

    def close(self) -> None:
        pass


def live_flights(points: DataFrame, c: Config = DEFAULT, types: DataFrame | None = None, late_s: float = 3600, keep_s: float = 86400) -> DataFrame:
    """Flights of a stream of points with event_time, as they are settled: kind, icao and the columns of the batch's flights;
    and late points (kind ``late``, with first_ts and seq). types: icao, type_code, as for the batch. Needs the RocksDB state store."""
    typed = points.join(types.select("icao", "type_code"), "icao", "left") if types is not None else points.withColumn("type_code", F.lit(None).cast("string"))
    window_s = F.greatest(F.lit(float(c.stitch_gap_min)), c.stitch_endurance_ratio * endurance(c=c)) * 60
    lean = classified(typed, c).withColumns({"height": F.coalesce("baro_ft", "geom_ft"), "stitch_s": window_s}).select(F.pmod(F.xxhash64("icao"), F.lit(BUCKETS)).alias("bucket"), "event_time", *KEPT)
    ts = points.schema["ts"].dataType
    kinds = {x: ts for x in WHOLE} | {"mid_air": T.BooleanType(), "callsign": T.StringType(), "max_gs_kt": T.DoubleType()}
    kinds |= {x: T.LongType() for x in ("n_points", "landing_points", "fragments", "seq")} | {x: points.schema["baro_ft"].dataType for x in ("first_alt_ft", "seen_alt_ft", "last_alt_ft", "peak_ft", "max_alt_ft")}
    names = ["fragments", *FIRST, "callsign", *LAST, "n_points", *GREATEST, "seq"]
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("icao", T.StringType()), *(T.StructField(x, kinds.get(x, T.DoubleType())) for x in names)])
    waiting = T.StructType([lean.schema[x] for x in KEPT])
    processor = LiveFlights(c, late_s, keep_s, schema, waiting)
    delay = f"{int((late_s + keep_s) * 1000)} milliseconds"
    return lean.withWatermark("event_time", delay).groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def settled_flights(found: DataFrame) -> DataFrame:
    """The flights among the rows of ``live_flights``, with the columns of the batch's."""
    minutes = F.round((F.col("last_ts") - F.col("first_ts")) / 60, 1)
    rows = found.where("kind = 'flight'").drop("kind", "seq")
    return rows.withColumns({"minutes": minutes, "landed": F.col("landing_ts").isNotNull(), "signal_gaps": F.col("fragments") - 1})


def run_to_end(points: DataFrame, out: str, checkpoint: str, **parameters) -> None:
    """Takes what a stream of points holds now, from where ``checkpoint`` left off, and appends the rows of ``live_flights`` to ``out``."""
    conf, provider = points.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = live_flights(points, **parameters)
        rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(provider, before)
