"""Flight extraction: the folds that are truly sequential, run per session in Arrow batches.

Only three steps need a fold: dropping near-repeats of the previous *kept* point, the ground and airborne state
machine, and the greedy joining of fragments. Points are dealt by (aircraft, session), so that one aircraft's history
spreads over tasks, and sorted; a fold then runs over whole batches and starts anew at each session. Everything else
about a flight is an aggregate over the labelled points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Config
from ..functions.geo import haversine_km
from ..sources.store import written
from .points import classified
from .scoring import endurance
from .tracks import sessions


Fold = Callable[[Iterator[tuple]], Iterator]


def in_order(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """``points`` with session, dealt by it and sorted within."""
    return sessions(points, c).repartition("icao", "session").sortWithinPartitions("icao", "session", "ts", "seq")


def folded(batch: pa.RecordBatch, columns: list[str], key: list, step: list, start: Callable[[], Callable]) -> list:
    """One value a row of ``batch``: what ``step`` says of ``columns``; made anew by ``start`` where a session begins.

    key and step are one-element lists that carry the session and its step from batch to batch.
    """
    out = []
    names = zip(batch.column("icao").to_pylist(), batch.column("session").to_pylist(), strict=True)
    for now, row in zip(names, zip(*(batch.column(x).to_pylist() for x in columns), strict=True), strict=True):
        if now != key[0]:
            key[0], step[0] = now, start()
        out.append(step[0](*row))
    return out


def keeper(c: Config = DEFAULT) -> Callable[[float, float, float], bool]:
    """Whether each next point of a session is kept: not within a second and a thousandth of a degree of the last one kept."""
    last = None

    def step(ts: float, lat: float, lon: float) -> bool:
        nonlocal last
        near = last and abs(ts - last[0]) < c.dedupe_s and abs(lat - last[1]) < c.dedupe_deg and abs(lon - last[2]) < c.dedupe_deg
        if not near:
            last = ts, lat, lon
        return not near

    return step


def deduplicated(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Drops near-repeats of the last point kept, per aircraft and session."""
    cut = in_order(points, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = [None], [None]
        for batch in batches:
            yield batch.filter(pa.array(folded(batch, ["ts", "lat", "lon"], key, step, lambda: keeper(c)), pa.bool_()))

    return cut.mapInArrow(run, cut.schema)


class Machine:
    """The ground and airborne states of one aircraft, point by point. Its attributes are all it remembers.

    A flight opens with the first airborne point, found in mid-air if nothing was known before, else observed: it then took off
    at the last ground point. A ground point lands it, but without speed two are needed. Up to ``post_landing_points`` ground points
    within ``post_landing_s``, and the one that ends that, still belong to it; so does the point by which flying again opens the next.
    """

    def __init__(self, c: Config = DEFAULT, state: tuple | None = None):
        self.limits = c.post_landing_s, c.post_landing_points
        self.fragment, self.state, self.since, self.landed, self.lone, self.ground, self.said = state or (0, "none", 0.0, 0, False, None, None)

    def remembered(self) -> tuple:
        return self.fragment, self.state, self.since, self.landed, self.lone, self.ground, self.said

    def step(self, s: str, ts: float, lat: float, lon: float, gs: float | None = 0.0, callsign: str | None = None) -> tuple:
        """(fragment, role, shared, from) of the next point. Roles: none (of no flight), airborne, landing, post_ground.

        shared: the point also ends the fragment before. from: where and when the flight that opens here took off, and the callsign then.
        """
        self.said = callsign or self.said
        before = self.state
        if before == "air":
            lone, self.lone = self.lone, False
            if s == "ground":
                if gs is None and not lone:
                    self.lone = True
                    return self.fragment, "airborne", False, None
                self.state, self.since, self.landed, self.ground = "post", ts, 1, (ts, lat, lon)
                return self.fragment, "landing", False, None
            return self.fragment, "airborne", False, None
        if s == "airborne":
            self.fragment, self.state = self.fragment + 1, "air"
            seen = self.ground if before != "none" else None
            return self.fragment, "airborne", before == "post", (*(seen or (ts, lat, lon)), seen is None, self.said)
        if s == "ground":
            self.ground = ts, lat, lon
        if before == "post":
            self.landed += s == "ground"
            if ts - self.since > self.limits[0] or self.landed >= self.limits[1]:
                self.state = "ground"
            return self.fragment, "post_ground" if s == "ground" else "airborne", False, None
        if s == "ground":
            self.state = "ground"
        return self.fragment, "none", False, None


def label(states: list[str], ts: list[float], gs_null: list[bool], c: Config = DEFAULT) -> list[tuple[int, str]]:
    """(fragment, role) of each point of one session, in order."""
    step = Machine(c).step
    return [step(s, t, 0.0, 0.0, None if n else 0.0)[:2] for s, t, n in zip(states, ts, gs_null, strict=True)]


def labelled(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """``points`` with session, state, fragment, role, shared and from: (ts, lat, lon, mid_air, callsign) where a fragment opens."""
    cut = classified(in_order(points, c), c)
    kind = cut.schema["ts"].dataType.simpleString()
    added = T.StructType.fromDDL(f"fragment long, role string, shared boolean, `from` struct<ts: {kind}, lat: double, lon: double, mid_air: boolean, callsign: string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = [None], [None]
        for batch in batches:
            found = folded(batch, ["state", "ts", "lat", "lon", "gs_kt", "callsign"], key, step, lambda: Machine(c).step)
            opened = pa.array([f and dict(zip(("ts", "lat", "lon", "mid_air", "callsign"), f, strict=True)) for *_, f in found], to_arrow_type(added["from"].dataType))
            more = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, opened], [*batch.schema.names, *added.names])

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, *added.fields]))


def said_before(points: DataFrame, c: Config = DEFAULT, carried: DataFrame | None = None) -> DataFrame:
    """Per session: the last callsign its aircraft said in any earlier one. A window over sessions, not points.

    carried (icao, callsign): what it said before the first of these points.
    """
    heard = F.col("callsign").isNotNull()
    last = sessions(points, c).groupBy("icao", "session").agg(F.max_by("callsign", F.when(heard, F.struct("ts", "seq"))).alias("last"))
    before = Window.partitionBy("icao").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    rows = last.select("icao", "session", F.last("last", ignorenulls=True).over(before).alias("before"))
    if carried is None:
        return rows
    told = carried.select("icao", F.col("callsign").alias("told"))
    return rows.join(told, "icao", "left").select("icao", "session", F.coalesce("before", "told").alias("before"))


def recorded(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The labelled points that belong to a fragment; one that ends a fragment and opens the next counts for both."""
    flown = labelled(points, c).where((F.col("fragment") > 0) & (F.col("role") != "none"))
    of = F.explode(F.when(F.col("shared"), F.array("fragment", F.col("fragment") - 1)).otherwise(F.array("fragment"))).alias("of")
    rows = flown.select("*", of)
    return rows.withColumns({"from": F.when(F.col("of") == F.col("fragment"), F.col("from")), "fragment": F.col("of")}).drop("of", "shared")


def fragments_of(points: DataFrame, c: Config = DEFAULT, carried: DataFrame | None = None) -> DataFrame:
    """One row a flight fragment. carried: as for ``said_before``."""
    return summed(recorded(points, c), said_before(points, c, carried))


def summed(rows: DataFrame, said: DataFrame) -> DataFrame:
    """One row a flight fragment, of ``recorded`` points and what was said before each session."""
    at = F.struct("ts", "seq")
    air, height = F.col("role") == "airborne", F.coalesce("baro_ft", "geom_ft")
    flying = air & (F.col("state") == "airborne") & height.isNotNull()
    landing = F.struct("ts", "lat", "lon")
    rows = rows.groupBy("icao", "session", "fragment").agg(
        F.max("from").alias("from"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(F.col("role") == "landing", landing)).alias("landing"),
        F.count("*").alias("n_points"),
        F.count_if(F.col("role").isin("landing", "post_ground")).alias("landing_points"),
        F.min_by(F.struct("lat", "lon"), at).alias("first"),
        F.max_by(F.struct("lat", "lon"), at).alias("last"),
        F.max_by(height, F.when(height.isNotNull(), at)).alias("seen_alt_ft"),
        F.max_by(height, F.when(flying, at)).alias("last_alt_ft"),
        F.min_by(height, F.when(flying, at)).alias("first_alt_ft"),
        F.max(F.when(flying, height)).alias("peak_ft"),
        F.max("baro_ft").alias("max_alt_ft"),
        F.max("gs_kt").alias("max_gs_kt"),
    )
    named = rows.join(said, ["icao", "session"]).select(
        "icao", "session", "fragment",
        F.col("from.ts").alias("takeoff_ts"), F.col("from.lat").alias("takeoff_lat"), F.col("from.lon").alias("takeoff_lon"), F.col("from.mid_air").alias("mid_air"),
        F.coalesce("from.callsign", "before").alias("callsign"),
        "first_ts", "last_ts", F.col("landing.ts").alias("landing_ts"), F.col("landing.lat").alias("landing_lat"), F.col("landing.lon").alias("landing_lon"), "n_points", "landing_points",
        F.col("first.lat").alias("first_lat"), F.col("first.lon").alias("first_lon"), F.col("last.lat").alias("last_lat"), F.col("last.lon").alias("last_lon"),
        "seen_alt_ft", "last_alt_ft", "first_alt_ft", "peak_ft", "max_alt_ft", "max_gs_kt",
    )
    return named


def whole_enough(fragments: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Without single points and short hops. This comes before stitching, so that no sliver is joined to a flight."""
    minutes = F.round((F.col("last_ts") - F.col("first_ts")) / 60, 1)
    km = haversine_km(F.col("takeoff_lat"), F.col("takeoff_lon"), F.col("landing_lat"), F.col("landing_lon"))
    short = F.col("landing_ts").isNotNull() & (minutes < c.min_flight_min) & (km < c.min_flight_km)
    return fragments.where((F.col("n_points") > 1) & ~short)


def stitched(fragments: DataFrame, c: Config = DEFAULT, types: DataFrame | None = None) -> DataFrame:
    """Joins a fragment without a landing to the next one found in mid-air, pair by pair from the left.

    How long a gap may be follows the type's endurance (types: icao, type_code). A long gap before a fragment that begins
    low and climbs away is a new departure and stays one. Adds flight: the session and fragment of the first of the pair. Pairs
    that may join are marked by lead; only the choice among overlapping pairs is a fold, over runs of marked rows: every
    second mark of a run counts.
    """
    order = ["session", "fragment"]
    w = Window.partitionBy("icao").orderBy(*order)
    nxt = lambda x: F.lead(x).over(w)
    gap = nxt("first_ts") - F.col("last_ts")
    km = haversine_km(F.col("last_lat"), F.col("last_lon"), nxt("takeoff_lat"), nxt("takeoff_lon"))
    reach = F.greatest(gap, F.lit(60)) / 3600 * c.stitch_speed_kt * 1.852 * c.stitch_slack
    typed = fragments.join(types.select("icao", "type_code"), "icao", "left") if types is not None else fragments.withColumn("type_code", F.lit(None).cast("string"))
    window_s = F.greatest(F.lit(float(c.stitch_gap_min)), c.stitch_endurance_ratio * endurance(c=c)) * 60
    peak = F.coalesce(nxt("peak_ft"), F.lit(0))
    fresh = (gap > c.stitch_ground_s) & (nxt("first_alt_ft") < c.stitch_fresh_ft) & (peak - nxt("first_alt_ft") > c.stitch_climb_ft)
    level = F.coalesce(F.abs(nxt("last_alt_ft") - F.col("seen_alt_ft")) <= c.stitch_alt_ft, F.lit(True))
    joins = F.col("landing_ts").isNull() & nxt("mid_air") & gap.between(0, window_s) & (km <= reach) & level & ~F.coalesce(fresh, F.lit(False))
    marked = typed.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    ran = marked.withColumn("_run", F.coalesce(F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("icao", "_run").orderBy(*order))
    # within a run the marks alternate: first of a pair, second of a pair
    placed = ran.withColumn("_second", F.pmod(place, F.lit(2)) == 0)
    name = F.struct(*order)
    return placed.withColumn("flight", F.when(F.col("_second"), F.lag(name).over(w)).otherwise(name)).drop("_joins", "_run", "_second", "type_code")


def merged(parts: DataFrame) -> DataFrame:
    """One row a flight, of the fragments that ``stitched`` gave it: the takeoff of the first, the end of the last, sums and greatest."""
    at = F.struct("session", "fragment")
    first, last = (lambda x: F.min_by(x, at).alias(x)), (lambda x: F.max_by(x, at).alias(x))
    whole = parts.groupBy("icao", "flight").agg(
        F.count("*").alias("fragments"),
        *map(first, ["takeoff_ts", "takeoff_lat", "takeoff_lon", "mid_air", "first_ts", "first_alt_ft"]),
        F.min_by("callsign", F.when(F.col("callsign").isNotNull(), at)).alias("callsign"),
        *map(last, ["last_ts", "landing_ts", "landing_lat", "landing_lon", "last_lat", "last_lon", "landing_points", "seen_alt_ft", "last_alt_ft"]),
        F.sum("n_points").alias("n_points"),
        *(F.max(x).alias(x) for x in ("peak_ft", "max_alt_ft", "max_gs_kt")),
    )
    minutes = F.round((F.col("last_ts") - F.col("first_ts")) / 60, 1)
    return whole.withColumns({"minutes": minutes, "landed": F.col("landing_ts").isNotNull(), "signal_gaps": F.col("fragments") - 1})


def flights(points: DataFrame, c: Config = DEFAULT, types: DataFrame | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Flights of all aircraft: labelled, freed of single points and short hops, and stitched. carried: as for ``said_before``."""
    return merged(stitched(whole_enough(fragments_of(points, c, carried), c), c, types)).drop("flight")


def flight_points(points: DataFrame, c: Config = DEFAULT, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The points that belong to flights, with the number of their aircraft's flight as ``session``; and the flights (icao, session and
    the columns of ``merged``). A point that ends one flight and opens the next is in both.

    The points are labelled once and written, as are the flights' points, so that whatever is derived of flights (all that takes
    ``session`` for its key) reads that table and neither the trace nor the machine again.
    """
    rows = written(recorded(points, c), "recorded")
    parts = stitched(whole_enough(summed(rows, said_before(points, c)), c), c, types)
    numbered = written(parts.withColumn("number", F.dense_rank().over(Window.partitionBy("icao").orderBy("flight")).cast("long")), "fragments")
    of = numbered.select("icao", "session", "fragment", "number")
    flown = rows.join(of, ["icao", "session", "fragment"]).select(*points.columns, F.col("number").alias("session"))
    whole = merged(numbered).join(numbered.select("icao", "flight", F.col("number").alias("session")).distinct(), ["icao", "flight"]).drop("flight")
    return written(flown.repartition("icao", "session").sortWithinPartitions("icao", "session", "ts", "seq"), "flown"), whole
