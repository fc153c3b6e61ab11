"""What is derived for each leg, in the order that the rules need one another.

Landing types come first; they tell noise from flights and which ends may have an airport. Airports feed confidence and
missions, types cap heights and speeds, probable destinations stand in where an airport is missing, alignment with a
runway there corrects confidence and landing type, and its segments make a pattern of a generic mission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.store import written
from . import derived, flights, reports, scoring, spatial, tracks

KEY = ["icao", "session"]
LOST = ("signal_lost", "dropped")
LIKELY = lambda: F.coalesce("destination", "near_destination", "probable")  # noqa: E731  the airport that a leg most likely went to


def is_noise(c: Config = DEFAULT) -> Column:
    """A sliver without a landing, short and sparse; or a transponder left on at the ramp."""
    sliver = F.col("landing_type").isin(*LOST, "uncertain") & (F.col("minutes") < c.viable_min) & (F.col("n_points") < c.viable_points)
    still = (F.col("path_km") < c.still_km) & (F.col("max_km") < c.still_km) & (F.coalesce("max_alt_ft", F.lit(0)) < c.still_ft) & (F.coalesce("max_gs_kt", F.lit(0.0)) < c.still_kt)
    return sliver | still


def with_ends(legs: DataFrame, airports: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """``legs`` with origin and destination on the field, near ones otherwise; an end that was not seen has no destination."""
    for end, name in (("takeoff", "origin"), ("landing", "destination")):
        found = spatial.airport_match(legs, airports, end, c)
        legs = legs.join(found.select(*KEY, F.col("airport").alias(name), F.col("near_airport").alias(f"near_{name}")), KEY, "left")
    seen = ~F.col("landing_type").isin(*LOST)
    return legs.withColumns({x: F.when(seen, F.col(x)) for x in ("destination", "near_destination")})


def aligned(legs: DataFrame, segments: DataFrame, airports: DataFrame, above_ft: float, c: Config = DEFAULT) -> DataFrame:
    """``legs`` with what their alignment tells: the longest segment (the earliest on ties) in line with a runway of the likely airport.

    It adds to the confidence, and makes a lost signal low over the airport a dropped approach. pattern_cycles counts the segments.
    """
    asked = legs.select(*KEY, "takeoff_ts", "landing_ts", LIKELY().alias("p_ident")).where("p_ident is not null")
    seconds = F.col("end_ts") - F.col("start_ts")
    met = asked.join(segments, ["icao", "p_ident"]).where((F.col("start_ts") >= F.col("takeoff_ts")) & (F.col("end_ts") <= F.col("landing_ts")))
    best = met.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct(seconds.alias("s"), (-F.col("start_ts")).alias("first"), F.col("p_runway").alias("runway"))).alias("b"))
    field = airports.select(F.col("ident").alias("_likely"), "elevation_ft")
    rows = legs.withColumn("_likely", LIKELY()).join(best, KEY, "left").join(field, "_likely", "left")
    s = F.col("b.s")
    bonus = F.when(s >= c.aligned_long_s, c.aligned_long_bonus).when(s >= c.aligned_short_s, c.aligned_short_bonus).otherwise(0.0)
    low = F.col("last_alt") < F.coalesce("elevation_ft", F.lit(0)) + above_ft
    kind = F.when((F.col("landing_type") == "signal_lost") & (s >= c.aligned_long_s) & low, "dropped").otherwise(F.col("landing_type"))
    sure = F.when(bonus > 0, F.round(F.least(F.lit(1.0), F.col("confidence") + bonus), 2)).otherwise(F.col("confidence"))
    changed = {"aligned_runway": F.col("b.runway"), "aligned_s": s, "pattern_cycles": F.coalesce("n", F.lit(0)), "confidence": sure, "landing_type": kind}
    return rows.withColumns(changed).drop("_likely", "n", "b", "elevation_ft")


def pattern_override() -> Column:
    """The mission, or pattern where a generic one came back to its airport in two aligned segments or more."""
    generic = F.col("mission").isin("unknown", "transport", "pattern")
    return F.when((F.col("origin") == F.col("destination")) & (F.col("pattern_cycles") >= 2) & generic, "pattern").otherwise(F.col("mission"))


def enriched(points: DataFrame, airports: DataFrame, ends: DataFrame, types: DataFrame, operators: DataFrame | None = None, c: Config = DEFAULT, places: DataFrame | None = None, **alignment: float) -> DataFrame:
    """All legs that are no noise, with everything derived. types: icao, type_code; operators: icao, operator.

    places (icao, session, takeoff_lat, takeoff_lon, landing_lat, landing_lon): where legs began and ended, if not at their first and last points.

    Sessions are found once and written, as are the legs before their alignment, which is looked for at their likely airports alone.
    """
    if "session" not in points.columns:
        points = written(tracks.sessions(points, c), "sessions")
    legs = tracks.legs(points, c)
    if places is not None:
        ends_at = [f"{end}_{x}" for end in ("takeoff", "landing") for x in ("lat", "lon")]
        legs = legs.drop(*ends_at).join(places.select(*KEY, *ends_at), KEY)
    landed = scoring.landings(points, c, spatial.airport_match(legs, airports, "landing", c), types)
    rows = legs.join(landed.drop("ground_points"), KEY).withColumn("minutes", F.round((F.col("landing_ts") - F.col("takeoff_ts")) / 60, 1)).where(~is_noise(c))
    rows = with_ends(rows, airports, c).join(types.select("icao", "type_code"), "icao", "left")
    rows = rows.join(operators.select("icao", "operator"), "icao", "left") if operators is not None else rows.withColumn("operator", F.lit(None).cast("string"))
    phases = derived.phase_budget(points, c).select(*KEY, "cruise_alt", "cruise_gs")
    rows = rows.join(phases, KEY, "left").join(derived.autopilot_target(points), KEY, "left")
    said = F.nullif(F.element_at(F.split("callsigns", ","), 1), F.lit(""))
    loiter = F.when(F.col("max_km") > 0, F.col("path_km") / (2 * F.col("max_km")))
    rows = reports.type_caps(rows.withColumns({"callsign": said, "loiter": loiter}).withColumn("mission", scoring.mission()))
    likely = spatial.probable_destination(landed, derived.landing_anchor(points), airports, c).select(*KEY, "probable", F.col("km").alias("probable_km"))
    rows = written(rows.join(likely, KEY, "left"), "legs")
    asked = rows.select("icao", LIKELY().alias("p_ident")).where("p_ident is not null")
    segments = spatial.runway_alignment(points, ends, asked=asked, **alignment)
    rows = aligned(rows, segments, airports, alignment.get("above_ft", 5000), c)
    return rows.withColumn("mission", pattern_override())


def enriched_flights(points: DataFrame, airports: DataFrame, ends: DataFrame, types: DataFrame, operators: DataFrame | None = None, c: Config = DEFAULT, **alignment: float) -> DataFrame:
    """As ``enriched``, of flights: session numbers an aircraft's flights, which begin at the last ground point before they
    were airborne and end at their touchdown, where those were seen. Trace points are read and labelled once."""
    flown, whole = flights.flight_points(points, c)
    landed = {f"landing_{x}": F.coalesce(f"landing_{x}", f"last_{x}") for x in ("lat", "lon")}
    rows = enriched(flown, airports, ends, types, operators, c, whole.withColumns(landed), **alignment)
    kept = ["mid_air", "fragments", "signal_gaps", "landed"]
    return rows.join(whole.select(*KEY, *kept), KEY)
