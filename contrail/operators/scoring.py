"""Landing types, confidence, missions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..fixed import CALLSIGN_MISSION, ENDURANCE_MIN, NEVER_SURVEY, OFFSHORE_OPERATORS, TRAINERS
from ..functions.geo import haversine_m, lerp
from .points import classified
from .tracks import over, sessions


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def endurance(type_code: str = "type_code", c: Config = DEFAULT) -> Column:
    """Longest plausible flight of a type, in minutes."""
    return F.coalesce(F.try_element_at(literal_map({k: float(v) for k, v in ENDURANCE_MIN.items()}), F.col(type_code)), F.lit(float(c.endurance_min)))


def _descent(inside: Column, place: Column) -> Column:
    """Descent over the points ``inside`` a window: by rates weighted by their place in it, else by its heights, else a half."""
    at = F.struct("ts", "seq")
    rated = F.when(inside & F.col("rate_fpm").isNotNull(), place)
    mean = F.sum(rated * F.col("rate_fpm")) / F.sum(rated)
    high = F.when(inside & F.col("baro_ft").isNotNull(), at)
    fell = F.max_by("baro_ft", high) - F.min_by("baro_ft", high)
    span = F.greatest(F.lit(1), F.max(F.when(inside, F.col("ts"))) - F.min(F.when(inside, F.col("ts"))))
    return F.when(F.count(rated) > 0, lerp(-mean, 0, 800)).when(F.count(high) >= 2, lerp(-fell / span * 60, 0, 800)).otherwise(0.5)


def leg_signals(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Per session, what classification needs: descent at the end and before the flare, last values, ground points, jump and errors."""
    w = over("icao", "session")
    whole = Window.partitionBy("icao", "session")
    back = over("icao", "session", order=[F.desc("ts"), F.desc("seq")])
    at = F.struct("ts", "seq")
    ground, air = F.col("state") == "ground", F.col("state") == "airborne"
    rows = classified(sessions(points, c), c).withColumns({"back": F.row_number().over(back), "end": F.max("ts").over(whole), "jump": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), "rn": F.row_number().over(w), "last_air": F.max(F.when(air, at)).over(whole)})
    # touchdown: the first ground point that no airborne one follows
    rows = rows.withColumn("down", F.min(F.when(ground & (F.col("last_air").isNull() | (at > F.col("last_air"))), F.col("ts"))).over(whole))
    tail = F.col("end") - F.col("ts") <= c.tail_s
    flare = F.coalesce(F.col("ts").between(F.col("down") - c.flare_from_s, F.col("down") - c.flare_to_s), F.lit(False))
    first = lambda inside: F.min(F.when(inside, F.col("rn"))).over(whole)
    rows = rows.withColumns({"tail": tail, "flare": flare, "tail_at": F.col("rn") - first(tail) + 1, "flare_at": F.col("rn") - first(flare) + 1})
    return rows.groupBy("icao", "session").agg(
        F.count("*").alias("n"),
        ((F.max("ts") - F.min("ts")) / 60).alias("minutes"),
        _descent(F.col("tail"), F.col("tail_at")).alias("descent"),
        F.when(F.count_if("flare") > 0, _descent(F.col("flare"), F.col("flare_at"))).alias("flare_descent"),
        F.count_if((F.col("back") <= 5) & (F.col("rate_fpm") <= -200)).alias("sinking"),
        F.count_if(F.col("reason").isin("baro_error", "speed_override")).alias("errors"),
        F.count_if(ground).alias("ground_points"),
        F.max(F.when(ground & (F.col("back") <= 5), F.col("jump"))).alias("jump_m"),
        F.max_by("baro_ft", F.when(air & F.col("baro_ft").isNotNull(), at)).alias("last_alt"),
        F.max_by("baro_ft", at).alias("seen_alt"),
        F.max_by("gs_kt", at).alias("last_gs"),
        F.max("baro_ft").alias("max_alt"),
        (F.max_by("state", at) == "ground").alias("landed"),
    )


def landing_type(longest: Column | None = None) -> Column:
    """Over leg_signals (and the type's longest flight in minutes): altitude_error, dropped, signal_lost, uncertain or confirmed; the first rule that fits."""
    alt, gs = F.coalesce("last_alt", F.lit(0)), F.coalesce("last_gs", F.lit(0.0))
    airborne = (alt > 2000) | (gs > 100) | (F.coalesce("max_alt", F.lit(0)) > 3000)
    no_ground = F.when(F.col("ground_points") == 0, 1.0).when(F.col("ground_points") == 1, 0.3).when(F.col("ground_points") == 2, 0.1).otherwise(0.0)
    terms = [(lerp(alt, 500, 5000), 3), (lerp(gs, 30, 180), 2.5), (no_ground, 3), (1 - F.col("descent"), 2), (lerp(F.coalesce("jump_m", F.lit(0.0)), 100, 500), 1.5)]
    lost = sum(x * w for x, w in terms) / sum(w for _, w in terms)
    return (
        F.when((F.col("n") >= 10) & (F.col("errors") / F.col("n") > 0.2), "altitude_error")
        .when(~F.col("landed") & airborne & (alt < 5000) & (F.col("sinking") >= 3), "dropped")
        .when(~F.col("landed") & airborne, "signal_lost")
        .when(~F.col("landed") | (F.col("minutes") > (F.lit(DEFAULT.endurance_min) if longest is None else longest)), "uncertain")
        .when(lost > 0.6, "signal_lost")
        .otherwise("confirmed")
    )


def landing_confidence() -> Column:
    """Weighted geometric mean of the landing's factors (km: to the airport, if one matches); fixed where the type leaves no doubt or no hope."""
    ground = F.when(F.col("ground_points") == 0, 0.0).when(F.col("ground_points") == 1, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.25 * (F.col("ground_points") - 1)))
    short = F.when(F.col("minutes") < 1440, 1.0).when(F.col("minutes") < 2880, 0.5).otherwise(0.1)
    near = F.coalesce(1 - lerp(F.col("km"), 0, 10), F.lit(0.3))
    factors = [
        (F.coalesce("flare_descent", "descent"), 2), (F.coalesce(lerp(F.col("last_gs"), 180, 30), F.lit(0.5)), 2), (F.coalesce(lerp(F.col("last_alt"), 5000, 500), F.lit(0.5)), 2),
        (near, 2), (1 - lerp(F.coalesce("jump_m", F.lit(0.0)), 200, 500), 1), (ground, 1.5), (short, 0.5),
    ]
    mean = F.exp(sum(w * F.ln(F.greatest(F.lit(0.01), x)) for x, w in factors) / sum(w for _, w in factors))
    t = F.col("landing_type")
    return F.round(F.when(t.isin("signal_lost", "dropped"), 0.0).when(t == "altitude_error", 0.1).when(t == "uncertain", 0.15).otherwise(mean), 2)


def landings(points: DataFrame, c: Config = DEFAULT, ports: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Landing type and confidence of each session.

    ports: icao, session, km to the airport at the landing, where one matches. types: icao, type_code, for the type's endurance.
    """
    rows = leg_signals(points, c)
    rows = rows.join(ports.select("icao", "session", "km"), ["icao", "session"], "left") if ports is not None else rows.withColumn("km", F.lit(None).cast("double"))
    rows = rows.join(types.select("icao", "type_code"), "icao", "left") if types is not None else rows.withColumn("type_code", F.lit(None).cast("string"))
    rows = rows.withColumn("landing_type", landing_type(endurance(c=c)))
    return rows.withColumn("confidence", landing_confidence()).select("icao", "session", "landing_type", "confidence", F.round("descent", 3).alias("descent"), "ground_points", "last_alt", "seen_alt")


def mission() -> Column:
    """Of callsign, operator, origin, destination, max_alt_ft, loiter, cruise_gs and type_code; the first rule that fits."""
    call, op = F.upper(F.trim(F.coalesce("callsign", F.lit("")))), F.upper(F.coalesce("operator", F.lit("")))
    same, has = F.col("origin") == F.col("destination"), F.col("origin").isNotNull() & F.col("destination").isNotNull()
    kind, alt = F.coalesce("type_code", F.lit("")), F.col("max_alt_ft")
    rules = [(F.contains(op, F.lit(k)), "offshore") for k in OFFSHORE_OPERATORS]
    rules += [(call.startswith(k), v) for k, v in CALLSIGN_MISSION.items()]
    rules += [
        (call.rlike("MT$") & ~call.rlike("[LRA]MT$"), "ems_hems"),
        ((F.col("loiter") > 3) & (F.col("cruise_gs") < 120) & ~kind.isin(*NEVER_SURVEY), "survey"),
        (same & (alt < 5000) & kind.isin(*TRAINERS), "training"),
        (same & (alt < 3000) & ~kind.isin(*NEVER_SURVEY), "pattern"),
        (has & ~same, "transport"),
        (call.rlike("^N[0-9A-Z]+$") & (F.col("origin").isNotNull() | F.col("destination").isNotNull()), "transport"),
    ]
    return F.coalesce(*(F.when(c, v) for c, v in rules), F.lit("unknown"))


def events(legs: DataFrame) -> DataFrame:
    """Zero or more events a leg: time, callsign, type, severity and summary.

    legs: icao, session, takeoff_ts, callsign, emergency_squawk, emergency_flag, landing_type, airport, hover_s, go_arounds.
    """
    made = [
        (F.col("emergency_squawk").isNotNull(), "emergency_squawk", "emergency", F.concat(F.lit("squawk "), "emergency_squawk")),
        (F.col("emergency_flag").isNotNull(), "emergency_flag", "emergency", F.concat(F.lit("emergency flag: "), "emergency_flag")),
        ((F.col("landing_type") == "confirmed") & F.col("airport").isNull(), "off_airport_landing", "unusual", F.lit("confirmed landing, no airport or helipad match")),
        (F.col("hover_s") >= 300, "long_hover", "unusual", F.format_string("hover %ds (%.1f min)", F.col("hover_s").cast("long"), F.col("hover_s") / 60)),
        (F.col("go_arounds") >= 2, "multiple_go_arounds", "unusual", F.concat(F.col("go_arounds").cast("string"), F.lit(" go-arounds on this flight"))),
    ]
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), m.alias("summary"))) for c, t, s, m in made)))
    return legs.select("icao", "session", F.col("takeoff_ts").alias("ts"), "callsign", F.explode(each).alias("e")).select("icao", "session", "ts", "callsign", "e.*")


def spoof_events(scores: DataFrame) -> DataFrame:
    """One event for each aircraft and day that is flagged: its first second, first callsign, and the pooled share."""
    n = F.when(F.col("sources") == "", 0).otherwise(F.size(F.split("sources", ",")))
    share = F.rint(1000 * F.col("sil0") / F.col("v2")) / 10
    text = F.format_string("pooled v2 samples with sil=0: %.1f%% (%d v2 samples across %d source(s))", share, "v2", n)
    return scores.where("flagged").select("icao", F.lit(None).cast("long").alias("session"), F.col("first_ts").alias("ts"), "callsign", F.lit("spoof_bimodal_integrity").alias("type"), F.lit("unusual").alias("severity"), text.alias("summary"))


def event_feed(legs: DataFrame, scores: DataFrame | None = None, since: int | None = None, severity: str = "all") -> DataFrame:
    """Events of legs that took off from ``since`` on, and of flagged days if scores are given, of one severity or all."""
    out = events(legs if since is None else legs.where(F.col("takeoff_ts") >= since))
    if scores is not None:
        out = out.unionByName(spoof_events(scores if since is None else scores.where(F.col("day") >= since // 86400)))
    return out if severity == "all" else out.where(F.col("severity") == severity)


def spoof_gate(c: Config = DEFAULT) -> Column:
    """Why a leg is held back, or null. v2, sil0, speed_kt, max_alt_ft, origin, destination, callsign."""
    pct = 100 * F.col("sil0") / F.col("v2")
    enough = F.col("v2") >= c.spoof_min_v2
    crude = (F.col("max_alt_ft") < 500) & F.col("origin").isNull() & F.col("destination").isNull() & F.col("callsign").rlike("^EK[0-9]+$")
    return F.when(enough & (pct >= 60), "hard_sil0").when(enough & (pct >= c.spoof_pct) & (F.col("speed_kt") > 900), "sil0_plus_teleport").when(crude, "crude_heuristic")


def takeoff_confidence(points: DataFrame, origin_km: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Per session: 0.3 if found in mid-air, else by ground points before takeoff and the airport's distance; less with faulty heights.

    origin_km: icao, session, km, where an airport matches.
    """
    at = F.struct("ts", "seq")
    whole = Window.partitionBy("icao", "session")
    rows = classified(sessions(points, c), c).withColumn("air", F.min(F.when(F.col("state") == "airborne", at)).over(whole))
    before = (F.col("state") == "ground") & (F.col("air").isNull() | (at < F.col("air")))
    n = F.count("*")
    signs = rows.groupBy("icao", "session").agg(
        F.count_if(before).alias("gp"), (F.min_by("state", at) == "airborne").alias("mid"), ((n >= 10) & (F.count_if(F.col("reason").isin("baro_error", "speed_override")) / n > 0.2)).alias("bad")
    )
    q = F.when(F.col("gp") == 0, 0.2).when(F.col("gp") == 1, 0.5).when(F.col("gp") == 2, 0.7).otherwise(1.0)
    near = (2 * q + 1.5 * (1 - lerp(F.col("km"), 0, 10))) / 3.5
    value = F.when(F.col("mid"), 0.3).otherwise(F.coalesce(near, q)) * F.when(F.col("bad"), 0.3).otherwise(1.0)
    return signs.join(origin_km, ["icao", "session"], "left").select("icao", "session", F.round(value, 2).alias("confidence"))
