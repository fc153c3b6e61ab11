"""Read-side projections, filters and small joins behind the query surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CEILING_FT, MAX_GS_KT
from ..functions.identity import is_address, tail_to_hex
from ..functions.text import any_contains, clean, percent_floor, pick
from .joins import within_intervals
from .scoring import literal_map


def legs_between(legs: DataFrame, from_day: int | None = None, to_day: int | None = None, airport: str | None = None) -> DataFrame:
    """Legs by half-open day range and by either airport."""
    day = F.floor(F.col("takeoff_ts") / 86400)
    out = legs if from_day is None else legs.where(day >= from_day)
    out = out if to_day is None else out.where(day <= to_day)
    return out if airport is None else out.where((F.col("origin") == airport) | (F.col("destination") == airport))


def shown_ends(legs: DataFrame) -> DataFrame:
    """What a list shows for both ends: the airport, ``~`` and a near one, or that the signal was lost."""
    end = lambda real, near, lost: F.coalesce(F.col(real), F.concat(F.lit("~"), F.col(near)), lost)
    lost = F.when(F.col("landing_type").isin("signal_lost", "dropped"), "sig lost")
    return legs.select("icao", "session", end("origin", "near_origin", F.lit(None)).alias("from"), end("destination", "near_destination", lost).alias("to"))


def type_caps(legs: DataFrame, ceilings: dict[str, int] = CEILING_FT, speeds: dict[str, int] = MAX_GS_KT) -> DataFrame:
    """``legs`` with heights and speeds held to what the type can do.

    A tenth more height is allowed only where the selected altitude (target_ft) is within 5,000 ft of it; speeds always have a
    tenth. Unknown types have 60,000 ft and 800 kt. cruise_alt and cruise_gs stay below the capped values.
    """
    known = lambda values, default: F.coalesce(F.try_element_at(literal_map(values), F.col("type_code")), F.lit(default))
    ceiling, agrees = known(ceilings, 60_000), F.abs(F.col("max_alt_ft") - F.col("target_ft")) <= 5000
    cap = F.when(agrees, F.floor(ceiling * 1.1)).otherwise(ceiling).cast("int")
    gs_cap = F.floor(known(speeds, 800) * 1.1).cast("double")
    alt = F.when(F.col("max_alt_ft").isNotNull(), F.least("max_alt_ft", cap))
    lower = lambda x, y: F.when(F.col(x).isNotNull(), F.least(F.col(x), y))
    return legs.withColumns({"_alt": alt}).withColumns({"cruise_alt": lower("cruise_alt", F.col("_alt").cast("double")), "max_gs_kt": lower("max_gs_kt", gs_cap), "cruise_gs": lower("cruise_gs", gs_cap), "max_alt_ft": F.col("_alt")}).drop("_alt")


def overridden_types(legs: DataFrame, prefix: str = "ae69", least: int = 3) -> DataFrame:
    """Aircraft of an address block in which ``least`` legs have had their type overridden: all their legs follow."""
    n = F.count_if(F.col("overridden")).over(Window.partitionBy("icao"))
    return legs.withColumn("promoted", F.col("icao").startswith(prefix) & (n >= least))


def stale(rows: DataFrame, version: str) -> DataFrame:
    """Rows made by another extractor version, or by none known."""
    return rows.where(~F.col("extractor_version").eqNullSafe(F.lit(version)))


def resolve_tail(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """tail -> icao: by the code if it is one, else the registry's newest row."""
    newest = registry.groupBy(F.upper("registration").alias("_r")).agg(F.max_by("icao", "fetched_at").alias("_icao"))
    joined = asked.join(newest, F.upper("tail") == F.col("_r"), "left")
    return joined.select("tail", F.coalesce(tail_to_hex(F.col("tail")), F.col("_icao")).alias("icao"))


def with_type(legs: DataFrame, registry: DataFrame, crossref: DataFrame) -> DataFrame:
    """Legs with the registry's type, else the cross-reference's."""
    r, x = registry.select("icao", F.col("type_code").alias("_r")), crossref.select("icao", F.col("type_code").alias("_x"))
    return legs.join(r, "icao", "left").join(x, "icao", "left").withColumn("type_code", F.coalesce("_r", "_x")).drop("_r", "_x")


def find_owner(registry: DataFrame, *, name: str = "", street: str = "", city: str = "", state: str = "") -> DataFrame:
    """Registry rows whose name and address hold all that is asked for."""
    parts = [any_contains(F.lit(v), F.col(c)) for c, v in (("name", name), ("street", street), ("city", city), ("state", state)) if v]
    out = registry
    for p in parts:
        out = out.where(p)
    return out


def address_lines(registry: DataFrame) -> DataFrame:
    """Street lines, and city, state and code, as they are written."""
    return registry.select("icao", F.concat_ws(", ", clean(F.col("street")), clean(F.col("street2"))).alias("street"), F.concat_ws(", ", clean(F.col("city")), clean(F.concat_ws(" ", clean(F.col("state")), clean(F.col("zip"))))).alias("city"))


def links(aircraft: DataFrame, bases: dict[str, str]) -> DataFrame:
    """One link a site for each valid address."""
    each = F.explode(F.array(*(F.struct(F.lit(site).alias("site"), F.concat(F.lit(base), F.col("icao")).alias("url")) for site, base in bases.items())))
    return aircraft.where(is_address(F.col("icao"))).select("icao", each.alias("l")).select("icao", "l.*")


def mix_label(mix: DataFrame) -> DataFrame:
    """Whole percentages of each source category."""
    whole = F.col("adsb") + F.col("mlat") + F.col("other")
    return mix.select("icao", *(percent_floor(F.col(c), whole).alias(c) for c in ("adsb", "mlat", "other")))


def layers(counts: DataFrame, known: list[str]) -> DataFrame:
    """Shares of the known groups, all else as ``other``."""
    group = F.when(F.col("group").isin(known), F.col("group")).otherwise("other")
    rows = counts.groupBy("icao", group.alias("layer")).agg(F.sum("n").alias("n"))
    return rows.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("icao")), 1))


def retention_warnings(starts: DataFrame, keeps_days: dict[str, int], today: Column) -> DataFrame:
    """Sources asked for days older than they keep."""
    keeps = F.create_map(*(F.lit(x) for kv in keeps_days.items() for x in kv))
    return starts.withColumn("missing_days", F.datediff(F.date_sub(today, keeps[F.col("source")]), F.col("start"))).where("missing_days > 0")


def refused_sources(log: DataFrame, days: int = 3) -> DataFrame:
    """Sources whose last ``days`` days were all refused."""
    per = log.groupBy("source", "date").agg(F.bool_and(F.col("status") == 403).alias("refused"))
    newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("date")))
    return per.withColumn("rank", newest).where(F.col("rank") <= days).groupBy("source").agg(F.bool_and("refused").alias("tripped"), F.count("*").alias("days"))


def parse_identity_dump(dump: DataFrame) -> DataFrame:
    """A JSON object of address -> [registration, type, flags] as rows; what cannot be read is dropped."""
    parsed = dump.select(F.explode(F.from_json("json", "map<string,array<string>>")).alias("icao", "v")).where(is_address(F.col("icao")))
    return parsed.select(F.lower("icao").alias("icao"), clean(F.get("v", F.lit(0))).alias("registration"), clean(F.get("v", F.lit(1))).alias("type_code"), F.coalesce(F.get("v", F.lit(2)), F.lit("")).startswith("1").alias("military"))


def flatten_messages(landed: DataFrame) -> DataFrame:
    """Message JSON to columns; one row a message id, the first seen."""
    schema = "id string, tail string, flight string, label string, text string, timestamp string"
    m = landed.select(F.from_json("json", schema).alias("m")).where("m.id is not null").select("m.*")
    rows = m.select("id", pick(F.col("tail")).alias("tail"), pick(F.col("flight")).alias("flight"), "label", "text", F.unix_seconds(F.try_to_timestamp("timestamp")).alias("ts"))
    return rows.groupBy("id").agg(F.min_by(F.struct("tail", "flight", "label", "text", "ts"), F.struct("ts", "text")).alias("r")).select("id", "r.*")


def climbs_between(segments: DataFrame, points: DataFrame, least_ft: float = 500) -> DataFrame:
    """Consecutive aligned segments with a climb of more than ``least_ft`` between them: a go-around by alignment.

    segments: icao, start_ts, end_ts, end_alt_ft. The join is on aircraft and hour buckets.
    """
    w = Window.partitionBy("icao").orderBy("start_ts")
    pauses = segments.withColumn("next_ts", F.lead("start_ts").over(w)).where("next_ts > end_ts + 1").select("icao", (F.col("end_ts") + 1).alias("a"), (F.col("next_ts") - 1).alias("b"), "end_alt_ft")
    met = within_intervals(points.select("icao", "ts", "baro_ft"), pauses, "icao", "ts", "a", "b")
    return met.groupBy("icao", "a").agg((F.max("baro_ft") - F.max("end_alt_ft") > least_ft).alias("climbed"))
