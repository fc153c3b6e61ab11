"""Aggregations: integrity scores, votes, per-aircraft statistics, calendars and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import retryable


def spoof_scores(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Per (aircraft, day): integrity of version-2 samples over all networks, flagged where sil is often zero."""
    v2 = F.col("version") == 2
    day = F.floor(F.col("ts") / 86400).cast("long").alias("day")
    rows = points.groupBy("icao", day).agg(
        F.count_if(v2).alias("v2"),
        F.count_if(v2 & (F.col("sil") == 0)).alias("sil0"),
        F.count_if(v2 & (F.col("nic") == 0)).alias("nic0"),
        F.array_join(F.array_sort(F.collect_set(F.when(v2, F.col("src")))), ",").alias("sources"),
        F.min("ts").alias("first_ts"),
        F.min("callsign").alias("callsign"),
    )
    return scores_of(rows, c)


def scores_of(days: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The score of counted or stored days: v2, sil0."""
    rows, pct = days, F.when(F.col("v2") > 0, 100 * F.col("sil0") / F.col("v2")).otherwise(0.0)
    return rows.withColumn("sil0_pct", F.round(pct, 2)).withColumn("flagged", (F.col("v2") >= c.spoof_min_v2) & (pct >= c.spoof_pct))


def registry_vote(votes: DataFrame) -> DataFrame:
    """Per aircraft: the type and description seen most often (latest on ties), how many disagree, and the latest registration."""
    named = votes.where("type_code is not null or description is not null")
    counts = named.groupBy("icao", "type_code", "description").agg(F.count("*").alias("n"), F.max("fetched_at").alias("latest"))
    won = counts.groupBy("icao").agg(F.max(F.struct("n", "latest", "type_code", "description")).alias("w"), F.sum("n").alias("all"))
    latest = votes.groupBy("icao").agg(F.max_by("registration", "fetched_at").alias("registration"))
    return latest.join(won, "icao", "left").select("icao", "registration", "w.type_code", "w.description", F.coalesce(F.col("all") - F.col("w.n"), F.lit(0)).alias("drift"))


def quality_tier(rate: Column) -> Column:
    return F.when(rate >= 0.5, "excellent").when(rate >= 0.3, "good").when(rate >= 0.1, "poor").otherwise("very_poor")


def aircraft_stats(legs: DataFrame) -> DataFrame:
    """Per aircraft: dates, counts, hours, airports, callsigns, busiest day, two bases with shares, and confirmation rate.

    legs: icao, takeoff_ts, landing_ts, landing_type, origin, destination, callsign.
    """
    day = F.floor(F.col("takeoff_ts") / 86400).cast("long")
    confirmed = F.col("landing_type") == "confirmed"
    flown = F.when(F.col("landing_ts") > F.col("takeoff_ts"), F.col("landing_ts") - F.col("takeoff_ts"))
    base = legs.groupBy("icao").agg(
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count("*").alias("flights"),
        F.count_if(confirmed).alias("confirmed"),
        F.round(F.coalesce(F.sum(flown), F.lit(0)) / 3600, 2).alias("hours"),
        F.round(F.avg(flown) / 60, 1).alias("mean_minutes"),
        F.count_distinct("callsign").alias("callsigns"),
    )
    stops = legs.select("icao", F.explode(F.array("origin", "destination")).alias("airport")).where("airport is not null")
    visits = stops.groupBy("icao", "airport").agg(F.count("*").alias("n"))
    ranked = visits.withColumn("rank", F.row_number().over(Window.partitionBy("icao").orderBy(F.desc("n"), "airport")))
    bases = ranked.groupBy("icao").agg(F.count("*").alias("airports"), F.sum("n").alias("_all"), *(x for i, c in ((1, "home"), (2, "second")) for x in (F.max(F.when(F.col("rank") == i, F.col("airport"))).alias(c), F.max(F.when(F.col("rank") == i, F.col("n"))).alias(f"_{c}"))))
    busiest = legs.groupBy("icao", day.alias("day")).count().groupBy("icao").agg(F.max(F.struct("count", "day")).alias("b"))
    joined = base.join(bases, "icao", "left").join(busiest, "icao", "left")
    rate = F.round(F.col("confirmed") / F.col("flights"), 3)
    return joined.select(
        *base.columns,
        F.coalesce("airports", F.lit(0)).alias("airports"),
        "home", F.round(F.col("_home") / F.col("_all"), 3).alias("home_share"),
        "second", F.round(F.col("_second") / F.col("_all"), 3).alias("second_share"),
        F.col("b.day").alias("busiest_day"), F.col("b.count").alias("busiest_count"),
        rate.alias("confirmation_rate"), quality_tier(rate).alias("tier"),
    )


def top_airports(legs: DataFrame, limit: int = 10) -> DataFrame:
    """The most visited airports: a top-k report."""
    stops = legs.select(F.explode(F.array("origin", "destination")).alias("airport")).where("airport is not null")
    return stops.groupBy("airport").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "airport").limit(limit)


def breakdown(legs: DataFrame, column: str) -> DataFrame:
    """Counts and percentage of each value."""
    whole = Window.partitionBy()
    counts = legs.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(whole), 2))


def weighted_mix(mix: DataFrame, shares: list[str], weight: str) -> DataFrame:
    """Means of percentages weighted by points; null where there are none."""
    return mix.groupBy("icao").agg(F.sum(weight).alias(weight), *(F.round(F.sum(F.col(s) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), 2).alias(s) for s in shares))


def daily_activity(legs: DataFrame, flagged: DataFrame, first_day: int, days: int) -> DataFrame:
    """Exactly ``days`` days for each aircraft, zero-filled; a day is flagged by an emergency leg or a spoofed day."""
    day = F.floor(F.col("takeoff_ts") / 86400).cast("long")
    per = legs.groupBy("icao", day.alias("day")).agg(F.count("*").alias("n"), F.max(F.col("emergency_squawk").isNotNull()).alias("e"))
    calendar = legs.select("icao").distinct().select("icao", F.explode(F.sequence(F.lit(first_day).cast("long"), F.lit(first_day + days - 1).cast("long"))).alias("day"))
    spoofed = flagged.where("flagged").select("icao", "day", F.lit(True).alias("s"))
    return calendar.join(per, ["icao", "day"], "left").join(spoofed, ["icao", "day"], "left").select("icao", "day", F.coalesce("n", F.lit(0)).alias("flights"), (F.coalesce("e", F.lit(False)) | F.coalesce("s", F.lit(False))).alias("flagged"))


def fetched_dates(log: DataFrame, trace_days: DataFrame) -> DataFrame:
    """(icao, source, date) not to fetch again: answered for good once, or present."""
    done = log.groupBy("icao", "source", "date").agg(F.bool_or(~retryable(F.col("status"))).alias("done")).where("done").drop("done")
    return done.unionByName(trace_days).distinct()


def resume_starts(log: DataFrame) -> DataFrame:
    """Per aircraft and source: the day after the last answered one; sources without one start at the earliest of the others."""
    done = log.groupBy("icao", "source").agg(F.max(F.when(~retryable(F.col("status")), F.col("date"))).alias("last"))
    peer = F.min("last").over(Window.partitionBy("icao"))
    return done.select("icao", "source", F.date_add(F.coalesce("last", peer), 1).alias("start"))


def source_health(log: DataFrame, recent: int = 30, failures: int = 20) -> DataFrame:
    """Per source: the run of failures that leads its ``recent`` newest requests; unhealthy from ``failures`` on."""
    newest = Window.partitionBy("source").orderBy(F.desc("fetched_at"))
    rows = log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= recent)
    failed = retryable(F.col("status"))
    run = F.coalesce(F.min(F.when(~failed, F.col("rank"))) - 1, F.max("rank"))
    return rows.groupBy("source").agg(run.cast("long").alias("failing")).withColumn("unhealthy", F.col("failing") >= failures)


def activity_ramp(counts: DataFrame, glyphs: int = 8) -> DataFrame:
    """Which of ``glyphs`` steps shows each count, 0 for none."""
    top = F.max("flights").over(Window.partitionBy("icao"))
    step = F.least(F.lit(glyphs - 1), F.lit(1) + F.rint(F.col("flights") / top * (glyphs - 2)).cast("int"))
    return counts.select("icao", "day", F.when(F.col("flights") > 0, step).otherwise(0).alias("step"))
