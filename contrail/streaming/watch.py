"""Watching a fleet: what is new since a snapshot. The snapshot and the diff are plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(days: DataFrame, legs: DataFrame) -> DataFrame:
    """Per aircraft: last day and last takeoff known before a run."""
    a = days.groupBy("icao").agg(F.max("day").alias("last_day"))
    return a.join(legs.groupBy("icao").agg(F.max("takeoff_ts").alias("last_takeoff")), "icao", "full")


def reactivations(before: DataFrame, days: DataFrame, log: DataFrame, dormant_days: int = 30) -> DataFrame:
    """Aircraft whose first new day is ``dormant_days`` after the last, if a request inside the gap shows that someone looked."""
    new = days.join(before, "icao").where(F.col("day") > F.col("last_day")).groupBy("icao", "last_day").agg(F.min("day").alias("first_new"))
    slept = new.where(F.datediff("first_new", "last_day") >= dormant_days)
    looked = log.select("icao", F.col("date").alias("d"))
    return slept.join(looked, (slept["icao"] == looked["icao"]) & (F.col("d") > F.col("last_day")) & (F.col("d") < F.col("first_new")), "left_semi")


def new_emergencies(before: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs with an emergency code that took off after the snapshot; aircraft without one only set the baseline."""
    known = before.where("last_takeoff is not null")
    return legs.join(known, "icao").where((F.col("takeoff_ts") > F.col("last_takeoff")) & F.col("emergency_squawk").isNotNull()).select("icao", "session", "takeoff_ts", "emergency_squawk")


def new_spoofs(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    return now.join(before, key, "left_anti")


def evaluated(legs: DataFrame, before: DataFrame) -> DataFrame:
    """Per aircraft: whether this run sets its baseline, as it had no trace day before, and its new emergencies, of which a baseline has none."""
    fresh = new_emergencies(before, legs).groupBy("icao").agg(F.count("*").alias("n"))
    known = legs.select("icao").distinct().join(before.select("icao", "last_day"), "icao", "left").join(fresh, "icao", "left")
    first = F.col("last_day").isNull()
    return known.select("icao", first.alias("baseline"), F.when(first, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("alerts"))
