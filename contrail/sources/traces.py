"""Landed trace files: heterogeneous JSON point arrays to typed points, and the CSV dimensions."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_DAY = "icao string, date string, source string, registration string, type_code string, description string, owner_operator string, year string, timestamp double, trace_json string, point_count int, fetched_at string"


def decode(trace_days: DataFrame) -> DataFrame:
    """A row a point, with its position in the day. Days whose JSON cannot be read are dropped.

    Slots stay raw text, so that altitude may be a number or "ground" and the detail slot an object.
    """
    parsed = trace_days.withColumn("points", F.from_json("trace_json", "array<array<string>>")).where("points is not null")
    return parsed.select(*[c for c in trace_days.columns if c != "trace_json"], F.posexplode("points").alias("seq", "slots"))


def _slot(i: int) -> Column:
    return F.try_element_at("slots", F.lit(i + 1))


def _detail(key: str) -> Column:
    return F.get_json_object(_slot(8), f"$.{key}")


def typed(raw: DataFrame) -> DataFrame:
    """Typed points: slots first, the detail object where a slot is missing."""
    number = lambda c, kind="double": c.try_cast(kind)
    whole = lambda key: F.when(_detail(key).rlike("^-?[0-9]+$"), number(_detail(key), "int"))
    return raw.select(
        "icao", "date", F.col("source").alias("network"), "seq",
        (F.col("timestamp") + number(_slot(0))).alias("ts"),
        number(_slot(1)).alias("lat"),
        number(_slot(2)).alias("lon"),
        (_slot(3) == "ground").alias("surface"),
        number(number(_slot(3)), "int").alias("baro_ft"),
        number(F.coalesce(number(_slot(10)), number(_detail("alt_geom"))), "int").alias("geom_ft"),
        number(_slot(4)).alias("gs_kt"),
        number(_slot(5)).alias("track_deg"),
        number(_slot(7)).alias("baro_rate_fpm"),
        F.coalesce(number(_slot(11)), number(_detail("geom_rate"))).alias("geom_rate_fpm"),
        _detail("squawk").alias("squawk"),
        _detail("category").alias("category"),
        number(_detail("nav_altitude_mcp"), "int").alias("nav_altitude_mcp"),
        _detail("emergency").alias("emergency"),
        F.nullif(F.trim(_detail("flight")), F.lit("")).alias("callsign"),
        F.coalesce(_slot(9), _detail("type")).alias("src"),
        whole("version").alias("version"), whole("sil").alias("sil"), whole("nic").alias("nic"),
    )


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order``. An upsert as an aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, "_row.*").select(*rows.columns)


def read_airports(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    rows = raw.select("ident", "type", "name", F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"), F.col("elevation_ft").try_cast("double").try_cast("int").alias("elevation_ft"))
    return rows.where(F.col("type").isin(types) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_runway_ends(spark: SparkSession, path: str) -> DataFrame:
    """One row for each end that has coordinates."""
    raw = spark.read.csv(path, header=True)
    end = lambda e: F.struct(
        F.col(f"{e}_ident").alias("runway"),
        F.col(f"{e}_latitude_deg").try_cast("double").alias("lat"),
        F.col(f"{e}_longitude_deg").try_cast("double").alias("lon"),
        F.col(f"{e}_heading_degT").try_cast("double").alias("heading"),
    )
    return raw.select(F.col("airport_ident").alias("ident"), F.explode(F.array(end("le"), end("he"))).alias("e")).select("ident", "e.*").where("runway is not null and lat is not null and lon is not null")


def read_navaids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    rows = raw.select("ident", "name", "type", F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"))
    return rows.where("lat is not null and lon is not null").dropDuplicates(["ident", "lat", "lon"])


def read_registry(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A registry text file: Latin-1, names trimmed and freed of a byte-order mark; fails before any write if a column is missing."""
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*(c.removeprefix("﻿").removeprefix("ï»¿").strip() for c in raw.columns))
    if missing := set(required) - set(raw.columns):
        raise ValueError(f"{path} has no {sorted(missing)}")
    return raw


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Addresses, one a line, with # comments; in order, without repeats."""
    line = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    rows = spark.read.text(path).select(line.alias("icao"), F.monotonically_increasing_id().alias("at")).where(F.col("icao").rlike("^[0-9a-f]{6}$"))
    return rows.groupBy("icao").agg(F.min("at").alias("at")).orderBy("at").select("icao")


def bodies(files: DataFrame) -> DataFrame:
    """Fetched bodies (path, content) as text: gunzipped or inflated where their first bytes say so, else taken as text; unreadable ones are null."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                if b[:2] == b"\x1f\x8b":
                    b = gzip.decompress(b)
                elif b[:1] == b"\x78" and int.from_bytes(b[:2], "big") % 31 == 0:
                    b = zlib.decompress(b)
                return b.decode()
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                return None

        return pd.Series([one(b) for b in content], dtype=object)

    return files.withColumn("body", text("content"))


def parsed_body(fetched: DataFrame) -> DataFrame:
    """icao, day and body of a trace file to its timestamp (the day's midnight if it has none) and its points as JSON text."""
    parsed = F.from_json("body", "timestamp double, trace string, r string, t string")
    midnight = F.unix_timestamp(F.col("day").cast("timestamp")).cast("double")
    rows = fetched.withColumn("_b", parsed).where("_b.trace is not null")
    return rows.select("icao", "day", F.coalesce("_b.timestamp", midnight).alias("timestamp"), F.col("_b.trace").alias("trace_json"), F.col("_b.r").alias("registration"), F.col("_b.t").alias("type_code"))


PATH = "array<struct<ts:double,lat:double,lon:double,alt_m:double,track:double,ground:boolean>>"


def path_points(tracks: DataFrame) -> DataFrame:
    """Waypoints of the path network (icao, start_ts, path of ``PATH``) as typed points: metres to feet, no speed; a height of zero is none."""
    rows = tracks.select("icao", "start_ts", F.posexplode("path").alias("seq", "p")).where("p.lat is not null and p.lon is not null")
    ground = F.coalesce("p.ground", F.lit(False))
    alt = F.when(~ground & (F.coalesce("p.alt_m", F.lit(0.0)) != 0), F.rint(F.col("p.alt_m") * 3.28084).cast("int"))
    return rows.select("icao", "seq", F.col("p.ts").alias("ts"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), ground.alias("surface"), alt.alias("baro_ft"), F.lit(None).cast("double").alias("gs_kt"))


def days_of(trace_days: DataFrame, icao: str | None = None, since: str | None = None, day: str | None = None, blobs: bool = True) -> DataFrame:
    """Trace days of one aircraft or all, from a day on or of one day. Without ``blobs`` the scan leaves their column unread."""
    rows = trace_days if blobs else trace_days.drop("trace_json")
    rows = rows if icao is None else rows.where(F.col("icao") == icao)
    rows = rows if since is None else rows.where(F.col("date") >= F.lit(since).cast("date"))
    return rows if day is None else rows.where(F.col("date") == F.lit(day).cast("date"))


def earliest_new_day(trace_days: DataFrame, fetched_from: int) -> DataFrame:
    """Per aircraft: its earliest day among those fetched from ``fetched_from`` on."""
    return trace_days.where(F.col("fetched_at") >= fetched_from).groupBy("icao").agg(F.min("date").alias("date"))


def without_window(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Rows (icao, day) before their aircraft's boundary: what stays when a window is deleted to be written anew."""
    met = rows.join(boundaries.select("icao", F.col("boundary").alias("_from")), "icao", "left")
    return met.where(F.col("_from").isNull() | (F.col("day") < F.col("_from"))).drop("_from")


def without_flightless(registry: DataFrame, legs: DataFrame) -> DataFrame:
    """Registry rows of aircraft that have flown."""
    return registry.join(legs.select("icao"), "icao", "left_semi")


def flights_sink(legs: DataFrame, order: list[Column]) -> DataFrame:
    """Legs as they are stored: the last by (icao, takeoff_ts), none that lands before or when it takes off."""
    return latest(legs.where(F.col("landing_ts").isNull() | (F.col("landing_ts") > F.col("takeoff_ts"))), ["icao", "takeoff_ts"], order)
