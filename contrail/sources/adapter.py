"""Positions, dimensions and legs derived from the driver's tables by arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position reports: an aircraft a user, time run sixty times as fast."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"), F.expr("unix_micros(cast(ts as timestamp)) div 60000000").alias("ts"))
    surface = F.col("event_type") == "signup"
    return e.select(
        F.lpad(F.lower(F.hex(10485760 + F.col("user_id"))), 6, "0").alias("icao"),
        F.col("event_id").alias("seq"),
        "ts",
        F.round(30 + F.col("user_id") % 40 * 0.25 + F.col("k") % 20 * 0.01, 4).alias("lat"),
        F.round(-100 + F.col("user_id") * 7 % 60 * 0.5 + F.col("k") * 3 % 20 * 0.01, 4).alias("lon"),
        surface.alias("surface"),
        F.when(~surface, F.floor(F.col("value") * 100).cast("int")).alias("baro_ft"),
        F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 100).cast("int") + 50).alias("geom_ft"),
        (F.col("event_id") * 37 % 480).cast("double").alias("gs_kt"),
        (F.col("event_id") * 53 % 360).cast("double").alias("track_deg"),
        (F.col("event_id") * 29 % 3000 - 1500).cast("double").alias("rate_fpm"),
        F.when(F.col("event_id") % 97 == 0, "7700").when(F.col("event_id") % 5 == 0, "1200").otherwise((1000 + F.col("k")).cast("string")).alias("squawk"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("N"), (F.col("user_id") % 7 + 1).cast("string"), (F.col("event_id") % 2).cast("string"))).alias("callsign"),
        F.expr("case event_type when 'click' then 'adsb_icao' when 'view' then 'mlat' when 'purchase' then 'tisb_icao' when 'error' then 'mode_s' end").alias("src"),
        F.when(F.col("event_id") % 3 != 0, 2).otherwise(0).alias("version"),
        F.when(F.col("k") < 12, 0).otherwise(3).alias("sil"),
        F.when(F.col("k") % 2 == 0, 0).otherwise(8).alias("nic"),
        F.concat(F.lit("A"), (F.col("k") % 4).cast("string")).alias("category"),
        F.when(~surface & (F.col("event_id") % 4 == 0), F.floor(F.col("value") * 100).cast("int") + (F.col("event_id") % 7 * 200 - 600).cast("int")).alias("mcp_ft"),
    )


def spread_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``points`` over more days: every two hours begin one or three days after the two before."""
    block = F.floor(F.col("ts") / 7200).cast("bigint")
    return points(spark, sf_dir).withColumn("ts", F.col("ts") + (2 * block - block % 2) * 86400)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as airports over the region where the points are."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), "s_acctbal")
    return s.select(
        F.concat(F.lit("K"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("ident"),
        F.round(30 + F.col("k") * 13 % 400 * 0.025, 4).alias("lat"),
        F.round(-100 + F.col("k") * 29 % 600 * 0.05, 4).alias("lon"),
        (F.col("k") * 17 % 3000).cast("int").alias("elevation_ft"),
        F.when(F.col("k") % 5 == 0, "heliport").when(F.col("k") % 3 == 0, "small_airport").otherwise("medium_airport").alias("type"),
    )


def navaids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as radio beacons."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    return p.select(F.concat(F.lit("V"), F.col("k").cast("string")).alias("ident"), F.round(30 + F.col("k") * 7 % 1000 * 0.01, 4).alias("lat"), F.round(-100 + F.col("k") * 11 % 3000 * 0.01, 4).alias("lon"))


def runway_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ends for each airport."""
    a = airports(spark, sf_dir)
    heading = (F.substring("ident", 2, 6).cast("int") * 10 % 180).cast("double")
    ends = F.array(F.struct(F.lit("A").alias("runway"), heading.alias("heading")), F.struct(F.lit("B").alias("runway"), (heading + 180).alias("heading")))
    return a.select("ident", "lat", "lon", "elevation_ft", F.explode(ends).alias("e")).select("ident", "lat", "lon", "elevation_ft", "e.runway", "e.heading")


def hex_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as address ranges, some overlapping."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    return n.select(F.col("n_name").alias("country"), (10485760 + F.col("k") * 8).alias("low"), (10485760 + F.col("k") * 8 + F.when(F.col("k") % 3 == 0, 20).otherwise(5)).alias("high"))


def registry_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as what trace days say about an aircraft."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), "c_mktsegment", "c_acctbal")
    return c.select(
        F.lpad(F.lower(F.hex(10485760 + F.col("k") % 100)), 6, "0").alias("icao"),
        F.when(F.col("k") % 11 != 0, F.concat(F.lit("T"), (F.col("k") % 3).cast("string"))).alias("type_code"),
        F.when(F.col("k") % 11 != 0, F.col("c_mktsegment")).alias("description"),
        F.concat(F.lit("N"), F.col("k").cast("string")).alias("registration"),
        F.col("k").alias("fetched_at"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as fetch requests."""
    o = table(spark, sf_dir, "orders")
    status = "case substr(o_orderpriority, 1, 1) when '1' then 200 when '2' then 404 when '3' then 429 when '4' then 500 else 403 end"
    source = "case o_orderstatus when 'F' then 'net_a' when 'O' then 'net_b' else 'net_c' end"
    return o.select(
        F.lpad(F.lower(F.hex(10485760 + F.col("o_custkey") % 50)), 6, "0").alias("icao"), F.expr(source).alias("source"), F.expr("cast(o_orderdate as date)").alias("date"), F.expr(status).alias("status"), F.col("o_orderkey").alias("fetched_at")
    )
