"""Flights kept as a table, and brought up to date from the days that new or late trace data can reach.

The table is partitioned by a hash of the aircraft and the day of takeoff. An incremental run finds each aircraft's boundary,
the last day before the new data that no earlier day can reach across; takes up what a full run would hold there
(the last callsign, the end of the last flight); extracts the points from there on; and replaces the aircraft's rows from that day,
by dynamic partition overwrite of the partitions concerned alone. Stored rows then equal those of a full run.

An aircraft that cannot be extended has the whole of its history for its window. Readers see only whole partitions; a run that is
killed leaves the old ones, and the same run again gives the same rows. An emptied partition keeps one marker row without an
aircraft, since dynamic overwrite replaces only partitions that it writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.store import TraceStore, day_of, written
from .feeds import refusals
from .flights import flights
from .rollups import scores_of
from .tracks import safe_boundary

VERSION = "2"
KEYS = ["shard", "day"]


def shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("icao"), F.lit(shards)).cast("int")


def extracted(points: DataFrame, c: Config = DEFAULT, types: DataFrame | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Flights with the minutes on the ground before each, and day. carried (icao, callsign, prev_end): what came before the points."""
    rows = flights(points, c, types, carried)
    rows = rows.join(carried.select("icao", "prev_end"), "icao", "left") if carried is not None else rows.withColumn("prev_end", F.lit(None).cast(points.schema["ts"].dataType))
    w = Window.partitionBy("icao").orderBy("first_ts", "takeoff_ts")
    end = F.coalesce(F.lag(F.coalesce("landing_ts", "last_ts")).over(w), F.col("prev_end"))
    return rows.withColumns({"ground_min": F.round((F.col("takeoff_ts") - end) / 60, 1), "extractor_version": F.lit(VERSION), "day": day_of(F.col("takeoff_ts"))}).drop("prev_end")


class FlightTable:
    """A stored table of rows by aircraft and day, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = 64):
        self.spark, self.folder, self.shards = spark, folder.rstrip("/"), shards

    def create(self, rows: DataFrame) -> FlightTable:
        """Writes all rows anew. A marker keeps the columns of a table without rows."""
        marker = self.spark.sql("select 0 as shard, date '1970-01-01' as day")
        rows.withColumn("shard", shard(self.shards)).unionByName(marker, allowMissingColumns=True).repartition(*KEYS).write.mode("overwrite").partitionBy(*KEYS).parquet(self.folder)
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().where("icao is not null").drop("shard")

    def replace(self, rows: DataFrame, boundary: DataFrame) -> None:
        """Puts ``rows`` in the place of each aircraft's rows from its ``boundary`` (icao, boundary) on."""
        stored = self._stored()
        marked = stored.join(boundary, "icao", "left").withColumn("_goes", F.coalesce(F.col("day") >= F.col("boundary"), F.lit(False))).drop("boundary")
        new = rows.withColumn("shard", shard(self.shards))
        touched = marked.where("_goes").select(*KEYS).unionByName(new.select(*KEYS)).distinct()
        kept = marked.where(~F.col("_goes") & F.col("icao").isNotNull()).drop("_goes").join(touched, KEYS, "left_semi")
        markers = stored.limit(0).unionByName(touched, allowMissingColumns=True)
        names = stored.columns
        whole = kept.select(names).unionByName(new.select(names)).unionByName(markers.select(names))
        whole.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.folder)


def spoofed_days(store: TraceStore, c: Config = DEFAULT) -> DataFrame:
    """Flagged trace days, from the stored statistics alone."""
    return scores_of(store.days(), c).where("flagged").select("icao", "day", "v2", "sil0", "nic0", "sil0_pct", "sources", "first_ts", "callsign")


def full_extract(store: TraceStore, table: FlightTable, spoofs: FlightTable, c: Config = DEFAULT, types: DataFrame | None = None) -> None:
    table.create(extracted(store.points().drop("day"), c, types))
    spoofs.create(spoofed_days(store, c))


def windows(store: TraceStore, stored: DataFrame, since: str, c: Config = DEFAULT, types: DataFrame | None = None) -> DataFrame:
    """icao, boundary: from where each aircraft with a day from ``since`` on is to be extracted; its first day where it is refused."""
    days = store.days().select("icao", "day")
    boundary = safe_boundary(days, since, c, types)
    why = refusals(boundary, stored, VERSION)
    first = days.groupBy("icao").agg(F.min("day").alias("first"))
    joined = boundary.join(why, "icao").join(first, "icao")
    return joined.select("icao", F.when(F.col("why").isNull(), F.col("boundary")).otherwise(F.col("first")).alias("boundary"))


def carried(store: TraceStore, stored: DataFrame, boundary: DataFrame) -> DataFrame:
    """icao, callsign, prev_end at each boundary: from the statistics of days and the stored flights, not from points."""
    before = F.col("day") < F.col("boundary")
    said = store.days().join(boundary, "icao").where(before & F.col("last_callsign").isNotNull()).groupBy("icao").agg(F.max_by("last_callsign", "day").alias("callsign"))
    flown = stored.join(boundary, "icao").where(before).groupBy("icao").agg(F.max_by(F.coalesce("landing_ts", "last_ts"), F.struct("first_ts", "takeoff_ts")).alias("prev_end"))
    return boundary.select("icao").join(said, "icao", "left").join(flown, "icao", "left")


def incremental_extract(store: TraceStore, table: FlightTable, spoofs: FlightTable, since: str, c: Config = DEFAULT, types: DataFrame | None = None) -> None:
    """Brings the flights and the flagged days up to date with trace days from ``since`` on, whether new or late."""
    stored = table.read()
    boundary = written(windows(store, stored, since, c, types), "extract-boundaries")
    from_day = boundary.agg(F.min("boundary")).first()[0]
    if from_day is None:
        return
    # one bound for all aircraft prunes folders; each one's own follows
    window = store.points().where(F.col("day") >= F.lit(from_day)).join(boundary, "icao").where("day >= boundary").drop("boundary", "day")
    table.replace(written(extracted(window, c, types, carried(store, stored, boundary)), "extract-flights"), boundary)
    flagged = spoofed_days(store, c).join(boundary, "icao").where("day >= boundary").drop("boundary")
    spoofs.replace(written(flagged, "extract-spoofs"), boundary)
