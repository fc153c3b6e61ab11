"""Where tables are kept: the folder that driver and executors share, and trace days as bucketed tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only Spark in one process, as in tests, makes its own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, from a table in the shared folder: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def day_of(ts: Column) -> Column:
    """The day of a time in seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))


def day_statistics(points: DataFrame) -> DataFrame:
    """Per (aircraft, day), what is kept beside its points: their number, integrity of version-2 samples, first time and callsigns."""
    v2 = F.col("version") == 2
    said = F.when(F.col("callsign").isNotNull(), F.struct("ts", "seq"))
    return points.groupBy("icao", "day").agg(
        F.count("*").alias("n_points"),
        F.count_if(v2).alias("v2"),
        F.count_if(v2 & (F.col("sil") == 0)).alias("sil0"),
        F.count_if(v2 & (F.col("nic") == 0)).alias("nic0"),
        F.array_join(F.array_sort(F.collect_set(F.when(v2, F.col("src")))), ",").alias("sources"),
        F.array_join(F.array_sort(F.collect_set("src")), ",").alias("all_sources"),
        F.min("ts").alias("first_ts"),
        F.min("callsign").alias("callsign"),
        F.max_by("callsign", said).alias("last_callsign"),
    )


class TraceStore:
    """Trace days as two tables: ``points``, partitioned by day and bucketed by aircraft, and ``days``, their statistics.

    Windows and aggregates by aircraft read the buckets as they lie, without an exchange; a range of days reads its folders alone;
    integrity scores, calendars, boundaries and carried callsigns read the statistics and no point.

    ``put`` replaces whole trace days, so that a day fetched again wins. Each table is written with dynamic partition
    overwrite, from staged files that a commit puts in place at once: a job that is killed leaves the old days. Points come
    first, and statistics are made from what was put; putting the same days again makes both agree after a kill between the two.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 200):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder.rstrip("/"), buckets

    def open(self, points: StructType) -> TraceStore:
        """Registers the tables over the folder, which may be new or hold them already. points: the columns without day."""
        new = not self.spark.catalog.tableExists(self.name)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points)
        kind = points["ts"].dataType.simpleString()
        sorted_by = f"clustered by (icao) sorted by (icao, ts, seq) into {self.buckets} buckets"
        self.spark.sql(f"create table if not exists {self.name} ({fields}, day date) using parquet partitioned by (day) {sorted_by} location '{self.folder}/points'")
        counts = f"icao string, n_points long, v2 long, sil0 long, nic0 long, sources string, all_sources string, first_ts {kind}, callsign string, last_callsign string, day date"
        self.spark.sql(f"create table if not exists {self.name}_days ({counts}) using parquet partitioned by (day) location '{self.folder}/days'")
        if new:
            for table, part in ((self.name, "points"), (f"{self.name}_days", "days")):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
                self.spark.catalog.recoverPartitions(table)
        return self

    def points(self) -> DataFrame:
        return self.spark.table(self.name)

    def days(self) -> DataFrame:
        return self.spark.table(f"{self.name}_days")

    def put(self, points: DataFrame) -> None:
        """Replaces the trace days that ``points`` holds, of the aircraft that it holds on them. Other days' files are not touched.

        Only the list of days comes to the driver: a few thousand values at most, as days are calendar days.
        """
        new = points.withColumn("day", day_of(F.col("ts")))
        touched = [r.day for r in new.select("day").distinct().collect()]
        if not touched:
            return
        key, here = new.select("icao", "day").distinct(), F.col("day").isin(touched)
        names = self.points().columns
        kept = self.points().where(here).join(key, ["icao", "day"], "left_anti")
        rows = kept.select(names).unionByName(new.select(names))
        self._overwrite(rows.repartition(self.buckets, "icao").sortWithinPartitions("day", "icao", "ts", "seq"), self.name)
        self._overwrite(day_statistics(self.points().where(here)).select(self.days().columns).repartition("day"), f"{self.name}_days")

    def _overwrite(self, rows: DataFrame, table: str) -> None:
        conf, mode = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(table)
        finally:
            conf.set(mode, before)
