"""Range, interval and identity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tracks import last_known


def in_ranges(addresses: DataFrame, ranges: DataFrame, bits: int = 6) -> DataFrame:
    """The narrowest range (then the lowest) that holds each address; null where none does.

    Ranges are cut at multiples of 2**bits, so that the join is on the block's number; neither side is broadcast.
    """
    n = F.conv("icao", 16, 10).cast("long")
    left = addresses.select("icao").distinct().select("icao", n.alias("n"), F.shiftright(n, bits).alias("block"))
    right = ranges.select("*", F.explode(F.sequence(F.shiftright("low", bits), F.shiftright("high", bits))).alias("block"))
    met = left.join(right, "block").where(F.col("n").between(F.col("low"), F.col("high")))
    best = met.groupBy("icao").agg(F.min(F.struct((F.col("high") - F.col("low")).alias("w"), "low", "country")).alias("b"))
    return left.select("icao").join(best, "icao", "left").select("icao", F.col("b.country").alias("country"))


SHORT, RADIX, LEVELS = 24, 4, 6  # buckets of a short interval; bits between levels of longer ones, and how many levels there are


def within_intervals(messages: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, bucket_s: int = 3600) -> DataFrame:
    """Messages inside intervals of the same key, both ends included, as equi-joins on key and bucket.

    A short interval lies in each bucket that it touches. A longer one lies in at most 17 nodes of the level of a tree of buckets, each
    level's 16 times as wide, that suits its length, and only messages of keys that have such an interval are looked up at every level: an interval
    of years does not become a row an hour. The last level's nodes are as wide as they need be.
    """
    block = lambda x: F.floor(F.col(x) / bucket_s).cast("long")
    sized = intervals.where(F.col(start) <= F.col(end)).withColumns({"_a": block(start), "_z": block(end)})
    inside = F.col(ts).between(F.col(start), F.col(end))
    short = F.col("_z") - F.col("_a") < SHORT
    few = sized.where(short).withColumn("_b", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    found = messages.withColumn("_b", block(ts)).join(few, [key, "_b"]).where(inside).drop("_b")
    at = lambda x, level: F.shiftright(F.col(x), RADIX * level)
    fits = F.coalesce(*(F.when(at("_z", i) - at("_a", i) <= 1 << RADIX, i) for i in range(1, LEVELS)), F.lit(LEVELS))
    node = lambda x: F.element_at(F.array(*(at(x, i) for i in range(1, LEVELS + 1))), F.col("_l"))
    long = sized.where(~short).withColumn("_l", fits)
    nodes = long.withColumn("_b", F.explode(F.sequence(node("_a"), node("_z")))).drop("_a", "_z")
    asked = messages.join(long.select(key).distinct(), key, "left_semi").withColumns({"_a": block(ts), "_l": F.explode(F.array(*map(F.lit, range(1, LEVELS + 1))))})
    far = asked.withColumn("_b", node("_a")).drop("_a").join(nodes, [key, "_l", "_b"]).where(inside).drop("_b", "_l")
    return found.unionByName(far)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: list[str], within_s: float | None = None, before: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` of the same key at or before its own ``ts``, and that row's time as ``as_of``.

    Both have ``key`` and ``ts``. Of rows of ``right`` at one time the last by ``order`` counts. ``before`` leaves out those at the very time,
    ``within_s`` those longer ago. Both sides are one stream in order of time, and the last value runs along it in chunks of a
    key's days (``tracks.last_known``), so that a hot key is many tasks' work and no interval is exploded.
    """
    side = F.lit(0 if before else 1)
    asked = left.select(F.struct(*left.columns).alias("_row"), key, ts, side.alias("_side"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)))
    known = F.struct(F.col(ts).alias("as_of"), *values)
    told = right.where(F.col(ts).isNotNull()).select(key, ts, (1 - side).alias("_side"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), known.alias("_known"))
    both = asked.unionByName(told, allowMissingColumns=True)
    run = last_known(both, "_known", "_last", key, ts, ["_side", *(f"_o{i}" for i in range(len(order)))])
    rows = run.where("_row is not null").select("_row.*", F.when(F.col(f"_row.{ts}").isNotNull(), F.col("_last")).alias("_last"))
    fresh = F.lit(True) if within_s is None else F.col(ts) - F.col("_last.as_of") <= within_s
    return rows.withColumn("_last", F.when(fresh, F.col("_last"))).select(*left.columns, "_last.*")


def merged_identity(base: DataFrame, sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Each column from the first source that has it, and the columns on which sources disagree."""
    out = base.select("icao").distinct()
    for name, source in sources:
        out = out.join(source.select("icao", *(F.col(c).alias(f"{name}_{c}") for c in columns)), "icao", "left")
    names = [n for n, _ in sources]
    pick = [F.coalesce(*(F.col(f"{n}_{c}") for n in names)).alias(c) for c in columns]
    differ = lambda c: F.size(F.array_distinct(F.array_compact(F.array(*(F.col(f"{n}_{c}") for n in names))))) > 1
    conflicts = F.array_join(F.array_compact(F.array(*(F.when(differ(c), F.lit(c)) for c in columns))), ",")
    return out.select("icao", *pick, conflicts.alias("conflicts"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` has not."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def prior_end(legs: DataFrame, boundary: Column) -> DataFrame:
    """Per aircraft: the end of its last leg that began before ``boundary``."""
    return legs.where(F.col("takeoff_ts") < boundary).groupBy("icao").agg(F.max_by("landing_ts", "takeoff_ts").alias("prev_end_ts"))


def top_per_group(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group: a top-k report; cut within tasks before the shuffle by Spark's group limit."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
