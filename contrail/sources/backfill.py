"""Moving raw trace days into the store, in batches that a kill may part anywhere.

A batch is a range of days of about as many raw rows. Its days are put in the store first, which replaces them whole, and only then
does a row of the progress table say so. Killed between the two, the next run puts the same days again and gets the same
tables; days that the progress table names are not read again. Raw rows that do not decode are counted and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .store import TraceStore

PROGRESS = "days array<date>, raw_rows long, malformed long, points long"


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that are done."""
    try:
        return spark.read.schema(PROGRESS).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


def ranges(counts: list[tuple], rows: int) -> list[list]:
    """Runs of consecutive days of about ``rows`` raw rows, at least one day each. counts: (day, rows) in order of day."""
    out, held = [], 0
    for day, n in counts:
        if not out or held >= rows:
            out.append([])
            held = 0
        out[-1].append(day)
        held += n
    return out


def backfill(raw: DataFrame, decoded, store: TraceStore, folder: str, rows: int = 1_000_000, most: int | None = None) -> dict[str, int]:
    """Puts what ``raw`` (icao, day and whatever ``decoded`` reads) holds on days that are not done yet; the sums of what this run did.

    ``decoded`` makes points (icao, ts, seq and the store's other columns) of raw rows, and no point of a row that it cannot read. ``most`` stops after so many
    batches. Only a count a day comes to the driver.
    """
    spark = raw.sparkSession
    done = {day for r in progress(spark, folder).collect() for day in r.days}
    counts = [(r.day, r["count"]) for r in raw.where("day is not null").groupBy("day").count().orderBy("day").collect()]
    made = {"batches": 0, "raw_rows": 0, "malformed": 0, "points": 0}
    held = {d: n for d, n in counts}
    for days in ranges([(d, n) for d, n in counts if d not in done], rows)[:most]:
        batch = raw.where(F.col("day").isin(days))
        store.put(decoded(batch).select(*(c for c in store.points().columns if c != "day")))
        stored = store.days().where(F.col("day").isin(days)).select("icao", "day", "n_points")
        points = stored.agg(F.coalesce(F.sum("n_points"), F.lit(0))).first()[0]
        row = (days, sum(held[d] for d in days), batch.join(stored, ["icao", "day"], "left_anti").count(), points)
        spark.createDataFrame([row], PROGRESS).write.mode("append").parquet(folder)
        for name, n in zip(made, (1, *row[1:]), strict=True):
            made[name] += n
    return made
