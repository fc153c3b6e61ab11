"""Point-level predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def ground_state(c: Config = DEFAULT) -> tuple[Column, Column]:
    """State and reason; the first rule that fits. Columns: surface, baro_ft, geom_ft, gs_kt."""
    ground, baro, geom, gs = F.coalesce("surface", F.lit(False)), F.col("baro_ft"), F.col("geom_ft"), F.col("gs_kt")
    rules = [
        (ground & (geom > c.baro_error_geom_ft), "airborne", "baro_error"),
        (ground & (gs > c.landing_speed_kt), "airborne", "speed_override"),
        (ground, "ground", "surface"),
        ((baro < 50) & (geom.isNull() | (geom < 200)), "ground", "low"),
        (baro >= 50, "airborne", "baro"),
        (geom >= 200, "airborne", "geom"),
        (geom < 200, "ground", "geom"),
    ]
    pick = lambda i: F.coalesce(*(F.when(r[0], r[i]) for r in rules), F.lit("unknown"))
    return pick(1), pick(2)


def source_bucket(src: str = "src") -> Column:
    s = F.col(src)
    return F.when(s.isNull(), None).when(s.startswith("adsb_"), "adsb").when(s == "mlat", "mlat").when(s.startswith("tisb_"), "tisb").when(s == "adsc", "adsc").otherwise("other")


def source_category(src: str = "src") -> Column:
    s = F.col(src)
    return F.when(s.startswith("adsb"), "adsb").when(s.startswith("mlat"), "mlat").otherwise("other")


def classified(points: DataFrame, c: Config = DEFAULT) -> DataFrame:
    state, reason = ground_state(c)
    return points.withColumns({"state": state, "reason": reason, "bucket": source_bucket(), "kind": source_category()})


def source_mix(points: DataFrame, key: list[str]) -> DataFrame:
    """Points and the percentage of each source bucket; null sources count in the whole only."""
    n = F.count("*")
    share = lambda b: F.round(100 * F.count_if(F.col("bucket") == b) / n, 2).alias(f"{b}_pct")
    return classified(points).groupBy(*key).agg(n.alias("n_points"), *map(share, ("adsb", "mlat", "tisb", "adsc", "other")), F.count_if(F.col("reason").isin("baro_error", "speed_override")).alias("baro_error_points"))
