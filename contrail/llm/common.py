"""Shared helpers: table access and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and Spark runs in one process (tests, notebooks) a temporary folder is made;
    on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage durably.

    Losing an executor afterwards costs no recomputation, and what Python computed is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as an identifier."""
    return "`" + name.replace("`", "``") + "`"


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as one struct ``row``, and ``text`` beside it unless the struct has it: a text goes to Python once."""
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in keep)).alias("row")
    return docs.select(row) if "text" in keep else docs.select(row, F.col("text").alias("text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ``with_text`` rows."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that no input column can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row"))


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of ``row`` again, but for those in ``changed``."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]


_kept: dict = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps across its tasks under ``key``. It keeps one thing at a time: another one takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v): rows (node, root), root the least node reachable.

    Alternates large-star and small-star steps, each a minimum by node and a join back, which AQE can split at
    a hub. Rounds go on until nothing changes, about as many as the logarithm of the longest chain; each is written to
    the shared folder, and only a row count and a checksum come to the driver.
    Null ends are dropped. Nodes without an edge to another node do not appear.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
