"""The registered queries of this subpackage: thin, whole-table applications of its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan as licenses
from . import oracle, url_filter
from .chat import digests, format_conversations
from .common import table
from .context_mixing import context_mixing_scores
from .decontaminate import decontaminate
from .fill_in_middle import fill_in_middle, restored
from .langid import language_id
from .line_dedup import line_dedup
from .merkle import merkle_fingerprints
from .mixing import mix
from .packing import best_fit_packing
from .simhash import simhash_groups
from .spelling import spelling_variants


def crc_remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return language_id(docs, ~held_out, ["doc_id", "held_out"])


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return digests(format_conversations(turns.unionByName(own)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("dropped_lines", F.array_join("dropped_lines", ","))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing_scores(table(spark, sf_dir, "documents"), crc_remainder(5) == 1)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    text = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), drop_every=199)


def queries() -> dict:
    found = (
        op1_language_id,
        op2_chat_format,
        op3_license_scan,
        op4_line_dedup,
        op5_simhash_near_dedup,
        op6_best_fit_packing,
        op7_url_filter,
        op8_merkle_fingerprint,
        op9_benchmark_decontamination,
        op10_context_mixing,
        op11_source_mix,
        op12_fill_in_middle,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
