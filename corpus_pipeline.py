"""A corpus-cleaning pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.common import table, written
from contrail.llm.decontaminate import decontaminated
from contrail.llm.langid import UNDETERMINED, identified, sample, train
from contrail.llm.line_dedup import line_dedup
from contrail.llm.near_copies import without_near_copies
from contrail.llm.packing import best_fit_packing

#: A text goes if its best language's mean marginal is under this many times what chance gives. Texts that switch between
#: three of four languages, and short ones with a foreign line, stay above it.
OVER_CHANCE = 1.2


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that no one language holds."""
    model = train(sample(docs))
    least = OVER_CHANCE / max(2, len(model.languages) if model else 1)
    return identified(docs, model, docs.columns).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages seen earlier out of texts, and drops the documents that were nothing else."""
    return line_dedup(docs, counts=False)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return without_near_copies(docs)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark's passages for a twentieth of their words or more."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), docs.columns).where(~F.col("contaminated")).select("row.*")


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences: a row a piece."""
    return best_fit_packing(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", stage_language),
    ("lines", stage_lines),
    ("near_copies", stage_near_copies),
    ("benchmark", stage_benchmark),
    ("pack", stage_pack),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
