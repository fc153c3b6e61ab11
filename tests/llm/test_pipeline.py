"""The pipeline against a plain version of each stage, over the small tables."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from contrail.llm.langid import identify, sample, train

from ..conftest import DATA
from .helpers import documents
from .test_decontaminate import expected as contaminated
from .test_line_dedup import expected as deduplicated
from .test_near_copies import expected as different


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made, outs = docs, []
    for name, stage in pipeline.STAGES:
        outs.append(made := stage(spark, made, DATA).cache())
        assert name == "pack" or made.columns == docs.columns
    rows = [sorted(o.collect(), key=lambda r: r.doc_id) for o in outs]
    model = train(sample(docs))
    language = {r.doc_id for r in identify(docs, model).where(f"lang_pred <> 'und' and score >= {pipeline.OVER_CHANCE / len(model.languages)}").collect()}
    assert [r.doc_id for r in rows[0]] == sorted(language)
    kept = [(r.doc_id, text, r.text) for r, (text, _) in zip(rows[0], deduplicated([r.text for r in rows[0]], 50), strict=True)]
    kept = [(d, text) for d, text, old in kept if text == old or text.strip()]
    assert [(r.doc_id, r.text) for r in rows[1]] == kept
    assert [r.doc_id for r in rows[2]] == different(kept)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    flagged = contaminated([r.text for r in rows[2]], bench)
    assert [r.doc_id for r in rows[3]] == [r.doc_id for i, r in enumerate(rows[2]) if not flagged[i][4]]
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3]}
    assert all(r.n_chars == len(r.text) for r in rows[1])


def test_run_returns_the_last_stage(spark):
    assert pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert pipeline.ORACLE_SQL is None


def test_stages_keep_input_columns_whatever_their_names(spark):
    text = "the cat and the dog with this and that\n" * 3
    docs = documents(spark, [text + "one", None, text + "two", "", text], [3, 1, None, 4, 5]).withColumns({c: F.lit(f"own {c}") for c in ("score", "n_words", "items", "n_lines", "dropped_lines", "lang_pred", "node")})
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns, name
        assert all(r[c] == f"own {c}" for r in found.collect() for c in ("score", "n_words", "items", "n_lines", "dropped_lines", "lang_pred", "node")), name
        assert stage(spark, docs.where("false"), DATA).count() == 0
