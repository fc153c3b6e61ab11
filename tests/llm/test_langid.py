from itertools import pairwise, product

import numpy as np
from pyspark.sql import functions as F

from contrail.llm import queries
from contrail.llm.langid import Model, identify, language_id, sample, train, turned, words

from ..conftest import DATA
from .helpers import documents



def test_marginals_and_turns_against_enumeration():
    rng = np.random.default_rng(4)
    model = Model(["a", "b", "c"], {})
    model.transition, model.start = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    counts = np.array([1, 4, 3])
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    found, (forward, backward, e, real, turn, _) = model.marginals(scores, counts)
    expected, turns, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in counts:
        paths = list(product(range(3), repeat=n))
        weight = np.exp([model.start[p[0]] + sum(scores[at + i, s] for i, s in enumerate(p)) + sum(model.transition[a, b] for a, b in pairwise(p)) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i, s in enumerate(p):
                expected[at + i, s] += w
            for a, b in pairwise(p):
                turns[a, b] += w
        at += n
    assert np.allclose(found, expected, atol=1e-5) and np.allclose(turned(forward, backward, e, real, turn), turns, atol=1e-5)


def test_training_raises_the_likelihood_of_its_labels():
    model = train([(x, t) for x, t in TEXTS.items() for _ in range(5)])
    for i, x in enumerate(model.languages):
        w = words(TEXTS[x])
        found, _ = model.marginals(model.scores(w), np.array([len(w)]))
        assert found[:, i].mean() > 0.8


def test_words_keep_their_combining_marks():
    assert words("नमस्ते दुनिया, e\u0301te\u0301 x1y") == ["नमस्ते", "दुनिया", "e\u0301te\u0301", "x", "y"]
    assert words("12 \u0301") == [] == words(None)


TEXTS = {"en": "the cat and the dog with this", "fr": "le chat et les chiens avec une", "de": "der hund und die katze mit einem"}


def labelled(spark):
    texts = [f"{TEXTS[x]} {TEXTS[x]}" for x in TEXTS for _ in range(20)]
    return documents(spark, texts, lang={i: x for i, x in enumerate(x for x in TEXTS for _ in range(20))})


def test_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right / n >= 0.95


def test_code_switched_words_are_labelled(spark):
    model = train(sample(labelled(spark)))
    rows = identify(documents(spark, [f"{TEXTS['en']} {TEXTS['de']}"]), model).collect()
    assert rows[0].switches == 1 and 0.4 < rows[0].score < 0.6


def test_edge_cases_and_columns(spark):
    model = train(sample(labelled(spark)))
    texts = [None, "", "123 !? ²½", "\n", "the", TEXTS["fr"] + " 日本", "und die katze " * 30_000]
    rows = sorted(identify(documents(spark, texts), model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "und", "en", "fr", "de"]
    assert [r.score for r in rows[:4]] == [0.0] * 4 and all(0 < r.score <= 1 for r in rows[4:])
    assert all((r.row, r.h, r["a.b"]) == ("r", "y", "dot") for r in rows)


def test_lang_is_no_input_of_a_prediction(spark):
    docs = labelled(spark)
    model = train(sample(docs))
    a, b = (identify(x, model, ["doc_id"]).orderBy("doc_id").collect() for x in (docs, docs.withColumn("lang", F.lit("zz"))))
    assert a == b


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["some words"])
    assert language_id(docs.withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"
    assert language_id(docs.where("false")).count() == 0
