import hashlib
import random

import numpy as np
import pytest
from contrail.llm import fill_in_middle as fim
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .helpers import documents

ODD = ["a", "é", "€", "😀", "́", "x<", "P>", "S>M", "\n"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_index_against_counting(text):
    data = text.encode("utf-8", "surrogatepass")
    index = fim.Exceptions(np.frombuffer(data, np.uint8))
    starts = [len(text[:i].encode("utf-8", "surrogatepass")) for i in range(len(text) + 1)]
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == starts
    snapped = [max(i for i, s in enumerate(starts) if s <= at) for at in range(len(data) + 1)]
    assert index.to_chars(np.arange(len(data) + 1)).tolist() == snapped
    assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


def expected(doc_id, text, plain=90, spm=20, seed=1):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(s in t for s in fim.SENTINELS) or h[2] % 100 >= plain:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_against_slices(spark):
    rng = random.Random(4)
    texts = [None, "", "<P>", "a<M>b", "<", "<<S", "é" * 50_000, "plain ascii " * 20_000]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = documents(spark, texts)
    rows = fim.fill_in_middle(docs, piece=900).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "") and r.row == "r" and r["a.b"] == "dot"


def test_byte_cuts_stay_between_characters(spark):
    texts = ["é€😀a" * k for k in range(1, 60)]
    found = fim.fill_in_middle(documents(spark, texts), ["doc_id"], unit="bytes").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in found:
        assert r.back == texts[r.doc_id] and "�" not in r.output
        if r.form != "plain":
            x = hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()
            data = texts[r.doc_id].encode()
            a = min(int(x[:8], 16) % (len(data) + 1), int(x[8:16], 16) % (len(data) + 1))
            assert r.prefix_chars == len(data[:a].decode(errors="ignore"))
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents(spark, ["a"]), unit="words")


def test_edge_cases(spark):
    docs = documents(spark, ["same text", "same text", "other", None], ids=[None, None, 7, 7])
    rows = fim.fill_in_middle(docs, ["doc_id"]).collect()
    assert sorted((r.output for r in rows), key=str) == sorted(expected(i, t)[4] for i, t in [(None, "same text")] * 2 + [(7, "other"), (7, None)])
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    clashing = docs.withColumns({"output": F.lit("x"), "form": F.lit(1), "draws": F.lit(2), "n": F.lit("y")})
    assert sorted(r.n for r in fim.fill_in_middle(clashing).collect()) == [0, 5, 9, 9]
