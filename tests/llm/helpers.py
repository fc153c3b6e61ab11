"""Small document tables, and brute-force versions to hold operators against."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, `_id` string, h string, score string, spans string, n_words string, fp string, `a.b` string"


def documents(spark, texts, ids=None, lang=None):
    """A table of documents with extra columns whose names operators might use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (lang or {}).get(i, "en"), "src", len(t) if t else None, "r", "x", "y", "z", "s", "n", "f", "dot") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def grouped(ids, linked):
    """Least id reachable from each, over linked(a, b)."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
