import hashlib
import random

from contrail.llm.decontaminate import decontaminate

from .helpers import documents, plain_words


def expected(texts, items, window=13):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= owners
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def check(spark, texts, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(documents(spark, texts), bench, **options).collect()
    assert {r.doc_id: (int(r.n_words), r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == expected(texts, items)
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) >= r.n_hit for r in rows)
    assert all((r.row, r.h, r["a.b"]) == ("r", "y", "dot") for r in rows)


def cases():
    rng = random.Random(11)
    vocabulary = ["the", "of", "É", "a1", "über", "x"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, draw(rng.randint(10, 40))) for i in range(30)] + [(90, None), (91, ""), (92, "..."), (93, "solo"), (94, "the x the of"), (5, draw(15)), (None, draw(14))]
    texts = [None, "", "?!", "solo", "SOLO!", draw(20_000)]
    for _ in range(60):
        parts = [draw(rng.randint(0, 30))]
        if rng.random() < 0.7:
            w = rng.choice(items)[1] or ""
            parts += [w.upper().replace(" ", ", ") if rng.random() < 0.5 else w, draw(rng.randint(0, 300))]
        texts.append("\n".join(parts))
    return texts, items


def test_against_brute_force(spark):
    check(spark, *cases())


def test_a_benchmark_in_several_blocks(spark):
    check(spark, *cases(), block_bytes=600)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(documents(spark, ["some words", None]), bench).collect()
    assert [(r.n_hit, r.contaminated) for r in rows] == [(0, False)] * 2
    assert decontaminate(documents(spark, ["a"]).where("false"), bench, ["doc_id"]).count() == 0
