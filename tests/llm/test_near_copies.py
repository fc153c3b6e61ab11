import random

from contrail.llm import near_copies
from contrail.llm.near_copies import SIMILARITY, without_near_copies

from .helpers import blank_words, documents, grouped


def shingles(text, k=5):
    w = blank_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def alike(x, y):
    return x == y or len(x & y) >= SIMILARITY * len(x | y)


def expected(rows):
    """doc_ids that stay, of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in rows}
    roots = grouped(list(sets), lambda a, b: alike(sets[a], sets[b]))
    return [d for d in sorted(sets) if roots[d] == d]


def varied(rng, n, copies):
    out = []
    for _ in range(n):
        w = [rng.choice("abcdefghij") * rng.randint(1, 6) + str(rng.randint(0, 99)) for _ in range(rng.randint(30, 500))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, copies)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = "new" + str(rng.randrange(9))
            out.append(" ".join(v))
    rng.shuffle(out)
    return out


def test_groups_against_brute_force(spark):
    texts = [None, "", " \n", "one two", "one  two", "One TWO", *varied(random.Random(5), 40, 4), "x " * 40_000]
    found = [r.doc_id for r in without_near_copies(documents(spark, texts)).orderBy("doc_id").collect()]
    assert found == expected(list(enumerate(texts)))


def changed(rng, words, n, mark):
    v = list(words)
    for i in rng.sample(range(len(v)), n):
        v[i] = f"{mark}{i}"
    return v


def test_alike_texts_share_a_band():
    rng = random.Random(23)
    shared = n = 0
    while n < 1500:
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        other = changed(rng, words, 3, "new")
        x, y = shingles(" ".join(words)), shingles(" ".join(other))
        if 0.8 <= len(x & y) / len(x | y) < 0.83:
            n += 1
            shared += any(near_copies.sketch(" ".join(words))[2] == near_copies.sketch(" ".join(other))[2])
    assert shared >= 0.99 * n  # 0.997 or more is expected


def test_a_large_group_of_copies_and_its_outliers(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 20)
    monkeypatch.setattr(near_copies, "PIVOTS", 3)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = [" ".join(changed(rng, base, 1, f"changed{i}-")) for i in range(120)]
    # ever further from the base, each a near copy of the one before it
    for i in range(12):
        base = changed(rng, base, 3, f"step{i}-")
        texts.append(" ".join(base))
    texts += varied(rng, 10, 0)
    found = [r.doc_id for r in without_near_copies(documents(spark, texts)).orderBy("doc_id").collect()]
    assert found == expected(list(enumerate(texts)))


def boilerplate(rng, pairs):
    """Pairs of alike texts, of whose words 85 % are one boilerplate: texts of different pairs are not alike."""
    shared = " ".join(f"b{i}" for i in range(170))
    texts = []
    for p in range(pairs):
        own = [f"p{p}w{i}" for i in range(30)]
        texts += [f"{shared} {' '.join(own)}", f"{shared} {' '.join(changed(rng, own, 1, f'c{p}-'))}"]
    rng.shuffle(texts)
    return texts


def test_many_groups_in_one_shard(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 32)
    monkeypatch.setattr(near_copies, "PIVOTS", 4)
    texts = boilerplate(random.Random(3), 150)
    docs = documents(spark, texts)
    nodes = near_copies.sketches(docs)
    assert not near_copies.large_shards(nodes).isEmpty()
    found = [r.doc_id for r in without_near_copies(docs).orderBy("doc_id").collect()]
    assert found == expected(list(enumerate(texts))) and len(found) == 150


def test_all_texts_of_a_token_meet(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 8)

    def check(roots):
        rows = [(1, 0, 10, bytes([i]), bytes([r])) for i, r in enumerate(roots)]
        parts = {}
        for r in near_copies.met(spark.createDataFrame(rows, "token long, at long, size long, node binary, root binary")).collect():
            parts.setdefault(r.part, []).append(r.node[0])
        found = {frozenset((a, b)) for p in parts.values() for a in p for b in p if roots[a] != roots[b]}
        wanted = {frozenset((a, b)) for a in range(len(roots)) for b in range(len(roots)) if roots[a] != roots[b]}
        assert found == wanted and all(len(p) <= 4 * 8 for p in parts.values())

    check([0, 1, 2])  # whole
    check([0] * 40 + [1, 2, 3])  # a component and a few others
    check(list(range(40)))  # no component: every two chunks
    check([0] * 40)  # one component: nothing to do


def test_alike_texts_are_candidates(spark):
    rng = random.Random(17)
    texts = varied(rng, 12, 3)
    sets = [shingles(t) for t in texts]
    rows = [(bytes([i]), bytes([i]), t) for i, t in enumerate(texts)]
    tokens = near_copies.prefixes(spark.createDataFrame(rows, "node binary, root binary, text string"))
    found = {(r.u[0], r.v[0]) for r in near_copies.candidates(tokens).collect()}
    assert {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(sets[i], sets[j])} <= found


def test_columns_null_ids_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [text, text + " more", text, text, "other words"], [None, 7, 3, 3, None])
    rows = without_near_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("3", text), ("3", text), ("None", "other words")]
    assert without_near_copies(docs).columns == docs.columns and rows[0]["a.b"] == "dot" and rows[0].row == "r"
    assert without_near_copies(docs.where("false")).count() == 0
