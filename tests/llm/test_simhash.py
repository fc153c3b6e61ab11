import random

import xxhash
from contrail.llm.common import components
from contrail.llm.simhash import Tree, _first_masks, shards, simhash_groups, spanning

from .helpers import blank_words, documents, grouped


def simhash(text):
    w = blank_words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "one two", "One TWO three", "É été\x0bb", "x" * 50_000]
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)).split()
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(9))
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    fp = dict(enumerate(map(simhash, texts)))
    roots = grouped(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(documents(spark, texts)).collect()}
    assert found == {i: (f"{fp[i]:016x}", roots[i]) for i in fp}


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", "other words are here now"], ids=[None, 7, 7, None])
    rows = simhash_groups(docs).collect()
    assert len(rows) == 4
    assert sorted((r.component_id for r in rows), key=str) == [7, 7, 7, None]


def test_empty_table(spark):
    assert simhash_groups(documents(spark, ["a"]).where("false")).count() == 0


def test_tree_finds_all_within_radius():
    rng = random.Random(5)
    values = list({rng.getrandbits(12) for _ in range(500)})
    tree = Tree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)
    assert len(spanning(values)) < len(values)


def test_a_tree_visits_a_part_of_its_nodes():
    rng = random.Random(6)
    tree = Tree()
    for _ in range(256):
        tree.add(rng.getrandbits(64))
    tree.visited = 0
    for _ in range(100):
        tree.within(rng.getrandbits(64), 3)
    assert tree.visited < 0.5 * 100 * 256


def test_shards_hold_real_trees_at_any_size():
    for count in (0, 1, 300, 5_000, 10**6, 10**8, 10**10):
        masks = _first_masks(count, 3)
        assert all(m & whole == m for m, whole in masks.items())
        bits = min(m.bit_count() for m in masks)
        assert count < 256 or count >> bits <= 2 * 256


def test_large_shards_are_dealt_again_without_losing_links(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(20) << 20 for _ in range(300)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    met = {}
    for r in shards(fps, len(values), shard=8).collect():
        met.setdefault((r.mask, r.value, r.part), set()).add(r.fp)
    assert max(map(len, met.values())) <= 20
    pairs = {(a, b) for group in met.values() for a in group for b in group if a < b and (a ^ b).bit_count() <= 3}
    assert pairs == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 101)} | {201: 200}
