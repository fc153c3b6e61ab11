import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from contrail.llm.spelling import Acceptor, near_words, roots, spelling_variants
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import documents, lower


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def pairs(words):
    return {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=60))
def test_composition_against_all_pairs(words):
    found = list(Acceptor(sorted(words)).near())
    assert len(found) == len(set(found))
    assert {p for a, b in found for p in ((a, b), (b, a))} == pairs(words)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=7), min_size=1, max_size=60))
def test_acceptor_is_minimal_and_accepts_the_words(words):
    machine = Acceptor(sorted(words))

    def language(state):
        return frozenset([""] * machine.final[state] + [x + w for x, s in machine.arcs[state].items() for w in language(s)])

    def reached(state, seen):
        if state not in seen:
            seen.add(state)
            for s in machine.arcs[state].values():
                reached(s, seen)
        return seen

    assert language(0) == words
    states = reached(0, set())
    assert len({(machine.final[s], language(s)) for s in states}) == len(states)


@pytest.mark.parametrize("letters", [30, 400, 250_000])
def test_parts_lose_no_pair(spark, letters):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    # a third of all words begin alike, and differ behind
    words |= {"commonfront" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))) for _ in range(200)}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    rows = near_words(table, letters).collect()
    assert {(r.word, r.near) for r in rows} == pairs(words)
    assert all(r.near_n == len(r.near) for r in rows)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    found = {r.word: r.root for r in roots(spark.createDataFrame([*chain, ("a", "b")], "word string, form string")).collect()}
    assert found == {**{w: "w37" for w, _ in chain}, "a": "b"}


def brute_force(rows, least=6, seen=5, ratio=5, drop_every=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= seen}
    near = defaultdict(set)
    for a, b in pairs(n):
        near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, n[w], len(near[w]), n.get(form[w])))
    return out


def test_whole_against_brute_force(spark):
    rng = random.Random(6)
    base = ["letters", "Éclairs", "straße", "summer", "hammer", "simmer", "glimmer", "ABSOLUTE", "short", "naïveté", "wordwordword"]
    texts = [None, "", "123 -- !", "x" * 50_000]
    for _ in range(120):
        said = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "", "a", "é", w[i] * 2]) + w[i + 1 :]
            said.append(w)
        texts.append(rng.choice([" ", ", ", "-", "1"]).join(said))
    texts.append("chaining " * 200 + "chainng " * 30 + "chanin " * 5 + "chaiing " * 8 + "channg " * 6)
    ids = [*range(len(texts) - 3), None, 7, 7]
    docs = documents(spark, texts, ids=ids)
    for drop in (None, 7, 199):
        expected = brute_force(list(zip(ids, texts, strict=True)), drop_every=drop)
        rows = spelling_variants(docs, drop_every=drop, letters=300).collect()
        assert len(rows) == len(expected) > 20
        assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == expected
    assert any(form and root != form for _, form, root, *_ in expected)


def test_edge_cases(spark):
    docs = documents(spark, ["longword " * 2, "longword " * 3, None], ids=[1, 1, 1])
    assert [tuple(r) for r in spelling_variants(docs).collect()] == [("longword", None, "longword", 5, 0, None)]
    assert spelling_variants(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(docs, ratio=1)
