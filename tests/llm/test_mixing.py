import random
import re
from collections import Counter, defaultdict

from contrail.llm import mixing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .helpers import documents


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by source, by pouring again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if level * weight[s] >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=40), st.integers(0, 99))
def test_flight_keeps_both_totals(given_units, seed):
    units = [(i, float(s), x) for i, (s, x) in enumerate(given_units)]
    found = dict(mixing.flight(iter(units), random.Random(seed)))
    assert sorted(found) == list(range(len(units)))
    assert sum(0 < x < 1 for x in found.values()) <= 2
    assert abs(sum(found.values()) - sum(x for _, _, x in units)) < 1e-6
    assert abs(sum(found[i] * s for i, s, _ in units) - sum(s * x for _, s, x in units)) < 1e-4


def test_flight_keeps_chances():
    units = [(i, s, x) for i, (s, x) in enumerate([(3, 0.2), (7, 0.5), (1, 0.9), (7, 0.4), (2, 0.75), (9, 0.3)])]
    sums = Counter()
    for seed in range(4000):
        for i, x in mixing.flight(iter(units), random.Random(seed)):
            sums[i] += x
    assert all(abs(sums[i] / 4000 - x) < 0.03 for i, _, x in units)


def size_of(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def corpus(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 8 + ["b", "é", "Z", "a", None, "tiny"])
        k = int(rng.paretovariate(0.9)) % 4000 if source != "tiny" else 1
        rows.append((i, "\n".join("w" * rng.randint(1, 3) for _ in range(k)), source))
    rows += [(n, None, "hot"), (n + 1, " \x0b\t", "empty"), (n + 2, "one big " * 700, "a"), (None, "no id", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"unit": F.lit("x"), "chance": F.lit("y"), "size": F.lit("z")})


def checked(rows, found):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    due, taken, left = shares(sizes), Counter(), Counter((i, s) for i, _, s in rows)
    left.subtract((r.doc_id, r.source) for r in found)
    assert not any(left.values()) and len(rows) == len(found)
    by = {i: t for i, t, _ in rows}
    for r in found:
        assert r.size == size_of(by[r.doc_id]) and r.source_size == sizes[r.source]
        assert abs(r.target - due[r.source]) <= 1e-9 * max(1, due[r.source])
        assert r.taken == r.size * r.times and r.times <= 3
        share = r.target / r.source_size if r.source_size else 0
        assert int(share) <= r.times <= int(share) + 1
        taken[r.source] += r.taken
    return due, taken


def test_mix_against_plain_shares(spark):
    rows, docs = corpus(spark)
    found = mixing.mix(docs, block=64).collect()
    due, taken = checked(rows, found)
    for source, words in due.items():
        assert abs(taken[source] - words) <= max(2, 0.001 * words), source
    number, times = Counter(r.source for r in found), Counter()
    for r in found:
        times[r.source] += r.times
    for s in ("hot", None):
        assert abs(times[s] - due[s] / next(r.source_size for r in found if r.source == s) * number[s]) < 40
    # the same rows in another order and over other partitions are taken as often
    again = mixing.mix(docs.repartition(7, "text").sortWithinPartitions(F.desc("doc_id")), block=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_repeated_rows_are_one_unit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(5, "a b c", "s")] * 500 + [(None, "d", None)] * 300 + [(100 + i, "e f", "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    due, taken = checked(rows, found)
    assert all(abs(taken[s] - due[s]) <= 3 for s in due)
    texts = mixing.mixture(docs).collect()
    assert Counter(r.source for r in texts) == Counter({s: sum(r.times for r in found if r.source == s) for s in due})


def test_mixture_repeats_whole_rows(spark):
    rows, docs = corpus(spark, 300)
    times = Counter()
    for r in mixing.mix(docs, weights=[1.0], most=2).collect():
        times[r.doc_id] += r.times
    found = mixing.mixture(docs, weights=[1.0], most=2)
    assert found.columns == docs.columns
    assert Counter(r.doc_id for r in found.collect()) == +times


def test_edge_cases(spark):
    docs = documents(spark, [None, "", "a b"], ids=[1, 1, None])
    assert sorted((r.size, r.taken) for r in mixing.mix(docs).collect()) == [(0, 0), (0, 0), (2, 2)]
    assert mixing.mix(docs.where("false")).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(docs.where("text = ''")).collect()] == [(0.0, 0)]


def test_ranks(spark):
    names = [None, "", "a", "B", "é", "z", "😀", "￿"]
    rows = mixing.ranked(spark.createDataFrame([(s, 1) for s in names], "source string, source_size long")).collect()
    assert {r.source: r["rank"] for r in rows} == {s: i for i, s in enumerate(["", "B", "a", "z", "é", "￿", "😀", None])}
