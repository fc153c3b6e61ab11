import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrail.llm import queries
from contrail.llm import context_mixing
from contrail.llm.context_mixing import MODELS, PATH_BITS, SLOT_BITS, Mixer, PathMixer, Vocabulary, class_bits, context_mixing_scores, contexts, path_bits, predictor_counts, tokens

from ..conftest import DATA
from .helpers import blank_words, documents


def check_counts(rows, docs, held):
    """The exact part: counts and the unigram base."""
    counted = Counter(x for d, t in docs if not held(d) for x in [*blank_words(t), None])
    total, distinct = counted.total(), len(counted)
    found = {r.doc_id: r for r in rows}
    for d, t in docs:
        w, r = [*blank_words(t), None], found[d]
        base = sum(math.log10((counted[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counted[x] > 0 for x in w), total, held(d))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert r.score <= 0


def test_counts_base_and_held_out_gain(spark):
    rows = queries.op10_context_mixing(spark, DATA).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_counts(rows, docs, lambda d: crc32(str(d).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_repetitive_text_is_likelier_in_context(spark):
    texts = ["a b c d " * 200] * 6 + ["a b c d " * 20, "d c b a " * 20]
    rows = {r.doc_id: r for r in context_mixing_scores(documents(spark, texts), F.col("doc_id") >= 6).collect()}
    assert rows[6].score > rows[7].score and math.isclose(rows[6].base_score, rows[7].base_score)


def test_edge_cases(spark):
    texts = [None, "", " ", "A a", "rare words only once", "z" * 30_000, "w " * 30_000]
    docs = documents(spark, [*texts, "dup", "dup"], ids=[0, 1, 2, 3, 4, 5, 6, 7, 7])
    rows = context_mixing_scores(docs, F.col("doc_id") == 4).collect()
    assert len(rows) == 9
    check_counts([r for r in rows if r.doc_id != 7] + [r for r in rows if r.doc_id == 7][:1], [*enumerate(texts), (7, "dup"), (7, "dup")], lambda d: d == 4)
    assert context_mixing_scores(docs, F.lit(True)).count() == 9
    assert context_mixing_scores(docs.where("false"), F.lit(False)).count() == 0


def test_tokens():
    assert tokens("A\x0bÉ b\u00a0c") == ["a".encode(), "É".encode(), "b\u00a0c".encode(), b" "]


def test_mixing_against_a_plain_version():
    """Coding documents in lockstep gives what coding them one after the other, bit by bit, gives."""
    rng = np.random.default_rng(2)
    words = [f"w{i}".encode() for i in range(40)]
    v = Vocabulary([(w, 100 - i) for i, w in enumerate([b" ", *words])], 5000, 60)
    docs = [[*rng.choice(words, n).tolist(), b" "] for n in (30, 1, 7, 0, 30)]
    docs = [[w.encode() if isinstance(w, str) else w for w in d] for d in docs]
    size = MODELS << SLOT_BITS
    mixer = Mixer(rng.integers(0, 5, size), rng.integers(0, 5, size))
    mixer.map, mixer.seen = rng.random(mixer.map.shape) * 3, np.full(mixer.seen.shape, 3.0)
    ids = np.concatenate([v.ids(d) for d in docs])
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *map(len, docs)][:-1])] = True
    found, at = mixer.code(v, ids, first), 0
    for d in docs:
        weights = mixer.weights.copy()
        for i, token in enumerate(d):
            before = [int(v.number[x]) for x in d[:i]][::-1][:2]
            band, word = [int(v.band[x]) + 1 for x in before], [int(v.hash[x]) for x in before]
            (b1, b2), (w1, w2) = (x + [0] * (2 - len(x)) for x in (band, word))
            m64, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15
            contexts = [0, b1 * mult & m64, (b1 * 33 + b2) * mult & m64, w1 * mult & m64, (w1 * 31 + w2) * mult & m64]
            total, target, changes = 0.0, int(v.band[v.number[token]]), []
            for depth in range(5):
                node, bit = 1 << depth | target >> (5 - depth), target >> (4 - depth) & 1
                x = []
                for k, c in enumerate(contexts):
                    slot = node if not k else ((c + node * 0xC2B2AE3D27D4EB4F & m64) * mult & m64) >> 64 - SLOT_BITS
                    z, o = (float(t[(k << SLOT_BITS) + slot]) for t in (mixer.zeros, mixer.ones))
                    x.append(math.log((o + 0.4) / (z + 0.4)) * (z + o) / (z + o + 2))
                x = np.array([*x, 1.0])
                y = float(weights[depth] @ x)
                changes.append((depth, 0.02 * (bit - 1 / (1 + math.exp(-y))) * x))
                cell = (node, min(16, max(-16, round(y * 2))) + 16)
                p = 1 / (1 + math.exp(-y))
                q = min(1 - 1e-5, max(1e-5, (p + (mixer.map[cell] + 4 * p) / (mixer.seen[cell] + 4)) / 2))
                total += math.log10(q if bit else 1 - q)
            for depth, change in changes:
                weights[depth] += change
            assert math.isclose(total, found[at], abs_tol=2e-2 if abs(total) > 1 else 1e-2), (i, total, found[at])
            at += 1


def test_tokens_of_one_class_are_told_apart_by_context(spark):
    """Where the word before settles the next one, a text is likelier than its words' shares of their classes, with classes for nothing."""
    words = [f"w{i:02}" for i in range(80)]
    docs = documents(spark, [" ".join(words[i:] + words[:i]) for i in range(80)] * 4)
    v = Vocabulary([(b" ", 320), *((w.encode(), 320) for w in words)], 81 * 320, 81)
    rows = context_mixing_scores(docs, F.col("doc_id") == 0).collect()
    shares = sum(math.log10(1 / (v.band == v.band[v.number[w.encode()]]).sum()) for w in words)
    assert next(r.score for r in rows if r.doc_id == 0) > shares / 2


def test_paths_are_a_code():
    """In each class the paths are prefix-free and complete, and the nodes' counts are those of the tokens below them."""
    counts = [(b" ", 900), *((f"w{i}".encode(), 1 + 5000 // (i + 1)) for i in range(700))]
    v = Vocabulary(counts, 10**5, 10**3)
    token, depth, _, bit, at = path_bits(v, np.arange(len(v.count)), np.zeros((MODELS, len(v.count)), np.uint64))
    node, share, ones, zeros = at(0), np.ones(len(v.count)), Counter(), Counter()
    np.multiply.at(share, token, 0.5)  # a path of n bits takes 2 ** -n of its class
    for t, n, b in zip(token.tolist(), node.tolist(), bit.tolist(), strict=True):
        (ones if b else zeros)[n] += int(v.count[t])
    assert all(math.isclose(share[v.band == c].sum(), 1) for c in set(v.band[1:].tolist()))
    assert len({(v.band[i], tuple(bit[token == i])) for i in range(1, len(v.count))}) == len(counts)
    assert all(v.zeros[n] == zeros[n] > 0 and v.ones[n] == ones[n] > 0 for n in {*ones, *zeros})
    assert depth.max() + 1 == v.depth


def test_paths_mixed_against_a_plain_version(monkeypatch):
    """As for classes, one document after the other and bit by bit, with blocks of a few steps."""
    monkeypatch.setattr(context_mixing, "BLOCK", 7)
    rng = np.random.default_rng(3)
    v = Vocabulary([(b" ", 900), *((f"w{i}".encode(), 1 + 3000 // (i + 1)) for i in range(300))], 10**5, 10**3)
    size = MODELS - 1 << PATH_BITS
    mixer = PathMixer(v, rng.integers(0, 5, size), rng.integers(0, 5, size))
    mixer.map, mixer.seen = rng.random(mixer.map.shape) * 3, np.full(mixer.seen.shape, 3.0)
    docs = [[*rng.integers(0, 301, n).tolist(), 1] for n in (30, 1, 7, 0, 30)]
    ids, first = np.concatenate([np.array(d, np.int32) for d in docs]), np.zeros(sum(map(len, docs)), bool)
    first[np.cumsum([0, *map(len, docs)][:-1])] = True
    context, found, at = contexts(v, ids, first), mixer.code(v, ids, first), 0
    for d in docs:
        weights = mixer.weights.astype(float)
        for token in d:
            changes, total, begin = [], 0.0, int(v.path_at[token])
            for depth in range(int(v.path_length[token])):
                node, bit = int(v.path_node[begin + depth]), int(v.path_bit[begin + depth])
                slots = [node]
                for m in range(1, MODELS):
                    key = (int(context[m, at]) + node * 0xC2B2AE3D27D4EB4F) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                    slots.append(len(v.zeros) + (m - 1 << PATH_BITS) + (key >> 64 - PATH_BITS))
                z, o = mixer.zeros[slots].astype(float), mixer.ones[slots].astype(float)
                x = np.append(np.log((o + 0.4) / (z + 0.4)) * (z + o) / (z + o + 2), 1)
                y = float(weights[depth] @ x)
                changes.append((depth, 0.02 * (bit - 1 / (1 + math.exp(-y))) * x))
                cell, p = (depth, min(16, max(-16, round(y * 2))) + 16), 1 / (1 + math.exp(-y))
                q = min(1 - 1e-5, max(1e-5, (p + (mixer.map[cell] + 4 * p) / (mixer.seen[cell] + 4)) / 2))
                total += math.log10(q if bit else 1 - q)
            for depth, change in changes:
                weights[depth] += change
            assert math.isclose(total, found[at], abs_tol=5e-2), (at, total, found[at])
            at += 1


def test_predictor_counts_against_a_plain_version(spark):
    """Each bit of each token is counted in its slot of every predictor's table, over documents in several tasks."""
    texts = ["a b c a b", None, "b", "a c unknown a c", "c c c b a " * 9, "b a"]
    counted = Counter(w for t in texts for w in tokens(t) if w != b"unknown")
    v = Vocabulary(sorted(counted.items(), key=lambda x: (-x[1], x[0])), counted.total() + 1, len(counted) + 1)
    expected = Counter()
    for t in texts:
        ids = v.ids(tokens(t))
        context = contexts(v, ids, np.arange(len(ids)) == 0)
        for start, models, bits, (_, _, _, bit, at) in (
            (0, range(MODELS), SLOT_BITS, class_bits(v, ids, context)),
            ((MODELS << SLOT_BITS) - (1 << PATH_BITS), range(1, MODELS), PATH_BITS, path_bits(v, ids, context)),
        ):
            expected.update((start + (m << bits) + s, b) for m in models for s, b in zip(at(m).tolist(), bit.tolist(), strict=True))
    found = Counter()
    for r in predictor_counts(documents(spark, texts).repartition(3), spark.sparkContext.broadcast(v)).collect():
        pairs = np.frombuffer(r.counts, np.int64).reshape(-1, 2)
        found.update({(r.page * len(pairs) + int(s), int(b)): int(pairs[s, b]) for s, b in zip(*np.nonzero(pairs), strict=True)})
    assert found == expected


def test_mixers_together_ask_once_for_a_run_of_classes(monkeypatch):
    """Coded in one loop, classes and paths give what they give apart, in training too; predictors that look at classes alone hash nothing a bit."""
    rng = np.random.default_rng(5)
    v = Vocabulary([(b" ", 900), *((f"w{i}".encode(), 1 + 3000 // (i + 1)) for i in range(300))], 10**5, 10**3)
    sizes = MODELS << SLOT_BITS, MODELS - 1 << PATH_BITS
    counts = [(rng.integers(0, 5, n), rng.integers(0, 5, n)) for n in sizes]
    ids = rng.integers(0, 301, 20_000)
    first = np.arange(len(ids)) % 400 == 0
    for learn in (True, False):
        together, apart = ([Mixer(*counts[0]), PathMixer(v, *counts[1])] for _ in range(2))
        found = context_mixing.code(together, v, ids, first, learn)
        assert np.allclose(found, sum(m.code(v, ids, first, learn) for m in apart), rtol=1e-4)
        for a, b in zip(together, apart, strict=True):
            assert np.allclose(a.ended, b.ended, rtol=1e-3, atol=1e-3) and a.seen.sum() == b.seen.sum()
    hashed, asked = context_mixing.hashed, []
    monkeypatch.setattr(context_mixing, "hashed", lambda context, *x: asked.append(len(context)) or hashed(context, *x))
    together[0].code(v, ids, first)
    assert sum(asked) == 2 * 5 * len(ids)  # by the token before and the two before; all four contexts until round 3


def test_words_and_rare_tokens_by_document():
    """Blanks at a text's ends, invalid UTF-8 and texts without a word; a rare end is a token of its document."""
    texts = [b" A b\x0bb ", None, b"\xff x\xff", b" ", b"b"]
    words, counts = context_mixing.words_of(pa.array(texts, pa.binary()))
    assert words.to_pylist() == [b"a", b"b", b"b", b"\xff", b"x\xff", b"b"] and counts.tolist() == [3, 0, 2, 0, 1]
    v = Vocabulary([(b"b", 5)], 20, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    ((part, words, ids, first, counts),) = context_mixing.chunks(iter([batch]), v)
    offsets, rare = context_mixing.rare_tokens(words, np.flatnonzero(ids == 0), np.repeat(np.arange(5), counts), counts)
    found = {t: {r["token"]: r["n"] for r in rs} for t, rs in zip(part.column("text").to_pylist(), pa.ListArray.from_arrays(offsets, rare).to_pylist(), strict=True)}
    assert found == {t: {w: n for w, n in Counter(tokens(t)).items() if w != b"b"} for t in texts}
    assert first.sum() == 5 and counts.sum() == len(ids) == 11
