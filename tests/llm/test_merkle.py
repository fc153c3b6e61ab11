import hashlib
import random
from collections import Counter

from contrail.llm import merkle
from contrail.llm.merkle import edits, fingerprint, likeness, merkle_fingerprints, merkle_nodes, tree

from .helpers import documents


def expected(docs):
    out = {}
    for i, (d, t) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        out[d] = len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited), likeness(fingerprint(t), fingerprint(edited)), likeness(fingerprint(t), fingerprint(after))
    return out


def check(spark, texts, ids):
    found = {r[0]: tuple(r)[1:] for r in merkle_fingerprints(documents(spark, texts, ids)).collect()}
    assert found == expected(sorted(zip(ids, texts, strict=True)))


def test_against_brute_force_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DOCS_PER_BUCKET", 7)
    texts = [None, "", "a", "abcd", "É" * 9, "one two three four\nfive six\n\nseven", *(" ".join(f"w{i * j % 17}" for j in range(i)) for i in range(94))]
    check(spark, texts, [(i * 37) % 1000 - 200 for i in range(100)])


def test_lone_and_repeated_rows(spark):
    check(spark, ["just one text here"], [4])
    rows = merkle_fingerprints(documents(spark, ["same text", "same text", "other"], [1, 1, None])).collect()
    assert len(rows) == 3 and len({r.fingerprint for r in rows}) == 2
    assert merkle_fingerprints(documents(spark, ["a"]).where("false")).count() == 0


def test_roots_and_edits():
    text = "\n".join(" ".join(f"word{i * j}" for j in range(12)) for i in range(40))
    changed = text.replace("word117", "changed")
    assert fingerprint(text) == fingerprint(str(text)) and likeness(fingerprint(text), fingerprint(text)) == 1
    assert 0.8 < likeness(fingerprint(text), fingerprint(changed)) < 1
    spans = [changed.encode()[a:b].decode() for a, b in edits(text, changed)]
    assert spans and all("changed" in s for s in spans) and sum(map(len, spans)) < 200
    assert edits(text, text) == [] and tree("")[-1][0][1:] == (0, 0)


def test_likeness_reads_the_whole_tree():
    def exact(a, b):
        x, y = (Counter(h for h, _, _ in tree(t)[0]) for t in (a, b))
        return 2 * (x & y).total() / (x.total() + y.total())

    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 40))) for _ in range(300))
    lines = text.split("\n")
    for at in range(0, 300, 10):  # one small edit anywhere shows
        changed = "\n".join([*lines[:at], "edited " + lines[at], *lines[at + 1 :]])
        found = likeness(fingerprint(text), fingerprint(changed))
        assert found == exact(text, changed) and 0.99 < found < 1
    other = "\n".join(" ".join(f"v{rng.randint(0, 9999)}" for _ in range(20)) for _ in range(300))
    for shared in ("\n" + lines[7] + "\n", "\n" + "\n".join(lines[50:80]) + "\n", "\n" + lines[7] + ("\n" + lines[9]) * 3 + "\n"):
        for a, b in ((text, other + shared), (text, shared * 3 + other), (text + shared, shared + other), (text, text + shared)):
            assert likeness(fingerprint(a), fingerprint(b)) == exact(a, b) > 0
    assert likeness(fingerprint(""), fingerprint("a")) == 0 and likeness(fingerprint(""), fingerprint(None)) == 1


def test_nodes_cover_the_text(spark):
    rows = merkle_nodes(documents(spark, ["a b c\nd e", None, "x" * 3000])).collect()
    for level in range(4):
        own = sorted((r.begin, r.end) for r in rows if r.doc_id == 2 and r.level == level)
        assert own[0][0] == 0 and own[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_short_texts_have_roots_of_their_own():
    prints = {fingerprint(f"id{i}")[:32] for i in range(40_000)}
    assert len(prints) == 40_000
    assert likeness(fingerprint("id34682"), fingerprint("id113420")) == 0
