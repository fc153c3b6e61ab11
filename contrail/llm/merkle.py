"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line. Its leaves are runs of a few words, cut behind a blank where the four bytes before it hash
to a multiple of ``LEAF_WORDS`` and after as many words at most (in text without blanks, now and then anywhere), so
that an edit moves only the next few cuts. A section is a run of paragraphs that ends where a paragraph's hash says so. Each node hashes its
children's hashes; equal roots mean equal texts, and differing branches lead down to the edited ranges.

A fingerprint is the whole tree in text: root, number of leaves, and each section's hash with its paragraphs' and their
leaves' hashes. All hashes have 128 bits, of which a fingerprint holds 64 of each leaf's. It grows with the text. The likeness of two fingerprints is the share of leaves they have in common,
counted as often as they occur (Dice); it is found by descending only branches that differ. Equal roots have likeness 1.

Defined results: null text is empty; the empty text has a root and no leaves; rows are ordered by doc_id (null
first), rows of one doc_id by text hash, so that each has a next row; a lone row is its own next. doc_id is a whole number.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_WORDS, SECTION_PARAGRAPHS = 4, 4
DOCS_PER_BUCKET = 2000
HELD = 1 << 24  # characters of fingerprints, beyond which rows go out


def leaves(data: bytes) -> np.ndarray:
    """Ends of the leaves of UTF-8 text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = b.copy()  # over the four bytes up to and with each
    for k, f in ((1, 31), (2, 1009), (3, 30011)):
        h[k:] += b[:-k] * np.uint32(f)
    h ^= h >> np.uint32(7)
    blank = (b == 32) | (b == 9) | (b == 13)
    cut = h % 257 == 0
    cut[1:] |= blank[1:] & (h[:-1] % LEAF_WORDS == 0)
    cut |= b == 10
    seen = np.cumsum(blank)
    since = seen - np.maximum.accumulate(np.where(cut, seen, 0))
    cut |= blank & (since > 0) & (since % LEAF_WORDS == 0)
    cut[-1] = True
    return np.flatnonzero(cut) + 1


def tree(text: str | None) -> list[list[tuple[int, int, int]]]:
    """Levels of (hash, begin, end) in bytes: leaves, paragraphs, sections, root."""
    data = (text or "").encode()
    ends = leaves(data).tolist()
    level = [(xxhash.xxh3_128_intdigest(data[a:b]), a, b) for a, b in zip([0, *ends][:-1], ends, strict=True)]
    out = [level]
    closes = (lambda n: data[n[2] - 1 : n[2]] == b"\n", lambda n: n[0] % SECTION_PARAGRAPHS == 0, lambda n: False)
    for seed, close in enumerate(closes, 1):
        above, held = [], []
        for node in level:
            held.append(node)
            if close(node):
                above.append(_parent(held, seed))
                held = []
        if held or seed == len(closes):
            above.append(_parent(held, seed))
        out.append(level := above)
    return out


def _parent(children: list[tuple[int, int, int]], seed: int) -> tuple[int, int, int]:
    digest = xxhash.xxh3_128_intdigest(b"".join(c[0].to_bytes(16, "big") for c in children), seed)
    return digest, children[0][1] if children else 0, children[-1][2] if children else 0


def fingerprint(text: str | None) -> str:
    """root.leaves.sections in hex: sections parted by ``;`` are ``hash:paragraphs``, and paragraphs parted by ``,`` their hash and leaf hashes."""
    leaf, paragraph, section, root = tree(text)
    digits = np.array([h & (1 << 64) - 1 for h, _, _ in leaf], ">u8").tobytes().hex()
    ends = np.searchsorted([e for _, _, e in leaf], [e for _, _, e in paragraph], "right").tolist()
    bodies = [f"{h:032x}{digits[16 * i : 16 * j]}" for (h, _, _), i, j in zip(paragraph, [0, *ends], ends, strict=False)]
    ends = np.searchsorted([e for _, _, e in paragraph], [e for _, _, e in section], "right").tolist()
    sections = ";".join(f"{h:032x}:{','.join(bodies[i:j])}" for (h, _, _), i, j in zip(section, [0, *ends], ends, strict=False))
    return f"{root[0][0]:032x}.{len(leaf)}.{sections}"


def _apart(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    """The branches of each side that the other lacks; a branch is named by its hash, and each matches one."""
    left = Counter(n[:32] for n in x)
    left.subtract(n[:32] for n in y)
    out: tuple[list[str], list[str]] = [], []
    for side, nodes, sign in zip(out, (x, y), (1, -1), strict=True):
        for n in nodes:
            if sign * left[n[:32]] > 0:
                left[n[:32]] -= sign
                side.append(n)
    return out


def likeness(a: str, b: str) -> float:
    """Dice coefficient of the leaves of two fingerprints. What equal branches hold is common; the differing ones are descended."""
    if a[:32] == b[:32]:
        return 1.0
    (_, n, x), (_, m, y) = a.split(".", 2), b.split(".", 2)
    sides = _apart(x.split(";") if x else [], y.split(";") if y else [])
    sides = _apart(*([p for s in side for p in s[33:].split(",")] for side in sides))
    lost, new = _apart(*([p[i : i + 16] for p in side for i in range(32, len(p), 16)] for side in sides))
    both = int(n) + int(m)
    return (both - len(lost) - len(new)) / both


def edits(old: str | None, new: str | None) -> list[tuple[int, int]]:
    """Byte ranges of ``new`` whose branches are not in ``old``: found from the root down, descending differing branches only."""
    a, b = tree(old), tree(new)
    ranges = [(b[-1][0][1], b[-1][0][2])] if a[-1][0][0] != b[-1][0][0] else []
    for level in (2, 1, 0):
        known = {h for h, _, _ in a[level]}
        ranges = [(s, e) for h, s, e in b[level] if h not in known and any(lo <= s and e <= hi for lo, hi in ranges)]
    merged: list[tuple[int, int]] = []
    for s, e in ranges:
        if merged and merged[-1][1] == s:
            merged[-1] = merged[-1][0], e
        else:
            merged.append((s, e))
    return merged


def merkle_nodes(docs: DataFrame) -> DataFrame:
    """All nodes: doc_id, level (0 leaf, 1 paragraph, 2 section, 3 root), pos, hash (hex), begin, end in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text")):
                rows = [(n, p, f"{h:x}", s, e) for n, level in enumerate(tree(t.as_py())) for p, (h, s, e) in enumerate(level)]
                names, kinds = ("level", "pos", "hash", "begin", "end"), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                cols = {c: pa.array([r[j] for r in rows], k) for j, (c, k) in enumerate(zip(names, kinds, strict=True))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array([i] * len(rows), pa.int64()))} | cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int, pos long, hash string, begin long, end long")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket and ghost, dealt and sorted so that each row's next row follows it in its task.

    Buckets are ranges of doc_id at approximate quantiles, of about DOCS_PER_BUCKET rows, or of as many as there are
    buckets: both then grow with the root of the corpus. Each is one task, which streams it, and also gets the first
    rows of the bucket behind it as ghosts; the last gets those of the first. Texts are shuffled once.
    """
    lowest = -(1 << 63)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(lowest)).cast("long").alias("k"))
    n = keyed.count()
    buckets = 1 + n // max(DOCS_PER_BUCKET, math.isqrt(n))
    quantiles = [i / buckets for i in range(1, buckets)]
    bounds = keyed.agg(F.percentile_approx("k", quantiles, 50 * buckets)).first()[0] if quantiles and n else []
    edges = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), "right").astype(np.int32))

    firsts = {r.b: r.k for r in keyed.select("k").groupBy(bucket_of("k").alias("b")).agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    first_k = np.array([firsts[b] for b in order], np.int64)
    before = np.array([order[i - 1] for i in range(len(order))], np.int32)

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        """The bucket, and the one before it if this row is among its first."""
        own = np.searchsorted(edges, k.to_numpy(), "right").astype(np.int32)
        at = np.clip(np.searchsorted(first_k, k.to_numpy()), 0, max(0, len(first_k) - 1))
        leads = first_k[at] == k.to_numpy() if len(first_k) else np.zeros(len(k), bool)
        return pd.Series([[int(o), int(before[i])] if x else [int(o)] for o, i, x in zip(own, at, leads, strict=True)])

    dealt = keyed.select("doc_id", "text", "k", F.posexplode(targets("k")).alias("ghost", "bucket"))
    return dealt.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", "k", F.xxhash64("text"))


def merkle_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by the beginning of the next document.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, done = None, None, False
        kinds = (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
        for batch in batches:
            rows, owners, size = [], [], 0

            def out() -> pa.RecordBatch:
                cols = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(owners, batch.schema.field("doc_id").type), *cols], names)  # noqa: B023

            for i, (b, ghost, text) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("ghost").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if b != bucket:
                    bucket, held, done = b, None, False
                if ghost and done:
                    continue
                text = text or ""
                print_ = fingerprint(text)
                if held:
                    old, old_print, doc_id = held
                    cut = len(old) // 4
                    new = old[: len(old) - cut] + text[:cut]
                    new_print = fingerprint(new) if new != old else old_print
                    owners.append(doc_id)
                    rows.append((len(old), hashlib.sha256(new.encode()).hexdigest(), old_print, new_print, likeness(old_print, new_print), likeness(old_print, print_)))
                    size += len(old_print) + len(new_print)
                    if size > HELD:
                        yield out()
                        rows, owners, size = [], [], 0
                held, done = (text, print_, batch.column("doc_id")[i].as_py()), bool(ghost)
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).select("doc_id", "text", "bucket", "ghost").mapInArrow(run, schema)
