"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees.

Fingerprint: of all word shingles (repeats included) of a text, hashed by XXH64 with seed 42, a bit is one if it
is one in more than half of the hashes.

Links are fingerprints at ``radius`` (3) or fewer differing bits. The distinct fingerprints, not the documents,
are dealt into *shards* of about ``TREE``: with the 64 bits cut in b blocks, two fingerprints within the radius agree on
at least b - radius blocks, so they meet in the shard of those blocks, or of as many of their bits as the number of
fingerprints asks for. A shard of over ``SHARD`` is dealt again on all bits of its blocks, then on the bits it lacks by the
same argument; one that is still too large is cut in chunks, of which every two meet in a task. All that keeps all links. Inside a task each shard becomes a BK-tree, whose children are keyed by integer Hamming
distance to their parent; a search follows only edges within the radius of its own distance. The trees live where their
shard is shuffled to rather than in a broadcast, since all fingerprints together grow with the corpus. A shard gives a
spanning set of links, never all pairs of a group.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows of one doc_id
are one node each by text; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

RADIUS, SHINGLE, SEED = 3, 3, 42
TREE, SHARD = 256, 4096  # fingerprints in a tree: about, and beyond which a shard is dealt again


def shingle_hashes(text: str | None, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles of one text, in pieces. Bytes split at ASCII white space, and lower-case A-Z only, as asked."""
    words = text.encode().lower().split() if text else []
    if not words:
        return
    if len(words) <= k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    joined = memoryview(b" ".join(words))
    ends, step = ends[k - 1 :].tolist(), 1 << 15
    for i in range(0, len(ends), step):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[i : i + step], ends[i : i + step], strict=True)], np.uint64)


def majority(hashes: list[np.ndarray]) -> int:
    """The bits that are one in more than half of the hashes."""
    n = sum(map(len, hashes))
    if n == 1:
        return int(hashes[0][0])
    ones = np.zeros(64, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """SimHash of one text."""
    return majority(list(shingle_hashes(text, k)))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius blocks out of ``bits`` cut in ``blocks`` parts."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(cut, blocks - radius)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _first_masks(count: int, radius: int) -> dict[int, int]:
    """Masks that deal ``count`` fingerprints into shards of about TREE, and for each the whole blocks it is a part of."""
    blocks = radius + 1
    while count >> (64 * (blocks - radius) // blocks) > TREE and blocks < radius + 5:
        blocks += 1
    whole = _masks(list(range(64)), blocks, radius)
    need = (count // TREE).bit_length()

    def part(mask: int) -> int:
        return sum(1 << b for b in [b for b in range(64) if mask >> b & 1][:need])

    parts = {part(m): m for m in whole}
    return parts if len(parts) == len(whole) or not need else {m: m for m in whole}


def shards(fps: DataFrame, count: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(mask, value, part, fp): each fingerprint in every shard that one of its links may need."""

    def dealt(df: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        """Deals rows of each shard kind (its mask) by the finer masks given for it."""
        pick = F.create_map(*(x for m, finer in masks.items() for x in (_signed(m), F.array(*map(_signed, finer)))))
        return df.withColumn("mask", F.explode(pick[F.col("mask")])).withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "value", "fp")

    first = _first_masks(count, radius)
    # the rest of its blocks; then every block of the bits they lack, as links inside the shard agree on one of those
    wider = {part: [whole] for part, whole in first.items() if part != whole} if len(first) > 1 else {}
    finer = {m: [m | x for x in _masks([b for b in range(64) if not m >> b & 1], radius + 1, radius)] for m in (first.values() if len(first) > 1 else first)}
    rows, done = dealt(fps.withColumn("mask", F.lit(0).cast("long")), {0: list(first)}), []
    for masks in [*(m for m in (wider, finer) if m), None]:
        large = written(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard), "shards")
        if large.isEmpty():
            break
        if masks is not None:
            keep = masks if masks is finer else masks | {m: [m] for m in first if m not in masks}
            done.append(rows.join(large, ["mask", "value"], "left_anti").select("mask", "value", F.lit(0).alias("part"), "fp"))
            rows = dealt(rows.join(large, ["mask", "value"], "left_semi"), keep)
        else:
            # alike on most bits: cut in chunks, of which every two meet
            chunks = F.ceil(2 * F.col("n") / shard).cast("int")
            cut = rows.join(large, ["mask", "value"], "left").withColumns({"c": F.coalesce(chunks, F.lit(1)), "i": F.pmod(F.xxhash64("fp"), F.coalesce(chunks, F.lit(1)).cast("long")).cast("int")})
            others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: (j != F.col("i")) | (F.col("c") == 1))
            return _together(cut.select("mask", "value", F.explode(F.transform(others, lambda j: F.least("i", j) * F.col("c") + F.greatest("i", j))).alias("part"), "fp"), done)
    return _together(rows.select("mask", "value", F.lit(0).alias("part"), "fp"), done)


def _together(rows: DataFrame, done: list[DataFrame]) -> DataFrame:
    for small in done:
        rows = rows.unionByName(small)
    return rows


class Tree:
    """BK-tree over integers under Hamming distance: a node is (value, {distance: child}). Counts the nodes its searches visit."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None
        self.visited = 0

    def within(self, value: int, radius: int) -> list[int]:
        """Values at ``radius`` or less: only edges whose key is within the radius of the node's distance can lead to one."""
        found, stack, seen = [], [self.root] if self.root else [], 0
        while stack:
            at, children = stack.pop()
            seen += 1
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for key in range(max(0, d - radius), d + radius + 1) if len(children) > 2 * radius else children:
                if abs(key - d) <= radius and key in children:
                    stack.append(children[key])
        self.visited += seen
        return found

    def add(self, value: int) -> None:
        node = self.root
        if node is None:
            self.root = (value, {})
            return
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]


def spanning(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the values of one shard just as all its links would."""
    tree, parent, out = Tree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        parent[v] = v
        for w in tree.within(v, radius):
            a, b = root(v), root(w)
            if a != b:
                parent[a] = b
                out.append((v, w))
        tree.add(v)
    return out


def links(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct fingerprints, enough to connect all that are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            found = np.array(spanning(held, radius), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "part", "fp")]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0), [True]]))
            fp = cols[3].view(np.uint64).tolist()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if len(fp) else ():
                if (this := (cols[0][a], cols[1][a], cols[2][a])) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = this, []
                held += fp[a:b]
        if len(held) > 1:
            yield close()

    dealt = shards(fps, count, radius).repartition("mask", "value", "part").sortWithinPartitions("mask", "value", "part")
    return dealt.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links."""
    prints = written(fingerprints(docs, k), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    fps = written(reps, "reps")
    roots = components(links(fps.select("fp"), fps.count(), radius)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
