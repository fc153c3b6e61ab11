"""Near copies at a similarity: SimHash trees over word shingles, with an exact check of what they link.

Two texts are near copies if the Jaccard similarity of their sets of ``k``-word shingles (five) is ``similarity`` (0.8)
or more. At that similarity SimHash fingerprints differ in up to some fifteen of 64 bits, too many for the shards that
``simhash.shards`` cuts from the bits alone. So the shards here come from the shingles:

1. **Deal.** Least shingle hashes under ``BANDS * ROWS`` permutations, ``ROWS`` to a band: texts at 0.8 share a given
   band with probability 0.8 ** 3, and one of eight with 0.997; unlike texts share none.
2. **Search.** Each band's shard becomes a BK-tree of fingerprints searched at ``WIDE`` bits. The texts that find another
   make a group; equal groups of several bands are one. In a shard of over ``CHUNK`` texts only ``PIVOTS`` of them are in
   the tree, and the others search it in chunks: that joins a large group of copies in linear work, and step 4 finds the rest.
3. **Link.** Texts go to their groups only. There each finds its neighbours in the group's tree, nearest first, and is
   linked to those whose shingle sets are alike enough, compared exactly, unless they are connected already: spanning
   links, never all pairs.
4. **Rest.** The texts of large shards are searched again, exactly: alike texts share one of their rarest shingles
   (``prefixes``), at places that leave enough shingles behind it in both. Texts that step 3 connected need not meet. Shingles
   of one component only are left out; where one component holds most of a shingle's texts, the others meet its
   chunks; else every two chunks meet. What passes is compared exactly.
5. **Join** what is linked to components; the least doc_id of each stays.

Exact copies are one text from the start, by a 128-bit digest. Nothing is sampled or dropped. Texts of large shards
miss no pair among themselves. Any other pair at exactly 0.8 is missed with the chance of step 1, or if its fingerprints differ
in over ``WIDE`` bits; both fall fast above 0.8.

Defined results: null is the empty text; texts without words are near copies of each other; rows of the document that
stays are all kept, repeated ones too, and of its texts only the one in the component; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, packed, written
from .simhash import Tree, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, WIDE = 8, 3, 18
CHUNK, PIVOTS = 1024, 32
BUCKETS = 1 << 20  # of shingle hashes, whose counts order shingles by rarity; the order changes work, never results
# multipliers and addends of the permutations, from hashes: multiples of one constant would have the same shingle least in many
_ODD, _ADD = (np.array([xxhash.xxh64_intdigest(f"{name}{i}") for i in range(BANDS * ROWS)], np.uint64) for name in ("times", "plus"))
_ODD |= np.uint64(1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def node_of(text: Column) -> Column:
    """What names a text: its 128-bit digest."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketch(text: str | None, k: int = SHINGLE) -> tuple[int, int, np.ndarray]:
    """Fingerprint, number of different shingles, and one key a band."""
    hashes = list(shingle_hashes(text, k))
    if not hashes:
        return 0, 0, np.arange(BANDS, dtype=np.int64)
    h = np.unique(np.concatenate(hashes))
    low = np.array([(h * odd + add).min() for odd, add in zip(_ODD, _ADD, strict=True)]).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ low[:, i]) * _STEP
        key ^= key >> np.uint64(31)
    return majority(hashes), len(h), key.view(np.int64)


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, node, fp, size, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py(), k) for t in batch.column("text")]
            fp = pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64))
            keys = pa.array([m[2] for m in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), fp, pa.array([m[1] for m in made], pa.int64()), keys], ["doc_id", "node", "fp", "size", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", node_of(F.col("text")).alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, fp long, size long, keys array<long>")


def found_in(rows: list[tuple[bool, int, bytes, int]], radius: int, similarity: float) -> list[tuple[bytes, bool]]:
    """Of the (pivot, fp, node, size) rows of one shard, the nodes that have a pivot within the radius, and whether they are one.

    Pivots come first; in a small shard all are pivots. Sizes too far apart cannot be alike.
    """
    tree, held, met = Tree(), {}, set()
    for pivot, fp, node, size in rows:
        for near in tree.within(fp, radius):
            for other, n in held[near]:
                if min(n, size) >= similarity * max(n, size):
                    met |= {(node, pivot), (other, True)}
        if not pivot:
            continue
        if fp not in held:
            tree.add(fp)
        held.setdefault(fp, []).append((node, size))
    return sorted(met)


def spanning(rows: list[tuple[bool, int, bytes, np.ndarray]], radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that connect the (pivot, fp, node, shingle set) rows of one group just as all its links with pivots would."""
    tree, held, parent, out = Tree(), {}, {}, []

    def root(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pivot, fp, node, x in rows:
        parent[node] = node
        for near in sorted(tree.within(fp, radius), key=lambda w: (w ^ fp).bit_count()):
            for other, y in held[near]:
                a, b = root(node), root(other)
                if a != b and alike(x, y, similarity):
                    parent[a] = b
                    out.append((node, other))
        if not pivot:
            continue
        if fp not in held:
            tree.add(fp)
        held.setdefault(fp, []).append((node, x))
    return out


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; empty ones do."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def banded(nodes: DataFrame) -> DataFrame:
    """(key, fp, node, size): each text in the shard of each of its bands."""
    return nodes.select(F.explode("keys").alias("key"), "fp", "node", "size")


def large_shards(nodes: DataFrame) -> DataFrame:
    """(key, n): the shards of over CHUNK texts."""
    return written(banded(nodes).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "large")


def dealt(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """(key, part, pivot, fp, node, size): large shards in chunks that all hold the shard's pivots, others whole."""
    at = F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    small, parts = F.col("n").isNull(), F.ceil(F.col("n") / CHUNK).cast("int")
    pivot = small | (at < PIVOTS / F.col("n"))
    own = F.array(F.floor(F.pmod(F.xxhash64("fp", "node"), F.lit(1 << 40)) / float(1 << 40) * parts).cast("int"))
    part = F.when(small, F.array(F.lit(0))).when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(own)
    return banded(nodes).join(large, "key", "left").select("key", F.explode(part).alias("part"), pivot.alias("pivot"), "fp", "node", "size")


def by_key(rows: Iterator[tuple]) -> Iterator[list]:
    """What belongs to each key of sorted (key, value) rows, where that is more than one."""
    now, held = None, []
    for key, value in rows:
        if key != now:
            if len(held) > 1:
                yield held
            now, held = key, []
        held.append(value)
    if len(held) > 1:
        yield held


def groups(nodes: DataFrame, large: DataFrame, radius: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """(group, node, pivot): texts whose fingerprints meet a pivot's within the radius in some shard; a group is named by a digest of its nodes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, part, pivot, fp, node, size in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "pivot", "fp", "node", "size")), strict=True):
                yield (key, part), (pivot, fp & (1 << 64) - 1, node, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(read(batches)):
            if met := found_in(rows, radius, similarity):
                name = xxhash.xxh3_128_digest(b"".join(node + bytes([pivot]) for node, pivot in met))
                columns = [pa.array([name] * len(met), pa.binary()), pa.array([m[0] for m in met], pa.binary()), pa.array([m[1] for m in met])]
                yield pa.RecordBatch.from_arrays(columns, ["group", "node", "pivot"])

    shared = dealt(nodes, large).repartition("key", "part").sortWithinPartitions("key", "part", F.desc("pivot"), "fp", "node")
    return shared.mapInArrow(run, "group binary, node binary, pivot boolean").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once for each of ``nodes``."""
    return docs.select(node_of(F.col("text")).alias("node"), "text").join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def links(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int = SHINGLE, radius: int = WIDE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between alike texts of each group, enough to connect all that are connected."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            text = batch.column("text")  # one text at a time is a string, and then a set
            for i, (group, pivot, fp, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "pivot", "fp", "node")), strict=True)):
                yield group, (pivot, fp & (1 << 64) - 1, node, _set(text[i].as_py(), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(read(batches)):
            yield _pairs(spanning(rows, radius, similarity))

    rows = members.join(nodes.select("node", "fp"), "node").join(texts_of(docs, members), "node")
    return rows.repartition("group").sortWithinPartitions("group", F.desc("pivot"), "fp", "node").mapInArrow(run, "u binary, v binary")


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["u", "v"])


def rarity(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """How many shingles of the texts fall in each of BUCKETS buckets: BUCKETS numbers, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                at, n = np.unique(_set(text.as_py(), k) % np.uint64(BUCKETS), return_counts=True)
                counts[at] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    table = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def least(share: float, n: int | np.ndarray) -> int | np.ndarray:
    """The least whole number that is ``share`` of n or more, of two when rounding leaves it open the smaller."""
    return np.ceil(share * n - 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(share * n - 1e-9))


def prefixes(texts: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(token, at, size, node, root): of each text its rarest shingles and their places in the order of rarity.

    Alike texts share ``similarity`` of the larger, so the first shingle they share, in one order for all texts, lies in
    that order's first ``size - least(similarity, size) + 1`` of both. Shingles of one text only are counted in the places
    and not sent. Texts without words have one token.
    """
    counts = texts.sparkSession.sparkContext.broadcast(rarity(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, text in zip(batch.column("node"), batch.column("root"), batch.column("text"), strict=True):
                x = _set(text.as_py(), k)
                n = len(x)
                often = counts.value[x % np.uint64(BUCKETS)]
                order = np.lexsort((x, often))[: n - least(similarity, n) + 1]
                at = np.flatnonzero(often[order] > 1) if n else np.zeros(1, np.int64)
                token = x[order[at]].view(np.int64) if n else np.zeros(1, np.int64)
                m = len(at)
                columns = [pa.array(token), pa.array(at), pa.array(np.full(m, n)), pa.array([node.as_py()] * m, pa.binary()), pa.array([root.as_py()] * m, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "at", "size", "node", "root"])

    return texts.select("node", "root", "text").mapInArrow(run, "token long, at long, size long, node binary, root binary")


def met(tokens: DataFrame) -> DataFrame:
    """(token, part, at, size, node, root): the texts that share a token, so that in some part every two of unlike roots meet."""
    by_root = tokens.groupBy("token", "root").agg(F.count("*").alias("n"))
    shared = by_root.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1").drop("roots")
    others, at = F.col("n") - F.col("most.n"), F.pmod(F.xxhash64("node"), F.lit(1 << 40)) / float(1 << 40)
    parts, chunks = F.ceil(F.col("n") / CHUNK).cast("int"), F.ceil(2 * F.col("n") / CHUNK).cast("int")
    own, chunk = F.floor(at * parts).cast("int"), F.floor(at * chunks).cast("int")
    # other roots than the most frequent one are few: they meet each of its chunks. Else every two chunks meet
    few = F.when(F.col("root") == F.col("most.root"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), chunks - 1), lambda j: j != chunk), lambda j: F.least(chunk, j) * chunks + F.greatest(chunk, j))
    part = F.when(F.col("n") <= CHUNK, F.array(F.lit(0))).when(others <= CHUNK, few).otherwise(pairs)
    return tokens.join(shared, "token").select("token", F.explode(part).alias("part"), "at", "size", "node", "root")


def candidates(tokens: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (u, v), u < v, of unlike roots, that may be alike: from a token they share on, both have shingles enough left."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for token, part, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "part", "at", "size", "node", "root")), strict=True):
                yield (token, part), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(read(batches)):
            at, size, nodes, roots = zip(*rows, strict=True)
            size, left = np.array(size), np.array(size) - np.array(at)
            root, found = np.unique(np.array(roots, object), return_inverse=True)[1], []
            for i in range(1, len(rows)):
                both = least(similarity / (1 + similarity), size[:i] + size[i])
                fits = np.flatnonzero((root[:i] != root[i]) & (np.minimum(left[:i], left[i]) >= both))
                found += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in fits.tolist()]
                if len(found) > 10_000:
                    yield _pairs(found)
                    found = []
            if found:
                yield _pairs(found)

    shared = met(tokens).repartition("token", "part").sortWithinPartitions("token", "part")
    return shared.mapInArrow(run, "u binary, v binary").distinct()


def rest_links(nodes: DataFrame, large: DataFrame, docs: DataFrame, linked: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between alike texts of large shards that ``linked`` does not connect: all of them."""
    wanted = banded(nodes).join(large, "key", "left_semi").select("node").distinct()
    texts = written(texts_of(docs, wanted).join(components(linked), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text"), "large-texts")
    pairs = written(candidates(written(prefixes(texts, k, similarity), "prefixes"), similarity), "pairs")
    # the texts that one is compared with come past in order, in several tasks where they are many
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    first = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("v"))
    others = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v")
    rows = first.unionByName(others).join(texts.select(F.col("node").alias("v"), "text"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            found = []
            for u, v, text in zip(batch.column("u"), batch.column("v"), batch.column("text"), strict=True):
                y = _set(text.as_py(), k)
                if u == v:
                    x = y
                elif alike(x, y, similarity):
                    found.append((u.as_py(), v.as_py()))
            yield _pairs(found)

    return rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("u") != F.col("v")).mapInArrow(run, "u binary, v binary")


def _set(text: str | None, k: int) -> np.ndarray:
    hashes = list(shingle_hashes(text, k))
    return np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)


def without_near_copies(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the least doc_id of each group of near copies only, in all its columns."""
    prints = written(sketches(docs, k), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    nodes = written(prints.groupBy("node").agg(first.alias("who"), *(F.first(c).alias(c) for c in ("fp", "size", "keys"))), "nodes")
    large = large_shards(nodes)
    members = written(groups(nodes, large, similarity=similarity), "groups")
    linked = links(members, nodes, docs, k, similarity=similarity)
    if not large.isEmpty():
        linked = written(linked, "links")
        linked = linked.unionByName(rest_links(nodes, large, docs, linked, k, similarity))
    roots = components(linked)
    rooted = nodes.select("node", "who").join(roots, "node", "left").select("node", "who", F.coalesce("root", "node").alias("root"))
    stays = written(rooted.groupBy("root").agg(F.min(F.struct("who", "node")).alias("m")).select(F.col("m.who.doc_id").alias("kept_id"), F.col("m.node").alias("kept")), "stays")
    rows = packed(docs).withColumns({"node": node_of(F.col("row").getField("text")), "id": F.col("row").getField("doc_id")})
    return rows.join(stays, (rows["node"] == stays["kept"]) & rows["id"].eqNullSafe(stays["kept_id"]), "left_semi").select("row.*")
