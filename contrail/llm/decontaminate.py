"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A *window* is ``window``
consecutive words of an item; an item with fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

Both sides keep, of every ``window`` words, the k-word grams of least hash as fingerprints. A window found in a
document therefore has a fingerprint in common with its item: this is guaranteed, not likely. At each document
position that shares a fingerprint with the benchmark the match is extended both ways over every window around
it, and each such window is compared word by word. Items shorter than a window are looked up whole.

A benchmark of at most ``block_bytes`` of text is broadcast, and documents are not shuffled at all, so neither hot sources
nor hot passages gather anywhere. A larger one is never broadcast whole: fingerprints of both sides are joined first, in
one pass over the documents; only texts that share one go on, through blocks of ``block_bytes`` each. Items shorter than
a window have no fingerprint, and what blocks they fill are held against all documents.

Defined results: null text has no words and is clean; repeated rows each get their own result; items with null
text are ignored, repeated item_ids count once, a null item_id is written as the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, with_text, written

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 2 << 20
PIECE_BYTES = 16 << 20
_NONE = np.uint64(2**64 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z; ASCII other than letters and digits to a space.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD).split() if text else []


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _BASE
        out += hashes[i : i + n]
    return out


def _sliding(of, a: np.ndarray, width: int) -> np.ndarray:
    """of(a[i:i+width]) for every i, by doubling."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = of(out[:-step] if step else out, out[step:])
        have += step
    return out


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least of some window of ``width`` grams; all of equals."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    least = _sliding(np.minimum, grams, width)
    edge = np.zeros(width - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([edge, least, edge]), width)
    return np.flatnonzero((best == grams) & (grams != _NONE))


class Index:
    """The fingerprints and windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        self.vocab: dict[bytes, int] = {}
        split = [(i, w) for i, text in items if (w := words(text))]
        ids = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32) for _, w in split]
        self.hash = np.array([0, *(xxhash.xxh64_intdigest(w) for w in self.vocab)], np.uint64)
        fingerprints, by_length = [], {}
        for (item, _), seq in zip(split, ids, strict=True):
            n = min(len(seq), window)
            for s in range(len(seq) - n + 1):
                by_length.setdefault(n, {}).setdefault(seq[s : s + n].tobytes(), set()).add(item)
            if n == window:
                grams = _grams(self.hash[seq], k)
                fingerprints.append(grams[winnow(grams, window - k + 1)])
        self.fingerprints = np.unique(np.concatenate(fingerprints)) if fingerprints else np.empty(0, np.uint64)
        self.tables = {}
        for n, found in by_length.items():
            seqs = np.frombuffer(b"".join(found), np.int32).reshape(-1, n)
            h = np.array([_grams(self.hash[x], n)[0] for x in seqs], np.uint64)
            order = np.argsort(h, kind="stable")
            owners = list(found.values())
            self.tables[n] = h[order], seqs[order], [sorted(owners[i]) for i in order]

    def starts(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Where windows of n words may begin."""
        if n < self.window:
            first = np.zeros(len(self.hash), bool)
            first[self.tables[n][1][:, 0]] = True
            return np.flatnonzero(first[ids])
        grams = _grams(self.hash[ids], self.k)
        grams[_sliding(np.minimum, ids, self.k) == 0] = _NONE
        picked = winnow(grams, self.window - self.k + 1)
        at = np.searchsorted(self.fingerprints, grams[picked])
        at[at == len(self.fingerprints)] = 0
        hit = picked[self.fingerprints[at] == grams[picked]] if len(self.fingerprints) else picked[:0]
        return np.unique((hit[:, None] - np.arange(self.window - self.k + 1)[None, :]).ravel())

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the starts of windows that occur, and which of its windows each is."""
        for n, (table, seqs, _) in self.tables.items():
            s = self.starts(ids, n)
            s = s[(s >= 0) & (s <= len(ids) - n)]
            if not len(s):
                continue
            seen = ids[s[:, None] + np.arange(n)[None, :]]
            s, seen = s[(seen > 0).all(axis=1)], seen[(seen > 0).all(axis=1)]
            h = np.zeros(len(s), np.uint64)
            for j in range(n):
                h = h * _BASE + self.hash[seen[:, j]]
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            for step in range(int((hi - lo).max(initial=0))):  # more than one step only where two windows' hashes are equal
                at = np.minimum(lo + step, len(table) - 1)
                same = (lo + step < hi) & (seqs[at] == seen).all(axis=1)
                if same.any():
                    yield n, s[same], at[same]


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts together have about ``most`` bytes, or are one text."""
    for batch in batches:
        size = np.asarray(pc.coalesce(pc.binary_length(text_of(batch)), 0))
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a or not len(batch):
                yield batch.slice(a, b - a)


def _pass(index, last: bool):
    """A mapInArrow function that adds one block's spans (begin, end, begin, end ...) and items to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        get, gap = ix.vocab.get, np.zeros(ix.window, np.int32)
        for batch in pieces(batches):
            names = batch.schema.names
            spans = [x or [] for x in batch.column("spans").to_pylist()] if "spans" in names else [[] for _ in range(len(batch))]
            items = batch.column("items").to_pylist() if "items" in names else [()] * len(batch)
            parts, begins, counts, at = [], [], [], 0
            for t in text_of(batch):
                w = words(t.as_py())
                parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), gap]
                begins.append(at)
                counts.append(len(w))
                at += len(w) + len(gap)
            begins = np.array(begins, np.int64)
            ids = np.concatenate(parts) if parts else gap
            cover, owners = np.zeros(len(ids) + 1, np.int32), {}
            for n, s, which in ix.matches(ids):
                np.add.at(cover, s, 1)
                np.add.at(cover, s + n, -1)
                doc = np.searchsorted(begins, s, "right") - 1
                for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                    owners.setdefault(d, set()).update(ix.tables[n][2][w])
            turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])))
            span_doc = np.searchsorted(begins, turns[::2], "right") - 1
            for d, a, b in zip(span_doc.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                spans[d] += [a - int(begins[d]), b - int(begins[d])]
            items = [sorted({*x, *owners.get(d, ())}) for d, x in enumerate(items)]
            out = {"row": batch.column("row"), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
            if last:
                hits = [_covered(x) for x in spans]
                out |= {
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array(hits, pa.int64()),
                    "n_items": pa.array(map(len, items), pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, counts, strict=True)], pa.bool_()),
                }
            else:
                out |= {"text": batch.column("text")} if "text" in names else {}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _covered(spans: list[int]) -> int:
    """Words in the union of ranges, as several passes may have overlapping ones."""
    n, end = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def named(items: DataFrame) -> DataFrame:
    """The benchmark's items: id as text, and text."""
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null").distinct()


def text_bytes(items: DataFrame) -> tuple[int, int]:
    """Bytes of text and number of ``named`` items."""
    return tuple(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count("*")).first())


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """``named`` items in blocks of ``block_bytes`` at most, or of one item; one empty block if there are none."""
    size, count = text_bytes(items)
    n = max(1, -(-size // block_bytes))
    while 1 < n < count:
        by = items.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(n))).agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("c"))
        if by.where((F.col("b") > block_bytes) & (F.col("c") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def fingerprinted(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(name, fp): the different fingerprints of each text (name, t), as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, prints = [], []
            for i, t in enumerate(batch.column("t")):
                w = words(t.as_py())
                if len(w) >= window:
                    grams = _grams(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), k)
                    prints.append(np.unique(grams[winnow(grams, window - k + 1)]))
                    owners.append(np.full(len(prints[-1]), i))
            fp = np.concatenate(prints) if prints else np.empty(0, np.uint64)
            at = pa.array(np.concatenate(owners) if owners else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("name").take(at), pa.array(fp.view(np.int64))], ["name", "fp"])

    return texts.select("name", "t").mapInArrow(run, "name binary, fp long")


def _is_long(window: int):
    @F.pandas_udf("boolean")
    def long(t: pd.Series) -> pd.Series:
        return t.map(lambda x: len(words(x)) >= window).astype(bool)

    return long("t")


ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]


def decontaminate(docs: DataFrame, items: DataFrame, columns: list[str] | None = None, **options: int) -> DataFrame:
    """Per document: ``columns`` of it (all by default), n_words, n_hit, n_items, items_sha256, contaminated,
    and the hit word ranges (spans: begin, end, ...) and items themselves. These replace input columns of equal names."""
    keep = [c for c in (columns or docs.columns) if c not in ADDED]
    return decontaminated(docs, items, keep, **options).select(*(F.col("row").getField(c).alias(c) for c in keep), *ADDED)


def decontaminated(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, k: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same with the columns to keep in one struct ``row``, so that none clashes."""
    rows, bench = with_text(docs, keep), named(items)
    if text_bytes(bench)[0] <= block_bytes:
        return through(rows, blocks(bench, block_bytes), window, k)
    bench = written(bench.withColumn("long", _is_long(window)), "benchmark")
    long, short = (bench.where(c).drop("long") for c in ("long", "not long"))
    text = F.col("text") if "text" in rows.columns else F.col("row").getField("text")
    rows = rows.withColumn("_name", F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    prints = fingerprinted(rows.select(F.col("_name").alias("name"), text.alias("t")), window, k)
    asked = written(fingerprinted(long.select(F.encode("i", "UTF-8").alias("name"), "t"), window, k).select("fp").distinct(), "fingerprints")
    met = written(prints.join(asked, "fp", "left_semi").select(F.col("name").alias("_name")).distinct(), "met")
    near, far = (rows.join(met, "_name", how).drop("_name") for how in ("left_semi", "left_anti"))
    found = through(near, chain(blocks(long, block_bytes), blocks(short, block_bytes)), window, k)
    return found.unionByName(through(far, blocks(short, block_bytes), window, k))


def through(rows: DataFrame, parts: Iterator[list[tuple[str, str]]], window: int, k: int) -> DataFrame:
    """``rows`` held against each block in turn; between two they are written."""
    spark = rows.sparkSession
    hits = [T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    counts = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    more = [f for f in rows.schema if f.name == "text"]
    block = next(parts)
    while block is not None:
        after = next(parts, None)
        schema = T.StructType([rows.schema["row"], *hits, *(more if after is not None else counts)])
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(Index(block, window, k)), after is None), schema)
        rows = rows if after is None else written(rows, "decontaminate")
        block = after
    return rows
