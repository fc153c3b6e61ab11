"""Best-fit packing by exact-complement hashing.

Documents become token ids and an end id; longer ones are cut into pieces of ``capacity`` ids. Packing depends on
lengths alone, and there are at most ``capacity`` of those, so the plan is made from the table of piece counts by
length, which has a proven bound at any corpus size:

* the longest length left leaves a gap; single lengths, pair sums and triple sums that fill it exactly are looked
  up, and the combination is consumed as many times at once as the available counts allow;
* where none fits exactly, the longest length that fits goes in (best fit) and the rest of the gap is tried again.

Each step uses up a length, so the plan is a few rows a length: (length, first rank, times, first sequence,
offset). Pieces get their rank within their length from counts by (length, salt) and a row number within it, so
that a length held by a third of all rows is ranked by many tasks; then each piece finds its own place in the plan.

Defined results: null and empty texts are one end id; repeated rows are packed each; ties in rank are broken by
doc_id, piece and checksum. Token ids do not leave the tasks unless ``with_ids`` asks for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import punctuation
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, written

CAPACITY, END_ID = 4096, 1
CACHED = 600_000  # chunks whose ids a task remembers, in each of two generations


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit strings.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its chunks between
    blanks, one after the other; nor does it join letters and punctuation, so a chunk's are those of its letters
    and of the punctuation behind them. Chunks repeat, and so each is put together once and remembered, the recent
    ones in two generations of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.older = {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token ends a word: by that, words encoded in one call are told apart.
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _each(self, chunks: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of runs of letters."""
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.final[ids]) + 1).tolist()
            if len(ends) == len(part):
                yield from (ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True))
            else:
                yield from self._each(part)

    def _learn(self, chunks: set[str]) -> None:
        known, older = self.known, self.older
        tailed = [(c, w, c[len(w) :]) for c in chunks if (w := c.rstrip(punctuation)) != c and w.isalpha()]
        words = (chunks - {c for c, _, _ in tailed}) | {w for _, w, _ in tailed} | {t for _, _, t in tailed}
        words -= known.keys()
        again = words & older.keys()
        known.update((w, older[w]) for w in again)
        words -= again
        plain = [w for w in words if w.isalpha()]
        known.update(zip(plain, self._letters(plain), strict=True))
        odd = [w for w in words if not w.isalpha()]
        known.update(zip(odd, self._each(odd), strict=True))
        known.update((c, known[w] + known[t]) for c, w, t in tailed)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        split = [_lower(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        self._learn(new - again)
        get = self.known.__getitem__
        for chunks in split:
            yield b"".join(map(get, chunks))


def encoder(path: str) -> Encoder:
    """The worker's own encoder, which outlives a task and so remembers across tasks, until another operator's turn."""
    return kept(("encoder", path), lambda: Encoder(path))


def _lower(text: str) -> str:
    """Lower case, as the vocabulary has it, where that is sure to be the same: it makes chunks repeat more.

    Latin-1 letters are; special tokens must be met as they are written.
    """
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = []
                for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    rows += [(i, n, s // 4, ids[s : s + width]) for n, s in enumerate(range(0, len(ids), width))]
                out = {
                    "doc_id": part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                    "piece": pa.array([r[1] for r in rows], pa.int32()),
                    "start": pa.array([r[2] for r in rows], pa.int64()),
                    "length": pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                    "ids_crc32": pa.array([crc32(r[3]) for r in rows], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([r[3] for r in rows], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Lengths:
    """Available counts by length, with indexes of exact sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] += n

    def pair_sums(self) -> np.ndarray:
        """For each sum: whether two available lengths may have it."""
        have = np.fft.rfft((self.n > 0).astype(float), 2 * len(self.n))
        return np.fft.irfft(have * have, 2 * len(self.n))[: len(self.n)] > 0.5

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.n[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair of this sum that is available most often."""
        b = np.arange(1, gap // 2 + 1)
        if not len(b):
            return None
        times = np.minimum(self.n[b], self.n[gap - b])
        if gap % 2 == 0:
            times[-1] = self.n[gap // 2] // 2
        best = int(times.argmax())
        return [gap - int(b[best]), int(b[best])] if times[best] > 0 else None

    def triple(self, gap: int) -> list[int] | None:
        first = np.arange(gap - 2, 0, -1)
        if not len(first):
            return None
        for a in first[(self.n[first] > 0) & self.pair_sums()[gap - first]].tolist():
            self.n[a] -= 1
            rest = self.pair(gap - a)
            self.n[a] += 1
            if rest:
                return [a, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), by length and rank."""
    left, used, sequence, out = Lengths(counts, capacity), Counter(), 0, []
    while len(available := np.flatnonzero(left.n)):
        chosen = [int(available[-1])]
        left.n[chosen[0]] -= 1
        while gap := capacity - sum(chosen):
            more = left.exact(gap)
            if not more:
                fits = np.flatnonzero(left.n[: gap + 1])
                if not len(fits):
                    break
                more = [int(fits[-1])]
            for x in more:
                left.n[x] -= 1
            chosen += more
        need = Counter(chosen)
        for x, n in need.items():
            left.n[x] += n
        times = min(int(left.n[x]) // n for x, n in need.items())
        offset = 0
        for x in chosen:
            out.append((x, used[x], times, sequence, offset))
            used[x] += times
            left.n[x] -= times
            offset += x
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, length, ids_crc32 and any more) with sequence_id and offset."""
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}
    salts = 16 + sum(counts.values()) // 100_000
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_salt.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    shared = parts.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = shared.value.T
        keys = (length << 44) | first
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) | rank, "right") - 1
            out = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence[at] + rank - first[at]), "offset": pa.array(offset[at])})

    kept = ranked.select(*parts.columns, "_rank")
    schema = T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return kept.mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with their sequence and place in it."""
    return pack(written(pieces(docs, tokenizer or default_tokenizer(), capacity, with_ids=with_ids), "pieces"), capacity)
