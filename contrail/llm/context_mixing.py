"""Language-model scoring by online logistic context mixing.

Text is lower-cased (A-Z) and cut in tokens at ASCII white space, with one end token last. A token is coded in
two parts:

* its **class**, five bits: the class of a frequent token is its frequency band; all rarer tokens, known or not,
  share one class. Each bit is predicted by several hashed-context bit predictors (no context, the class before, the two
  classes before, the token before, the two tokens before). Their stretched probabilities and confidences
  are combined by a gated set of weights, chosen by the bit's depth in the code tree, in the logistic domain. The
  weights are refined online through the whole document, after each token by the errors of its bits, and an adaptive
  probability map trained on the corpus has the last word.
* the **token within its class**. A frequent one by the bits of its path in a tree over its class, cut in halves of like
  count: each bit is predicted by the node's own counts and under the same hashed contexts, and mixed in the same way, with
  weights and a map of its own. A rare one by its count; absolute discounting leaves a share for tokens never seen.

Every part is normalised, so a text's score is the log probability of its token sequence, and -score * log2(10)
over its bytes is its bits per byte.

What is gathered from the corpus: token counts stay distributed, at any vocabulary; only the ``FREQUENT`` most
frequent tokens are broadcast (a fixed bound). Predictors are counts by hashed context, summed over all training
documents through a shuffle, in tables of ``2 ** SLOT_BITS`` (classes) and ``2 ** PATH_BITS`` slots (paths) at every size of
corpus; contexts share slots as it grows, and the mixer learns how far to trust each predictor. Rare tokens of a text meet their counts in a join, pre-aggregated by document.

Defined results: a null text is empty: one end token. Repeated rows are scored each. With nothing to learn from, counts are zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import copy
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FREQUENT = 100_000
BITS = 5
CLASSES = 1 << BITS
RUNS = (CLASSES + 1) ** 2 * CLASSES  # of three classes; the first two may be missing
RARE, END = 0, 1
RATE = 0.02
SLOT_BITS = 17  # of a predictor's table
PATH_BITS = 18  # of a predictor's table for the bits within a class
DISCOUNT = 0.75  # what each rare count gives up to tokens never seen
CHUNK = 400_000  # tokens coded together
SLICE = 4 << 20  # bytes of text cut in words at once
COUNTED = 2_000_000  # words counted at once
BLOCK = 10_000  # tokens whose predictions are made at once
PAGE = 1024  # slots of the predictors' tables that are added up together
COUNT = np.int32  # of a bit in one task; a type, as np.add.at is slow on a dtype that was pickled
MODELS = 5
_END_TOKEN = b" "  # no word holds a blank
_M, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_DEPTH = np.arange(BITS)
_NODES = 1 << _DEPTH | np.arange(CLASSES)[:, None] >> (BITS - _DEPTH)  # of a class, in the code tree: 1 is the root
_CLASS_BITS = np.arange(CLASSES)[:, None] >> (BITS - 1 - _DEPTH) & 1
_STEPPED = _NODES.astype(np.uint64) * _STEP


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text.cast(pa.binary()), b"").view(pa.string())))
    words = cut.flatten().view(pa.binary())
    full = np.asarray(pc.binary_length(words)) > 0  # blanks at a text's ends leave empty words
    at = np.asarray(cut.offsets)
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[at - at[0]])
    return (words if full.all() else words.filter(pa.array(full))), counts


def tokens(text: str | bytes | None) -> list[bytes]:
    return [*words_of(pa.array([text], pa.binary()))[0].to_pylist(), _END_TOKEN]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE bytes of text together."""
    end = np.cumsum(np.asarray(pc.coalesce(pc.binary_length(batch.column("text")), 0)), dtype=np.int64)
    cut = [0, *(np.flatnonzero(np.diff(end // SLICE)) + 1).tolist(), len(batch)]
    yield from (batch.slice(a, b - a) for a, b in zip(cut, cut[1:]) if b > a)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all of ``docs``; counted within tasks first, in pieces of bounded size."""

    def counted(words: list[pa.Array], texts: int) -> pa.RecordBatch:
        seen = pa.chunked_array([*words, pa.array([], pa.binary())]).value_counts()
        token = pa.concat_arrays([seen.field("values"), pa.array([_END_TOKEN], pa.binary())])
        return pa.RecordBatch.from_arrays([token, pa.concat_arrays([seen.field("counts"), pa.array([texts], pa.int64())])], ["token", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, n = [], 0, 0
        for part in (part for batch in batches for part in slices(batch)):
            words, _ = words_of(part.column("text"))
            held.append(words)
            texts, n = texts + len(part), n + len(words)
            if n > COUNTED:
                yield counted(held, texts)
                held, texts, n = [], 0, 0
        if texts:
            yield counted(held, texts)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent tokens: their number, class and path within it; and figures of the whole corpus."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.number = {t: i + 1 for i, (t, _) in enumerate(frequent)}  # 0: rare
        self.frequent = pa.array([t for t, _ in frequent], pa.binary())
        count = np.array([0, *(c for _, c in frequent)], np.float64)
        self.count = count
        # bands of about equal mass: the code then tells apart the few very frequent tokens
        mass = np.cumsum(count) - count / 2
        band = np.minimum(CLASSES - 1, 2 + (mass / max(1.0, count.sum()) * (CLASSES - 2)).astype(np.int64))
        band[0] = RARE
        if _END_TOKEN in self.number:
            band[self.number[_END_TOKEN]] = END
        self.band = band.astype(np.uint8)
        self._paths(count, band)
        self.hash = np.array([0, *(xxhash.xxh64_intdigest(t) for t, _ in frequent)], np.uint64)
        #: Within the rare class a count c has (c - DISCOUNT) / rare, and all tokens never seen share the rest.
        self.rare = total - int(count.sum())
        kinds = distinct - len(frequent)
        self.unseen = math.log10(DISCOUNT * kinds / self.rare) if self.rare else 0.0
        self.base_divisor = math.log10(total + 0.5 * (distinct + 1))
        self.base = np.log10(count + 0.5) - self.base_divisor

    def _paths(self, count: np.ndarray, band: np.ndarray) -> None:
        """Each frequent token's path in the tree over its class: (node, bit) from ``path_at[id]`` on, ``path_length[id]`` long.

        A node is named by the place, in order of class and count, of its first token on the right.
        """
        place = np.argsort(band, kind="stable")[1:]  # the only one of class RARE is id 0
        mass, in_order = np.concatenate([[0], np.cumsum(count[place])]), band[place]
        low, high = np.searchsorted(in_order, in_order), np.searchsorted(in_order, in_order, "right")
        at, levels = np.arange(len(place)), []
        self.zeros, self.ones = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
        while len(open_ := np.flatnonzero(high - low > 1)):
            a, b = low[open_], high[open_]
            middle = np.clip(np.searchsorted(mass, (mass[a] + mass[b]) / 2), a + 1, b - 1)
            self.zeros[middle], self.ones[middle] = mass[middle] - mass[a], mass[b] - mass[middle]
            right = at[open_] >= middle
            levels.append((place[open_], middle, right))
            low[open_], high[open_] = np.where(right, middle, a), np.where(right, b, middle)
        self.depth = max(1, len(levels))  # of the deepest path
        ids, node, bit = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in levels)]) for k in range(3))
        order = np.argsort(ids, kind="stable")
        self.path_node, self.path_bit = node[order], bit[order].astype(np.int64)
        self.path_both = self.path_node * 2 + self.path_bit
        self.path_length = np.bincount(ids.astype(np.int64), minlength=len(count))
        self.path_at = np.cumsum(self.path_length) - self.path_length

    def ids(self, words: pa.Array | list[bytes]) -> np.ndarray:
        if isinstance(words, list):
            words = pa.array(words, pa.binary())
        return np.asarray(pc.fill_null(pc.index_in(words, self.frequent), -1)) + np.int32(1)


def preceding(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is one place and two places before each token in its document; 0 beyond its beginning."""
    one = ~first
    two = one & np.concatenate([[False], one[:-1]])
    return tuple(np.where(ok, np.concatenate([np.zeros(k, x.dtype), x[:-k]])[: len(x)], 0) for k, ok in ((1, one), (2, two)))


def contexts(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashed contexts (MODELS x tokens) of each token, from the tokens before it in its document.

    first: whether a token begins a document.
    """
    (w1, w2), (b1, b2) = preceding(vocabulary.hash[ids], first), preceding(vocabulary.band[ids].astype(np.uint64) + np.uint64(1), first)
    return np.stack([np.zeros(len(ids), np.uint64), b1 * _M, (b1 * np.uint64(CLASSES + 1) + b2) * _M, w1 * _M, (w1 * np.uint64(31) + w2) * _M])


def class_bits(vocabulary: Vocabulary, ids: np.ndarray, context: np.ndarray) -> tuple:
    """The bits of the tokens' classes: place of the token, depth, row of the map, bit, and their slots in the table of predictor ``m``.

    Without a context, a slot is the node itself.
    """
    return band_bits(vocabulary.band[ids].astype(np.int64), context)


def band_bits(band: np.ndarray, context: np.ndarray) -> tuple:
    """``class_bits`` of given classes."""
    node, bit, stepped = (x.take(band, axis=0).ravel() for x in (_NODES, _CLASS_BITS, _STEPPED))
    token, depth = np.repeat(np.arange(len(band)), BITS), np.tile(_DEPTH, len(band))
    return token, depth, node, bit, lambda m: hashed(np.repeat(context[m], BITS), stepped, SLOT_BITS) if m else node


def runs_of(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token's class with the classes of the two tokens before it, as one number."""
    band = vocabulary.band.take(ids).astype(np.int64)
    b1, b2 = preceding(band + 1, first)
    return (b1 * (CLASSES + 1) + b2) * CLASSES + band


def run_bits(runs: np.ndarray) -> tuple:
    """``class_bits`` of such numbers, for the predictors that look at classes alone."""
    pair, band = np.divmod(runs, CLASSES)
    return band_bits(band, np.stack([0 * pair, pair // (CLASSES + 1), pair]).astype(np.uint64) * _M)


def path_bits(vocabulary: Vocabulary, ids: np.ndarray, context: np.ndarray) -> tuple:
    """The bits of the tokens' paths within their classes, as ``class_bits``; a token's bits are neighbours, by depth."""
    length = vocabulary.path_length.take(ids)
    token = np.repeat(np.arange(len(ids)), length)
    every, begin = np.arange(len(token)), np.cumsum(length) - length
    depth = every - np.repeat(begin, length)
    both = vocabulary.path_both.take(every + np.repeat(vocabulary.path_at.take(ids) - begin, length))
    node = both >> 1
    stepped = node.view(np.uint64) * _STEP
    return token, depth, depth, both & 1, lambda m: hashed(np.repeat(context[m], length), stepped, PATH_BITS) if m else node


def hashed(context: np.ndarray, stepped: np.ndarray, bits: int) -> np.ndarray:
    slot = context + stepped
    slot *= _M
    slot >>= np.uint64(64 - bits)
    return slot.view(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple]:
    """Whole documents of about CHUNK tokens together: (part of a batch, its words, ids with those of the ends, first, tokens by document).

    Documents of like length go together, longest first, as a chunk takes as many steps as its longest has tokens.
    """
    end = v.number.get(_END_TOKEN, 0)
    for batch in batches:
        size = np.asarray(pc.coalesce(pc.binary_length(batch.column("text")), 0))
        batch = batch.take(pa.array(np.argsort(-size.astype(np.int64), kind="stable")))
        for part in slices(batch):
            words, counts = words_of(part.column("text"))
            found, after = v.ids(words), np.cumsum(counts)
            cut = [0, *(np.flatnonzero(np.diff((after + np.arange(len(part))) // CHUNK)) + 1).tolist(), len(part)]
            for a, b in zip(cut, cut[1:]):
                mine = slice(after[a] - counts[a], after[b - 1])
                n, last = mine.stop - mine.start + b - a, after[a:b] - mine.start + np.arange(b - a)
                ids, first, word = np.full(n, end, found.dtype), np.zeros(n, bool), np.ones(n, bool)
                first[0], first[last[:-1] + 1], word[last] = True, True, False
                ids[word] = found[mine]
                yield part.slice(a, b - a), words.slice(mine.start, mine.stop - mine.start), ids, first, counts[a:b] + 1


def predictor_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(page, counts): how often each predictor's context saw each bit, over all of ``docs``; PAGE slots a row, each a zeros and a ones.

    The slots of the classes' bits come first, then those of the paths within classes. A task sends a row a page, and
    the rows of a page are added up together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        classes, inner = np.zeros((MODELS, 2 << SLOT_BITS), COUNT), np.zeros((MODELS, 2 << PATH_BITS), COUNT)
        runs = np.zeros(RUNS, np.int64)
        for _, _, every, first, _ in chunks(batches, v):
            before = contexts(v, every, first)
            runs += np.bincount(runs_of(v, every, first), minlength=RUNS)
            for begin in range(0, len(every), 5 * BLOCK):
                ids, context = every[begin : begin + 5 * BLOCK], before[:, begin : begin + 5 * BLOCK]
                for seen, models, (_, _, _, bits, at) in ((classes, (3, 4), class_bits(v, ids, context)), (inner, (1, 2, 3, 4), path_bits(v, ids, context))):
                    for m in models:
                        np.add.at(seen[m], at(m) * 2 + bits, COUNT(1))
        # predictors that look at classes alone: by what runs of classes there were
        found = np.flatnonzero(runs)
        _, _, _, bits, at = run_bits(found)
        for m in range(3):
            counted = np.bincount(at(m) * 2 + bits, np.repeat(runs[found], BITS))
            classes[m, : len(counted)] += counted.astype(np.int64)
        seen = np.concatenate([classes.ravel(), inner[1:].ravel()]).reshape(-1, 2)  # the nodes' own counts are known
        pages = seen.reshape(-1, 2 * PAGE)
        for page in np.flatnonzero(pages.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([pages[page].tobytes()], pa.binary())], ["page", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(2 * PAGE, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_buffer(), COUNT)
        return pa.table({"page": rows.column("page")[:1].cast(pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(run, "page long, counts binary").groupBy("page").applyInArrow(added, "page long, counts binary")


class Lockstep:
    """The order in which documents are coded together.

    Tokens are put in order of their place in the document, longest documents first, so that those of one step are
    neighbours, and a document keeps its lane among them.
    """

    def __init__(self, first: np.ndarray):
        n = len(first)
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, n))
        lane = np.empty(len(length), np.int64)
        lane[np.argsort(-length, kind="stable")] = np.arange(len(length))
        step = np.arange(n) - np.repeat(begin, length)
        self.documents, self.live = len(length), np.bincount(step)
        at = (np.cumsum(self.live) - self.live)[step] + np.repeat(lane, length)
        self.order = np.empty(n, np.int64)
        self.order[at] = np.arange(n)


    def blocks(self) -> Iterator[list[int]]:
        """How many tokens each step has, for whole steps of about BLOCK tokens together."""
        end = np.cumsum(self.live)
        cut = np.flatnonzero(np.diff(end // BLOCK, prepend=0)) + 1
        yield from (x.tolist() for x in np.split(self.live, cut) if len(x))


class Predictors:
    """Predictors' counts by slot, and the weights and map that combine what they say about bits of ``depth`` levels.

    bits: which bits of a token these are; starts: where each predictor's slots begin; cells: the map's rows, by
    node or, where there are many nodes, by depth.
    """

    def __init__(self, bits: Callable, zeros: np.ndarray, ones: np.ndarray, starts: list[int], depth: int, cells: int):
        self.bits, self.starts = bits, starts
        self.zeros, self.ones = zeros.astype(np.float32), ones.astype(np.float32)
        self.weights = np.full((depth, MODELS + 1), 0.3, np.float32)
        self.weights[:, MODELS] = 0
        self.map = np.zeros((cells, 33), np.float64)
        self.seen = np.zeros((cells, 33), np.float64)
        self.ended = np.zeros(self.weights.shape)
        self.said = _said(self.zeros, self.ones)
        self.own = None

    def code(self, vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray, learn: bool = False) -> np.ndarray:
        return code([self], vocabulary, ids, first, learn)

    def say_all(self, said: np.ndarray, truth: np.ndarray, columns: slice, bits: tuple, runs: np.ndarray, own: bool) -> Callable:
        """Puts what the predictors say about ``bits`` in these columns of ``said`` (predictors x tokens x columns), and the bits in those of ``truth``.

        Depths that a token does not have stay 0. Gives a function that takes these bits out of such an array.
        """
        token, depth, _, bit, at = bits
        n, width = truth.shape
        whole = len(token) == n * len(self.weights)
        place = None if whole else token * width + (depth + columns.start)

        def put(x: np.ndarray, values: np.ndarray | int) -> None:
            if whole:
                x[:, columns] = values if isinstance(values, int) else values.reshape(n, -1)
            else:
                x.reshape(-1)[place] = values

        for m in range(MODELS):
            put(said[m], self.predicted(m, at, bit, runs, own))
        put(said[MODELS], 1)
        put(truth, bit)
        return lambda x: x[:, columns].ravel() if whole else x.reshape(-1)[place]

    def adaptive(self) -> tuple[np.ndarray, np.ndarray]:
        """The adaptive map: the mean of the mixed probability and of what has followed such ones."""
        followed = (np.stack([self.seen - self.map, self.map], axis=2) / (self.seen + 4)[..., None]).ravel().astype(np.float32)
        return followed, np.repeat((4 / (self.seen + 4)).ravel(), 2).astype(np.float32)

    def predicted(self, m: int, at: Callable, bit: np.ndarray, runs: np.ndarray, own: bool) -> np.ndarray:
        """What predictor ``m`` says about each bit; ``at`` gives its slots."""
        slot = at(m)
        return self.say(slot + self.starts[m] if self.starts[m] else slot, bit, own)

    def say(self, slot: np.ndarray, bit: np.ndarray, own: bool) -> np.ndarray:
        """What the slots say; own: their counts hold these very bits, as in training, and one of each is taken out."""
        if not own:
            return self.said.take(slot, mode="clip")  # all are within
        if self.own is None:
            less = np.float32(1)
            self.own = np.stack([_said(np.maximum(self.zeros - less, 0), self.ones), _said(self.zeros, np.maximum(self.ones - less, 0))], axis=1).ravel()
        return self.own.take(slot * 2 + bit, mode="clip")


class Mixer(Predictors):
    """Mixes the bits of classes."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        super().__init__(class_bits, zeros, ones, [m << SLOT_BITS for m in range(MODELS)], BITS, CLASSES)
        self.of_runs = {}

    def predicted(self, m: int, at: Callable, bit: np.ndarray, runs: np.ndarray, own: bool) -> np.ndarray:
        """Predictors that look at classes alone say the same about all five bits of every like run, and are asked once for each run."""
        if m > 2:
            return super().predicted(m, at, bit, runs, own)
        if own not in self.of_runs:
            _, _, _, bits, slots = run_bits(np.arange(RUNS))
            none, one, two = (super(Mixer, self).predicted(k, slots, bits, runs, own).reshape(CLASSES + 1, CLASSES + 1, CLASSES, BITS) for k in range(3))
            self.of_runs[own] = none[0, 0], one[:, 0].reshape(-1, BITS), two.reshape(-1, BITS)
        band = runs & (CLASSES - 1)
        run = runs if m == 2 else runs // (CLASSES * (CLASSES + 1)) * CLASSES + band if m else band
        return self.of_runs[own][m].take(run, axis=0).ravel()


class PathMixer(Predictors):
    """Mixes the bits of paths within classes. The nodes' own counts come first, then a table a predictor with a context."""

    def __init__(self, v: Vocabulary, zeros: np.ndarray, ones: np.ndarray):
        starts = [0, *(len(v.zeros) + (m << PATH_BITS) for m in range(MODELS - 1))]
        super().__init__(path_bits, np.concatenate([v.zeros, zeros]), np.concatenate([v.ones, ones]), starts, v.depth, v.depth)


def in_lockstep(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[Lockstep, np.ndarray, np.ndarray]:
    """The texts' lockstep, and their contexts and runs of classes in its order."""
    together = Lockstep(first)
    context = contexts(vocabulary, ids, first)
    for of_model in context:
        of_model[:] = of_model.take(together.order)
    return together, context, runs_of(vocabulary, ids, first).take(together.order)


def code(mixers: list[Predictors], vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray, learn: bool = False, given: tuple | None = None) -> np.ndarray:
    """log10 probability of each token's bits of all ``mixers``, mixing online through the documents in lockstep.

    Only the mixing itself runs step by step, over all bits of a step's tokens; what leads to it and follows
    it is done for many steps at once. A token with fewer bits than a mixer has depths predicts nothing by the others, which change no weight.
    learn: the texts are those the counts came from; gathers the map, and the weights that documents end with.
    given: what ``in_lockstep`` gives of the texts, if known.
    """
    if not len(ids):
        return np.zeros(0)
    together, context, runs = given or in_lockstep(vocabulary, ids, first)
    ids, back, begin = ids.take(together.order), np.zeros(len(ids)), 0
    ends = np.cumsum([len(m.weights) for m in mixers]).tolist()
    columns = [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]
    less = np.tile(-np.concatenate([m.weights for m in mixers]).T, together.documents)
    maps = None if learn else [m.adaptive() for m in mixers]
    for widths in together.blocks():
        now = slice(begin, begin + sum(widths))
        begin, n = now.stop, now.stop - now.start
        said, truth = np.zeros((MODELS + 1, n, ends[-1]), np.float32), np.zeros((n, ends[-1]), np.float32)
        bits = [m.bits(vocabulary, ids[now], context[:, now]) for m in mixers]
        taken = [m.say_all(said, truth, c, b, runs[now], learn) for m, c, b in zip(mixers, columns, bits, strict=True)]
        every, total = mixed(said.reshape(MODELS + 1, -1), truth.ravel(), [w * ends[-1] for w in widths], less).reshape(n, -1), np.zeros(n)
        for k, (m, (token, _, row, bit, _)) in enumerate(zip(mixers, bits, strict=True)):
            y = taken[k](every)
            cell = (np.clip(np.rint(y * 2), -16, 16).astype(np.int64) + (row * 33 + 16)) * 2 + bit
            if learn:
                found = np.bincount(cell, minlength=2 * m.map.size).reshape(*m.map.shape, 2)
                m.map += found[..., 1]
                m.seen += found.sum(axis=2)
                continue
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(np.float32(1 - 2 * bit) * y))
            followed, trust = maps[k]
            q = np.clip((p * (1 + trust.take(cell)) + followed.take(cell)) / 2, np.float32(1e-5), np.float32(1 - 1e-5))
            total += np.bincount(token, np.log(q), n)
        back[together.order[now]] = total / math.log(10)
    if learn:
        ended = -less.reshape(MODELS + 1, -1, ends[-1]).sum(axis=1, dtype=np.float64).T
        for m, c in zip(mixers, columns, strict=True):
            m.ended += ended[c]
    return back


def mixed(said: np.ndarray, truth: np.ndarray, widths: list[int], less: np.ndarray) -> np.ndarray:
    """The mixed prediction of each bit, refining the documents' weights after each step. ``less``: the weights' negatives."""
    out, begin = np.empty_like(truth), 0
    truth, space, error = truth * np.float32(RATE), np.empty((len(less), max(widths)), np.float32), np.empty(max(widths), np.float32)
    rate = np.float32(RATE)
    with np.errstate(over="ignore"):
        for width in widths:
            end = begin + width
            x, w, part, e = said[:, begin:end], less[:, :width], space[:, :width], error[:width]  # the documents that are as long come first
            np.add.reduce(np.multiply(w, x, out=part), 0, out=out[begin:end])
            # RATE * (1 / (1 + exp(-y)) - truth), where out has -y as yet
            np.exp(out[begin:end], out=e)
            np.add(e, 1, out=e)
            np.divide(rate, e, out=e)
            np.subtract(e, truth[begin:end], out=e)
            np.add(w, np.multiply(e, x, out=part), out=w)
            begin = end
    return np.negative(out, out=out)


def _said(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A predictor's stretched probability, softer the less its context has seen."""
    n = zeros + ones
    return (np.log((ones + 0.4) / (zeros + 0.4)) * (n / (n + 2))).astype(np.float32)


def learned(docs: DataFrame, vocabulary, mixers) -> np.ndarray:
    """Sums over all of ``docs`` of what coding them teaches each mixer: weights, map and its counts; and the number of documents.

    A task sends one row a sum, and rows are added up by cell before they reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, mine, documents = vocabulary.value, [fresh(m) for m in mixers.value], 0
        for _, _, ids, first, _ in chunks(batches, v):
            given = in_lockstep(v, ids, first)
            code(mine, v, ids, first, learn=True, given=given)
            documents += given[0].documents
        if documents:
            flat = np.concatenate([*(x.ravel() for m in mine for x in (m.ended, m.map, m.seen)), [documents]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "value"])

    rows = docs.select("text").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(sum(x.size for m in mixers.value for x in (m.ended, m.map, m.seen)) + 1)
    for r in rows:
        out[r.cell] = r.value
    return out


def fresh(mixer: Predictors) -> Predictors:
    """A mixer with the same counts, for one task's sums."""
    mine = copy(mixer)
    mine.ended, mine.map, mine.seen = np.zeros_like(mine.ended), np.zeros_like(mine.map), np.zeros_like(mine.seen)
    return mine


def sums(docs: DataFrame, vocabulary, mixers) -> DataFrame:
    """Per document, under a key of its own: what its classes and frequent tokens give, and its rare tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for part, words, ids, first, counts in chunks(batches, v):
            n, owner = len(part), np.repeat(np.arange(len(part)), counts)
            given, frequent = in_lockstep(v, ids, first), ids > 0
            coded = code(mixers.value, v, ids, first, given=given)
            offsets, rare = rare_tokens(words, np.flatnonzero(~frequent), owner, counts)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([uuid4().bytes for _ in range(n)], pa.binary()),
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "n_tokens": pa.array(counts),
                    "n_bytes": pc.coalesce(pc.binary_length(part.column("text")), 0).cast(pa.int64()),
                    "known": pa.array(np.bincount(owner, frequent, n).astype(np.int64)),
                    "base": pa.array(np.bincount(owner, np.where(frequent, v.base[ids], 0), n)),
                    "coded": pa.array(np.bincount(owner, coded, n)),
                    "rare": pa.ListArray.from_arrays(offsets, rare),
                }
            )

    schema = f"key binary, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, known long, base double, coded double, rare array<struct<token:binary,n:bigint>>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def rare_tokens(words: pa.Array, at: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each document's rare tokens with how often it has them, as offsets and (token, n); ``at``: their places among the documents' tokens.

    Those places count a document's end, which ``words`` does not hold.
    """
    whose = owner[at]
    end = at == (np.cumsum(counts) - 1)[whose]
    found = pc.fill_null(words.take(pa.array(at - whose, mask=end)), _END_TOKEN).dictionary_encode()
    kinds = max(1, len(found.dictionary))
    pair, n = np.unique(whose * kinds + np.asarray(found.indices), return_counts=True)
    offsets = np.searchsorted(pair // kinds, np.arange(len(counts) + 1))
    rare = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pair % kinds)), pa.array(n.astype(np.int64))], ["token", "n"])
    return pa.array(offsets, pa.int32()), rare


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The tokens seen often enough that there are ``most`` of them at most, and twice at least; by a histogram of counts."""
    step = F.floor(F.log2("c") * 8)
    histogram = {r.b: r["count"] for r in counts.groupBy(step.alias("b")).count().collect()}
    least, taken = max(histogram, default=0) + 1, 0
    for b in sorted(histogram, reverse=True):
        taken += histogram[b]
        if taken > most:
            break
        least = b
    rows = counts.where((step >= least) & (F.col("c") >= 2)).collect()
    return sorted(((bytes(r.token), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def context_mixing_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from ``docs`` where ``held_out`` is false, and scores all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (log10 probability), bits_per_byte.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    seen = docs.where(~F.col("held_out"))
    counts = written(token_counts(seen), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    v = Vocabulary(frequent_tokens(counts), total, distinct)
    vocabulary = context.broadcast(v)
    table = np.zeros((2, (MODELS << SLOT_BITS) + (MODELS - 1 << PATH_BITS)), np.float32)
    for r in predictor_counts(seen, vocabulary).collect():
        table[:, r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.counts, np.int64).reshape(PAGE, 2).T
    mixers = Mixer(*table[:, : MODELS << SLOT_BITS]), PathMixer(v, *table[:, MODELS << SLOT_BITS :])
    taught = learned(seen, vocabulary, context.broadcast(mixers))
    if taught[-1]:
        begin = 0
        for m in mixers:
            ended, m.map, m.seen = (x.reshape(y.shape) for x, y in zip(np.split(taught[begin:-1], np.cumsum([m.ended.size, m.map.size, m.seen.size]))[:3], (m.ended, m.map, m.seen), strict=True))
            m.weights = (ended / taught[-1]).astype(np.float32)
            begin += m.ended.size + m.map.size + m.seen.size
    found = written(sums(docs, vocabulary, context.broadcast(mixers)), "scored")
    rare = found.select("key", F.explode("rare").alias("r")).select("key", F.col("r.token").alias("token"), F.col("r.n").alias("n"))
    met = rare.join(counts, "token", "left")
    c, n = F.coalesce(F.col("c"), F.lit(0)), F.col("n")
    parts = met.select(
        "key",
        F.when(c > 0, n).otherwise(0).alias("known"),
        (n * (F.log10(c + 0.5) - v.base_divisor)).alias("base"),
        (n * F.when(c > 0, F.log10(F.greatest(c - DISCOUNT, F.lit(1 - DISCOUNT)) / F.lit(float(max(v.rare, 1))))).otherwise(v.unseen)).alias("coded"),
    )
    own = found.select("key", F.struct("doc_id", "held_out", "n_tokens", "n_bytes").alias("doc"), "known", "base", "coded")
    both = own.unionByName(parts.groupBy("key").agg(*(F.sum(x).alias(x) for x in ("known", "base", "coded"))), allowMissingColumns=True)
    summed = both.groupBy("key").agg(F.max("doc").alias("doc"), *(F.sum(x).alias(x) for x in ("known", "base", "coded")))
    return summed.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("coded").alias("score"),
        (-F.col("coded") * math.log2(10) / F.greatest(F.col("doc.n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
