"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased. A word's features are its affixes (1 to 3 letters), the character
n-grams within it (2 and 3, with its borders) and lexicon entries: the word itself if training has it often, and
each language that mostly owns it. States are the languages seen in training; start and transition weights are
learned with the feature weights from code-switched sequences spliced from documents of different languages.
Forward-backward over chains of ``CHAIN`` consecutive words of the whole text gives each word's marginals. The
document's language is the one with the largest mean marginal, and that mean is its score.

Training fits the classifier on a bounded sample of rows: at most ``DOCS_PER_LANGUAGE`` labelled documents of each
language, chosen by a hash of doc_id, with their whole texts, of which ``SEQUENCES`` chains are spliced. The model's size
is fixed by ``FEATURES`` and the number of languages; it is broadcast. Predictions read the whole of every text and never see lang, source or
doc_id. They shuffle nothing.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if no
labelled text has a letter; null langs are not trained on; repeated rows get equal predictions.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, text_of, with_text

DOCS_PER_LANGUAGE = 400
CHAIN, FEATURES = 64, 1 << 16
SEQUENCES, STEPS, RATE, RIDGE = 2000, 40, 0.15, 1e-6
CACHED = 100_000  # words whose scores a task remembers
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall
_MARK = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M") + "]").search
_MARKED_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words(text: str | None) -> list[str]:
    """Runs of letters, with the combining marks that belong to them."""
    if not text:
        return []
    try:
        text.encode("latin-1")  # the quickest way to see that there are no marks
        find = _WORDS
    except UnicodeEncodeError:
        find = _MARKED_WORDS if _MARK(text) else _WORDS
    found = find(text.lower())
    return found if any(c.isalpha() for w in found for c in w) else []


class Model:
    """Weights of a trained field: emission (features x languages), transition and start."""

    def __init__(self, languages: list[str], lexicon: dict[str, list[str]]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.emission, self.transition, self.start = np.zeros((FEATURES, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def features(self, word: str) -> list[int]:
        padded = f"^{word}$"
        names = {f"<{word[:n]}" for n in (1, 2, 3)} | {f"{word[-n:]}>" for n in (1, 2, 3)}
        names |= {padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)}
        names |= {f"={x}" for x in self.lexicon.get(word, ())}
        return [crc32(x.encode()) % FEATURES for x in names]

    def flat(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words in a row, and where each word's begin."""
        each = [self.features(w) for w in vocabulary]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((x for f in each for x in f), np.int64, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)

    def scores(self, vocabulary: list[str]) -> np.ndarray:
        at, begins = self.flat(vocabulary)
        return np.add.reduceat(self.emission[at], begins, axis=0) if len(vocabulary) else np.zeros((0, len(self.languages)), np.float32)

    def marginals(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Forward-backward over all chains of documents with ``counts`` words at once.

        scores: a row a word, documents one after the other. Returns marginals a row a word, and what training needs.
        """
        k = len(self.languages)
        chains = -(-counts // CHAIN)
        begin = np.repeat(np.cumsum(counts) - counts, counts)
        within = np.arange(len(scores)) - begin
        row = np.repeat(np.cumsum(chains) - chains, counts) + within // CHAIN
        step = within % CHAIN
        n, depth = int(chains.sum()), int(step.max(initial=0)) + 1
        e = np.ones((depth, n, k), np.float32)
        e[step, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real = np.zeros((depth, n, 1), bool)
        real[step, row] = True
        turn = np.exp(self.transition - self.transition.max())
        forward, backward = np.empty_like(e), np.ones_like(e)
        a = np.exp(self.start - self.start.max()) * e[0]
        forward[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, depth):
            a = (forward[t - 1] @ turn) * e[t]
            forward[t] = a / a.sum(axis=1, keepdims=True)
        for t in range(depth - 2, -1, -1):
            b = (e[t + 1] * backward[t + 1]) @ turn.T
            backward[t] = np.where(real[t + 1], b / b.sum(axis=1, keepdims=True), 1)
        m = forward * backward
        m /= m.sum(axis=2, keepdims=True)
        return m[step, row], (forward, backward, e, real, turn, m)


def turned(forward: np.ndarray, backward: np.ndarray, e: np.ndarray, real: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Expected number of turns from each language to each, summed step by step."""
    out = np.zeros(turn.shape)
    for t in range(1, len(e)):
        a, b = forward[t - 1], e[t] * backward[t]
        whole = ((a @ turn) * b).sum(axis=1, keepdims=True)
        out += turn * ((a * real[t] / np.maximum(whole, 1e-30)).T @ b)
    return out


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fits the field to (language, text) samples by Adam on the exact gradient."""
    by_language: dict[str, list[list[str]]] = {}
    for language, text in samples:
        if w := words(text):
            by_language.setdefault(language, []).append(w)
    languages = sorted(by_language)
    if not languages:
        return None
    owners: dict[str, Counter] = {}
    for language, texts in by_language.items():
        for w in (w for text in texts for w in text):
            owners.setdefault(w, Counter())[language] += 1
    lexicon = {w: [w, *(f"@{x}" for x, n in c.items() if n >= 0.8 * c.total())] for w, c in owners.items() if c.total() >= 3}
    model, rng = Model(languages, lexicon), random.Random(seed)
    texts, labels = [], []
    while len(texts) < CHAIN * SEQUENCES:
        state = rng.randrange(len(languages))
        source = rng.choice(by_language[languages[state]])
        size, at = rng.randint(6, 40), rng.randrange(len(source))
        texts += source[at : at + size]
        labels += [state] * len(source[at : at + size])
    n = CHAIN * SEQUENCES
    texts, labels = texts[:n], np.array(labels[:n])
    vocabulary = sorted(set(texts))
    number = {w: i for i, w in enumerate(vocabulary)}
    ids, counts = np.array([number[w] for w in texts]), np.full(SEQUENCES, CHAIN)
    at, begins = model.flat(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(begins, len(at))))
    k, truth = len(languages), np.eye(len(languages), dtype=np.float32)[labels]
    pairs = np.zeros((k, k))
    inside = np.flatnonzero(np.arange(n) % CHAIN)
    np.add.at(pairs, (labels[inside - 1], labels[inside]), 1)
    heads = truth[::CHAIN].sum(axis=0)
    parameters = [model.emission, model.transition, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for it in range(1, STEPS + 1):
        scores = np.add.reduceat(model.emission[at], begins, axis=0)[ids]
        found, (forward, backward, e, real, turn, m) = model.marginals(scores, counts)
        wrong = found - truth
        by_word = np.stack([np.bincount(ids, wrong[:, j], len(vocabulary)) for j in range(k)], axis=1)
        emission = np.stack([np.bincount(at, by_word[owner, j], FEATURES) for j in range(k)], axis=1)
        gradients = [emission, turned(forward, backward, e, real, turn) - pairs, m[0].sum(axis=0) - heads]
        for p, g, (first, second) in zip(parameters, gradients, moments, strict=True):
            g = g / n + RIDGE * p
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p -= (RATE * (first / (1 - 0.9**it)) / (np.sqrt(second / (1 - 0.99**it)) + 1e-8)).astype(np.float32)
    return model


def sample(docs: DataFrame, where: Column | None = None, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language: a bounded number, chosen by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if where is None else where))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * per_language / n))))
    h = F.xxhash64("doc_id")
    drawn = labelled.where(F.pmod(h, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    rows = drawn.select("lang", h.alias("h"), "text").collect()
    out, taken = [], Counter()
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        taken[r.lang] += 1
        if taken[r.lang] <= per_language:
            out.append((r.lang, r.text))
    return out


ADDED = ("lang_pred", "score", "switches")


def identify(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of each document (all by default), lang_pred, score, and switches: the number of places where
    the labels of neighbouring words differ. These three replace input columns of equal names."""
    keep = [c for c in (columns or docs.columns) if c not in ADDED]
    return identified(docs, model, keep).select(*(F.col("row").getField(c).alias(c) for c in keep), *ADDED)


def identified(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The same with the columns to keep in one struct ``row``, so that none clashes."""
    shared, rows = docs.sparkSession.sparkContext.broadcast(model), with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language", lambda: None)  # lets go of what another operator kept
        model = shared.value
        known, table = {}, None
        for batch in batches:
            languages, scores, switches = [UNDETERMINED] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            texts = text_of(batch) if model else []
            at = 0
            while at < len(texts):
                docs, n, first = [], 0, at
                while at < len(texts) and (not n or n < 150_000):
                    docs.append(words(texts[at].as_py()))
                    n += len(docs[-1])
                    at += 1
                if not n:
                    continue
                if len(known) > CACHED:
                    known, table = {}, None
                new = [w for w in set().union(*docs) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                table = model.scores(new) if table is None else np.concatenate([table, model.scores(new)])
                ids = np.fromiter((known[w] for d in docs for w in d), np.int64, n)
                counts = np.fromiter(map(len, docs), np.int64, len(docs))
                found, _ = model.marginals(table[ids], counts)
                owner = np.repeat(np.arange(len(docs)), counts)
                mean = np.stack([np.bincount(owner, found[:, j], len(docs)) for j in range(found.shape[1])], axis=1) / np.maximum(counts, 1)[:, None]
                label = found.argmax(axis=1)
                turns = np.bincount(owner[1:], (label[1:] != label[:-1]) & (owner[1:] == owner[:-1]), len(docs))
                for i in np.flatnonzero(counts).tolist():
                    best = int(mean[i].argmax())
                    languages[first + i], scores[first + i], switches[first + i] = model.languages[best], min(1.0, float(mean[i, best])), turns[i]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores), "switches": pa.array(switches)})

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())])
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, trained_on: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Trains on the labelled documents where ``trained_on`` holds, and predicts all."""
    return identify(docs, train(sample(docs, trained_on)), columns)
