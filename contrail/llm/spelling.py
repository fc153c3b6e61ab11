"""Spelling variants by finite-state composition: acceptor, one-edit transducer, acceptor.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The composition's states are
pairs of states of a minimal acceptor with a note of whether the edit is spent: before it both sides walk along one
path; it replaces (two arcs of a state) or inserts (one arc of it, on one side only); after it both must read the same
letters, which a table of the pairs of states that share a word decides. Only paths that end in an accepted pair are walked.

A vocabulary of any size is dealt into acceptors of bounded size, the composition's initial states:

* two near words whose shorter one has m letters share m - 1 in all at both ends, and so the first or the last
  ceil((m - 1) / 2) of them; a word is dealt by both, as the shorter (m its length) and as the longer (m one less);
* what a part's words share is known, and only the rest goes into its acceptor; a part whose rests have over ``letters``
  letters is dealt again in the same way on them, until one letter is left. Such words differ in one or two letters of the
  alphabet. No pair is lost.

Then each word takes its most frequent near word as its form, where that is frequent enough, and roots are found
by pointer doubling: a form is at least ``ratio`` times as frequent, so that chains end and are as short as a logarithm.

What moves: counts by word, the vocabulary four times, near pairs, forms. Every intermediate table is written to the shared
folder. No word has more near words than its length and the alphabet allow.

Defined results: null text has no runs; null doc_id counts as empty; repeated rows count each; runs of any length are
whole; ties of count go to the least word by code points; an empty table gives an empty table; no other column is read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = 250_000  # letters of one acceptor's words
COUNTED = 200_000  # words a task counts before it gives them on


def _runs(least: int) -> re.Pattern:
    """Maximal runs of at least ``least`` letters, of texts whose A-Z are lowered."""
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def vocabulary(docs: DataFrame, least: int = 6, seen: int = 5, drop_every: int | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z lowered, of at least ``least`` code points and ``seen`` occurrences.

    With ``drop_every``, a run is misspelt where that divides h, the crc32 of ``<doc_id>:<run>``: it loses its code point
    h modulo its length.
    """
    pattern = _runs(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return made

        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                found = Counter(pattern.findall(text.as_py().encode().lower().decode()))
                if drop_every:
                    start = zlib.crc32(f"{name.as_py()}:".encode())
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % drop_every == 0]:
                        n, at = found.pop(word), zlib.crc32(word.encode(), start) % len(word)
                        if len(word) > least:
                            counts[word[:at] + word[at + 1 :]] += n
                counts.update(found)
                if len(counts) >= COUNTED:
                    yield out()
        if counts:
            yield out()

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    counted = docs.where("text is not null").select(name, "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words, and its composition with one edit and itself.

    State 0 is the initial one. ``arcs`` has a dict of letters to states for each state, ``final`` whether a word ends there.
    """

    def __init__(self, words: list[str]):
        self.arcs, self.final = [{}], [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""  # states along the last word, not yet joined with equal ones
        for word in [*words, None]:
            common = 0
            if word is not None:
                while common < len(last) and common < len(word) and last[common] == word[common]:
                    common += 1
            for at in range(len(last), common, -1):
                state = path.pop()
                kind = self.final[state], *self.arcs[state].items()
                same = known.setdefault(kind, state)
                if same != state:
                    self.arcs[path[-1]][last[at - 1]] = same
            for letter in (word or "")[common:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            if word is not None:
                self.final[path[-1]], last = True, word
        self.shared: dict[tuple[int, int], bool] = {}
        self.edits: dict[int, list] = {}
        self.useful: dict[int, bool] = {}

    def share(self, a: int, b: int) -> bool:
        """Whether some word leads from both states to an end."""
        if a == b:
            return True
        top = (a, b) if a < b else (b, a)
        stack = [top]
        while top not in self.shared:
            a, b = pair = stack[-1]
            ends, waiting = self.final[a] and self.final[b], None
            if not ends:
                mine, other = self.arcs[a], self.arcs[b]
                for letter, x in mine.items():
                    y = other.get(letter)
                    if y is None:
                        continue
                    if x == y or (known := self.shared.get((x, y) if x < y else (y, x))):
                        ends = True
                        break
                    if known is None:
                        waiting = (x, y) if x < y else (y, x)
            if not ends and waiting:
                stack.append(waiting)
                continue
            self.shared[pair] = ends
            stack.pop()
        return self.shared[top]

    def common(self, a: int, b: int, never: str = "") -> Iterator[str]:
        """The words that lead from both states to an end; none that begins with the letter ``never``."""
        path, stack = [], [(0, a, b, "")]
        while stack:
            depth, a, b, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(letter)
            if self.final[a] and self.final[b]:
                yield "".join(path)
            other = self.arcs[b]
            for letter, x in self.arcs[a].items():
                if (depth or letter != never) and letter in other and self.share(x, other[letter]):
                    stack.append((depth + 1, x, other[letter], letter))

    def edits_at(self, state: int) -> list[tuple[str, str, int, int]]:
        """The edits here that can end in an accepted pair: letters (none: inserted on the other side) and states after."""
        if state not in self.edits:
            arcs = list(self.arcs[state].items())
            found = [(a, b, x, y) for i, (a, x) in enumerate(arcs) for b, y in arcs[i + 1 :] if self.share(x, y)]
            found += [("", b, state, y) for b, y in arcs if self.share(state, y)]
            self.edits[state] = found
        return self.edits[state]

    def leads(self, state: int) -> bool:
        """Whether an edit here or further on ends in an accepted pair."""
        stack = [state]
        while state not in self.useful:
            now = stack[-1]
            yes = bool(self.edits_at(now)) or any(self.useful.get(x) for x in self.arcs[now].values())
            unknown = None if yes else next((x for x in self.arcs[now].values() if x not in self.useful), None)
            if unknown is not None:
                stack.append(unknown)
                continue
            self.useful[now] = yes
            stack.pop()
        return self.useful[state]

    def near(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit parts, each once; of two lengths, the shorter first."""
        path, stack = [], [(0, 0, "")] if self.leads(0) else []
        while stack:
            depth, state, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            if depth:
                path.append(letter)
            begun = "".join(path) if self.edits_at(state) else ""
            for a, b, x, y in self.edits_at(state):
                # an insertion beside an equal letter is told by its last place alone
                for rest in self.common(x, y, "" if a else b):
                    yield begun + a + rest, begun + b + rest
            for letter, x in self.arcs[state].items():
                if self.leads(x):
                    stack.append((depth + 1, x, letter))


def _dealt(parts: DataFrame) -> DataFrame:
    """Each word of a part by the first, and by the last, half of the letters that the part leaves open. Columns: part,
    word, n, m (letters of the shorter word of a pair), front, back (letters shared at the ends)."""
    half = F.ceil((F.col("m") - F.col("front") - F.col("back") - 1) / 2).cast("int")
    key = lambda side, from_: F.xxhash64("part", F.lit(side), F.substring("word", from_, F.col("half")))
    ahead = F.struct(key(0, F.col("front") + 1).alias("part"), (F.col("front") + F.col("half")).alias("front"), "back")
    behind = F.struct(key(1, F.length("word") - F.col("back") - F.col("half") + 1).alias("part"), "front", (F.col("back") + F.col("half")).alias("back"))
    sides = parts.withColumn("half", half).select("word", "n", "m", F.explode(F.array(ahead, behind)).alias("side"))
    return sides.select("side.part", "word", "n", "m", "side.front", "side.back")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (word, near, near_n) both ways, of rows that come sorted by part."""
    part, groups, rows = None, {}, []  # of the part: counts by open letters, by m and the letters shared at both ends

    def out() -> pa.RecordBatch:
        kinds = pa.string(), pa.string(), pa.int64()
        made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "near", "near_n"])
        rows.clear()
        return made

    def found() -> Iterator[pa.RecordBatch]:
        for (m, head, tail), counts in groups.items():
            if len(counts) > 1:
                for a, b in Acceptor(sorted(counts)).near():
                    if len(a) == m - len(head) - len(tail):  # pairs of longer words are another part's
                        one, two = head + a + tail, head + b + tail
                        rows.extend(((one, two, counts[b]), (two, one, counts[a])))
                        if len(rows) >= 10_000:
                            yield out()

    for batch in batches:
        for now, word, n, m, front, back in zip(*(batch.column(c).to_pylist() for c in ("part", "word", "n", "m", "front", "back")), strict=True):
            if now != part:
                yield from found()
                part, groups = now, {}
            end = len(word) - back
            groups.setdefault((m, word[:front], word[end:]), {})[word[front:end]] = n
    yield from found()
    if rows:
        yield out()


def near_words(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n; each once) that one edit parts, both ways. Some come more than once.

    ``letters`` bounds an acceptor.
    """
    as_either = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    parts = words.where("word <> ''").select("word", "n", as_either).select(F.xxhash64("m").alias("part"), "word", "n", "m", F.lit(0).alias("front"), F.lit(0).alias("back"))
    done = None
    while True:
        parts = written(_dealt(parts), "spelling-parts")
        left = F.col("m") - F.col("front") - F.col("back")
        sizes = parts.groupBy("part").agg(F.count("*").alias("words"), F.sum(left).alias("size"), F.max(left).alias("left"))
        large = sizes.where((F.col("words") > 1) & (F.col("size") > letters) & (F.col("left") > 1)).select("part")
        again = bool(large.take(1))
        small = parts.join(large, "part", "left_anti") if again else parts
        done = small if done is None else done.unionByName(small)
        if not again:
            break
        parts = parts.join(large, "part", "left_semi")
    return done.repartition("part").sortWithinPartitions("part").mapInArrow(_pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the chain of ``form`` from each word of ``forms`` (word, form), by pointer doubling."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = links.join(on, "root", "left")
        links = written(both.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not links.where("moved").take(1):
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 6, seen: int = 5, ratio: int = 5, drop_every: int | None = None, letters: int = LETTERS) -> DataFrame:
    """Per word of the vocabulary of ``docs``: word, form, root, n, n_near, form_n.

    form is the near word of largest n, if that is at least ``ratio`` times the word's (over 1), else null; root is the
    end of the chain of forms. The other parameters are those of ``vocabulary`` and ``near_words``.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2: forms of equal counts could go round in a circle")
    words = written(vocabulary(docs, least, seen, drop_every), "spelling-words")
    best: Column = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    near = near_words(words, letters).repartition("word").dropDuplicates(["word", "near"]).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = F.col("best.near_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, F.col("best.near_n")).alias("form_n"),
    )
    found = written(joined, "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
