"""Fill-in-the-middle transformation with a sparse exception index over UTF-8.

Texts stay bytes. Of a batch's bytes only the multibyte characters are recorded: where each begins, and how many
bytes it has beyond the first. Between two of them a code point is a byte, so a cut at a code point is that number plus the
excess of the exceptions before it, which one ``searchsorted`` finds for all cuts of a batch; a cut at a byte goes the
same way back. ASCII texts have an empty index and cost arithmetic alone.

A text is cut in prefix, middle and suffix by hashes of its doc_id, and put in one of three forms:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text as it is, for a share of the documents and for texts that hold a sentinel.

No sentinel overlaps itself or another one, and no text with one is cut, so an output splits at its sentinels in just
one way and ``restored`` gives the text back.

Nothing is shuffled: a row goes to Python and back once, in pieces of ``PIECE`` bytes or one text.

Defined results: null text is the empty text and plain; a null doc_id draws like an empty one; rows of equal doc_id
and text get equal results, each its own; any other column is kept in ``row`` and given back under its name unless it is
one of the result's. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

SENTINELS = ("<P>", "<S>", "<M>")
PIECE = 16 << 20  # bytes of text a task works on at once
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


class Exceptions:
    """The multibyte characters of UTF-8 ``data``: their first bytes, their places in code points, and the excess so far."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        self.excess = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        self.so_far = np.concatenate([[0], np.cumsum(self.excess, dtype=np.int64)])
        self.at_byte, self.at_char = lead, lead - self.so_far[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Where code points begin, in bytes."""
        return chars + self.so_far[np.searchsorted(self.at_char, chars)]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before a byte; a byte within a character counts as that character's first."""
        k = np.searchsorted(self.at_byte, at)
        if not len(self.at_byte):
            return at
        last = np.maximum(k - 1, 0)
        inside = (k > 0) & (at <= self.at_byte[last] + self.excess[last])
        return np.where(inside, self.at_char[last], at - self.so_far[k])


def draws(doc_id: Column, seed: int) -> Column:
    """The first four numbers of 32 bits of the sha256 of ``<seed>:<doc_id>``, as bytes."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))


def _pieces(text: pa.Array, piece: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``piece`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + piece, "right")))
        yield at, end
        at = end


def _laid_out(text: pa.Array, h: np.ndarray, plain: int, spm: int, unit: str) -> list[pa.Array]:
    """The columns of ``ADDED`` for texts without nulls, by their draws (four a row)."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bound = offsets - offsets[0]
    index = Exceptions(data)
    first = index.to_chars(bound)
    n = np.diff(first)
    size = n if unit == "characters" else np.diff(bound)
    one, two = h[:, 0] % (size + 1), h[:, 1] % (size + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    if unit == "characters":
        low, high = first[:-1] + low, first[:-1] + high
    else:
        low, high = index.to_chars(bound[:-1] + low), index.to_chars(bound[:-1] + high)
    a, b = index.to_bytes(low), index.to_bytes(high)
    marked = np.zeros(len(text), bool)
    for s in SENTINELS:
        marked |= pc.match_substring(text, s).to_numpy(zero_copy_only=False)
    kept = (n == 0) | marked | (h[:, 2] % 100 >= plain)
    form = np.where(kept, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    whole, (p, s, m) = data.tobytes(), (x.encode() for x in SENTINELS)
    parts, length = [], np.diff(bound) + np.where(kept, 0, len(p) + len(s) + len(m))
    for kind, begin, cut, end, stop in zip(form.tolist(), bound.tolist(), a.tolist(), b.tolist(), bound[1:].tolist(), strict=False):
        if kind == "plain":
            parts.append(whole[begin:stop])
        elif kind == "psm":
            parts += p, whole[begin:cut], s, whole[end:stop], m, whole[cut:end]
        else:
            parts += s, whole[end:stop], p, whole[begin:cut], m, whole[cut:end]
    ends = np.concatenate([[0], np.cumsum(length)])
    kinds = pa.array(form.tolist(), pa.string())
    output = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(parts)))
    return [pa.array(n, pa.int64()), kinds, pa.array(low - first[:-1], pa.int64(), mask=kept), pa.array(high - low, pa.int64(), mask=kept), output]


def fill_in_middle(docs: DataFrame, columns: list[str] | None = None, plain: int = 90, spm: int = 20, seed: int = 1, unit: str = "characters", piece: int = PIECE) -> DataFrame:
    """Documents with their texts cut and laid out: ``columns`` (all by default), and those of ``ADDED``.

    A document is cut if its third draw modulo 100 is below ``plain``; of those, one whose fourth draw is below ``spm`` gets
    that form. ``unit`` says what the first two draws count: characters (code points), or bytes, of which a cut within a
    character goes to its beginning.
    """
    if unit not in ("characters", "bytes"):
        raise ValueError(f"unit is characters or bytes, not {unit}")
    columns = docs.columns if columns is None else columns
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in columns)).alias("row")
    rows = docs.select(row, F.coalesce("text", F.lit("")).alias("text"), draws(F.col("doc_id"), seed).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in _pieces(whole.column("text"), piece):
                batch = whole.slice(begin, end - begin)
                h = np.frombuffer(b"".join(batch.column("draws").to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *_laid_out(batch.column("text"), h, plain, spm, unit)], ["row", *ADDED])

    kinds = {"form": T.StringType(), "output": T.StringType()}
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, kinds.get(c, T.LongType())) for c in ADDED)])
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col("row").getField(c).alias(c) for c in columns if c not in ADDED), *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>")
    at = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
