"""Mixing sources to target weights by the cube method.

Sources share all words by weight; none takes more than ``most`` times what it has, and what it cannot take is shared again
among the others. A target over its source's size says how often each of its documents is taken: the whole part for
certain, the rest as a chance. The cube method turns chances into decisions and keeps two totals of each source, its words
and its documents:

* flight: three undecided documents have one direction in which neither total changes (the cross product of the rows of
  ones and of sizes). Chances move along it, forward or back by lot so that each keeps its mean, until one of them is 0 or
  1; the next document takes its place. Two are left at the end;
* documents are dealt into blocks of about ``block``; what blocks leave undecided is dealt again, until a source has
  one block. Documents come by falling size, so that what is left is small beside what is decided;
* landing: those last two of a source and about ``pool`` others that were kept back, and as many drawn by size, go by falling size to whatever
  keeps the source's words nearest its target. The few documents that hold a ``pool``-th of a source land first, and the
  chances of all others take up what is then over or short, as nothing small could do so at the end.

Rows equal in doc_id, source and text are one unit of the sample, of which a whole number is taken outright and at most
one row is left to chance, so that copies beyond number neither meet in a task nor differ from run to run. Lots are drawn from hashes of the
block and the round: runs over the same rows agree however they are partitioned.

What moves: 40 bytes a document to its unit and its block, then two documents a block. Of the sources only scalars come to
the driver: the water level rises in rounds of one aggregate. Sizes are counted once.

Defined results: null text has no words; documents without words are sampled but take none; null is a source, the last;
an empty table gives an empty table; repeated rows are each given as a row. ``mix`` reads and returns doc_id and source alone,
``mixture`` keeps all columns.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written

BLOCK, POOL, COPIES = 4096, 64, 10_000
WEIGHTS = [1, 2, 3]  # by rank of the source, repeating
CERTAIN = 1e-9  # a chance this near 0 or 1 is that


def words(text: Column) -> Column:
    """How many runs of anything but ASCII blanks a text has."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0): the place of a source by code point, null last. Sources are dealt by range, so that no
    task ranks them all; the ranges' counts, one a partition, give where each begins."""
    last = F.col("source").isNull()
    dealt = written(sources.withColumn("last", last).repartitionByRange("last", "source").withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    return dealt.withColumn("place", place).join(starts, "range").withColumn("rank", F.col("start") + F.col("place")).drop("last", "range", "start", "place")


def targets(sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Adds ``target`` to sources (source, source_size): shares of all words by weight, none over ``most`` times its size.

    Weights repeat by rank. The excess of capped sources is shared by weight among the rest until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(ranked(sources).withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))}), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight") if capped >= 0 else F.lit(False)
        count, held, open_ = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if count == capped or not open_:
            break
        capped, level = count, (total - (held or 0)) / open_
    return rows.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("rank", "weight", "cap")


def flight(units: Iterator[tuple[object, float, float]], lot: random.Random) -> Iterator[tuple[object, float]]:
    """(name, chance) of units (name, size, chance), whose chances become 0 or 1 but for two at most; totals of chances
    and of sizes times chances stay. Only three units are held."""
    names, sizes, chances = [], [], []
    for name, size, chance in units:
        if chance <= CERTAIN or chance >= 1 - CERTAIN:
            yield name, float(round(chance))
            continue
        names.append(name)
        sizes.append(size)
        chances.append(chance)
        if len(names) < 3:
            continue
        a, b, c = sizes
        way = (1.0, -1.0, 0.0) if a == b else (c - b, a - c, b - a)
        ahead = min((1 - x) / w if w > 0 else -x / w for x, w in zip(chances, way, strict=True) if w)
        back = min(x / w if w > 0 else (x - 1) / w for x, w in zip(chances, way, strict=True) if w)
        step = ahead if lot.random() * (ahead + back) < back else -back
        chances = [x + step * w for x, w in zip(chances, way, strict=True)]
        for i in (2, 1, 0):
            if chances[i] <= CERTAIN or chances[i] >= 1 - CERTAIN:
                yield names.pop(i), float(round(chances.pop(i)))
                sizes.pop(i)
    yield from zip(names, chances, strict=True)


def landing(units: list[tuple[object, float, float]]) -> Iterator[tuple[object, float]]:
    """Decides the last units by falling size, each so that what was taken stays nearest to what was due."""
    over = 0.0
    for name, size, chance in units:
        taken = 1.0 if abs(over + size * (1 - chance)) < abs(over - size * chance) else 0.0
        over += size * (taken - chance)
        yield name, taken


def units(docs: DataFrame) -> DataFrame:
    """unit, source, doc_id, size, copies: rows equal in doc_id, source and text are one unit, counted before they are shuffled."""
    unit = F.xxhash64("doc_id", "source", "text").alias("unit")
    return docs.select(unit, "source", "doc_id", words(F.col("text")).alias("size")).groupBy("unit", "source", "doc_id", "size").agg(F.count("*").alias("copies"))


def _flown(rows: DataFrame, land: bool) -> DataFrame:
    """``rows`` (with block and round) by source and block, with their chances after a flight or, with ``land``, the landing."""
    columns = [c for c in rows.columns if c not in ("block", "round")]
    at, size = columns.index("chance"), columns.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def read() -> Iterator[tuple[tuple, tuple]]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field(c) for c in columns])
                keys = zip(*(batch.column(c).to_pylist() for c in ("source", "block", "round")), strict=True)
                yield from zip(keys, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)

        def out(done: list[tuple]) -> pa.RecordBatch:
            values = zip(*(row[:at] + (chance, *row[at + 1 :]) for row, chance in done), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        done = []
        for key, group in groupby(read(), itemgetter(0)):
            given = ((row, float(row[size]), row[at]) for _, row in group)
            for one in landing(list(given)) if land else flight(given, random.Random(repr(key))):
                done.append(one)
                if len(done) >= 10_000:
                    yield out(done)
                    done = []
        if done:
            yield out(done)

    dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "unit")
    fields = T.StructType([rows.schema[c] for c in columns])
    return written(dealt.mapInArrow(run, fields), "mix-landing" if land else "mix-flight")


def _exact(x: Column) -> Column:
    """The sum of ``x`` in steps of a millionth: whole numbers, so that the order of adding is all one."""
    return F.coalesce(F.sum(F.floor(x * (1 << 20))), F.lit(0))


def _after_heads(chances: DataFrame, pool: int) -> list[DataFrame]:
    """The units of over a ``pool``-th of their source, of which there are fewer than ``pool``, decided by landing; and the
    rest, whose chances are moved so that they take up what those leave over or short."""
    head, size = F.col("size") * pool > F.col("source_size"), F.col("size")
    heads = _flown(chances.where(head).withColumns({"block": F.lit(0), "round": F.lit(-1)}), True)
    got = heads.groupBy(F.col("source").alias("_got_of")).agg(_exact(size * F.col("chance")).alias("_got"))
    due = chances.groupBy(F.col("source").alias("_of")).agg(
        _exact(F.when(head, size * F.col("chance"))).alias("_due"),
        _exact(F.when(~head, size * F.col("chance"))).alias("_less"),
        _exact(F.when(~head, size * (1 - F.col("chance")))).alias("_more"),
    )
    over = F.coalesce("_got", F.lit(0)) - F.col("_due")
    shifts = written(due.join(got, F.col("_of").eqNullSafe(F.col("_got_of")), "left").select("_of", over.alias("_over"), "_less", "_more"), "mix-shifts")
    share = lambda of: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs("_over"), of), F.lit(0.0)))
    moved = F.when(F.col("_over") > 0, F.col("chance") * (1 - share(F.col("_less")))).otherwise(F.col("chance") + (1 - F.col("chance")) * share(F.col("_more")))
    rest = chances.where(~head).join(shifts, F.col("source").eqNullSafe(F.col("_of"))).withColumn("chance", moved)
    return [heads, rest.select(*chances.columns)]


def decided(chances: DataFrame, block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """``chances`` (at least unit, source, source_size, size, chance) with every chance moved to 0 or 1."""
    columns = chances.columns

    def dealt(rows: DataFrame, number: int) -> DataFrame:
        counts = written(rows.groupBy(F.col("source").alias("_of")).agg(F.count("*").alias("_n")), "mix-counts")
        keyed = rows.join(counts, F.col("source").eqNullSafe(F.col("_of")))
        blocks = {"block": F.pmod(F.xxhash64("unit", F.lit(number)), F.ceil(F.col("_n") / block)), "round": F.lit(number)}
        waits = F.pmod(F.xxhash64("unit", F.lit(-1)), F.lit(1 << 30)) / (1 << 30) < F.greatest(F.least(F.lit(0.25), pool / F.col("_n")), F.coalesce(F.try_divide(F.lit(float(pool)) * F.col("size"), F.col("source_size")), F.lit(0.0)))
        return written(keyed.withColumns({**blocks, "_waits": waits}).drop("_of", "_n"), "mix-blocks")

    heads, rest = _after_heads(chances, pool)
    first = dealt(rest, 0)
    rows, number, done = first.where("not _waits").drop("_waits"), 0, [heads]
    certain = (F.col("chance") == 0) | (F.col("chance") == 1)
    while True:
        flown = _flown(rows, False)
        done.append(flown.where(certain))
        rows = flown.where(~certain)
        most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 2:
            break
        number += 1
        rows = dealt(rows, number).drop("_waits")
    last = rows.unionByName(first.where("_waits").select(*columns))
    done.append(_flown(last.withColumns({"block": F.lit(0), "round": F.lit(0)}), True))
    return reduce(DataFrame.unionByName, done)


def planned(docs: DataFrame, weights: list[float] = WEIGHTS, most: float = 3, block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """unit, source, doc_id, size, copies, source_size, target, total: how often each unit is taken, all its copies together."""
    counted = written(units(docs), "mix-units")
    of = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    due = written(targets(of, weights, most).withColumnRenamed("source", "_of"), "mix-targets")
    joined = counted.join(due, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("times") * F.col("copies") + F.floor(F.col("copies") * (F.col("times") - F.floor("times")))
    chance = F.col("copies") * (F.col("times") - F.floor("times"))
    rows = joined.withColumn("times", times).withColumns({"total": whole, "chance": chance - F.floor(chance)}).drop("times")
    return decided(rows, block, pool).withColumn("total", F.col("total") + F.col("chance").cast("long")).drop("chance")


def _repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` over, numbered from 0 in ``name``; by ``COPIES`` at once, and these spread over tasks where there are more."""
    heaps = rows.withColumn("_times", times).withColumn("_heap", F.explode(F.expr(f"sequence(0L, (_times - 1) div {COPIES})")))
    upto = F.least(F.col("_times"), (F.col("_heap") + 1) * COPIES) - 1
    return heaps.withColumn(name, F.explode(F.sequence(F.col("_heap") * COPIES, upto))).drop("_times", "_heap")


def mix(docs: DataFrame, weights: list[float] = WEIGHTS, most: float = 3, block: int = BLOCK, pool: int = POOL) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, times (how often it is taken), taken (words).

    ``weights`` repeat over the sources by rank, ``most`` caps repeats (a whole number keeps documents to it), ``block`` and ``pool`` are sizes of the
    flight's blocks and of what waits for the landing.
    """
    rows = _repeated(planned(docs, weights, most, block, pool), F.col("copies"), "copy")
    times = F.floor(F.col("total") / F.col("copies")) + (F.col("copy") < F.col("total") % F.col("copies")).cast("long")
    return rows.withColumn("times", times).select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken. Texts are shuffled once, by unit."""
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("row")
    plan = planned(docs, **parameters).where("total > 0").select("unit", "source", "doc_id", "total")
    keyed = docs.select(row, F.xxhash64("doc_id", "source", "text").alias("unit"))
    same = (keyed.unit == plan.unit) & F.col("row.source").eqNullSafe(plan.source) & F.col("row.doc_id").eqNullSafe(plan.doc_id)
    once = keyed.join(plan, same).select("row", keyed.unit, "total").dropDuplicates(["unit"])
    return _repeated(once, F.col("total"), "copy").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
