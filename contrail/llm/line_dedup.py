"""Line dedup: winnowing over line hashes, in DataFrame functions only.

A document is its lines, cut at ``\\n``; blank lines carry no words and take part in no run. A *minimal run*
ending at line ``j`` is the shortest run of whole lines up to ``j`` holding ``min_words`` words. The steps:

1. **Winnow.** Each minimal run is a window; its line with the least hash (the rightmost of equals) is its
   fingerprint. Equal runs pick equal fingerprints, so every repeated run of ``min_words`` words or more is
   guaranteed to share one.
2. **Join positions.** Fingerprints that occur at two places or more are joined to the windows that chose them. Only
   those windows are gathered whole, as two 64-bit hashes a line, and matched with the first place of their content.
3. **Extend both ways.** The windows matched at one distance between two documents make a range; it grows line by line
   to the left and right for as long as both documents' lines agree, so that short lines at its ends belong to it.
4. **Delete** the lines of every run that has been seen earlier (order: doc_id, text hash, line).

No pairs of documents are formed beyond (document, document of the first place): a passage shared by n documents costs
n rows. Hot fingerprints and passages are joined to written tables of one row each, which AQE splits.

Defined results: null or empty text has no lines and is returned as it is; rows of equal (doc_id, text) are
one document and are treated alike; null doc_id sorts first; other columns pass through untouched, whatever
their names. A document that loses all its lines keeps an empty text and ``kept_lines`` 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written

MIN_WORDS = 50


def _bare(line: Column) -> Column:
    """The line with tabs, carriage returns, vertical tabs and form feeds as spaces, trimmed."""
    for blank in "\t\r\v\f":
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.trim(line)


def _words(bare: Column) -> Column:
    """Number of words of a bare line between runs, of any length, of spaces. Plain byte searches, no patterns."""
    letters = F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    # only spaces are left, so that two other blanks can mark each: a run of any length then falls to one pair
    runs = F.replace(F.replace(bare, F.lit(" "), F.lit("\t\r")), F.lit("\r\t"), F.lit(""))
    apart = F.when(F.contains(bare, F.lit("  ")), F.octet_length(runs) / 2 - letters / 2).otherwise(F.octet_length(bare) - letters).cast("int")
    return F.when(bare == "", 0).otherwise(apart + 1)


def _document(doc_id: Column, text: Column) -> Column:
    """What names a document: a struct, so that null ids are equal to each other in joins."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("th"))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row a line with words: its document ``_d``, place, rank among such lines, hashes, and the minimal run that ends here.

    ``_from`` is the rank of the run's first line (null if there are too few words before); ``_fp`` and ``_fp_rank`` its
    fingerprint and where that stands.
    """
    lines = docs.where(F.length("text") > 0).select(_document(F.col("doc_id"), F.col("text")).alias("_d"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    # apart, so that a bare line is made once for all that is asked of it
    lines = lines.select("_d", "_pos", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), F.col("_line")).alias("_g"), _bare(F.col("_line")).alias("_bare"))
    lines = lines.select("_d", "_pos", "_h", "_g", _words(F.col("_bare")).alias("_n")).where("_n > 0")
    # rows of one (doc_id, text) give equal lines, of which one is kept; the windows below use the same exchange
    lines = lines.repartition("_d").groupBy("_d", "_pos").agg(*(F.first(c).alias(c) for c in ("_h", "_g", "_n")))
    order = Window.partitionBy("_d").orderBy("_pos")
    lines = lines.withColumns({"_cum": F.sum("_n").over(order), "_rank": F.row_number().over(order) - 1})
    # lines that end within the last min_words words before j's end: the first of them starts at least min_words words before it
    run = Window.partitionBy("_d").orderBy("_cum").rangeBetween(-(min_words - 1), Window.currentRow)
    picked = lines.withColumns({"_least": F.min(F.struct(F.col("_h"), (-F.col("_rank")).alias("_at"))).over(run), "_first": F.first("_rank").over(run)})
    whole = F.col("_cum") >= min_words
    return picked.select(
        "_d", "_pos", "_rank", "_h", "_g", "_cum",
        F.when(whole, F.col("_first")).alias("_from"),
        F.when(whole, F.col("_least._h")).alias("_fp"),
        F.when(whole, -F.col("_least._at")).alias("_fp_rank"),
    )


def shared_windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The windows whose fingerprint stands at two places or more, with the hashes of their whole content."""
    whole = lines.where("_from is not null")
    place = F.struct("_d", "_fp_rank")
    often = whole.groupBy("_fp").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("_fp")
    often = written(often, "fingerprints")
    inside = lines.join(whole.join(often, "_fp", "left_semi").select("_d").distinct(), "_d", "left_semi")
    run = Window.partitionBy("_d").orderBy("_cum").rangeBetween(-(min_words - 1), Window.currentRow)
    held = inside.withColumns({"_run": F.collect_list("_h").over(run), "_twin": F.collect_list("_g").over(run)}).where("_from is not null")
    return held.select("_d", "_from", "_rank", "_fp", F.xxhash64("_run").alias("_key"), F.xxhash64("_twin").alias("_key2")).join(often, "_fp", "left_semi")


def matched_ranges(windows: DataFrame) -> DataFrame:
    """(_d, _o, _shift, _from, _to): ranges of ranks whose windows have their first place in document ``_o``, ``_shift`` ranks before."""
    here = F.struct("_d", "_from", "_rank")
    first = windows.groupBy("_key", "_key2").agg(F.min(here).alias("_first"), F.max(here).alias("_last")).where(F.col("_first") != F.col("_last")).drop("_last")
    later = windows.join(written(first, "places"), ["_key", "_key2"]).where(here != F.col("_first"))
    # a run that overlaps its own first place, as in a line said many times, loses what lies behind that place only
    begin = F.when(F.col("_d") == F.col("_first._d"), F.greatest("_from", F.col("_first._rank") + 1)).otherwise(F.col("_from"))
    cut = later.select("_d", F.col("_first._d").alias("_o"), (F.col("_from") - F.col("_first._from")).alias("_shift"), begin.alias("_begin"), "_rank").where("_begin <= _rank")
    lines = cut.select("_d", "_o", "_shift", F.explode(F.sequence("_begin", "_rank")).alias("_at")).distinct()
    # neighbours make a range: their number less their place in order is one and the same
    key = ["_d", "_o", "_shift"]
    ranked = lines.withColumn("_island", F.col("_at") - F.row_number().over(Window.partitionBy(*key).orderBy("_at")))
    return ranked.groupBy(*key, "_island").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to")).drop("_island")


def _alike(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(differ == 0, n).otherwise(differ - 1).cast("int")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each document with a run seen earlier: the ranges (begin, end) of lines to delete."""
    lines = written(windows(docs, min_words), "lines")
    ranges = written(matched_ranges(written(shared_windows(lines, min_words), "windows")), "ranges")
    both = ranges.select("_d").union(ranges.select(F.col("_o").alias("_d"))).distinct()
    held = lines.join(both, "_d", "left_semi").groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("_rank", "_h", "_g", "_pos"))).alias("_all"))
    held = written(held.select("_d", F.transform("_all", lambda x: F.struct(x["_h"], x["_g"])).alias("_x"), F.col("_all._pos").alias("_at")), "held")
    met = ranges.join(held, "_d").join(held.select(F.col("_d").alias("_o"), F.col("_x").alias("_y")), "_o")
    start, to, shift = F.col("_from"), F.col("_to"), F.col("_shift")
    back = _alike(F.reverse(F.slice("_x", 1, start)), F.reverse(F.slice("_y", 1, start - shift)))
    # within one document a run does not grow into its own first place
    back = F.when(F.col("_d") == F.col("_o"), F.least(back, F.greatest(F.lit(0), start - 1 - to + shift))).otherwise(back)
    on = _alike(F.slice("_x", to + 2, F.size("_x")), F.slice("_y", to - shift + 2, F.size("_y")))
    grown = met.select("_d", "_at", (start - back).alias("_from"), (to + on).alias("_to"))
    cut = grown.select("_d", F.explode(F.slice("_at", F.col("_from") + 1, F.col("_to") - F.col("_from") + 1)).alias("_line")).distinct()
    ranked = cut.withColumn("_island", F.col("_line") - F.row_number().over(Window.partitionBy("_d").orderBy("_line")))
    out = ranked.groupBy("_d", "_island").agg(F.min("_line").alias("begin"), F.max("_line").alias("end"))
    return out.groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_drop"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` with repeated runs of ``min_words`` words or more cut out of ``text``.

    Adds n_lines, kept_lines and dropped_lines (an array of line numbers), which replace input columns of
    these names; every other input column keeps its place. Without ``counts``: the input's columns alone, all as they
    were but ``text``; n_chars, if there, follows a text that was cut, and documents that lost all their text go.
    """
    columns = [c for c in docs.columns if not counts or c not in {"n_lines", "kept_lines", "dropped_lines"}]
    text = F.col("row").getField("text")
    keyed = packed(docs).withColumn("_k", _document(F.col("row").getField("doc_id"), text))
    drop = repeated_lines(docs.select("doc_id", "text"), min_words)
    joined = keyed.join(drop, keyed["_k"] == drop["_d"], "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_drop", lambda r: i.between(r["begin"], r["end"])))
    cleaned = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    if not counts:
        cut = joined.select("row", F.col("_drop").isNotNull().alias("_cut"), cleaned.alias("_text")).where(~F.col("_cut") | (F.length(F.trim("_text")) > 0))
        changed = {"text": F.col("_text")}
        if "n_chars" in columns:
            was = F.col("row").getField("n_chars")
            changed["n_chars"] = F.when(F.col("_cut"), F.length("_text")).otherwise(was).cast(docs.schema["n_chars"].dataType)
        return cut.select(*unpacked(columns, **changed))
    n = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    dropped = F.coalesce(F.flatten(F.transform("_drop", lambda r: F.sequence(r["begin"], r["end"]))), F.array().cast("array<int>"))
    return joined.select(*unpacked(columns, text=cleaned), n.alias("n_lines"), (n - F.size(dropped)).alias("kept_lines"), dropped.alias("dropped_lines"))
