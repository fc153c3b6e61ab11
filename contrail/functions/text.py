"""Text helpers: cleaning, out-off-on-in times, and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("out", "off", "on", "in")


def clean(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def pick(*columns: Column) -> Column:
    return F.coalesce(*map(clean, columns))


def duration_label(minutes: Column) -> Column:
    m = F.floor(minutes).cast("long")
    return F.when(minutes.isNotNull(), F.format_string("%dh %dm", F.floor(m / 60).cast("long"), F.pmod(m, F.lit(60))))


def percent_floor(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100 * part / whole).cast("string")).otherwise("-")


def retryable(status: Column) -> Column:
    return status.isin(403, 429) | (status >= 500)


def near_time(hhmm: Column, reference: Column) -> Column:
    """Epoch seconds of a four-digit time on the day before, of or after ``reference``, whichever is nearest; the same day wins ties."""
    minutes = F.when(hhmm.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int"))
    same = F.floor(reference / 86400) * 86400 + minutes * 60
    late = same - reference
    return (same - F.when(late > 43200, 86400).when(late < -43200, -86400).otherwise(0)).cast("long")


def oooi(label: Column, text: Column, reference: Column) -> Column:
    """Struct of out, off, on, in: from the last four slash fields of position reports (label 4T), else by keyword."""
    fields = F.split(text, "/")
    positional = (label == "4T") & (F.size(fields) >= 5)
    out = []
    for i, phase in enumerate(PHASES):
        tail = F.trim(F.try_element_at(fields, F.lit(i - 4)))
        word = F.regexp_extract(text, rf"(?i)\b{phase}\b\s*[:=]?\s*([0-9]{{4}})\b", 1)
        out.append(F.when(label.isin("14", "44", "4T", "H1"), near_time(F.when(positional, tail).otherwise(word), reference)).alias(phase))
    return F.struct(*out)


def squeezed_join(sep: str, *columns: Column) -> Column:
    """Join of the non-blank parts."""
    return F.concat_ws(sep, *map(clean, columns))


def any_contains(needle: Column, *columns: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(needle)) for c in columns))
