"""What a client shows of a result, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(similarity: Column) -> Column:
    return F.format_string("%.1f%%", similarity * 100)


def source_label(source: Column, filename: Column) -> Column:
    return F.coalesce(source, filename, F.lit("Unknown"))


def type_label(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("unknown"))


def page_label(page: Column) -> Column:
    return F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))).otherwise("")


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.80, "high").when(similarity >= 0.65, "good").when(similarity >= 0.50, "fair").otherwise("low")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def clamp_k(k: Column) -> Column:
    """A number of results as typed: whole, 5 if it isn't one, between 1 and 50."""
    return F.least(F.greatest(F.coalesce(k.try_cast("int"), F.lit(5)), F.lit(1)), F.lit(50))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def defaults(similarity: Column, distance: Column, document: Column) -> tuple[Column, Column, Column]:
    """Nulls as a client reads them: similarity 0, distance 1, an empty document."""
    return F.coalesce(similarity, F.lit(0.0)), F.coalesce(distance, F.lit(1.0)), F.coalesce(document, F.lit(""))
