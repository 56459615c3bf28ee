"""Running headers and footers of paged documents, over tables of lines (doc, page, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip

# fixed values: share of pages, cropped margins, and what a page number looks like
SHARE, TOP, BOTTOM = 0.40, 0.08, 0.08
PAGE_NUMBER = r"^(?:[-–—]?\s*\d+\s*[-–—]?|[Pp]age\s+\d+(?:\s+of\s+\d+)?)$"


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def repeated_lines(lines: DataFrame) -> DataFrame:
    """doc, line, pages: stripped lines on at least max(2, 40 %) of a document's pages, blank pages counted."""
    total = lines.groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    on = (
        lines.select("doc", "page", strip(F.col("line")).alias("line")).where("line <> ''").distinct()
        .groupBy("doc", "line").agg(F.count("*").alias("pages"))
    )
    least = F.greatest(F.lit(2), (F.col("n_pages") * F.lit(SHARE)).cast("int"))
    return on.where("pages >= 2").join(total, "doc").where(F.col("pages") >= least).select("doc", "line", "pages")


def cropped(lines: DataFrame) -> DataFrame:
    """Lines with positions (top, bottom, height of the page) between the margins."""
    return lines.where((F.col("top") >= F.lit(TOP) * F.col("height")) & (F.col("bottom") <= F.lit(1 - BOTTOM) * F.col("height")))


def body_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines that are neither blank, repeated nor page numbers."""
    bare = lines.withColumn("line", strip(F.col("line"))).where("line <> ''").where(~is_page_number(F.col("line")))
    return bare.join(repeated_lines(lines).select("doc", "line"), ["doc", "line"], "left_anti")


def joined_pages(lines: DataFrame) -> DataFrame:
    """doc, text: lines joined by \\n, pages that have any by a blank line."""
    pages = lines.groupBy("doc", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    kept = pages.where(strip(F.col("text")) != "")
    return kept.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )


def without_header_footer(body: DataFrame, marginal: DataFrame) -> DataFrame:
    """doc, text: stripped body paragraphs (doc, no, text) that no header or footer (doc, text) has, joined by blank lines."""
    bare = body.select("doc", "no", strip(F.col("text")).alias("text")).where("text <> ''")
    drop = marginal.select("doc", strip(F.col("text")).alias("text")).where("text <> ''").distinct()
    kept = bare.join(drop, ["doc", "text"], "left_anti")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    return kept.groupBy("doc").agg(F.array_join(parts, "\n\n").alias("text"))
