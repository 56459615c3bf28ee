"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and by leading bits of a document's hash; a running sum over those few sums finds the bucket
in which a source's budget ends, only that bucket is refined by the next bits, and the result is one threshold per
source.  A document is in when its hash lies below it, so no document is ever sorted against another and any rerun
agrees.  Whole epochs come first (a target above a source's size takes all of it once); what a threshold leaves of a
budget, less than one document, is offered to the smaller documents behind it in further nested thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, cut

#: Bits of the hash: two histogram levels of BUCKET_BITS, then the rest of the boundary bucket.
HASH_BITS, BUCKET_BITS = 62, 12
#: Sources whose plans, a row each, are sent to all tasks; rows that stand for one beyond that number.
MOST_SOURCES, SALTS = 20_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")  # possessive: no backtracking


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def measured(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with skey (source, null told from empty), size (words) and place (hash of the id, or of the text where that is null) added."""
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    place = F.shiftrightunsigned(hashed, 64 - HASH_BITS)
    return docs.withColumns({"skey": _source_key(F.col("source")), "size": word_count(F.col("text")), "place": place})


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """skey, source_size, target.  Weights repeat over the sources by code point, null last.

    A level of water fills vessels of width weight and height most * size: sources are passed in the order in which
    they fill up, and the first whose share of what is left fits fixes the level.  One row per source is all it sorts.
    """
    by_source = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy((F.col("skey") == "").cast("int"), "skey"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = by_source.withColumn("w", w).withColumn("cap", cap).withColumn("fills", F.col("cap") / F.col("w"))
    before = everything.orderBy("fills", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    width = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / width)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "skey", "level"))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("skey", "source_size", target.alias("target"))


def _with_sources(rows: DataFrame, of_source: DataFrame, sources: int) -> DataFrame:
    """rows joined with a table of one row per source (skey), without bringing the rows of a source together.

    Up to MOST_SOURCES that table goes to all tasks; beyond, each of its rows is dealt SALTS times.
    """
    if sources <= MOST_SOURCES:
        return rows.join(F.broadcast(of_source), "skey")
    salted = of_source.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt_"]).drop("salt_")


def _inside(size: Column, place: Column, cuts: Column) -> Column:
    return F.exists(cuts, lambda c: (size <= c["most"]) & (place < c["theta"]))


def _edges(sums: DataFrame, at: str) -> DataFrame:
    """skey, `at` of the place at which a running sum (n, from below on) first exceeds the budget, and the sum before it."""
    run = F.col("below") + F.sum("n").over(Window.partitionBy("skey").orderBy(at))
    over = sums.withColumn("run", run).where("run > budget")
    return over.groupBy("skey").agg(F.min(at).alias(at), F.min_by(F.col("run") - F.col("n"), at).alias("below"))


def _first_threshold(offered: DataFrame, sources: int) -> DataFrame:
    """skey, theta, took: the largest threshold whose documents (skey, size, place, budget) fit the budget, and their sizes.

    A source all of whose documents fit isn't among them.
    """
    base, below = offered, F.lit(0).cast("long")
    for level in (1, 2, 3):
        bucket = F.shiftright("place", max(0, HASH_BITS - level * BUCKET_BITS)) if level < 3 else F.col("place")
        if level > 1:
            below = F.col("below")
        sums = base.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first(below).alias("below"))
        edge = cut(_edges(sums, "bucket"))  # one row per source
        if level < 3:
            base = _with_sources(offered, edge.withColumnRenamed("bucket", "edge"), sources).where(bucket == F.col("edge")).drop("edge")
    return edge.select("skey", F.col("bucket").alias("theta"), F.col("below").alias("took"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, close: float = 0.0005) -> DataFrame:
    """One row per source: skey, source_size, target, whole (epochs taken in full), cuts and again (nested thresholds).

    sized: skey, size, place.  The first threshold leaves less of a budget than one document's size.  That is offered
    to the smaller documents behind it in further thresholds, until every source lies within `close` of its target or
    no document behind them fits what is left (cuts); then, in an unfinished first epoch, documents are taken a second
    time in the same way (again).  Large sources are close with the first; each further one takes a document at least
    of every source that still has one that fits, so this ends.
    """
    state = targets(sized, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("whole", whole).withColumn(
        "left", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    )
    none = F.array().cast("array<struct<most:bigint,theta:bigint>>")
    state = cut(state.withColumns({"cuts": none, "again": none}))
    sources = state.count()
    size, place = F.col("size"), F.col("place")
    open_ = F.expr(f"left > 0 and left > {close}D * target")

    def grown(found: DataFrame, kind: str, limit: Column) -> DataFrame:
        """state with a threshold more for the sources in found (skey, theta, took)."""
        new = F.when(F.col("theta").isNotNull(), F.array(F.struct(limit.cast("long").alias("most"), F.col("theta").cast("long").alias("theta")))).otherwise(none)
        out = state.join(found, "skey", "left").withColumn(kind, F.concat(kind, new))
        out = out.withColumn("left", F.col("left") - F.coalesce("took", F.lit(0)))
        return cut(out.select("skey", "source_size", "target", "whole", "left", "cuts", "again"))

    budgets = state.where("left > 0").select("skey", F.col("left").alias("budget"))
    offered = _with_sources(sized.where("size > 0").select("skey", "size", "place"), budgets, sources)
    state = grown(_first_threshold(offered, sources), "cuts", F.lit((1 << 62) - 1))
    for kind in ("cuts", "again"):
        rest = _with_sources(sized.where("size > 0").select("skey", "size", "place"), state.where(open_).select("skey", "left", "whole", "cuts"), sources)
        taken = _inside(size, place, F.col("cuts"))
        rest = rest.where("size <= left").where(~taken if kind == "cuts" else taken & (F.col("whole") == 0))
        # of a source within reach of its target, few; documents of one hash are in or out together
        rest = cut(rest.groupBy("skey", "place", "size").agg(F.count("*").alias("times")))
        while True:
            fits = rest.join(state.where(open_).select("skey", "left", kind), "skey").where(F.col("size") <= F.col("left")).where(~_inside(size, place, F.col(kind)))
            sums = fits.groupBy("skey", "place").agg(F.sum(F.col("size") * F.col("times")).alias("n"), F.first("left").alias("left"))
            run = sums.where("n <= left").withColumn("run", F.sum("n").over(Window.partitionBy("skey").orderBy("place")))
            # hashes whose documents exceed what is left are behind the threshold: it ends before the first of them
            ends = sums.where("n > left").groupBy("skey").agg(F.min("place").alias("end"))
            inside = run.where("run <= left").join(ends, "skey", "left").where("end is null or place < end")
            found = inside.groupBy("skey").agg((F.max("place") + 1).alias("theta"), F.max("run").alias("took"))
            found = cut(found)
            if found.isEmpty():
                break
            state = grown(found, kind, F.col("left"))
    return state


def copies(sized: DataFrame, plan_: DataFrame) -> DataFrame:
    """sized with source_size, target and copies (how often the mix takes the row, at most twice) added."""
    once = _inside(F.col("size"), F.col("place"), F.col("cuts"))
    twice = once & (F.col("whole") == 0) & _inside(F.col("size"), F.col("place"), F.col("again"))
    joined = _with_sources(sized, plan_.drop("left"), plan_.count())
    return joined.withColumn("copies", F.least(F.col("whole") + once.cast("long") + twice.cast("long"), F.lit(2).cast("long"))).drop("whole", "cuts", "again")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row of docs (doc_id, source, text).

    A null or wordless text has size 0 and is taken with 0 words; a null source is a source, after all others.  Rows
    of one id share their hash and so are taken alike, as are equal texts of null ids.  No row is taken more than twice.
    An empty table gives no rows; other columns of docs are ignored.
    """
    sized = cut(measured(docs.select("doc_id", "source", "text")).drop("text", "source"))
    out = copies(sized, plan(sized, **parameters))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: the rows of docs that it takes, each as often as it takes them, with the columns of docs.

    Rows without words carry nothing to mix and are left out.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sized = cut(measured(docs.select("doc_id", "source", "text")).drop("text", "source"))
    decided = plan(sized, **parameters)
    wrapped = docs.select(F.struct(*columns).alias("row_"), F.col("doc_id"), F.col("source"), F.col("text"))
    taken = copies(measured(wrapped), decided).where("size > 0 and copies > 0")
    return taken.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("turn_")).select("row_.*")
