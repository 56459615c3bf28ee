"""Near-duplicate groups by one-permutation MinHash.

One hash of every shingle fills all bins of a sketch (bin: the hash's leading part; value: the least hash in it);
empty bins borrow from a full one that a universal hash of (bin, attempt) picks, which is optimal densification.
Bands of bins are bucket keys.  In each bucket the member with the most company is the star's centre, and edges run
from it to the others, so a bucket of m members has m - 1 candidate pairs, never m * m.  Every pair is confirmed on the
full shingle sets.

A star alone would lose links between members that their centre doesn't confirm.  They are found through differences:
for members x, y of centre a, |x ^ y| = |x ^ a| + |y ^ a| - 2 |(x ^ a) & (y ^ a)|, so similar members must share much
of what sets them apart from the centre.  Prefix filtering on those differences, elements foreign to the centre first,
yields the remaining candidates, which are confirmed in full too.  No link within a bucket is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import kernels
from quern.llm.common import arrow_batches, cut, text_slices, worker_free
from quern.llm.components import connected

_U = np.uint64


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of a sorted set of hashes, densified."""
    where = ((shingles >> _U(32)) * _U(bins)) >> _U(32)
    full, first = np.unique(where, return_index=True)
    out = np.zeros(bins, dtype=_U)
    out[full.astype(np.int64)] = shingles[first]
    has = np.zeros(bins, dtype=bool)
    has[full.astype(np.int64)] = True
    empty = np.flatnonzero(~has)
    attempt = 0
    with np.errstate(over="ignore"):
        while len(empty):
            attempt += 1
            drawn = kernels.mix(empty.astype(_U) * _U(0x9FB21C651E98DF25) + _U(attempt) * _U(0xC2B2AE3D27D4EB4F))
            source = (((drawn >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
            hit = has[source]
            out[empty[hit]] = kernels.mix(out[source[hit]] + _U(1))
            empty = empty[~hit]
    return out


def band_keys(filled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        grid = filled.reshape(bands, rows)
        key = np.arange(1, bands + 1, dtype=_U) * _U(0xD1B54A32D192ED03)
        for i in range(rows):
            key = kernels.mix(key + grid[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole shingle set; null if empty), keys (one bucket key per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, raw in text_slices(texts):
                sets = kernels.shingle_sets(raw, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(raw)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(
                            [band_keys(sketch(s, bands * rows), bands, rows) if len(s) else None for s in sets],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, keys array<long>"
    )


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, shingles (sorted as unsigned, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        for batch in batches:
            for first, raw in text_slices(batch.column(1)):
                sets = kernels.shingle_sets(raw, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(raw)),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with sa and sb: the set of a travels to each b, so a centre's many members don't meet."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def difference_keys(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, int, np.ndarray, np.ndarray]:
    """Of a centre's set a and a member's set b: linked, |a ^ b|, and the member's prefixes as outer and inner partner.

    Let s = percent / 100.  Sets x, y reach s just if |x ^ y| <= (1 - s) / (1 + s) * (|x| + |y|), which is at most
    t = (1 - s) / s * |x|, as |y| <= |x| / s.  With dx = |x ^ a| >= dy, the overlap of the differences is at least
    dx - t from x's side (as dy >= dx - t), and at least dy - t / 2 from y's side with t in terms of |y|.
    """
    foreign, missing = np.setdiff1d(b, a, assume_unique=True), np.setdiff1d(a, b, assume_unique=True)
    d, common = len(foreign) + len(missing), len(b) - len(foreign)
    linked = 100 * common >= percent * (len(a) + len(foreign))
    ordered = np.concatenate([np.sort(foreign), np.sort(missing)])
    t = (100 - percent) / percent * len(b)
    outer = d - max(1, int(np.ceil(d - t - 1e-9))) + 1
    inner = d - max(1, int(np.ceil(d - t / 2 - 1e-9))) + 1
    return linked, d, ordered[: max(0, outer)], ordered[: max(0, inner)]


def _stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, n (size of b's set), linked, d, outer, inner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        for batch in batches:
            rows = []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                x, y = (np.asarray(s.values).view(_U) for s in (sa, sb))
                linked, d, outer, inner = difference_keys(x, y, percent)
                rows.append((len(y), linked, d, outer.view(np.int64), inner.view(np.int64)))
            n, linked, d, outer, inner = zip(*rows) if rows else ((),) * 5
            keys = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(linked, pa.bool_()),
                 pa.array(d, pa.int64()), pa.array(outer, keys), pa.array(inner, keys)],
                names=["a", "b", "n", "linked", "d", "outer", "inner"],
            )

    return _with_sets(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(
        run, "a long, b long, n long, linked boolean, d long, outer array<long>, inner array<long>"
    )


def near_duplicates(
    docs: DataFrame, percent: int = 85, bands: int = 30, rows: int = 6, width: int = 5
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (columns doc_id and text; others are ignored).

    A null or empty text has no shingles: it is its own component and kept.  Rows of one id are one node of the
    graph; a row with a null id takes the component of its text, or null, and is kept only in the latter case.
    Equal sets share a class, of which only the least id is compared.  An empty table gives no rows.  With bands=30 and
    rows=6 a pair at similarity 0.85 shares no bucket with a probability of 7e-7 if its bins are independent, as those of
    long texts nearly are; texts of few shingles fill bins from one another, and miss more often.
    """
    base = cut(signatures(docs, bands, rows, width))
    some = base.where(F.col("digest").isNotNull())
    nodes = cut(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    # sides of joins are tables of their own, so that the parts of a bucket with a large share of the rows can be split
    keyed = nodes.where("rep is not null").select("rep", F.explode("keys").alias("key")).distinct()
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = cut(keyed.join(sizes, "key"))
    weight = members.groupBy("rep").agg(F.sum("m").alias("w"))
    best = F.max(F.struct("w", (-F.col("rep")).alias("o")))
    centre = cut(members.join(weight, "rep").groupBy("key").agg(best.alias("z")).select("key", (-F.col("z.o")).alias("a")))
    pairs = cut(members.join(centre, "key").where("a <> rep").select("a", F.col("rep").alias("b")).distinct())

    involved = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = cut(full_sets(texts.join(involved, "doc_id", "left_semi"), width))
    stars = cut(_stars(pairs, sets, percent))

    outer = stars.select("a", "linked", F.col("b").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.posexplode("outer").alias("i", "e"))
    inner = stars.select("a", "linked", F.col("b").alias("y"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.posexplode("inner").alias("j", "e"))
    # the sizes, the triangle inequality |x ^ y| >= dx - dy, and positions: behind the first element in common at i and j
    # there are no more than min(dx - i, dy - j), of which the overlap needs half of dx + dy - |x ^ y|
    fits = (
        f"x <> y and (dx > dy or (dx = dy and x > y)) and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
        f" and (100 + {percent}) * (dx - dy) <= (100 - {percent}) * (nx + ny)"
        f" and 2 * {100 + percent} * least(dx - i, dy - j) >= {100 + percent} * (dx + dy) - {100 - percent} * (nx + ny)"
    )
    # either may be linked to the centre, and the linked one may differ more; two linked ones are joined through it
    more = outer.where("not linked").drop("linked").join(inner.drop("linked"), ["a", "e"]).where(fits).select("x", "y").unionByName(
        outer.where("linked").drop("linked").join(inner.where("not linked").drop("linked"), ["a", "e"]).where(fits).select("x", "y")
    )
    more = more.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    common = F.size(F.array_intersect("sa", "sb"))
    confirmed = _with_sets(more, sets).where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    # an id whose rows have different texts joins their classes; only ids of several digests are looked at
    twice = some.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("z")).where("d <> z").select("doc_id")
    twice = cut(twice)
    joined = links = stars.where("linked").select("a", "b").unionByName(confirmed)
    if not twice.isEmpty():
        reps = some.join(twice, "doc_id").select("doc_id", "digest").distinct().join(nodes.select("digest", "rep"), "digest")
        joined = links.unionByName(
            reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
        )
    labels = connected(joined, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("c"))
    # classes of one row that nothing is linked with need no label; texts without a shingle have no class at all
    label = nodes.select("digest", "rep", "n").join(labels, "rep", "left").where("n > 1 or c is not null or rep is null")
    label = cut(label.select("digest", F.coalesce("c", "rep").alias("c")))
    out = some.select("doc_id", "n_shingles", "digest").join(label, "digest", "left").select("doc_id", "n_shingles", "c")
    out = out.unionByName(base.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("c")))
    component = F.coalesce("c", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )
