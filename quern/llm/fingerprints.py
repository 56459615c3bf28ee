"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

A text is cut into paragraphs after line ends and these into clauses after marks; a cut drops nothing, so a text is its
clauses one after the other.  A clause's SHA-256 is a leaf, a paragraph's node hashes its leaves, and a section, a run of
paragraphs that ends where a paragraph's own hash says so (an edit moves no other bound), hashes its paragraphs.  The
root hashes the sections.  Equal roots mean equal texts, white space included; two trees are compared from the root
down, and only branches that differ are opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes of text of a range bucket, and bounds that the driver gets; more buckets lie evenly between two bounds.
BUCKET_ROWS, BUCKET_BYTES, MOST_BOUNDS = 4000, 32 << 20, 4096
#: Buckets up to which a row of three numbers for each is sent to all tasks.
MOST_SENT = 100_000

# fixed values of the format: other ones give other fingerprints
PARAGRAPH = r"[^\n]*\n|[^\n]+"
CLAUSE = r"[^.,;:!?]{1,240}[.,;:!?]*|[.,;:!?]+"
#: A paragraph ends a section if its hash begins with one of these: one in eight.
SECTION_ENDS = ("0", "8")


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a text's tree: {name}_root, {name}_sections (array<string>), {name}_leaves (number of distinct ones).

    A null text counts as empty.  A section is written as its digest, `=` and its paragraphs with `,` between; a
    paragraph as its digest, `:` and its leaves with ` ` between.  An entry is thus a node with all below it, and two
    entries are equal just if their digests are.  Entries are taken apart at these marks only, in one pass each:
    length() and substring() count code points from the start at every call.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # each step is a column of its own, which is computed once
    out = df.withColumn(f"{name}_clauses", F.transform(
        F.regexp_extract_all(body, F.lit(PARAGRAPH), F.lit(0)),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda c: F.sha2(c, 256)),
    ))
    clauses = F.col(f"{name}_clauses")
    entry = lambda leaves: F.concat(F.sha2(F.array_join(leaves, ""), 256), F.lit(":"), F.array_join(leaves, " "))
    out = out.withColumns({f"{name}_entries": F.transform(clauses, entry), f"{name}_leaves": F.size(F.array_distinct(F.flatten(clauses)))})
    entries = F.col(f"{name}_entries")

    def runs(part: Callable[[Column], Column]) -> Column:
        """The sections' paragraphs: a bar after one that ends a section, a comma after any other."""
        ends = lambda e: F.left(_head(e, ":"), F.lit(1)).isin(*SECTION_ENDS)
        marked = F.transform(entries, lambda e: F.concat(part(e), F.when(ends(e), "|").otherwise(",")))
        return F.filter(F.split(F.array_join(marked, ""), r"\|", -1), lambda s: s != "")

    digested = runs(lambda e: _head(e, ":"))
    out = out.withColumn(f"{name}_sections", F.zip_with(digested, runs(lambda e: e), lambda d, run: F.concat(F.sha2(d, 256), F.lit("="), run)))
    root = F.sha2(F.array_join(F.transform(f"{name}_sections", lambda s: _head(s, "=")), ""), 256)
    return out.withColumn(f"{name}_root", root).drop(f"{name}_clauses", f"{name}_entries")


def _head(entry: Column, mark: str) -> Column:
    """An entry's digest, which stands before the first mark."""
    return F.substring_index(entry, mark, 1)


def _below(entry: Column, mark: str, between: str) -> Column:
    """What stands after an entry's only mark, as an array."""
    return F.split(F.get(F.split(entry, mark, -1), F.lit(1)), between, -1)


def fingerprint(name: str) -> Column:
    """The root of a tree, then 16 digits of each section's digest: `root/sections`."""
    digits = F.transform(f"{name}_sections", lambda s: F.left(_head(s, "="), F.lit(16)))
    return F.concat(F.col(f"{name}_root"), F.lit("/"), F.array_join(digits, ""))


def _paragraphs(sections: Column) -> Column:
    """The paragraph entries of section entries."""
    return F.filter(F.flatten(F.transform(sections, lambda s: _below(s, "=", ","))), lambda p: p != "")


def _leaves(paragraphs: Column) -> Column:
    """The distinct leaves of paragraph entries."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: _below(p, ":", " "))))


def differing(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with {name}_a, {name}_b: the paragraph entries of each of two trees that the other lacks, in sections that it lacks."""
    x, y = F.col(f"{a}_sections"), F.col(f"{b}_sections")
    out = df.withColumns({f"{name}_a": _paragraphs(F.array_except(x, y)), f"{name}_b": _paragraphs(F.array_except(y, x))})
    x, y = F.col(f"{name}_a"), F.col(f"{name}_b")
    return out.withColumns({f"{name}_a": F.array_except(x, y), f"{name}_b": F.array_except(y, x)})


def differing_paragraphs(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the numbers (from 0) of the paragraphs of tree a that tree b lacks: where an edit lies."""
    out = differing(df, a, b, name)
    marked = F.transform(_paragraphs(F.col(f"{a}_sections")), lambda p, i: F.when(F.array_contains(f"{name}_a", p), i))
    return out.withColumn(name, F.filter(marked, lambda i: i.isNotNull())).drop(f"{name}_a", f"{name}_b")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of two trees as a column: 1 for equal roots, 0 with nothing in common.

    Both are descended to the branches that differ; the leaves there that the other tree's branches lack, of the leaves
    of both, are what they don't share.
    """
    out = differing(df, a, b, name)
    out = out.withColumns({f"{name}_a": _leaves(F.col(f"{name}_a")), f"{name}_b": _leaves(F.col(f"{name}_b"))})
    lacking = F.size(F.array_except(f"{name}_a", f"{name}_b")) + F.size(F.array_except(f"{name}_b", f"{name}_a"))
    of = F.col(f"{a}_leaves") + F.col(f"{b}_leaves")
    value = F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).otherwise(1.0 - lacking / of)
    return out.withColumn(name, value).drop(f"{name}_a", f"{name}_b")


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text) with h, a hash of the text, and bucket: numbers that rise with (doc_id, h); and how many at most.

    Bounds are quantiles of the ids.  An id that is more than one of them has so many rows that these are dealt by h;
    other buckets are cut evenly in as many as the rows and bytes ask for.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    wanted = max(1, size["n"] // BUCKET_ROWS, (size["chars"] or 0) // BUCKET_BYTES)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    bounds: list[int] = []
    n = min(wanted, MOST_BOUNDS)
    if n > 1:  # at most MOST_BOUNDS numbers come to the driver
        at = [i / n for i in range(1, n)]
        bounds = docs.agg(F.percentile_approx("doc_id", at, 10 * n).alias("q")).first()["q"] or []
    parts = -(-wanted // n)
    cuts = F.array(*[F.lit(c) for c in bounds]).cast("array<bigint>")
    low, high = F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))), F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))
    rows = rows.withColumns({"low": low, "high": high})
    share = F.when(F.col("high") > F.col("low") + 1, (F.col("h").cast("double") / 2.0**64 + 0.5) * (F.col("high") - F.col("low")))
    coarse = F.col("low").cast("long") + F.coalesce(F.floor(share), F.col("high") - F.col("low"))
    left, right = F.get(cuts, F.col("high") - 1).cast("double"), F.get(cuts, F.col("high")).cast("double")
    inside = F.when(share.isNull() & (right > left), F.floor((F.col("doc_id") - left) / (right - left) * parts))
    fine = F.least(F.greatest(F.coalesce(inside, F.lit(0)), F.lit(0)), F.lit(parts - 1))
    return rows.withColumn("bucket", (coarse * parts + fine).cast("long")).drop("low", "high"), (len(bounds) + 1) * parts


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, h, own, bucket and next_text: the text of the document before it in ascending id order.

    The least document's next is the greatest.  Null ids come before all others, rows of one id are ordered by a hash
    of the text.  Rows go to range buckets with one shuffle; into each comes a copy of the last row of the bucket before
    it, so neighbours meet across bounds.  Which rows those are is settled without their texts, one row per bucket.
    """
    rows, buckets = _bucketed(docs)
    last = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("z"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    to = F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(every.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.select("bucket", F.col("z.doc_id").alias("i"), F.col("z.h").alias("z"), to.alias("to"))
    same = (rows["bucket"] == last["bucket"]) & rows["doc_id"].eqNullSafe(last["i"]) & (rows["h"] == last["z"])
    ghosts = rows.join(F.broadcast(last) if buckets <= MOST_SENT else last, same).select("doc_id", "text", "h", F.lit(0).alias("own"), F.col("to").alias("bucket")).dropDuplicates(["bucket"])
    near = Window.partitionBy("bucket").orderBy("own", "doc_id", "h", "text")
    return rows.select("doc_id", "text", "h", F.lit(1).alias("own"), "bucket").unionByName(ghosts).withColumn("next_text", F.lag("text").over(near))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text; others are ignored) and of its edited text.

    The edited text is the text with its last half (rounded down) replaced by as many first code points of the next
    document's text, or all of it.  A null text is empty.  An empty table gives no rows; repeated rows are each other's
    next ones; of null ids see with_next().  Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pairs = with_next(docs.select(F.col("doc_id").cast("long"), text.alias("text")))
    near = Window.partitionBy("bucket").orderBy("own", "doc_id", "h", "text")
    done = with_tree(pairs, "text", "tree")
    done = done.withColumns({f"next_{c}": F.lag(f"tree_{c}").over(near) for c in ("root", "sections", "leaves")}).where("own = 1")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    done = with_tree(done.withColumn("edited_text", edited), "edited_text", "edited")
    done = with_likeness(with_likeness(done, "tree", "edited", "near_edited"), "tree", "next", "near_next")
    return done.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint("tree").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"), "near_edited", "near_next",
    )
