"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns become `<|im_start|>role\\ntext<|im_end|>\\n`.  Control strings inside roles and texts are broken by an escape that
can be undone.  A conversation is cut into windows at turn bounds: prefix sums of turn tokens choose the spans, each
window starts with the system turn and a limited repeat of the turns before its span, and only assistant texts of the
span itself lie under the loss mask, so a repeated target is never learnt twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of common others, as one pattern (fixed values).
CONTROL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>"
#: The escape character; E0 stands for itself, E1 breaks a control string, E2 is a line end in a role.
ESCAPE = "\ue000"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return F.regexp_replace(doubled, f"(?s)(?=(?:{CONTROL}))(.)", f"$1{ESCAPE}1")


def unescape(text: Column) -> Column:
    whole = F.replace(text, F.lit(ESCAPE + "1"), F.lit(""))
    return F.replace(whole, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "2"), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn for budgeting: words and single marks, and four for the template."""
    return (F.regexp_count(text, F.lit(r"\w++|[^\w\s]")) + 4).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window, text, context (leading turns that are repeats), loss (array of start from 0 and length).

    turns: conv_id, turn, role, text; other columns are ignored.  Turns are ordered by turn (null last), then role and
    text, so repeated rows stay, in a defined order.  A null role or text is empty; rows with a null conv_id are one
    conversation; an empty table gives no rows.  Only a first turn of role system is retained in every window.

    budget: tokens of a window.  What the system turn and history leave of it is its room.  A turn of more than half the
    room has a window of its own, whatever its size.  Between such turns a turn's window is its prefix sum divided by a
    stride, the room less the longest other turn, so that a window's turns fit the room.  history: tokens of the turns
    before a window that it repeats, whole turns of the window before it.

    Windows are numbered over rows sorted by conversation, which stream through a task, and a row is never joined with
    its whole conversation: the work is linear in the turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), turn_tokens(text).alias("n"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("system", (F.col("i") == 1) & (F.col("role") == "system"))
    # the system turn takes its tokens from every window's room; of all others there are prefix sums
    rows = rows.withColumn("m", F.when(F.col("system"), 0).otherwise(F.col("n")))
    rows = rows.withColumns({
        "prefix": F.sum("m").over(upto) - F.col("m"),
        "room": F.greatest(F.lit(budget - history) - F.max(F.when(F.col("system"), F.col("n")).otherwise(0)).over(whole), F.lit(2)),
    })
    rows = rows.withColumn("long", 2 * F.col("m") > F.col("room"))
    longest = F.coalesce(F.max(F.when(~F.col("long"), F.col("m"))).over(whole), F.lit(0))
    rows = rows.withColumns({"stride": F.col("room") - longest, "opens": F.col("long") | F.coalesce(F.lag("long").over(order), F.lit(True))})
    rows = rows.withColumn("origin", F.max(F.when(F.col("opens"), F.col("prefix"))).over(upto))
    rows = rows.withColumn("step", F.floor((F.col("prefix") - F.col("origin")) / F.col("stride")))
    new = F.col("opens") | (F.col("step") != F.coalesce(F.lag("step").over(order), F.lit(-1)))
    new = (F.col("i") == 1) | (new & ~F.coalesce(F.lag("system").over(order), F.lit(False)))  # the turn after the system's is in its window
    rows = rows.withColumn("new", new.cast("int")).withColumn("window", (F.sum("new").over(upto) - 1).cast("int"))
    part = F.struct(
        "i", "role", F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), "prefix", "system",
    )
    spans = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("t"))
    by_window = whole.orderBy("window")
    none = F.filter("t", lambda x: F.lit(False))
    before = F.coalesce(F.lag("t").over(by_window), none)
    first = F.first(F.get("t", F.lit(0))).over(by_window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = spans.withColumns({"before": before, "first": first})
    spans = spans.withColumn("before", F.filter("before", lambda x: ~x["system"] & (F.get("t", F.lit(0))["prefix"] - x["prefix"] <= history)))
    # the system turn is a repeat in all windows but the first
    head = F.when((F.col("window") > 0) & F.col("first.system"), F.array("first")).otherwise(none)
    spans = spans.withColumn("parts", F.concat(head, F.col("before"), F.col("t")))
    spans = spans.withColumn("context", F.size("parts") - F.size("t"))
    whole_text = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))
    # where each part's text starts: running sum of the lengths before it; a window has no more turns than its budget
    state = F.aggregate(
        F.transform("parts", lambda p, k: F.struct(
            F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"),
            ((p["role"] == "assistant") & (k >= F.col("context"))).alias("learn"),
        )),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda s, p: F.struct(
            (s["at"] + p["h"] + p["b"] + len(CLOSE)).alias("at"),
            F.when(p["learn"], F.concat(s["loss"], F.array(F.struct((s["at"] + p["h"]).alias("start"), p["b"].alias("length"))))).otherwise(s["loss"]).alias("loss"),
        ),
    )
    return spans.select("conv_id", "window", F.array_join(whole_text, "").alias("text"), "context", state["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, formatted_chars, from the windows alone."""
    pieces = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    parsed = F.transform(bare, lambda p: F.struct(
        _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
    ))
    fresh = F.slice(parsed, F.col("context") + 1, F.greatest(F.size(parsed) - F.col("context"), F.lit(0)))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    rows = formatted.select("conv_id", F.struct("window", fresh.alias("turns"), learnt.alias("learnt"), F.length("text").cast("long").alias("chars")).alias("w"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return grouped.select(
        "conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.learnt", "").alias("loss_text"),
        F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )
