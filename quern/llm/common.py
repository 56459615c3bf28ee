"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of anything but a blank and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"

T = TypeVar("T")

#: Bytes of text that one numpy pass takes; a longer single text is a pass of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 10_000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches of a session by bytes and rows; a smaller limit of its own stays.

    Long texts, not row counts, decide how much a Python worker holds.  Plans read these settings when they run, which
    may be after the caller has returned, so they stay set; they change no result.
    """
    name = "spark.sql.execution.arrow.max{}PerBatch"
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < in_bytes(spark.conf.get(name.format("Bytes"))) <= size:
        spark.conf.set(name.format("Bytes"), str(size))
    if not 0 < int(spark.conf.get(name.format("Records"))) <= rows:
        spark.conf.set(name.format("Records"), str(rows))


_held: dict[str, object] = {}


def worker_held(key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one object at a time.

    Another key's object goes first, so a worker never holds what two operators have cached.  Objects bound their own
    bytes.  A module's function is pickled by reference, so tasks of a worker share it.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def worker_free() -> None:
    """Called by operators that keep nothing, at the start of a task: what another one has kept goes."""
    _held.clear()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares (spark.checkpoint.dir).

    Only where that setting is unset, as in tests, is a folder of our own used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(
            context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="quern-checkpoint-")
        )
    return df.checkpoint(eager=True)


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) for runs of rows of about `most` bytes; a null text is empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_buffer().to_pybytes() if value.is_valid else b""
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held

