"""Media columns: texts stored in progressive JPEG files, read back as payloads, RGB tensors and features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from quern.llm import jpeg
from quern.llm.common import arrow_batches, worker_free

#: Payloads are filled up with bytes 255 to a positive multiple of this.
UNIT = 576


def _padded(raw: bytes) -> bytes:
    return raw + b"\xff" * ((-len(raw) % UNIT) if raw else UNIT)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (the file) for every row of docs (doc_id, text; others are ignored).

    A null text is empty and has a file too; null ids pass, repeated rows have a file each, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        for batch in batches:
            raw = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([jpeg.write(_padded(r)) for r in raw], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    arrow_batches(docs.sparkSession, 256, 2 << 20)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def statistics(pixels: np.ndarray) -> list[int]:
    """Mean and variance, rounded down, of each channel of a tensor."""
    flat = pixels.reshape(-1, 3)
    n, total = len(flat), flat.sum(axis=0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64, casting="unsafe")
    return np.stack([total // n, (square - total * total // n) // n], axis=1).ravel().tolist()


def tensors(files: DataFrame) -> DataFrame:
    """files (media) with payload, height, width, rgb (rows of pixels, three bytes each) and channels (statistics()) added.

    All are read from the stored file: the payload from its coefficients, the tensor by inverse transform and
    upsampling.  Columns of files with these names are replaced, others pass; null media give nulls; an empty table
    gives no rows, and repeated rows are decoded each by itself.
    """
    others = [c for c in files.columns if c.lower() not in ("payload", "height", "width", "rgb", "channels", "media")]
    schema = files.select(*[F.col(f"`{c}`") for c in others], "media").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_free()
        types = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for value in batch.column(len(others)):
                if not value.is_valid:
                    rows.append((None,) * 5)
                    continue
                image = jpeg.read(value.as_buffer().to_pybytes())
                pixels = np.ascontiguousarray(jpeg.rgb(image))
                rows.append((jpeg.payload(image), pixels.shape[0], pixels.shape[1], pixels.tobytes(), statistics(pixels)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*batch.schema.names, "payload", "height", "width", "rgb", "channels"]
            )

    added = {"payload": BinaryType(), "height": IntegerType(), "width": IntegerType(), "rgb": BinaryType(), "channels": ArrayType(LongType())}
    schema = StructType([*schema.fields, *(StructField(name, kind) for name, kind in added.items())])
    arrow_batches(files.sparkSession, 256, 2 << 20)
    return files.select(*[F.col(f"`{c}`") for c in others], "media").mapInArrow(run, schema)


def inspected(files: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Digests of the columns of tensors(): of the payload and the file, and as feature the tensor's size, the mean and
    variance of its channels and a checksum of all its bytes.
    """
    shown = tensors(files.select("doc_id", "n_bytes", "media"))
    return shown.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("-", F.concat_ws("x", "width", "height"), F.array_join(F.transform("channels", lambda c: c.cast("string")), "."), F.lower(F.hex(F.crc32("rgb")))).alias("feature"),
    )
