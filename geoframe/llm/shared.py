"""Helpers that every operator of this subpackage uses: lineage cuts in the
shared checkpoint folder, and zero-copy access to Arrow text columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only when the session names none, and only in
    local mode, where driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="geoframe-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    A reliable checkpoint survives lost executors, and Spark's cleaner removes
    the files once no plan refers to them."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever case its names are in."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model learns from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def doc_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def tasks_for(spark: SparkSession, rows: float, per_task: float) -> int:
    """Partitions for ``rows`` at ``per_task`` each, at least one per core."""
    return int(min(200_000, max(spark.sparkContext.defaultParallelism, -(-rows // per_task))))
