"""Rows dealt by ranges of their order, so that ordered work needs no task that holds all rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Rows of a range; with fewer rows than that for each core, ranges are smaller, but not under LEAST.
ROWS = 250_000
LEAST = 10_000


def in_ranges(df: DataFrame, order: list[str | Column], rows: int | None = None, n: int | None = None) -> DataFrame:
    """``df`` (of n rows, if that is known) with _range (numbered in order) and _at (the place within
    it), written to the checkpoint folder.  The number of ranges follows the number of rows."""
    n = df.count() if n is None else n
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = -(-n // rows) if rows else max(-(-n // ROWS), min(cores, -(-n // LEAST)))
    dealt = df.repartitionByRange(tasks, *order) if tasks > 1 else df.coalesce(1)
    return cut(dealt.sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))


def starts(ranged: DataFrame) -> DataFrame:
    """_range, n and _start, the number of rows in the ranges before: a row for each range that has any."""
    counted = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    out, total = [], 0
    for r in counted:
        out.append((r["_range"], r["n"], total))
        total += r["n"]
    return ranged.sparkSession.createDataFrame(out, "_range int, n long, _start long")


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of one task, which is one range."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def with_ranks(df: DataFrame, order: list[str], name: str = "_rank") -> DataFrame:
    """Adds a column of ranks from 0 in the given order.  Only a count for each range reaches the
    driver, so no task holds all rows."""
    ranged = in_ranges(df, order)
    return ranged.join(F.broadcast(starts(ranged)), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "n", "_start")  # a row for each range


def every_pair(left: DataFrame, right: DataFrame, size: int = 1000) -> DataFrame:
    """Each row of ``left`` with each of ``right`` (with other column names), for results that are
    all pairs.  Both are dealt into blocks of about ``size`` rows and joined by equal pairs of
    blocks, so copies of rows are few against the pairs and the pairs of two blocks are one task's."""
    blocks = max(1, -(-max(left.count(), right.count()) // size))
    place = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.withColumn("_i", place(left)).withColumn("_j", others)
    b = right.withColumn("_j", place(right)).withColumn("_i", others)
    return a.join(b, ["_i", "_j"]).drop("_i", "_j")
