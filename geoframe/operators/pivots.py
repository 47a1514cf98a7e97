"""Exact k-nearest-neighbour joins of vectors of any dimension, bounded by pivots.

Each reference row belongs to the pivot that is nearest to it; rows are dealt into blocks by ranges
of (pivot, distance to the pivot), so a block holds rings around one or a few pivots.  Two bounds tell
how near a ring's rows can be to a query, from distances to pivots alone: the triangle inequality,
and the plane half-way between the query's pivot and the ring's.  A query first meets the block with
the least bound, then only those whose bound doesn't exceed its k-th distance so far.  Where bounds
can't tell blocks apart (vectors without any structure), every block is met: the result is the same.

Blocks meet queries as matrices, so no pair of rows is ever a row of a table.  ``compared`` counts
the pairs whose distance was computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges
from .shared import cut

#: Rows of a block at least, query rows of a task, the most blocks and the most pivots.
BLOCK = 4096
QUERIES = 16_384
MOST = 100_000
PIVOTS = 4096
#: Numbers of a tile of distances.
TILE = 1 << 22
#: Share of the vectors' lengths by which products may miss a distance.
SLACK = 1e-7


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by a product, good to about SLACK of the vectors' lengths."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))


def nearest_rows(a: np.ndarray, b: np.ndarray, idx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k rows of b (fewer if there are fewer) that are nearest to each row of
    a, by distance and id.  A product finds candidates, differences give their distances; as a product
    may take near rows for one another, candidates are all rows within its error of the k-th."""
    k = min(k, len(b))
    ids, found = np.empty((len(a), k), np.int64), np.empty((len(a), k))
    for s in range(0, len(a), max(1, TILE // max(1, len(b)))):
        part = a[s : s + max(1, TILE // max(1, len(b)))]
        rough = distances(part, b)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * SLACK * (np.linalg.norm(part, axis=1) + np.linalg.norm(b, axis=1).max(initial=0))
        row, col = np.nonzero(rough <= limit[:, None])
        d = np.sqrt(((part[row] - b[col]) ** 2).sum(1))
        order = np.lexsort((idx[col], d, row))
        first = np.searchsorted(row[order], np.arange(len(part)))
        pick = order[first[:, None] + np.arange(k)]
        ids[s : s + len(part)], found[s : s + len(part)] = idx[col[pick]], d[pick]
    return ids, found


def _bounds(q: np.ndarray, pivots: np.ndarray, between: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance that a row of each ring can have to each query."""
    d = distances(q, pivots)
    own = d.argmin(1)
    nearest = d[np.arange(len(q)), own]
    to = d[:, cell]
    ring = np.maximum(to - high, low - to)
    apart = between[own][:, cell]
    plane = np.divide(to * to - nearest[:, None] ** 2, 2 * apart, out=np.zeros_like(to), where=apart > 0)
    slack = SLACK * (np.linalg.norm(q, axis=1)[:, None] + np.linalg.norm(pivots, axis=1)[cell] + high)
    return np.maximum(np.maximum(ring, plane) - 4 * slack, 0.0)


def _placed(pivots):
    """Adds each row's nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("vec"))
                d = np.concatenate([distances(v[i : i + 1024], pivots.value) for i in range(0, len(v), 1024)])
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell])], [*batch.schema.names, "cell", "away"])

    return run


def _routed(rings):
    """The block with the least bound of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, between, block, cell, low, high = rings.value
        for batch in batches:
            q = matrix(batch.column("vec")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            at = [block[_bounds(q[i : i + 256], pivots, between, cell, low, high).argmin(1)] for i in range(0, len(q), 256)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(at) if at else [], pa.int32()), pa.array(np.full(len(q), np.inf))], [*batch.schema.names, "block", "bound"])

    return run


def _compared(k: int, rings, first: bool):
    """A block meets queries: their k nearest rows in it and, at first, the blocks that are in reach."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        m, n = len(queries), len(rows)
        q = matrix(queries.column("vec")) if m else np.zeros((0, 1))
        ids, d = nearest_rows(q, matrix(rows.column("vec")), rows.column("idx").to_numpy(), k) if m and n else (np.zeros((m, 0), np.int64), np.zeros((m, 0)))
        reach: list = [[]] * m
        if first and m:
            pivots, between, block, cell, low, high = rings.value
            limit = d[:, k - 1] if d.shape[1] == k else np.full(m, np.inf)
            home, reach = queries.column("block")[0].as_py(), []
            for i in range(0, m, 256):
                near = (_bounds(q[i : i + 256], pivots, between, cell, low, high) <= limit[i : i + 256, None]) & (block != home)[None]
                reach += [np.unique(block[r]) for r in near]
        ends = pa.array(np.arange(m + 1, dtype=np.int32) * d.shape[1])
        best = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(ids.ravel())], ["d", "near"]))
        return pa.table({"own": queries.column("idx"), "vec": queries.column("vec"), "best": best, "compared": pa.array(np.full(m, n)), "reach": pa.array(reach, pa.list_(pa.int32()))})

    return run


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("idx").cast("long").alias("idx"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))


def _meeting(k: int, blocks: DataFrame, rings):
    def met(routed: DataFrame, first: bool) -> DataFrame:
        """Queries meet the rows of their block; a block of many queries has several tasks."""
        parts = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))  # MOST rows at most
        salted = routed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int"))
        copies = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return salted.groupBy("block", "part").cogroup(copies.select("block", "part", "idx", "vec").groupBy("block", "part")).applyInArrow(_compared(k, rings, first), "own long, vec array<double>, best array<struct<d:double,near:long>>, compared long, reach array<int>")

    return met


def k_nearest(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """own, best (an array of (d, near), ascending by distance and id; shorter if there are fewer
    rows) and compared.  Both tables have idx and vec, all vectors of one length."""
    spark = reference.sparkSession
    best = "own long, best array<struct<d:double,near:long>>, compared long"
    n = reference.count()
    if not n:
        return spark.createDataFrame([], best)
    rows = _rows(reference)
    if n <= BLOCK:  # one block, which every query meets
        met = _meeting(k, rows.withColumn("block", F.lit(0)), None)
        return met(_rows(queries).withColumn("block", F.lit(0)), False).select("own", "best", "compared")
    some = rows.orderBy(F.xxhash64("idx"), "idx").limit(min(PIVOTS, max(1, -(-n // BLOCK)) * 2)).collect()  # PIVOTS at most
    centers = np.unique(np.array([r["vec"] for r in some], float), axis=0)
    size = max(BLOCK, -(-n // MOST))
    blocks = in_ranges(rows.mapInArrow(_placed(spark.sparkContext.broadcast(centers)), "idx long, vec array<double>, cell int, away double"), ["cell", "away", "idx"], size, n).withColumnRenamed("_range", "block")
    found = blocks.groupBy("block", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).orderBy("block", "cell").collect()  # MOST and PIVOTS rows at most
    of = lambda c, t: np.array([r[c] for r in found], t)
    rings = spark.sparkContext.broadcast((centers, distances(centers, centers) * (1 - np.eye(len(centers))), of("block", np.int32), of("cell", int), of("low", float), of("high", float)))

    met = _meeting(k, blocks, rings)
    begun = cut(met(_rows(queries).mapInArrow(_routed(rings), "idx long, vec array<double>, block int, bound double").select("idx", "vec", "block"), True))
    on = begun.select(F.col("own").alias("idx"), "vec", F.explode("reach").alias("block"))
    both = begun.select("own", "best", "compared").unionByName(met(on, False).select("own", "best", "compared"))
    # a query has a row for each block that it met
    return both.groupBy("own").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"), F.sum("compared").alias("compared"))
