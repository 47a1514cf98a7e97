"""Exact top-k search by no-random-access aggregation.

Vectors are split into shards; a shard keeps, for every component, the list of its rows sorted
by that component.  A block of queries reads the lists together, from the top for weights over
zero and from the bottom for weights under zero, all down to a common depth that grows round by
round.  What a list has shown of a row is known; of a row that it hasn't shown yet the component
is at most the list's value at that depth and at least the value at its other end (the other way
round from the bottom).  The known values and these bounds are two tables, so a query's lower and
upper bounds of all rows are two matrix products.  A row whose upper bound is under the k-th best
lower bound can't qualify; when few rows are open, their scores are resolved and the query reads
no further.  Every block of queries meets every shard, and the shards' best are merged.

All numbers are whole, and sums stay under 2**53, so bounds and scores in double precision are
exact; a block whose sums could pass that is scored with Python's whole numbers.

Defined results: a component x becomes floor(1024 * x), x as double.  Vectors that are null,
empty, or hold null or non-finite numbers, and rows with a null id, take no part.  Shorter
vectors count as padded with zeros.  Rows that repeat a query's id are that query's own and
no candidates for it; a repeated query id gives the rows of one of its vectors (the smallest
by their components).  Ties go to smaller ids, then equal ids to any.  A score that a 64-bit
number can't hold becomes the nearest one that it can; its rank is that of the true score
within a shard and of the held one between shards.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hnsw import _matrix, usable
from .shared import cut, tasks_for

SHARD = 8_192
QUERIES = 1024
#: Queries whose bounds are held at once.
TOGETHER = 128
#: Depths of the rounds, as shares of the lists; after the last one every score is known.
DEPTHS = (0.06, 0.3, 1.0)
#: A query is resolved when at most this share of the rows is open, or RESOLVE * k rows.
FEW = 0.02
RESOLVE = 8
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def _whole(x: float) -> int:
    """floor(1024 * x) of any finite number."""
    return int(x) * 1024 if abs(x) >= EXACT else int(np.floor(x * 1024))


class SortedLists:
    """One shard: a sorted list for each component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        """``x``: rows of numbers as they are given."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], np.ascontiguousarray(x[order])
        self.rows = np.argsort(-self.raw, axis=0, kind="stable").T.astype(np.uint16 if len(ids) <= 1 << 16 else np.int32)

    def prepare(self) -> None:
        """What all blocks of queries share: whole components and the lists' values."""
        with np.errstate(over="ignore"):
            self.x = np.floor(self.raw * 1024.0)
        self.values = np.take_along_axis(self.x, self.rows.T.astype(np.int64), axis=0).T

    def _read(self, known: np.ndarray, old: int, new: int, top: bool) -> None:
        """The entries of every list between two depths, into the table of what is known."""
        n, dims = self.x.shape
        part = slice(old, new) if top else slice(n - new, n - old)
        at = self.rows[:, part].astype(np.int64)
        known[at, np.arange(dims)[:, None]] = self.values[:, part]

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best rows, those of its own id left out."""
        n, dims = self.x.shape
        with np.errstate(over="ignore"):
            q = np.floor(queries[:, :dims] * 1024.0)
        q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        out: list = [None] * len(q)
        high = np.abs(self.x).max(axis=0, initial=0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            safe = (np.abs(q) * high).sum(axis=1) < EXACT
        for i in np.flatnonzero(~safe):
            out[i] = self._long(queries[i], int(own[i]), k)
        open_ = np.flatnonzero(safe)
        weights = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        low = np.concatenate([np.broadcast_to(self.x.min(axis=0), (n, dims)), np.broadcast_to(self.x.max(axis=0), (n, dims))], axis=1).copy()
        done = 0
        for share in DEPTHS:
            depth = n if share == 1.0 else min(n, max(4 * k, int(share * n)))
            self._read(low[:, :dims], done, depth, True)
            self._read(low[:, dims:], done, depth, False)
            done = depth
            # not shown from the top: at most the last value read; from the bottom: at least
            up = np.concatenate([np.maximum(low[:, :dims], self.values[:, depth - 1]), np.minimum(low[:, dims:], self.values[:, n - depth])], axis=1)
            left = []
            for a in range(0, len(open_), TOGETHER):
                some = open_[a : a + TOGETHER]
                upper = weights[some] @ up.T
                lower = upper.copy() if depth == n else weights[some] @ low.T
                for i, lo, hi in zip(some.tolist(), lower, upper, strict=True):
                    first, last = np.searchsorted(self.ids, own[i], "left"), np.searchsorted(self.ids, own[i], "right")
                    lo[first:last] = hi[first:last] = -np.inf
                    rest = n - int(last - first)
                    bound = np.partition(lo, n - k)[n - k] if rest > k else -np.inf
                    rows = np.flatnonzero((hi >= bound) & (hi > -np.inf))
                    if depth == n or len(rows) <= max(RESOLVE * k, FEW * n):
                        scores = self.x[rows] @ q[i]
                        top = np.lexsort((self.ids[rows], -scores))[:k]
                        out[i] = (self.ids[rows[top]], scores[top].astype(np.int64))
                    else:
                        left.append(i)
            open_ = np.array(left, np.int64)
            if depth == n or not len(open_):
                break
        return out

    def _long(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Without a bound on sizes, row by row."""
        q = [(j, _whole(float(v))) for j, v in enumerate(query[: self.x.shape[1]]) if v]
        rows = np.flatnonzero(self.ids != own)
        scores = [sum(w * _whole(float(self.raw[r, j])) for j, w in q) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
        return self.ids[rows[order]], np.array([min(max(scores[i], LONG[0]), LONG[1]) for i in order], np.int64)


def _index(key: tuple, table: pa.Table) -> pa.Table:
    lists = SortedLists(table.column("id").to_numpy(), _matrix(table.column("vector")))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(lists, protocol=5)], pa.binary())})


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = table.filter(pa.compute.is_valid(table.column("index"))).column("index")
        asked = table.filter(pa.compute.is_null(table.column("index")))
        found: list[tuple] = []
        own = asked.column("id").to_numpy()
        if len(blobs) and len(own):
            lists = pickle.loads(blobs[0].as_buffer())
            lists.prepare()
            found = lists.best(_matrix(asked.column("vector")), own, k)
        sizes = [len(f[0]) for f in found]
        parts = [np.repeat(own, sizes) if found else own[:0], *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(p, pa.int64()) for p in parts), strict=True)))

    return run


def top_k(rows: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score; the queries are the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    whole = cut(vectors)
    n = whole.count()
    shards = max(1, -(-n // SHARD))
    queries = whole.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // QUERIES))
    index = cut(whole.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_index, "shard int, index binary"))
    lists = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "index")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector", F.lit(None).cast("binary").alias("index"))
    tasks = tasks_for(spark, shards * blocks, 0.25)  # a few empty tasks cost less than two shards in one
    found = lists.unionByName(asked).repartition(tasks, "shard", "block").groupBy("shard", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
