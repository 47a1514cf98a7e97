"""Exact nearest neighbours of point clouds of any density (columns x, y, z).

The reference is dealt into blocks by ranges of a Morton code, so a block has about as many points
as any other, however dense the cloud is somewhere, and its bounding box is compact.  A query point
first goes to the block that its own code falls into, which gives a bound for its neighbours'
distance; then to the blocks whose boxes the bound reaches, and to no other.  Inside a block the
points lie in the leaves of a k-d tree, and leaves are pruned the same way.  Only a query's own best
distances leave a task, never a pair.  Blocks that many query points reach are searched by several
tasks, so no task holds more than a block and BLOCK query points.

Blocks grow with the cloud beyond MOST of them, so their boxes, which every task gets, are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import in_ranges
from .shared import cut

AXES = ("x", "y", "z")
#: Points of a block, as of query points and of the reference, and the most blocks.
BLOCK = 50_000
MOST = 100_000
LEAF = 64
BITS = 21


def morton(low: Sequence[float], high: Sequence[float]) -> Column:
    """Interleaved bits of a point's place in a box; a binary number read as octal has its bits three apart."""

    def spread(axis: str, lo: float, hi: float) -> Column:
        share = (F.col(axis) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        place = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * ((1 << BITS) - 1)).cast("long")
        return F.conv(F.bin(place), 8, 10).cast("long")

    x, y, z = (spread(*a) for a in zip(AXES, low, high, strict=True))
    return x * 4 + y * 2 + z


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance from each point (rows) to each box (columns)."""
    out = 0.0
    for a in range(3):
        gap = np.maximum(np.maximum(low[None, :, a] - points[:, None, a], points[:, None, a] - high[None, :, a]), 0.0)
        out = out + gap * gap
    return np.sqrt(out)


class Leaves:
    """A k-d tree: an order of the points, cut into leaves, the leaves' boxes, and the planes that
    split the points (axis, value, and the nodes on both sides; a leaf i is node -1 - i)."""

    def __init__(self, points: np.ndarray) -> None:
        parts, axis, value, sides = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            leaf = len(rows) <= LEAF
            if parent >= 0:
                sides[parent][side] = -1 - len(parts) if leaf else len(axis)
            if leaf:
                parts.append(rows)
                continue
            a, half = int(np.ptp(points[rows], axis=0).argmax()), len(rows) // 2
            rows = rows[np.argpartition(points[rows, a], half)]
            todo += [(rows[half:], len(axis), 1), (rows[:half], len(axis), 0)]
            axis.append(a)
            value.append(points[rows[half], a])
            sides.append([0, 0])
        self.order = np.concatenate(parts)
        self.points = points[self.order]
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts = self.ends - [len(p) for p in parts]
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        self.axis, self.value, self.sides = np.array(axis, int), np.array(value), np.array(sides, int).reshape(-1, 2)

    def homes(self, queries: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all planes each query is."""
        node = np.zeros(len(queries), int) if len(self.axis) else np.full(len(queries), -1)
        while (on := np.flatnonzero(node >= 0)).size:
            at = node[on]
            node[on] = self.sides[at, (queries[on, self.axis[at]] >= self.value[at]).astype(int)]
        return -1 - node

    def nearest(self, queries: np.ndarray, bound: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (up to ``bound``, ascending, inf where there are fewer) and rows of the k
        nearest points of each query; points whose id is the query's own don't count."""
        m, ids = len(queries), ids[self.order]
        best, rows = np.full((m, k), np.inf), np.full((m, k), -1)

        def visit(at: np.ndarray, leaf: int) -> None:
            span = np.arange(self.starts[leaf], self.ends[leaf])
            q, p = queries[at], self.points[span]
            d = np.sqrt((q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2 + (q[:, None, 2] - p[None, :, 2]) ** 2)
            d[(own[at][:, None] == ids[span][None]) | (d > bound[at][:, None])] = np.inf
            if k == 1:
                j = d.argmin(1)
                d = d[np.arange(len(at)), j]
                closer = d < best[at, 0]
                best[at[closer], 0], rows[at[closer], 0] = d[closer], self.order[span[j[closer]]]
                return
            better = (d < best[at, k - 1 :]).any(1)
            at, d = at[better], np.concatenate([best[at[better]], d[better]], 1)
            r = np.concatenate([rows[at], np.broadcast_to(self.order[span], (len(at), len(span)))], 1)
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            best[at], rows[at] = np.take_along_axis(d, first, 1), np.take_along_axis(r, first, 1)

        home = self.homes(queries)
        by_place = np.argsort(home, kind="stable")
        for i in range(0, m, 256):  # queries of one place are searched together
            some = by_place[i : i + 256]
            for leaf in np.unique(home[some]):
                visit(some[home[some] == leaf], leaf)
            limit = np.minimum(best[some, k - 1], bound[some])
            gap = np.maximum(np.maximum(self.low - queries[some].max(0), queries[some].min(0) - self.high), 0.0)
            near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= limit.max())
            far = box_distances(queries[some], self.low[near], self.high[near])
            far[home[some][:, None] == near[None]] = np.inf
            for n in np.argsort(far.min(0, initial=np.inf), kind="stable"):
                # equally far is no nearer, else equal points would all be compared
                reach = some[(far[:, n] < best[some, k - 1]) & (far[:, n] <= bound[some])]
                if len(reach):
                    visit(reach, near[n])
        return best, rows


def _coordinates(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(a).to_numpy() for a in AXES], axis=1)


def _homes(blocks):
    """Adds the block whose range of codes a query falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes = blocks.value[:2]
        for batch in batches:
            at = np.maximum(np.searchsorted(codes, batch.column("_m").to_numpy(), side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", *AXES, "bound")), pa.array(numbers[at]), pa.array(np.full(batch.num_rows, -1, np.int32))], ["_row", *AXES, "bound", "block", "home"])

    return run


def _searched(k: int, keep: Sequence[str], blocks):
    """The k nearest of a block to its queries, and, in the first pass, the other blocks in reach."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        # so that ties don't depend on the order of arrival
        points = points.sort_by([(a, "ascending") for a in (*AXES, "_id")])
        m, at, bound = len(queries), _coordinates(queries), queries.column("bound").to_numpy()
        best, rows = np.full((m, k), np.inf), np.full((m, k), -1)
        if m and len(points):
            best, rows = Leaves(_coordinates(points)).nearest(at, bound, k, queries.column("_row").to_numpy(), points.column("_id").to_numpy())
        found = np.isfinite(best)
        ends = pa.array(np.r_[0, np.cumsum(found.sum(1))].astype(np.int32))
        made = {"_row": queries.column("_row"), "ds": pa.ListArray.from_arrays(ends, pa.array(best[found]))}
        made |= {c: pa.ListArray.from_arrays(ends, points.column(c).combine_chunks().take(pa.array(rows[found]))) for c in keep}
        made |= {a: queries.column(a) for a in AXES} | {"bound": pa.array(np.minimum(best[:, k - 1], bound))}
        reach: list = [[]] * m
        if m and queries.column("home")[0].as_py() == -1:
            numbers, _, low, high = blocks.value
            # first the boxes within the largest bound of the queries' own box, then each query's
            gap = np.maximum(np.maximum(low - at.max(0), at.min(0) - high), 0.0)
            near = np.flatnonzero((np.sqrt((gap * gap).sum(1)) <= np.minimum(best[:, k - 1], bound).max()) & (numbers != queries.column("block")[0].as_py()))
            reach = []
            for i in range(0, m, 1024):
                far = box_distances(at[i : i + 1024], low[near], high[near])
                reach += [numbers[near[r]] for r in (far < best[i : i + 1024, k - 1 :]) & (far <= bound[i : i + 1024, None])]
        return pa.table(made | {"reach": pa.array(reach, pa.list_(pa.int32()))})

    return run


class Index:
    """A reference cloud dealt into blocks, for any number of searches.  ``reference``: x, y, z,
    the columns of ``keep`` and, if a search is for other points of the cloud itself, _row."""

    def __init__(self, reference: DataFrame, keep: Sequence[str] = (), itself: bool = False) -> None:
        self.spark, kinds = reference.sparkSession, dict(reference.dtypes)
        self.keep, self.names = list(keep), [f"k_{c}" for c in keep]
        self.kept = "".join(f", `k_{c}` array<{kinds[c]}>" for c in keep)
        numbers = [F.col(a).cast("double").alias(a) for a in AXES]
        points = reference.select(*numbers, F.col("_row").alias("_id") if itself else F.lit(-1).cast("long").alias("_id"), *[F.col(c).alias(f"k_{c}") for c in keep])
        corners = lambda: [f(a).alias(f"{f.__name__}{a}") for f in (F.min, F.max) for a in AXES]
        box = points.agg(F.count("*").alias("n"), *corners()).first()
        self.n = box["n"]
        if self.n:
            self.low, self.high = ([box[f"{f}{a}"] for a in AXES] for f in ("min", "max"))
            self.single = self.n <= BLOCK
            if self.single:  # the whole cloud is a block, and its box is known
                self.points = points.withColumn("block", F.lit(0))
                self.blocks = self.spark.sparkContext.broadcast((np.zeros(1, np.int32), np.zeros(1, np.int64), np.array([self.low]), np.array([self.high])))
                return
            self.points = in_ranges(points.withColumn("_m", morton(self.low, self.high)), ["_m", *AXES], max(BLOCK, -(-self.n // MOST)), self.n).withColumnRenamed("_range", "block")
            boxes = self.points.groupBy("block").agg(F.min("_m").alias("m"), *corners()).orderBy("block").collect()  # MOST rows at most
            self.blocks = self.spark.sparkContext.broadcast((np.array([r["block"] for r in boxes], np.int32), np.array([r["m"] for r in boxes]), *(np.array([[r[f"{f}{a}"] for a in AXES] for r in boxes], float) for f in ("min", "max"))))

    def _meet(self, routed: DataFrame, k: int) -> DataFrame:
        """Queries meet the points of their block; a block of many queries has several tasks."""
        parts = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))  # MOST rows at most
        salted = routed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"))
        copies = self.points.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left, right = salted.select("_row", *AXES, "bound", "block", "home", "part"), copies.select("block", "part", *AXES, "_id", *self.names)
        schema = f"_row long, ds array<double>{self.kept}, x double, y double, z double, bound double, reach array<int>"
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_searched(k, self.names, self.blocks), schema)

    def nearest(self, query: DataFrame, k: int, radius: float = float("inf")) -> DataFrame:
        """_row, ds (the distances of the k nearest points within the radius, ascending) and an array
        for each kept column of these points.  ``query``: _row, x, y, z, which must not change when
        it is read again.  No rows if the reference is empty."""
        columns = ["ds", *self.names]
        if not self.n:
            return self.spark.createDataFrame([], f"_row long, ds array<double>{self.kept}").withColumnsRenamed(dict(zip(self.names, self.keep, strict=True)))
        placed = query.select("_row", *[F.col(a).cast("double").alias(a) for a in AXES], F.lit(float(radius)).alias("bound")).withColumn("_m", morton(self.low, self.high))
        first = self._meet(placed.mapInArrow(_homes(self.blocks), "_row long, x double, y double, z double, bound double, block int, home int"), k)
        if self.single:
            return first.select("_row", *[F.col(c).alias(c.removeprefix("k_")) for c in columns])
        first = cut(first)
        again = first.select("_row", *AXES, "bound", F.explode("reach").alias("block"), F.lit(0).alias("home"))
        both = first.select("_row", *columns).unionByName(self._meet(again, k).select("_row", *columns))
        # a query has a row for each block that it reached, and k distances in each
        closer = (lambda a, b: F.when(a["ds"] < b["ds"], -1).when(a["ds"] > b["ds"], 1).otherwise(0)) if self.keep else None
        best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*columns))), closer), 1, k).alias("best")
        return both.groupBy("_row").agg(best).select("_row", *[F.col(f"best.{c}").alias(c.removeprefix("k_")) for c in columns])


def k_nearest(query: DataFrame, reference: DataFrame, k: int, radius: float = float("inf"), keep: Sequence[str] = (), itself: bool = False) -> DataFrame:
    """``Index.nearest`` of a reference that is searched once."""
    return Index(reference, keep, itself).nearest(query, k, radius)
