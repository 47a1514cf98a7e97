"""Image pairs, descriptor matching, and views that share points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poses
from ..functions.cameras import root_sift
from ..functions.linear import at
from . import pivots
from .ranges import every_pair
from .shared import cut

#: Distances in one matrix product of the matching kernel.
TILE = 1 << 22
#: Descriptors of a tile of an image.
ROWS = 8192
#: Pairs of images up to which their table is broadcast.
TOLD = 100_000
#: Angles that a task holds before it sends them, and angles of a bucket.
ANGLES, BUCKET = 1 << 20, 2_000_000


def image_pairs(images: DataFrame, band: int = 0) -> DataFrame:
    """Pairs a < b of image_id, with b - a <= band if it isn't 0.  A band is joined by equal
    blocks of ids, each block with itself and the next."""
    ids = images.select(F.col("image_id").cast("long").alias("image_a"))
    if not band:
        return every_pair(ids, ids.withColumnRenamed("image_a", "image_b")).filter("image_a < image_b")
    left = ids.withColumn("block", F.floor(F.col("image_a") / band))
    right = ids.select(F.col("image_a").alias("image_b")).withColumn("block", F.explode(F.array(F.floor(F.col("image_b") / band), F.floor(F.col("image_b") / band) - 1)))
    return left.join(right, "block").filter((F.col("image_a") < F.col("image_b")) & (F.col("image_b") - F.col("image_a") <= band)).select("image_a", "image_b").distinct()


def rooted(descriptors: DataFrame) -> DataFrame:
    return descriptors.withColumn("vec", root_sift(F.col("vec")))


def _top_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest row of b for each row of a, and the two smallest distances; ties to the first."""
    near, first, second = (np.empty(len(a), k) for k in (np.int64, float, float))
    for s in range(0, len(a), max(1, TILE // len(b))):
        part = slice(s, s + max(1, TILE // len(b)))
        d2 = (a[part] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * a[part] @ b.T
        d = np.sqrt(np.maximum(np.where(np.isnan(d2), np.inf, d2), 0))
        k = d.argmin(axis=1)
        row = np.arange(len(k))
        near[part], first[part] = k, d[row, k]
        d[row, k] = np.inf
        second[part] = d.min(axis=1)
    return near, first, second


def match_kernel(a: np.ndarray, b: np.ndarray, ratio: float, mutual: bool) -> np.ndarray:
    """Index pairs by the ratio test, mutual if asked; none if a is empty or b has under two rows."""
    if not len(a) or len(b) < 2:
        return np.zeros((0, 2), np.int64)
    near, first, second = _top_two(a, b)
    keep = first < ratio * second
    if mutual:
        back = _top_two(b, a)[0]
        keep &= back[near] == np.arange(len(a))
    return np.column_stack([np.flatnonzero(keep), near[keep]])


def match_descriptors(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.8, mutual: bool = True) -> DataFrame:
    """image_a, image_b, kp_a, kp_b.  ``descriptors``: image_id, kp_idx, vec; ``pairs``: image_a,
    image_b, of which each counts once.

    Images are dealt into tiles of about ROWS descriptors, and two tiles are a task's group, so a task's
    memory doesn't grow with an image.  Each descriptor's two nearest of every tile are then merged."""
    rows = descriptors.filter("vec is not null").select(F.col("image_id").cast("long").alias("image"), F.col("kp_idx").cast("long").alias("idx"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = rows.groupBy("image").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    sized = pairs.select(*[F.col(f"image_{s}").cast("long").alias(f"image_{s}") for s in "ab"]).distinct()
    for s in "ab":
        sized = sized.join(parts.select(F.col("image").alias(f"image_{s}"), F.col("parts").alias(f"parts_{s}")), f"image_{s}")
    keys = ["image_a", "image_b", "tile_a", "tile_b"]
    tasks = descriptors.sparkSession.sparkContext.defaultParallelism * 4

    def side(s: str, other: str) -> DataFrame:
        met = rows.join(sized, F.col("image") == F.col(f"image_{s}"))
        tile = F.pmod(F.xxhash64("row"), F.col(f"parts_{s}")).cast("int").alias(f"tile_{s}")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(f"tile_{other}")
        return met.select("image_a", "image_b", tile, copies, "idx", "row", "vec").select(*[F.col(c).alias(c) for c in (*keys, "idx", "row", "vec")]).repartition(tasks, *keys)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table([pa.array([], f.type) for f in _NEAREST], schema=_NEAREST)
        image_a, image_b = a.column("image_a")[0].as_py(), a.column("image_b")[0].as_py()
        ends = []
        for t in (a, b):
            idx, row = t.column("idx").to_numpy(), t.column("row").to_numpy()
            order = np.lexsort((row, idx))
            ends.append((idx[order], row[order], pivots.matrix(t.column("vec"))[order]))
        out = []
        for back, (idx, row, v), (far_idx, far_row, w) in [(False, *ends), (True, *ends[::-1])][: 2 if mutual else 1]:
            near, first, second = _top_two(v, w)
            n = len(v)
            out.append(pa.table([np.full(n, image_a), np.full(n, image_b), np.full(n, back), row, idx, first, far_idx[near], far_row[near], second], schema=_NEAREST))
        return pa.concat_tables(out)

    found = cut(side("a", "b").groupBy(*keys).cogroup(side("b", "a").groupBy(*keys)).applyInArrow(run, "image_a long, image_b long, back boolean, own long, kp long, d double, near_kp long, near long, second double"))
    best = found.groupBy("image_a", "image_b", "back", "own", "kp").agg(F.min(F.struct("d", "near_kp", "near")).alias("best"), F.array_sort(F.flatten(F.collect_list(F.array("d", "second")))).getItem(1).alias("second"))
    # an image of a single descriptor has no second
    one = best.filter(~F.col("back") & (F.col("second") < float("inf")) & (F.col("best.d") < ratio * F.col("second")))
    one = one.select("image_a", "image_b", F.col("kp").alias("kp_a"), F.col("best.near_kp").alias("kp_b"), "own", F.col("best.near").alias("near"))
    if mutual:
        one = one.join(best.filter("back").select("image_a", "image_b", F.col("best.near").alias("own"), F.col("own").alias("near")), ["image_a", "image_b", "own", "near"])
    return one.select("image_a", "image_b", "kp_a", "kp_b")


_NEAREST = pa.schema([("image_a", pa.int64()), ("image_b", pa.int64()), ("back", pa.bool_()), ("own", pa.int64()), ("kp", pa.int64()), ("d", pa.float64()), ("near_kp", pa.int64()), ("near", pa.int64()), ("second", pa.float64())])


def match_sets(a: DataFrame, b: DataFrame, ratio: float = 0.8, mutual: bool = True) -> DataFrame:
    """The same for two descriptor tables (idx, vec) of any size: i, j.

    Pivots bound which blocks of rows have to be compared; no pair of rows is ever a row of a table."""
    two = pivots.k_nearest(a, b, 2)
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    one = two.filter(first["d"] < ratio * second["d"]).select(F.col("own").alias("i"), first["near"].alias("j"))
    if not mutual:
        return one
    return one.join(pivots.k_nearest(b, a, 1).select(F.col("own").alias("j"), first["near"].alias("i")), ["i", "j"])


def shared_points(keypoints: DataFrame, a: int, b: int) -> DataFrame:
    """kp_a, kp_b, point3d_id that two images observe; keypoints without a point don't join."""
    side = lambda i, s: keypoints.filter(F.col("image_id") == i).select("point3d_id", F.col("kp_idx").alias(f"kp_{s}"))
    return side(a, "a").join(side(b, "b"), "point3d_id")


def simulated_matches(keypoints: DataFrame, pairs: DataFrame, outliers: float = 0.0, least: int = 20, seed: int = 0) -> DataFrame:
    """True matches of each pair (shared points) and wrong ones in the given share, drawn by hashes.
    Pairs with fewer true matches are left out."""
    seen = keypoints.filter("point3d_id is not null").select("image_id", "kp_idx", "point3d_id")
    a, b = (seen.select(F.col("image_id").alias(f"image_{s}"), F.col("kp_idx").alias(f"kp_{s}"), "point3d_id") for s in "ab")
    # few pairs have many matches each: these stay where they are
    told = F.broadcast if pairs.count() <= TOLD else lambda df: df
    true = a.join(b, "point3d_id").join(told(pairs.select("image_a", "image_b")), ["image_a", "image_b"])
    sized = true.groupBy("image_a", "image_b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    true = true.join(told(sized.select("image_a", "image_b")), ["image_a", "image_b"]).select("image_a", "image_b", "kp_a", "kp_b")
    if not outliers:
        return true
    counts = keypoints.groupBy("image_id").agg(F.count("*").alias("m"))
    wrong = sized.withColumn("k", F.explode(F.sequence(F.lit(1), F.round(F.col("n") * outliers / (1 - outliers)).cast("int"))))
    for s in "ab":
        wrong = wrong.join(counts.select(F.col("image_id").alias(f"image_{s}"), F.col("m").alias(f"m_{s}")), f"image_{s}")
    draw = lambda s, salt: F.pmod(F.xxhash64("image_a", "image_b", "k", F.lit(seed), F.lit(salt)), F.col(f"m_{s}")).alias(f"kp_{s}")
    return true.unionByName(wrong.select("image_a", "image_b", draw("a", 1), draw("b", 2))).distinct()


def view_neighbors(observations: DataFrame, points: DataFrame, images: DataFrame, k: int, min_angle: float = 1.0, least: int = 10) -> DataFrame:
    """For each view its k best others: image_id, neighbor, rank, shared, angle, score.

    score: shared points times min(1, median angle / 5 degrees).  ``observations``: point_id,
    image_id; ``points``: point_id, x, y, z; ``images``: image_id (once each), pose.  A point's views
    are shuffled once, as a set; the views' centers (three numbers a view) are told by broadcast.  Pairs
    of views are never rows: tasks send their angles in arrays, sorted by pair, to buckets of pairs."""
    spark, kind = observations.sparkSession, observations.schema["image_id"].dataType
    center = images.filter("pose is not null").select(F.col("image_id").cast("long").alias("image_id"), poses.center(F.col("pose")).alias("c"))
    told = center.select("image_id", *[at(F.col("c"), i).alias(a) for i, a in enumerate("xyz")]).orderBy("image_id").toArrow()
    ids, n = told.column("image_id").to_numpy(), told.num_rows
    if not n:
        return top(spark.createDataFrame([], _SCORED), "image_id", ["neighbor"], k).withColumns({c: F.col(c).cast(kind) for c in ("image_id", "neighbor")})
    m = observations.groupBy("point_id").agg(F.count("*").cast("double").alias("m"))
    pairs = m.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    buckets = int(max(1, min(cores, pairs // 10_000), pairs // BUCKET))
    tasks = max(min(4 * cores, buckets), buckets // 4)
    views = spark.sparkContext.broadcast((ids, np.stack([told.column(a).to_numpy() for a in "xyz"], 1), np.all([told.column(a).is_valid() for a in "xyz"], axis=0)))
    # the number is given, as sets are small against the pairs in them
    seen = observations.repartition(tasks, "point_id").groupBy("point_id").agg(F.collect_set(F.col("image_id").cast("long")).alias("images")).filter(F.size("images") > 1)
    seen = seen.join(points.select("point_id", "x", "y", "z"), "point_id").select("images", *[F.col(a).cast("double").alias(a) for a in "xyz"])
    sent = seen.mapInArrow(_angles(views, buckets), "bucket int, own binary, other binary, angle binary")

    def run(chunks: pa.Table) -> pa.Table:
        own, other, angle = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in chunks.column(c)]) for c, t in (("own", np.int32), ("other", np.int32), ("angle", float)))
        key = own.astype(np.int64) * n + other
        order = np.lexsort((angle, key))  # missing angles last
        key, angle = key[order], angle[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        shared = np.diff(np.r_[start, len(key)])
        known = np.add.reduceat((~np.isnan(angle)).astype(np.int64), start)
        middle = (angle[start + np.maximum(known - 1, 0) // 2] + angle[np.minimum(start + known // 2, start + shared - 1)]) / 2
        keep = (shared >= least) & (known > 0) & (middle >= min_angle)
        a, b, shared, middle = ids[key[start[keep]] // n], ids[key[start[keep]] % n], shared[keep], middle[keep]
        return pa.table([pa.array(np.r_[a, b]), pa.array(np.r_[b, a]), pa.array(np.r_[shared, shared]), pa.array(np.r_[middle, middle])], ["image_id", "neighbor", "shared", "angle"])

    scored = sent.groupBy("bucket").applyInArrow(run, _SCORED).withColumn("score", F.col("shared") * F.least(F.lit(1.0), F.col("angle") / 5))
    scored = scored.withColumns({c: F.col(c).cast(kind) for c in ("image_id", "neighbor")})
    return top(scored, "image_id", [F.desc("score"), F.desc("neighbor")], k)


_SCORED = "image_id long, neighbor long, shared long, angle double"


def _angles(views: Broadcast, buckets: int):
    """All pairs of views of each point, in arrays by buckets: the pair's own view (the smaller one if
    their sum is even), the other, and the angle in degrees (missing if a ray has no direction)."""

    def sent(own: np.ndarray, other: np.ndarray, angle: np.ndarray, n: int) -> pa.RecordBatch:
        key = own.astype(np.int64) * n + other
        order = np.argsort(key)
        own, other, angle = own[order], other[order], angle[order]
        bucket = np.minimum((key[order] / (n * n) * buckets).astype(np.int32), buckets - 1)
        ends = np.r_[np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        starts = np.r_[0, ends[:-1]]
        blobs = [pa.array([c[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()) for c in (own, other, angle)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *blobs], ["bucket", "own", "other", "angle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centers, known = views.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            lists = batch.column("images")
            image, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            view = np.minimum(np.searchsorted(ids, image), len(ids) - 1)
            there = ids[view] == image
            view, row = view[there].astype(np.int32), row[there]
            point = np.stack([batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"], 1)
            placed = np.all([batch.column(a).is_valid() for a in "xyz"], axis=0)
            ray = centers[view] - point[row]
            length = np.sqrt(ray[:, 0] * ray[:, 0] + ray[:, 1] * ray[:, 1] + ray[:, 2] * ray[:, 2])
            good = known[view] & placed[row] & (length != 0)
            ray = ray / np.where(length != 0, length, 1.0)[:, None]
            # each ray with those after it of the same point
            later = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1
            ahead = np.r_[0, later.cumsum()]
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(ahead, ahead[begin] + ANGLES // 4, "right")) - 1)
                a = np.repeat(np.arange(begin, end), later[begin:end])
                b = a + 1 + np.arange(len(a)) - (ahead[a] - ahead[begin])
                p, q = ray[a], ray[b]
                cosine = p[:, 0] * q[:, 0] + p[:, 1] * q[:, 1] + p[:, 2] * q[:, 2]
                cosine = np.where(np.isnan(cosine), 1.0, np.clip(cosine, -1.0, 1.0))
                angle = np.where(good[a] & good[b], np.degrees(np.arccos(cosine)), np.nan)
                low, high = np.minimum(view[a], view[b]), np.maximum(view[a], view[b])
                even = (low + high) % 2 == 0
                held.append((np.where(even, low, high), np.where(even, high, low), angle))
                size += len(a)
                begin = end
                if size >= ANGLES:
                    yield sent(*map(np.concatenate, zip(*held, strict=True)), len(ids))
                    held, size = [], 0
        if size:
            yield sent(*map(np.concatenate, zip(*held, strict=True)), len(ids))

    return run


def top(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)
