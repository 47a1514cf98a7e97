"""Accuracy of poses, images and models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cameras, poses
from ..functions.linear import at, divide, dot, let, minus, norm, safe_acos, vec
from .ranges import with_ranks
from .selection import medians, quantiles

#: Images of a block of pairs.
PAIRED = 1000


def pose_auc(errors: DataFrame, thresholds: Sequence[float], column: str = "error") -> DataFrame:
    """threshold, auc: mean of max(0, 1 - error / threshold); 0 without errors.  One scan."""
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.avg(F.greatest(F.lit(0.0), 1 - F.col(column) / float(t))), F.lit(0.0)).alias("auc")) for t in thresholds])
    return errors.agg(each.alias("each")).select(F.explode("each").alias("x")).select("x.threshold", "x.auc")


def relative_pose_errors(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """name_i, name_j, rot_deg, trans_deg over pairs of images that both models have.

    ``estimate``, ``truth``: name, pose.  A pair without a baseline has a direction error of 180.
    Blocks of images meet as arrays; only a block's pairs are held at once."""
    both = estimate.filter("pose is not null").groupBy("name").agg(F.first("pose").alias("e")).join(truth.filter("pose is not null").groupBy("name").agg(F.first("pose").alias("t")), "name")
    kind = both.schema["name"].dataType.simpleString()
    flat = both.select("name", *[F.transform(F.col(f"{m}.{part}"), lambda x: x.cast("double")).alias(f"{m}{part}") for m in "et" for part in "Rt"])
    ranked = with_ranks(flat, ["name"], "k").withColumn("block", F.floor(F.col("k") / PAIRED))
    last = ranked.agg(F.max("block")).first()[0]
    others = lambda first, to: F.explode(F.sequence(first.cast("long"), to.cast("long")))
    side = lambda df: df.groupBy("i", "j")
    i = ranked.withColumnRenamed("block", "i").withColumn("j", others(F.col("i"), F.lit(last or 0)))
    j = ranked.select(*[F.col(c).alias("j" if c == "block" else c) for c in ranked.columns]).withColumn("i", others(F.lit(0), F.col("j")))
    return side(i).cogroup(side(j)).applyInArrow(_pose_errors, f"name_i {kind}, name_j {kind}, rot_deg double, trans_deg double")


def _pose_errors(left: pa.Table, right: pa.Table) -> pa.Table:
    """Errors of all pairs of two blocks, a few rows of the first at a time."""

    def read(table: pa.Table) -> tuple[np.ndarray, ...]:
        of = lambda c, w: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        er, et, tr, tt = of("eR", 9).reshape(-1, 3, 3), of("et", 3), of("tR", 9).reshape(-1, 3, 3), of("tt", 3)
        back = lambda m, v: np.einsum("nba,nb->na", m, v)
        # the trace of two relative rotations' product is the inner product of these
        return table.column("k").to_numpy(), er, et, tr, tt, np.einsum("nba,nbc->nac", er, tr).reshape(-1, 9), back(er, et), back(tr, tt)

    degrees = lambda c: np.degrees(np.arccos(np.fmax(-1.0, np.fmin(1.0, c))))
    (ki, *_, bi, ai, ci), (kj, er, et, tr, tt, bj, _, _) = read(left), read(right)
    rows, columns, rot, trans = [], [], [], []
    for s in range(0, len(ki), 64):
        r, c = np.nonzero(ki[s : s + 64, None] < kj[None])
        e = et[None] - np.einsum("jab,ib->ija", er, ai[s : s + 64])
        t = tt[None] - np.einsum("jab,ib->ija", tr, ci[s : s + 64])
        le, lt = np.sqrt((e * e).sum(2)), np.sqrt((t * t).sum(2))
        with np.errstate(all="ignore"):
            off = np.where((le < 1e-12) | (lt < 1e-12), 180.0, degrees((e * t).sum(2) / (le * lt)))
        rows.append(r + s)
        columns.append(c)
        rot.append(degrees((bi[s : s + 64] @ bj.T - 1) / 2)[r, c])
        trans.append(off[r, c])
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    name = lambda table, at: table.column("name").take(pa.array(join(at, np.int64)))
    return pa.table({"name_i": name(left, rows), "name_j": name(right, columns), "rot_deg": join(rot, float), "trans_deg": join(trans, float)})


def reprojection(observations: DataFrame, images: DataFrame, cams: DataFrame, points: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Residuals of all observations in registered images: point_id, image_id, kp_idx, z, error."""
    views = images.filter("pose is not null").join(F.broadcast(cams) if cams.count() <= 10_000 else cams, "camera_id").select("image_id", "pose", F.struct(*[F.col(c) for c in cameras.FIELDS]).alias("camera"))
    full = observations.join(views, "image_id").join(points.select("point_id", vec(F.col("x"), F.col("y"), F.col("z")).alias("p")), "point_id").join(keypoints.select("image_id", "kp_idx", "u", "v"), ["image_id", "kp_idx"])
    seen = full.withColumn("s", cameras.project(F.col("camera"), F.col("pose"), F.col("p")))
    return seen.select("point_id", "image_id", "kp_idx", F.col("s.z").alias("z"), F.hypot(at(F.col("s.uv"), 0) - F.col("u"), at(F.col("s.uv"), 1) - F.col("v")).alias("error"))


def rmse(residuals: DataFrame, column: str = "error") -> DataFrame:
    """One row: root mean square, 0 without rows."""
    return residuals.agg(F.coalesce(F.sqrt(F.avg(F.col(column) * F.col(column))), F.lit(0.0)).alias("rmse"))


def point_errors(residuals: DataFrame) -> DataFrame:
    return residuals.groupBy("point_id").agg(F.avg("error").alias("error"))


def psnr(error2: Column, max_value: float = 1.0) -> Column:
    """From squared differences, as an aggregate; infinite for equal images."""
    mse = F.avg(error2)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.try_divide(F.lit(max_value**2), mse)))


def trajectory_error(estimate: DataFrame, truth: DataFrame, with_scale: bool = True) -> DataFrame:
    """One row: rmse, median and largest distance of camera centers after the best alignment, and its scale."""
    from . import align

    both = estimate.filter("pose is not null").select("name", poses.center(F.col("pose")).alias("a")).join(truth.filter("pose is not null").select("name", poses.center(F.col("pose")).alias("b")), "name")
    pairs = both.select(*[at(F.col("a"), i).alias(f"s{c}") for i, c in enumerate("xyz")], *[at(F.col("b"), i).alias(f"d{c}") for i, c in enumerate("xyz")])
    s = align.umeyama(pairs, with_scale)
    moved = poses.similarity_point(s.s, align.matrix_column(s.R), align.vector_column(s.t), vec(F.col("sx"), F.col("sy"), F.col("sz")))
    e = pairs.select(norm(minus(moved, vec(F.col("dx"), F.col("dy"), F.col("dz")))).alias("e"))
    return medians(e, [], F.col("e"), "median", [F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.max("e").alias("max"), F.count("*").alias("n")]).withColumn("scale", F.lit(s.s))


def georef_summary(residuals: DataFrame) -> DataFrame:
    """One row of errors over de, dn, du."""
    h2 = F.col("de") ** 2 + F.col("dn") ** 2
    r2 = h2 + F.col("du") ** 2
    return residuals.agg(F.count("*").alias("num_images"), F.sqrt(F.avg(r2)).alias("rmse_3d"), F.sqrt(F.avg(h2)).alias("rmse_horizontal"), F.sqrt(F.avg(F.col("du") ** 2)).alias("rmse_vertical"), F.sqrt(F.max(r2)).alias("max_3d"))


def trend_slope(residuals: DataFrame) -> DataFrame:
    """One row: slope of the vertical residual over the distance from the block's center (null if all are as far)."""
    mid = residuals.agg(F.avg("e").alias("me"), F.avg("n").alias("mn"))
    far = residuals.crossJoin(F.broadcast(mid)).select("du", F.hypot(F.col("e") - F.col("me"), F.col("n") - F.col("mn")).alias("r"))  # one row
    return far.agg(F.when(F.max("r") - F.min("r") > 1e-9, F.regr_slope("du", "r")).alias("slope"))


def planar_r2(residuals: DataFrame) -> DataFrame:
    """axis, r2: how much of each residual a plane over (e, n) explains; 0 for a constant one.
    From centered moments, in two scans."""
    names = ("de", "dn", "du")
    mid = residuals.agg(*[F.avg(c).alias(f"m_{c}") for c in ("e", "n", *names)])
    c = residuals.crossJoin(F.broadcast(mid)).select(*[(F.col(v) - F.col(f"m_{v}")).alias(v) for v in ("e", "n", *names)])  # one row
    sums = [F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("e") * F.col("n")).alias("en"), F.sum(F.col("n") * F.col("n")).alias("nn")]
    for v in names:
        sums += [F.sum(F.col("e") * F.col(v)).alias(f"e_{v}"), F.sum(F.col("n") * F.col(v)).alias(f"n_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"s_{v}")]
    m = c.agg(*sums)
    det = F.col("ee") * F.col("nn") - F.col("en") ** 2

    def r2(v: str) -> Column:
        a, b, s = F.col(f"e_{v}"), F.col(f"n_{v}"), F.col(f"s_{v}")
        plane = (a * a * F.col("nn") - 2 * a * b * F.col("en") + b * b * F.col("ee")) / det
        line = F.when(F.col("ee") >= F.col("nn"), F.try_divide(a * a, F.col("ee"))).otherwise(F.try_divide(b * b, F.col("nn")))
        explained = F.when(det > 1e-12 * F.col("ee") * F.col("nn"), F.try_divide(plane * det, det)).otherwise(F.coalesce(line, F.lit(0.0)))
        return F.when(s > 1e-12, F.try_divide(explained, s)).otherwise(0.0)

    return m.select(F.explode(F.array(*[F.struct(F.lit(v).alias("axis"), r2(v).alias("r2")) for v in names])).alias("x")).select("x.axis", "x.r2")


def depth_ranges(depths: DataFrame, key: str = "image_id", least: int = 10) -> DataFrame:
    """key, lo, hi: 0.8 of the first and 1.25 of the 99th percentile of positive depths z, for
    views with enough points."""
    ranges = quantiles(depths, [key], F.when(F.col("z") > 0, F.col("z")), [0.01, 0.99], [F.count("*").alias("n")])
    return ranges.filter((F.col("n") >= least) & F.col("q").isNotNull()).select(key, (0.8 * F.get("q", F.lit(0))).alias("lo"), (1.25 * F.get("q", F.lit(1))).alias("hi"))


def ground_sampling_distance(depths: DataFrame, key: str = "image_id", least: int = 10) -> DataFrame:
    """One row: the median over views of the median positive depth over fx."""
    by = medians(depths, [key], F.when(F.col("z") > 0, F.col("z")), "mid", [F.count("*").alias("n"), F.first("fx").alias("fx")]).filter((F.col("n") >= least) & F.col("mid").isNotNull())
    return medians(by, [], F.col("mid") / F.col("fx"), "gsd")


def model_summary(cams: DataFrame, images: DataFrame, points: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: cameras, registered, images, points, mean track length."""
    one = lambda df, *a: df.agg(*a)
    out = one(cams, F.count("*").alias("cameras"))
    for part in (one(images, F.count("pose").alias("registered"), F.count("*").alias("images")), one(points, F.count("*").alias("points")), one(observations, F.count("*").alias("_o"))):
        out = out.crossJoin(part)  # single rows
    return out.withColumn("mean_track", F.coalesce(F.try_divide(F.col("_o"), F.col("points")), F.lit(0.0))).drop("_o")


def numbered_points(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Gives new points the ids after the largest existing one."""
    from .ranges import with_ranks

    start = existing.agg(F.coalesce(F.max("point_id"), F.lit(0)).alias("_top"))
    return with_ranks(new, order).crossJoin(F.broadcast(start)).withColumn("point_id", F.col("_top") + F.col("_rank") + 1).drop("_rank", "_top")  # one row


def max_ray_angle(observations: DataFrame) -> DataFrame:
    """point_id, angle: the largest angle between two rays to the point.  Rows: point_id, c
    (camera center), p (point)."""
    ray = let(minus(F.col("c"), F.col("p")), lambda r: let(norm(r), lambda n: vec(*[divide(at(r, i), n) for i in range(3)])))
    rays = observations.select("point_id", ray.alias("ray"))
    return rays.groupBy("point_id").agg(F.collect_list("ray").alias("rays")).select("point_id", F.degrees(safe_acos(F.array_min(F.flatten(F.transform("rays", lambda a: F.transform("rays", lambda b: dot(a, b))))))).alias("angle"))
