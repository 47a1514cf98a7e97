"""Generated scenes with known truth: trajectories, terrain, projections and rendered slabs.
Random numbers are hashes of ids, so rows don't depend on partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cameras, poses
from .functions.linear import at, const, vec


def uniform(seed: int, *ids: str) -> Column:
    """In (0, 1), from a hash of the ids."""
    return (F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 52).cast("long")).cast("double") + 0.5) / float(1 << 52)


def gauss(seed: int, *ids: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(2 * seed + 1, *ids))) * F.cos(2 * math.pi * uniform(2 * seed + 2, *ids))


def default_camera(spark: SparkSession, width: int = 640, height: int = 480, degrees: float = 70.0, camera_id: int = 1) -> DataFrame:
    return spark.range(1).select(F.lit(camera_id).cast("long").alias("camera_id"), cameras.from_fov(width, height, degrees).alias("c")).select("camera_id", "c.*")


def _images(df: DataFrame) -> DataFrame:
    return df.select(F.col("image_id"), F.lit(1).cast("long").alias("camera_id"), F.format_string("view_%04d.png", "image_id").alias("name"), "pose")


def orbit(spark: SparkSession, n: int, radius: float = 60.0, altitude: float = 40.0, target: tuple = (0.0, 0.0, 0.0), arc: float = 360.0) -> DataFrame:
    """n views on a circle that look at the target; a part of a circle has its end included."""
    step = math.radians(arc) / (n if arc >= 360 else max(1, n - 1))
    a = F.col("id") * step
    eye = vec(target[0] + radius * F.cos(a), target[1] + radius * F.sin(a), target[2] + altitude)
    return _images(spark.range(n).select((F.col("id") + 1).alias("image_id"), poses.look_at(eye, const(target), const((0, 0, 1))).alias("pose")))


def survey(spark: SparkSession, rows: int, cols: int, spacing: float, altitude: float, pitch: float = -90.0) -> DataFrame:
    """Serpentine grid about the origin, all views headed north with the given pitch."""
    row = F.floor(F.col("id") / cols)
    col = F.when(row % 2 == 0, F.col("id") % cols).otherwise(cols - 1 - F.col("id") % cols)
    x, y = (col - (cols - 1) / 2) * spacing, (row - (rows - 1) / 2) * spacing
    ahead = (0.0, math.cos(math.radians(pitch)), math.sin(math.radians(pitch)))
    eye = vec(x, y, altitude)
    aim = vec(x, y + ahead[1], altitude + ahead[2])
    return _images(spark.range(rows * cols).select((F.col("id") + 1).alias("image_id"), poses.look_at(eye, aim, const((0, 0, 1))).alias("pose")))


def terrain_height(x: Column, y: Column, relief: float, extent: float) -> Column:
    return relief * (F.sin(2 * math.pi * x / extent) * F.cos(2 * math.pi * y / extent))


def terrain(spark: SparkSession, n: int = 1500, extent: float = 40.0, relief: float = 2.0, buildings: int = 4, per_building: int = 150, seed: int = 0) -> DataFrame:
    """Ground points over a square, and box-shaped buildings with points on roof and walls."""
    x, y = ((uniform(seed + i, "id") - 0.5) * extent for i in (1, 2))
    ground = spark.range(n).select("id", x.alias("x"), y.alias("y")).select("id", "x", "y", terrain_height(F.col("x"), F.col("y"), relief, extent).alias("z"))
    total = buildings * per_building
    b = spark.range(n, n + total).withColumn("b", F.floor((F.col("id") - n) / per_building))
    b = b.select("id", ((uniform(seed + 3, "b") - 0.5) * extent * 0.7).alias("bx"), ((uniform(seed + 4, "b") - 0.5) * extent * 0.7).alias("by"), (3 + 5 * uniform(seed + 5, "b")).alias("w"), (3 + 6 * uniform(seed + 6, "b")).alias("h"), uniform(seed + 7, "id").alias("u"), uniform(seed + 8, "id").alias("v"), F.floor(5 * uniform(seed + 9, "id")).alias("side"))
    half = F.col("w") / 2
    across, up = (F.col("u") - 0.5) * F.col("w"), F.col("v") * F.col("h")
    place = lambda roof, east, west, north, south: F.when(F.col("side") == 0, roof).when(F.col("side") == 1, east).when(F.col("side") == 2, west).when(F.col("side") == 3, north).otherwise(south)
    walls = b.select("id", (F.col("bx") + place(across, half, -half, across, across)).alias("x"), (F.col("by") + place((F.col("v") - 0.5) * F.col("w"), across, across, half, -half)).alias("y"), place(F.col("h"), up, up, up, up).alias("z"))
    return ground.union(walls).select((F.col("id") + 1).alias("point_id"), "x", "y", "z") if total else ground.select((F.col("id") + 1).alias("point_id"), "x", "y", "z")


def scene(images: DataFrame, cams: DataFrame, points: DataFrame, noise: float = 0.0, min_track: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(keypoints, observations): every point in every view that sees it.  Keypoints are numbered
    in hashed order within their image."""
    views = images.join(F.broadcast(cams) if cams.count() <= 10_000 else cams, "camera_id").select("image_id", "pose", F.struct(*[F.col(c) for c in cameras.FIELDS]).alias("camera"))
    # views are few next to points: every point meets every view, which is the task itself
    both = points.select("point_id", vec(F.col("x"), F.col("y"), F.col("z")).alias("p")).crossJoin(views).withColumn("s", cameras.project(F.col("camera"), F.col("pose"), F.col("p")))
    u, v = at(F.col("s.uv"), 0), at(F.col("s.uv"), 1)
    seen = both.filter((F.col("s.z") > 0.1) & (u >= 0) & (u < F.col("camera.width")) & (v >= 0) & (v < F.col("camera.height"))).select("image_id", "point_id", u.alias("u"), v.alias("v"))
    kept = seen.groupBy("point_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_track).select("point_id")
    seen = seen.join(kept, "point_id")
    order = Window.partitionBy("image_id").orderBy(F.xxhash64("image_id", "point_id", F.lit(seed)), "point_id")
    off = lambda c, k: F.col(c) + (noise * gauss(seed + k, "image_id", "point_id") if noise else F.lit(0.0))
    keypoints = seen.select("image_id", (F.row_number().over(order) - 1).cast("long").alias("kp_idx"), off("u", 11).alias("u"), off("v", 12).alias("v"), F.col("point_id").alias("point3d_id"))
    return keypoints, keypoints.select(F.col("point3d_id").alias("point_id"), "image_id", "kp_idx")


def texture(x: np.ndarray, y: np.ndarray, z: float) -> np.ndarray:
    """A gray pattern with detail at several scales, different at each height."""
    return 0.5 + sum(w * np.sin(f * x + p + z) * np.cos(f * y * 1.13 - p + z) for f, w, p in ((0.9, 0.16, 0.3), (2.3, 0.14, 1.1), (5.1, 0.1, 2.0), (9.7, 0.08, 0.7)))


def render(cam, pose: tuple[np.ndarray, np.ndarray], slabs: list[tuple[float, float, float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(gray, depth) of the ground z = 0 and of level slabs (xmin, xmax, ymin, ymax, z); the nearest hit wins."""
    from .kernels.rigid import Cam, undistorted
    from .kernels.stereo import centers

    c = Cam.of(cam)
    x, y = centers(c.height, c.width)
    rays = np.concatenate([undistorted(c, np.stack([x, y], -1)), np.ones((c.height, c.width, 1))], -1) @ pose[0]
    eye = -pose[0].T @ pose[1]
    gray, depth = np.zeros(x.shape), np.full(x.shape, np.inf)
    for x0, x1, y0, y1, z in [(-np.inf, np.inf, -np.inf, np.inf, 0.0), *slabs]:
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (z - eye[2]) / rays[..., 2]
        hit = eye + s[..., None] * rays
        inside = (s > 0) & (s < depth) & (hit[..., 0] >= x0) & (hit[..., 0] <= x1) & (hit[..., 1] >= y0) & (hit[..., 1] <= y1)
        gray = np.where(inside, texture(hit[..., 0], hit[..., 1], z), gray)
        depth = np.where(inside, s, depth)
    return gray.astype(np.float32), np.where(np.isfinite(depth), depth, 0).astype(np.float32)
