"""Dense depth and fusion: one view with its sources is a group; fused points are voxel means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cameras as cam_f
from ..functions import poses
from ..functions.linear import at, vec
from ..kernels import stereo
from ..kernels.rigid import Cam
from ..operators import matching, metrics, spatial
from ..operators.shared import cut
from .model import Model

TILE = "image_id long, height int, width int, depth binary, score binary"


@dataclass(frozen=True)
class Options:
    sources: int = 4
    hypotheses: int = 128
    window: int = 7
    min_score: float = 0.5
    min_consistent: int = 2
    fusion_neighbors: int = 8
    max_pixels: float = 1.0
    max_relative: float = 0.01
    voxel: float = 0.05  # 0 or less: auto_voxel times the ground sampling distance
    auto_voxel: float = 4.0


def view_depths(model: Model) -> DataFrame:
    """image_id, z, fx for every observation in a registered view."""
    views = model.images.filter("pose is not null").join(model.cameras, "camera_id").select("image_id", "pose", "fx")
    return model.observations.join(views, "image_id").join(model.points, "point_id").select("image_id", at(poses.apply(F.col("pose"), vec(F.col("x"), F.col("y"), F.col("z"))), 2).alias("z"), "fx")


def _tiles(images: DataFrame, rasters: DataFrame, cams: DataFrame) -> DataFrame:
    return _views(images, cams, rasters, "gray")


def _views(images: DataFrame, cams: DataFrame, rasters: DataFrame, data: str) -> DataFrame:
    """image_id and view: pose, camera, and the raster's own size and data."""
    posed = images.filter("pose is not null").join(cams, "camera_id").select("image_id", "pose", F.struct(*cam_f.FIELDS).alias("camera"))
    tiles = rasters.select("image_id", "height", "width", data)
    return posed.join(tiles, "image_id").select("image_id", F.struct("pose", "camera", "height", "width", data).alias("view"))


def _array(blob: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(blob, np.float32).reshape(h, w)


def _pose(p) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(p["R"]), float).reshape(3, 3), np.array(list(p["t"]), float)


def sweep(model: Model, rasters: DataFrame, neighbors: DataFrame, options: Options = Options()) -> DataFrame:
    """Depth and score tiles.  ``rasters``: image_id, height, width, gray (float32 bytes); views
    without sources or a depth range are left out.  Planes lie evenly in inverse depth."""
    tiles = _tiles(model.images, rasters, model.cameras)
    ranges = metrics.depth_ranges(view_depths(model))
    chosen = neighbors.filter(F.col("rank") <= options.sources).select("image_id", F.col("neighbor").alias("source"), "rank")
    sources = chosen.join(tiles.select(F.col("image_id").alias("source"), F.col("view").alias("other")), "source")
    grouped = sources.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("others"))
    jobs = tiles.join(ranges, "image_id").join(grouped, "image_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                v = r.view
                depths = 1 / np.linspace(1 / r.lo, 1 / r.hi, options.hypotheses)
                others = [(_array(o["other"]["gray"], o["other"]["height"], o["other"]["width"]), Cam.of(o["other"]["camera"]), _pose(o["other"]["pose"])) for o in r.others]
                depth, score = stereo.plane_sweep(_array(v["gray"], v["height"], v["width"]), Cam.of(v["camera"]), _pose(v["pose"]), others, depths, options.window)
                keep = (score > options.min_score) & (depth > r.lo * 1.001) & (depth < r.hi * 0.999)
                yield pd.DataFrame({"image_id": [r.image_id], "height": [v["height"]], "width": [v["width"]], "depth": [np.where(keep, depth, 0).astype(np.float32).tobytes()], "score": [score.astype(np.float32).tobytes()]})

    tasks = max(1, rasters.sparkSession.sparkContext.defaultParallelism)
    return jobs.repartition(tasks, "image_id").mapInPandas(run, TILE)


def fuse(depths: DataFrame, images: DataFrame, cams: DataFrame, neighbors: DataFrame, options: Options = Options()) -> DataFrame:
    """image_id, row, col, x, y, z of pixels that enough neighbours confirm.  ``depths``: tiles."""
    tiles = _views(images, cams, depths, "depth")
    chosen = neighbors.filter(F.col("rank") <= options.fusion_neighbors).select("image_id", F.col("neighbor").alias("source"))
    others = chosen.join(tiles.select(F.col("image_id").alias("source"), F.col("view").alias("other")), "source").groupBy("image_id").agg(F.collect_list("other").alias("others"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                read = lambda v: (_array(v["depth"], v["height"], v["width"]), Cam.of(v["camera"]), _pose(v["pose"]))
                depth, cam, pose = read(r.view)
                count = stereo.agreeing_views(depth, cam, pose, [read(o) for o in r.others], options.max_pixels, options.max_relative)
                x, flat = stereo.back_project(np.where(count >= options.min_consistent, depth, 0), cam, pose)
                yield pd.DataFrame({"image_id": r.image_id, "row": flat // depth.shape[1], "col": flat % depth.shape[1], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    tasks = max(1, depths.sparkSession.sparkContext.defaultParallelism)
    return tiles.join(others, "image_id").repartition(tasks, "image_id").mapInPandas(run, "image_id long, row long, col long, x double, y double, z double")


def consistent_pixels(depths: DataFrame, images: DataFrame, cams: DataFrame, neighbors: DataFrame, least: int = 1, max_pixels: float = 1.0, max_relative: float = 0.01) -> DataFrame:
    """The same check in relational form over pixel rows (image_id, row, col, z): image_id, row,
    col, n.  A pixel's point is looked up in its neighbours by image, row and column."""
    c = F.struct(*[F.col(k) for k in cam_f.FIELDS])
    views = images.filter("pose is not null").join(cams, "camera_id").select("image_id", "pose", c.alias("camera"))
    lit = depths.filter("z > 0").join(views, "image_id")
    here = lambda: vec(F.col("col") + 0.5, F.col("row") + 0.5)
    ref = lit.withColumn("p", cam_f.unproject(F.col("camera"), F.col("pose"), here(), F.col("z"))).select("image_id", "row", "col", "z", "pose", "camera", "p")
    src = views.select(F.col("image_id").alias("neighbor"), F.col("pose").alias("pose_s"), F.col("camera").alias("camera_s"))
    pairs = ref.join(neighbors.select("image_id", "neighbor"), "image_id").join(src, "neighbor").withColumn("s", cam_f.project(F.col("camera_s"), F.col("pose_s"), F.col("p"))).filter("s.z > 0")
    pixel = lambda i: F.floor(at(F.col("s.uv"), i)).cast("long")
    look = depths.filter("z > 0").select(F.col("image_id").alias("neighbor"), F.col("row").cast("long").alias("row_s"), F.col("col").cast("long").alias("col_s"), F.col("z").alias("z_s"))
    hit = pairs.withColumns({"row_s": pixel(1), "col_s": pixel(0)}).join(look, ["neighbor", "row_s", "col_s"])
    back = cam_f.unproject(F.col("camera_s"), F.col("pose_s"), vec(F.col("col_s") + 0.5, F.col("row_s") + 0.5), F.col("z_s"))
    again = hit.withColumn("b", back).withColumn("q", cam_f.project(F.col("camera"), F.col("pose"), F.col("b")))
    good = (F.hypot(at(F.col("q.uv"), 0) - F.col("col") - 0.5, at(F.col("q.uv"), 1) - F.col("row") - 0.5) < max_pixels) & (F.abs(F.col("q.z") - F.col("z")) / F.col("z") < max_relative)
    return again.filter(good).groupBy("image_id", "row", "col").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def dense(model: Model, rasters: DataFrame, options: Options = Options(), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(depth tiles, fused cloud).  ``known``: tiles of an earlier run, which aren't swept again."""
    size = options.voxel
    if size <= 0:
        gsd = metrics.ground_sampling_distance(view_depths(model)).first()["gsd"]
        if gsd is None:
            raise ValueError("no view has enough points for the ground sampling distance")
        size = options.auto_voxel * gsd
    neighbors = cut(matching.view_neighbors(model.observations, model.points, model.images, max(options.sources, options.fusion_neighbors)))
    if known is None:
        tiles = cut(sweep(model, rasters, neighbors, options))
    else:
        todo = model.with_(images=model.images)
        fresh = sweep(todo, rasters, neighbors.join(known.select("image_id"), "image_id", "left_anti"), options)
        tiles = cut(known.unionByName(fresh))
    return tiles, spatial.voxel_downsample(fuse(tiles, model.images, model.cameras, neighbors, options), size)
