"""Ordered frames: motion, keyframes, splits and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import flow
from .ranges import with_ranks


def displacement_to_previous(frames: DataFrame, video: str, order: list, value: Column) -> DataFrame:
    """Adds displacement, the absolute change of ``value`` from the frame before (null for the first)."""
    return frames.withColumn("displacement", F.abs(value - F.lag(value).over(Window.partitionBy(video).orderBy(*order))))


def first_frames(frames: DataFrame, video: str, order: list, n: int) -> DataFrame:
    """The first n frames of each video, as a limit on what is read."""
    return frames.withColumn("_k", F.row_number().over(Window.partitionBy(video).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def motion_threshold(frames: DataFrame, video: str, target: int) -> DataFrame:
    """Total motion of each video over the number of keyframes wanted."""
    return frames.groupBy(video).agg((F.sum("displacement") / target).alias("min_displacement"))


def pick_keyframes(sharpness: np.ndarray, displacement: np.ndarray, least: float, window: int) -> list[int]:
    """Keyframes of one short video by a scan; ``keyframes.select_keyframes`` gives those of tables.

    The sharpest of the first ``window`` frames; then again and again, from where the motion since
    the last pick reaches ``least``, the sharpest of the next ``window``; ties to the earliest."""
    n = len(sharpness)
    if not n:
        return []
    picks = [int(np.argmax(sharpness[:window]))]
    at, moved = picks[0], 0.0
    while at + 1 < n:
        moved += displacement[at]
        at += 1
        if moved >= least:
            at += int(np.argmax(sharpness[at : at + window]))
            picks.append(at)
            moved = 0.0
    return picks


def sharpness(gray: np.ndarray) -> float:
    """Variance of the five-point Laplacian, borders mirrored."""
    g = np.pad(np.asarray(gray, float), 1, mode="symmetric")
    return float(np.var(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]))


def tracked_displacement(images: DataFrame, video: str, order: str, most: int = flow.CORNERS) -> DataFrame:
    """video, order and displacement_to_next of frames (height, width, gray as 32-bit floats): the
    median shift of tracked corners, null for the last frame.  Only keys are ordered; images meet
    their successor in a join, and each pair is tracked by itself."""
    kinds = dict(images.dtypes)
    keys = images.select(video, order).withColumn("_next", F.lead(order).over(Window.partitionBy(video).orderBy(order)))
    pixels = ["height", "width", "gray"]
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in pixels]
    pairs = keys.join(images.select(video, order, *named("a")), [video, order]).join(images.select(F.col(video).alias("_video"), F.col(order).alias("_order"), *named("b")), F.col(video).eqNullSafe(F.col("_video")) & (F.col("_next") == F.col("_order")), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            image = lambda r, side: np.frombuffer(r[f"gray_{side}"], np.float32).reshape(int(r[f"height_{side}"]), int(r[f"width_{side}"]))
            found = [None if r["gray_b"] is None else flow.displacement(image(r, "a"), image(r, "b"), most) for r in f.to_dict("records")]
            yield pd.DataFrame({video: f[video], order: f[order], "displacement_to_next": pd.array(found, "Float64")})

    columns = [video, order, *(f"{c}_{s}" for s in "ab" for c in pixels)]
    return pairs.select(*columns).mapInPandas(run, f"{video} {kinds[video]}, {order} {kinds[order]}, displacement_to_next double")


def holdout_split(names: DataFrame, column: str, every: int = 8) -> DataFrame:
    """Adds is_test, true for every k-th row by name, from the first."""
    return with_ranks(names, [column]).withColumn("is_test", F.col("_rank") % every == 0).drop("_rank")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def largest(df: DataFrame, key: str, size: str, tie: str, n: int) -> DataFrame:
    """The n largest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(size), tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def initial_pair(pairs: DataFrame, min_angle: float = 4.0) -> DataFrame:
    """The pair to start from (image_a, image_b, n_inliers, median_angle_deg): the most inliers
    among wide pairs, higher ids first; else the largest product, lower ids first."""
    wide = F.col("median_angle_deg") >= min_angle
    product = F.col("n_inliers") * F.col("median_angle_deg")
    return pairs.orderBy(
        F.desc(wide), F.desc(F.when(wide, F.col("n_inliers"))), F.desc(F.when(wide, F.col("image_a"))), F.desc(F.when(wide, F.col("image_b"))),
        F.desc(product), "image_a", "image_b",
    ).limit(1)


def next_image(counts: DataFrame, least: int = 20) -> DataFrame:
    """The image with the most correspondences (image_id, n), at least ``least``; ties to the lowest id."""
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "image_id").limit(1)
