"""Incremental forms: voxel means over a stream of points, keyframes over a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spatial import AXES, cell


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """For update or complete mode: the state is one row of sums for each voxel."""
    return points.groupBy(*[cell(F.col(a), size).alias(f"v{a}") for a in AXES]).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in AXES])


def windowed_motion(frames: DataFrame, time: str, video: str, width: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Motion by time window with a watermark, for append mode."""
    return frames.withWatermark(time, late).groupBy(F.window(time, width), video).agg(F.sum("displacement").alias("motion"), F.count("*").alias("frames"))


def keyframes(frames: DataFrame, min_displacement: float) -> DataFrame:
    """video, frame_idx of frames at which the motion since the last one reaches the threshold.
    Frames of a video come in order; the state is the motion so far."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moved, first = state.get if state.exists else (0.0, True)
        picks = []
        for part in parts:
            for r in part.sort_values("frame_idx").itertuples():
                moved += 0.0 if first else float(r.displacement)
                if first or moved >= min_displacement:
                    picks.append(int(r.frame_idx))
                    moved, first = 0.0, False
        state.update((moved, first))
        yield pd.DataFrame({"video": [key[0]] * len(picks), "frame_idx": picks})

    return frames.select("video", "frame_idx", "displacement").groupBy("video").applyInPandasWithState(step, "video string, frame_idx long", "moved double, first boolean", "append", GroupStateTimeout.NoTimeout)
