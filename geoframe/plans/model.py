"""A reconstruction as five tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

POSE = "struct<R:array<double>,t:array<double>>"
CAMERAS = "camera_id long, width int, height int, fx double, fy double, cx double, cy double, k1 double, k2 double"
IMAGES = f"image_id long, camera_id long, name string, pose {POSE}"
KEYPOINTS = "image_id long, kp_idx long, u double, v double, point3d_id long"
POINTS = "point_id long, x double, y double, z double, r short, g short, b short, error double"
OBSERVATIONS = "point_id long, image_id long, kp_idx long"


@dataclass(frozen=True)
class Model:
    """An image without a pose isn't registered; a keypoint without a point has a null point3d_id."""

    cameras: DataFrame
    images: DataFrame
    keypoints: DataFrame
    points: DataFrame
    observations: DataFrame

    def with_(self, **tables: DataFrame) -> Model:
        return replace(self, **tables)
