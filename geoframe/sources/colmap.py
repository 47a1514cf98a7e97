"""Models as text (cameras.txt, images.txt with two lines an image, points3D.txt) or binary (the same names, .bin)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cameras, poses
from ..functions.linear import at
from ..plans.model import Model
from . import records

HEADERS = {
    "cameras": "# CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]",
    "images": "# IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME\n# POINTS2D[] as (X, Y, POINT3D_ID)",
    "points3D": "# POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)",
}


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments, as token lists."""
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("t"))


def _numbers(tokens: Column, start: int) -> Column:
    return F.transform(F.slice(tokens, start, F.greatest(F.size(tokens) - start + 1, F.lit(0))), lambda v: v.cast("double"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    t = F.col("t")
    made = cameras.model_parameters(at(t, 1), at(t, 2).cast("int"), at(t, 3).cast("int"), _numbers(t, 5))
    return data_lines(spark, path).select(at(t, 0).cast("long").alias("camera_id"), made.alias("c")).select("camera_id", "c.*")


def _image_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file is one row, as a line of keypoints belongs to the line before."""
    for frame in frames:
        for content in frame["content"]:
            lines = [x for x in bytes(content).decode().splitlines() if not x.startswith("#")]
            rows = []
            for head, tail in zip(lines[::2], [*lines[1::2], *[""] * (len(lines) % 2)], strict=True):
                t = head.split()
                if t:
                    xy = np.array(tail.split(), float).reshape(-1, 3)
                    rows.append((int(t[0]), [float(v) for v in t[1:5]], [float(v) for v in t[5:8]], int(t[8]), " ".join(t[9:]), xy.tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "q", "t", "camera_id", "name", "xy"])


# Names and numbers of parameters of the binary format's camera models.
BINARY_MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8)}


class _Cursor:
    """Little-endian values of a file, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        found = struct.unpack_from(f"<{layout}", self.data, self.at)
        self.at += struct.calcsize(f"<{layout}")
        return found


def _binary_cameras(data: bytes) -> list[tuple]:
    c, rows = _Cursor(data), []
    for _ in range(c.take("Q")[0]):
        camera_id, model, width, height = c.take("iiQQ")
        if model not in BINARY_MODELS:
            raise ValueError(f"camera model number {model} isn't known")
        name, n = BINARY_MODELS[model]
        rows.append((camera_id, name, width, height, list(c.take(f"{n}d"))))
    return rows


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split("; ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(parse(bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema.replace("; ", ", "))


def _read_binary(spark: SparkSession, folder: str) -> Model:
    cams = _binary(spark, f"{folder}/cameras.bin", _binary_cameras, "camera_id long; model string; width int; height int; p array<double>")
    cams = cams.select("camera_id", cameras.model_parameters(F.col("model"), F.col("width"), F.col("height"), F.col("p")).alias("c")).select("camera_id", "c.*")
    raw = records.read(spark, records.ModelImages, f"{folder}/images.bin")
    images = raw.select("image_id", "camera_id", "name", poses.pose(poses.from_quaternion(F.col("q")), F.col("t")).alias("pose"))
    keypoints = raw.select("image_id", F.posexplode("spots").alias("kp_idx", "s")).select("image_id", F.col("kp_idx").cast("long").alias("kp_idx"), "s.u", "s.v", F.when(F.col("s.p") >= 0, F.col("s.p")).alias("point3d_id"))
    raw = records.read(spark, records.ModelPoints, f"{folder}/points3D.bin")
    observations = raw.select("point_id", F.explode("seen").alias("o")).select("point_id", "o.image_id", "o.kp_idx")
    return Model(cams, images, keypoints, raw.drop("seen"), observations)


def read_model(spark: SparkSession, folder: str) -> Model:
    """A text model or, where there is no cameras.txt but a cameras.bin, a binary one."""
    exists = lambda name: (path := spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if exists("cameras.bin") and not exists("cameras.txt"):
        return _read_binary(spark, folder)
    cams = read_cameras(spark, f"{folder}/cameras.txt")
    raw = spark.read.format("binaryFile").load(f"{folder}/images.txt").select("content").mapInPandas(_image_rows, "image_id long, q array<double>, t array<double>, camera_id long, name string, xy array<array<double>>")
    images = raw.select("image_id", "camera_id", "name", poses.pose(poses.from_quaternion(F.col("q")), F.col("t")).alias("pose"))
    keypoints = raw.select("image_id", F.posexplode("xy").alias("kp_idx", "p")).select("image_id", F.col("kp_idx").cast("long").alias("kp_idx"), at(F.col("p"), 0).alias("u"), at(F.col("p"), 1).alias("v"), F.when(at(F.col("p"), 2) >= 0, at(F.col("p"), 2).cast("long")).alias("point3d_id"))
    t = F.col("t")
    rows = data_lines(spark, f"{folder}/points3D.txt")
    value = lambda i: at(t, i).cast("double")
    points = rows.select(at(t, 0).cast("long").alias("point_id"), *[value(i + 1).alias(c) for i, c in enumerate("xyz")], *[at(t, i + 4).cast("short").alias(c) for i, c in enumerate("rgb")], value(7).alias("error"))
    tail = F.transform(F.slice(t, 9, F.greatest(F.size(t) - 8, F.lit(0))), lambda v: v.cast("long"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 9, F.lit(0))), lambda i: (i % 2 == 0) & (i + 9 < F.size(t))), lambda i: F.struct(F.get(F.col("tail"), i).alias("image_id"), F.get(F.col("tail"), i + 1).alias("kp_idx")))
    observations = rows.withColumn("tail", tail).select(at(t, 0).cast("long").alias("point_id"), F.explode(pairs).alias("o")).select("point_id", "o.image_id", "o.kp_idx")
    return Model(cams, images, keypoints, points, observations)


def _number(v: Column, digits: int = 12) -> Column:
    """Like %g: shortest decimal text with so many significant digits."""
    text = F.format_string(f"%.{digits - 1}e", v)
    return F.regexp_replace(text.cast("double").cast("string"), r"\.0$", "")


def model_lines(model: Model) -> dict[str, DataFrame]:
    """(key, line) of each file; only registered images, and points that one of them sees."""
    registered = model.images.filter("pose is not null")
    points = model.points
    points = points.withColumns({k: F.lit(128) for k in "rgb" if k not in points.columns} | ({} if "error" in points.columns else {"error": F.lit(0.0)}))
    c = F.struct(*[F.col(k) for k in cameras.FIELDS])
    cams = model.cameras.withColumn("m", cameras.model_of(c)).select(F.col("camera_id").alias("key"), F.concat_ws(" ", "camera_id", "m.model", "width", "height", F.array_join(F.transform("m.params", lambda v: _number(v)), " ")).alias("line"))
    q = registered.withColumn("q", poses.to_quaternion(F.col("pose.R")))
    head = q.select("image_id", F.concat_ws(" ", "image_id", F.array_join(F.transform(F.concat("q", "pose.t"), lambda v: _number(v)), " "), "camera_id", "name").alias("head"))
    spot = F.format_string("%.6f %.6f %d", "u", "v", F.coalesce("point3d_id", F.lit(-1)))
    kps = model.keypoints.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kp_idx", spot.alias("s")))), lambda x: x["s"]), " ").alias("tail"))
    images = head.join(kps, "image_id", "left").select(F.col("image_id").alias("key"), F.concat("head", F.lit("\n"), F.coalesce("tail", F.lit(""))).alias("line"))
    seen = model.observations.join(registered.select("image_id"), "image_id", "left_semi").groupBy("point_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "kp_idx"))), lambda x: F.concat_ws(" ", x["image_id"], x["kp_idx"])), " ").alias("track"))
    points = points.join(seen, "point_id").select(F.col("point_id").alias("key"), F.concat_ws(" ", "point_id", *[_number(F.col(a)) for a in "xyz"], "r", "g", "b", _number(F.coalesce("error", F.lit(0.0)), 6), "track").alias("line"))
    return {"cameras": cams, "images": images, "points3D": points}


def write_model(model: Model, folder: str) -> None:
    """Each file is a folder of text parts, ordered by id, with the header as its first part."""
    for name, lines in model_lines(model).items():
        head = lines.sparkSession.createDataFrame([(HEADERS[name],)], "value string")
        body = lines.repartitionByRange(lines.sparkSession.sparkContext.defaultParallelism, "key").sortWithinPartitions("key").select(F.col("line").alias("value"))
        head.coalesce(1).union(body).write.mode("overwrite").text(f"{folder}/{name}.txt")


def write_model_files(model: Model, folder: str) -> None:
    """Single local files, as other programs want them; rows stream through the driver."""
    import os

    os.makedirs(folder, exist_ok=True)
    for name, lines in model_lines(model).items():
        with open(f"{folder}/{name}.txt", "w") as f:
            f.write(HEADERS[name] + "\n")
            for r in lines.orderBy("key").toLocalIterator():
                f.write(r["line"] + "\n")
