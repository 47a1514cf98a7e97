"""Point clouds as ASCII PLY, and loading by suffix (PLY, LAS or Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import at
from . import records


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and, if the file has them, r, g, b.  Lines after the header are numbers only, the
    header's lines are not, so no line order is needed."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[-+]?(\d|\.\d|nan|inf)")).select(F.split(F.trim("value"), r"\s+").alias("t"))
    t = F.col("t")
    colours = [F.get(t, F.lit(i + 3)).cast("int").alias(c) for i, c in enumerate("rgb")]
    return lines.select(*[at(t, i).cast("double").alias(c) for i, c in enumerate("xyz")], *colours)


def ply_lines(cloud: DataFrame) -> tuple[str, DataFrame]:
    """Header and body.  Colours of a fractional type are scaled by 255 if none is over 1, then
    rounded half to even and clipped."""
    n = cloud.count()
    header = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
    parts = [F.format_string("%.6f %.6f %.6f", *[F.col(c).cast("double") for c in "xyz"])]
    if set("rgb") <= set(cloud.columns):
        header += [f"property uchar {c}" for c in ("red", "green", "blue")]
        fractional = any(dict(cloud.dtypes)[c] in ("double", "float") for c in "rgb")
        top = cloud.agg(F.max(F.greatest(*"rgb"))).first()[0] if fractional else None
        factor = 255.0 if fractional and top is not None and top <= 1 else 1.0
        parts += [F.least(F.lit(255), F.greatest(F.lit(0), F.bround(F.col(c) * factor).cast("int"))).cast("string") for c in "rgb"]
    return "\n".join([*header, "end_header"]), cloud.select(F.concat_ws(" ", *parts).alias("value"))


def write_ply(cloud: DataFrame, path: str) -> None:
    """A folder of text parts; the first is the header."""
    header, body = ply_lines(cloud)
    cloud.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).union(body).write.mode("overwrite").text(path)


def write_ply_file(cloud: DataFrame, path: str) -> None:
    header, body = ply_lines(cloud)
    with open(path, "w") as f:
        f.write(header + "\n")
        for r in body.toLocalIterator():
            f.write(r["value"] + "\n")


def load_points(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".ply"):
        return read_ply(spark, path)
    if path.endswith((".las", ".laz")):
        return records.read(spark, records.LasPoints, path)
    return spark.read.parquet(path)
