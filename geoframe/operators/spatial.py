"""Voxels, grid joins and nearest neighbours of point clouds (columns x, y, z)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbors import AXES, Index, k_nearest
from .selection import medians
from .shared import cut


def cell(value: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((value - origin) / size).cast("long")


def voxel_downsample(cloud: DataFrame, size: float, means: Sequence[str] = AXES) -> DataFrame:
    """Mean of each voxel's points (and of the other columns named), with its index and count.
    One partial and one final hash aggregate; keys are three columns, so any range works."""
    keys = [cell(F.col(a), size).alias(f"v{a}") for a in AXES]
    return cloud.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means])


def occupied(cloud: DataFrame, size: float, origin: tuple[float, float]) -> DataFrame:
    return cloud.select(cell(F.col("x"), size, origin[0]).alias("cx"), cell(F.col("y"), size, origin[1]).alias("cy")).distinct()


def corner(*clouds: DataFrame) -> tuple[float, float]:
    """Smallest x and y over the clouds."""
    rows = [c.agg(F.min("x"), F.min("y")).first() for c in clouds]
    xs, ys = [r[0] for r in rows if r[0] is not None], [r[1] for r in rows if r[1] is not None]
    return (float(min(xs)), float(min(ys))) if xs else (0.0, 0.0)


def footprint_crop(points: DataFrame, reference: DataFrame, size: float = 1.0) -> DataFrame:
    """Points in ground cells that the reference occupies."""
    origin = corner(reference)
    placed = points.withColumns({"cx": cell(F.col("x"), size, origin[0]), "cy": cell(F.col("y"), size, origin[1])})
    return placed.join(occupied(reference, size, origin), ["cx", "cy"], "left_semi").drop("cx", "cy")


def vertical_offset(points: DataFrame, reference: DataFrame, size: float = 1.0) -> DataFrame:
    """One row: the median over shared ground cells of the difference of median heights (NaN if none)."""
    origin = corner(points, reference)

    def heights(cloud: DataFrame, name: str) -> DataFrame:
        return medians(cloud.select(cell(F.col("x"), size, origin[0]).alias("cx"), cell(F.col("y"), size, origin[1]).alias("cy"), "z"), ["cx", "cy"], F.col("z"), name)

    both = cut(heights(points, "a").join(heights(reference, "b"), ["cx", "cy"]))
    return medians(both, [], F.col("a") - F.col("b"), "dz", [F.count("*").alias("cells")]).withColumn("dz", F.coalesce("dz", F.lit(float("nan"))))


def nearest(query: DataFrame, reference: DataFrame | Index, radius: float, keep: Sequence[str] = ()) -> DataFrame:
    """``query`` with d, the distance to the nearest reference point, at most ``radius``; columns
    ``keep`` of that point come as near_<name> (null beyond the radius).  An index of the reference
    that keeps these columns serves many searches."""
    ids = cut(query.withColumn("_row", F.monotonically_increasing_id()))
    index = reference if isinstance(reference, Index) else Index(reference, keep)
    best = index.nearest(ids, 1, float(radius)).select("_row", F.get("ds", F.lit(0)).alias("_d"), *[F.get(c, F.lit(0)).alias(f"near_{c}") for c in keep])
    return ids.join(best, "_row", "left").withColumn("d", F.coalesce("_d", F.lit(float(radius)))).drop("_row", "_d")


def remove_outliers(cloud: DataFrame, neighbours: int, sigma: float) -> DataFrame:
    """Drops points whose mean distance to their nearest neighbours is more than sigma standard
    deviations over the cloud's mean."""
    ids = cut(cloud.withColumn("_row", F.monotonically_increasing_id()))
    near = k_nearest(ids, ids.select("_row", *AXES), neighbours, itself=True)
    mean = F.coalesce(F.try_divide(F.aggregate("ds", F.lit(0.0), lambda a, x: a + x), F.size("ds")), F.lit(0.0))
    scored = cut(ids.join(near.select("_row", mean.alias("_m")), "_row"))
    limits = scored.agg(F.avg("_m").alias("_avg"), F.coalesce(F.stddev("_m"), F.lit(0.0)).alias("_std"))
    return scored.crossJoin(F.broadcast(limits)).filter(F.col("_m") <= F.col("_avg") + sigma * F.col("_std")).drop("_row", "_m", "_avg", "_std")  # one row


def distance_shares(d: Column, thresholds: Sequence[float], strict: bool = True) -> list[Column]:
    """Share of distances under (or up to) each threshold, as aggregates of one scan."""
    return [F.avg(F.when(d < t if strict else d <= t, 1.0).otherwise(0.0)).alias(f"{t:g}") for t in thresholds]


def geometry_metrics(points: DataFrame, truth: DataFrame, thresholds: Sequence[float], cap: float) -> DataFrame:
    """threshold, precision, recall, f_score, accuracy and completeness (mean distances, capped).
    Two nearest-neighbour passes serve all thresholds."""
    spark = points.sparkSession
    levels = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")

    def side(a: DataFrame, b: DataFrame, share: str, mean: str) -> DataFrame:
        d = nearest(a, b, cap).select("d")
        one = d.agg(F.avg("d").alias(mean), F.map_from_arrays(F.array(*[F.lit(float(t)) for t in thresholds]), F.array(*[F.coalesce(F.avg(F.when(F.col("d") < t, 1.0).otherwise(0.0)), F.lit(0.0)) for t in thresholds])).alias("m"))
        return one.select(mean, F.explode("m").alias("threshold", share))

    out = levels.join(side(points, truth, "precision", "accuracy"), "threshold").join(side(truth, points, "recall", "completeness"), "threshold")
    p, r = F.col("precision"), F.col("recall")
    return out.select("threshold", "precision", "recall", F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0).alias("f_score"), "accuracy", "completeness")


def sparse_dense_agreement(sparse: DataFrame, dense: DataFrame, unit: float, multiples: Sequence[float], size: float) -> DataFrame:
    """One row: sparse points over the dense footprint, their median distance in units and the
    share within each multiple of the unit."""
    inside = footprint_crop(sparse, dense, size)
    d = cut(nearest(inside, dense, 100 * unit).select((F.col("d") / unit).alias("u")))
    return medians(d, [], F.col("u"), "median_units", [F.count("*").alias("in_footprint"), *[F.avg(F.when(F.col("u") <= m, 1.0).otherwise(0.0)).alias(f"within_{m:g}") for m in multiples]])
