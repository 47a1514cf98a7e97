"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps all different values of a group in one buffer.  That is fine for
groups of up to LARGE values, and it serves those (the table is read once more to tell).  Larger groups are few (at most one for each
LARGE rows), and all their quantiles are found together by radix selection: a double's bits, as a
whole number that sorts alike, are read thirteen at a time from the top; a pass counts the values
under each digit below the prefixes that are still sought, and each sought rank moves on to the
digit that holds it.  Five passes over (group, bits), written once, give the values at the ranks.
A task holds counts only, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .shared import cut

#: Values that a group may have to be left to the built-in aggregate.
LARGE = 500_000
#: Bits of a digit.
DIGIT = 13


@F.pandas_udf(LongType())
def ordered_bits(value: pd.Series) -> pd.Series:
    """A whole number that sorts as the double does; NaN is the largest."""
    bits = (np.where(np.isnan(v := value.to_numpy(float)), np.nan, v) + 0.0).view(np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(DoubleType())
def double_of(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b >= 0, b, b ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(float))


def _at_ranks(rows: DataFrame, sought: DataFrame) -> DataFrame:
    """gid, rank, bits: the value at each rank.  ``rows``: gid, bits; ``sought``: gid, rank."""
    sought = sought.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rank")})
    seen, shift = 0, 64
    while shift > 0:
        width = min(DIGIT, shift)
        shift -= width
        # the sign bit is turned, so that digits are counted up from the least value
        turned = F.col("bits").bitwiseXOR(F.lit(np.iinfo(np.int64).min))
        above = F.lit(0).cast("long") if seen == 0 else F.shiftrightunsigned(turned, 64 - seen)
        digit = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << width) - 1))
        wanted = F.broadcast(sought.select("gid", "prefix").distinct())  # at most two a quantile and large group
        counts = rows.select("gid", above.alias("prefix"), digit.alias("digit")).join(wanted, ["gid", "prefix"]).groupBy("gid", "prefix", "digit").agg(F.count("*").alias("n"))
        # of a prefix there are 2 ** DIGIT counts at most
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("gid", "prefix").orderBy("digit")))
        found = sought.join(upto, ["gid", "prefix"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        sought = cut(found.select("gid", "rank", (F.shiftleft("prefix", width) + F.col("digit")).alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")))
        seen += width
    return sought.select("gid", "rank", F.col("prefix").bitwiseXOR(F.lit(np.iinfo(np.int64).min)).alias("bits"))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probabilities: Sequence[float], also: Sequence[Column] = (), large: int | None = None) -> DataFrame:
    """A row for each group: keys, q (array of the quantiles of its values that aren't null, with
    linear interpolation; null if there are none) and the other aggregates ``also``."""
    large = large or LARGE
    keys = list(keys)
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    named = df.withColumn("_value", value.cast("double"))
    whole = F.percentile("_value", at).alias("q")
    small = named.groupBy(*keys).agg(whole, *also)
    if named.count() <= large:
        return small
    big = cut(named.groupBy(*keys).agg(F.count("_value").alias("_n")).filter(F.col("_n") > large).withColumn("gid", F.monotonically_increasing_id()))
    if big.isEmpty():
        return small
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    both = lambda how: named.alias("a").join(big.alias("b"), same, how) if keys else named.crossJoin(F.broadcast(big))  # one row
    rows = cut(both("inner").filter("_value is not null").select("gid", ordered_bits("_value").alias("bits")))
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities])))
    values = _at_ranks(rows, big.select("gid", F.explode(ranks).alias("rank"))).select("gid", "rank", double_of("bits").alias("x"))
    by = big.join(values.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x")), "gid")
    low, high = lambda p: F.col("x")[F.floor(place(p))], lambda p: F.col("x")[F.ceil(place(p))]
    between = lambda p: F.when(low(p) == high(p), low(p)).otherwise(low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p))))
    solved = by.select(*keys, F.array(*[between(p) for p in probabilities]).alias("q"))
    if not keys:
        return solved.crossJoin(named.agg(*also)) if also else solved  # one row each
    others = named.alias("a").join(big.alias("b"), same, "left_anti").groupBy(*keys).agg(whole, *also)
    if also:
        rest = named.alias("a").join(big.alias("b"), same, "left_semi").groupBy(*keys).agg(*also)
        solved = solved.alias("a").join(rest.alias("b"), same).select("a.*", *[f"b.{c}" for c in rest.columns if c not in keys])
    return others.unionByName(solved)


def medians(df: DataFrame, keys: Sequence[str], value: Column, name: str, also: Sequence[Column] = ()) -> DataFrame:
    """As ``quantiles``, with the median as a column."""
    out = quantiles(df, keys, value, [0.5], also)
    return out.select(*keys, F.get("q", F.lit(0)).alias(name), *[c for c in out.columns if c not in (*keys, "q")])
