"""The operators on the driver's tables, with the same results in DuckDB SQL where SQL can say it.

The tables hold no images, so columns stand in for coordinates, poses and scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import synthetic
from .functions import cameras, geodesy, poses
from .functions.linear import at, const, dot, norm, vec
from .operators import align, frames, graph, matching, metrics, spatial
from .operators import keyframes as keyframe_picks
from .operators.ranges import with_ranks
from .plans import mvs, sfm
from .plans.model import Model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def r_many(c: Column, digits: int = 6) -> Column:
    """``r`` of doubles, for very many rows: equal to it, but decimal digits are made only near a half
    (and of very large, infinite and missing numbers)."""
    x = c * 10.0**digits
    plain = (F.abs(x) < 1e11) & (F.abs(x - F.floor(x) - 0.5) > 1e-4)
    return F.when(plain, F.floor(x + 0.5) / 10.0**digits).otherwise(r(c, digits))


def items(a: Column, names: list[str], digits: int = 6) -> list[Column]:
    return [r(at(a, i), digits).alias(n) for i, n in enumerate(names)]


def rows(names: list[str], digits: int = 6) -> list[Column]:
    return [r(F.col(n), digits).alias(n) for n in names]


# -- clouds

_CLOUD = "SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1017.0 AS z FROM lineitem"


def _cloud(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1017.0).alias("z"))


@query(f"""SELECT CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz, count(*) AS n,
  round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, round(avg(z), 4) + 0.0 AS z FROM ({_CLOUD}) GROUP BY 1, 2, 3""")
def voxel_downsample(spark, folder):
    return spatial.voxel_downsample(_cloud(spark, folder), 5.0).select("vx", "vy", "vz", "n", *rows(["x", "y", "z"], 4))


@query("""WITH ref AS (SELECT l_quantity AS x, l_extendedprice / l_quantity AS y FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT min(x) AS x0, min(y) AS y0 FROM ref),
cells AS (SELECT DISTINCT floor((x - x0) / 2) AS cx, floor((y - y0) / 2) AS cy FROM ref, o)
SELECT p_partkey FROM part, o WHERE (floor((p_size - x0) / 2), floor((p_retailprice - y0) / 2)) IN (SELECT (cx, cy) FROM cells)""")
def footprint_crop(spark, folder):
    points = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    reference = table(spark, folder, "lineitem").filter("l_linenumber = 1").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"))
    return spatial.footprint_crop(points, reference, 2.0).select("p_partkey")


@query("""WITH c AS (SELECT l_returnflag = 'R' AS f, l_quantity AS x, l_tax * 100 AS y, l_extendedprice AS z FROM lineitem),
o AS (SELECT min(x) AS x0, min(y) AS y0 FROM c),
h AS (SELECT f, floor((x - x0) / 1) AS cx, floor((y - y0) / 1) AS cy, median(z) AS z FROM c, o GROUP BY ALL)
SELECT round(median(a.z - b.z), 4) + 0.0 AS dz, count(*) AS cells FROM h a JOIN h b ON NOT a.f AND b.f AND a.cx = b.cx AND a.cy = b.cy""")
def vertical_offset(spark, folder):
    c = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.col("l_extendedprice").alias("z"))
    return spatial.vertical_offset(c.filter("l_returnflag <> 'R'"), c.filter("l_returnflag = 'R'"), 1.0).select(r(F.col("dz"), 4).alias("dz"), "cells")


def _dims(spark, folder, odd: int):
    e = table(spark, folder, "embeddings").filter(F.col("vec_id") % 2 == odd)
    return e.select("vec_id", *[at(F.col("embedding"), i).cast("double").alias(c) for i, c in enumerate("xyz")])


_PAIRS = """e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
d AS (SELECT a.vec_id, a.vec_id % 2 AS side, least(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), {cap}) AS d
  FROM e a JOIN e b ON a.vec_id % 2 <> b.vec_id % 2 GROUP BY a.vec_id)"""


@query(f"WITH {_PAIRS.format(cap='0.1')} SELECT vec_id, round(d, 6) + 0.0 AS d FROM d WHERE side = 0")
def nearest_distance(spark, folder):
    return spatial.nearest(_dims(spark, folder, 0), _dims(spark, folder, 1), 0.1).select("vec_id", r(F.col("d")).alias("d"))


@query(f"""WITH {_PAIRS.format(cap='0.2')}, t(threshold) AS (VALUES (CAST(0.02 AS DOUBLE)), (0.05), (0.1)),
m AS (SELECT threshold, avg(CASE WHEN side = 0 THEN CASE WHEN d < threshold THEN 1.0 ELSE 0.0 END END) AS p, avg(CASE WHEN side = 1 THEN CASE WHEN d < threshold THEN 1.0 ELSE 0.0 END END) AS q,
  avg(CASE WHEN side = 0 THEN d END) AS a, avg(CASE WHEN side = 1 THEN d END) AS c FROM d, t GROUP BY threshold)
SELECT threshold, round(p, 6) + 0.0 AS precision, round(q, 6) + 0.0 AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) + 0.0 AS f_score, round(a, 6) + 0.0 AS accuracy, round(c, 6) + 0.0 AS completeness FROM m""")
def geometry_metrics(spark, folder):
    m = spatial.geometry_metrics(_dims(spark, folder, 0), _dims(spark, folder, 1), (0.02, 0.05, 0.1), 0.2)
    return m.select("threshold", *rows(["precision", "recall", "f_score", "accuracy", "completeness"]))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
o AS (SELECT min(x) AS x0, min(y) AS y0 FROM e WHERE vec_id % 2 = 1),
cells AS (SELECT DISTINCT floor((x - x0) / 0.05) AS cx, floor((y - y0) / 0.05) AS cy FROM e, o WHERE vec_id % 2 = 1),
s AS (SELECT e.* FROM e, o WHERE vec_id % 2 = 0 AND (floor((x - x0) / 0.05), floor((y - y0) / 0.05)) IN (SELECT (cx, cy) FROM cells)),
u AS (SELECT s.vec_id, least(min(sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y) + (s.z - b.z) * (s.z - b.z))), 2.0) / 0.02 AS u FROM s JOIN e b ON b.vec_id % 2 = 1 GROUP BY s.vec_id)
SELECT count(*) AS in_footprint, round(median(u), 6) + 0.0 AS median_units, round(avg(CASE WHEN u <= 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS within_2, round(avg(CASE WHEN u <= 4 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS within_4 FROM u""")
def sparse_dense(spark, folder):
    a = spatial.sparse_dense_agreement(_dims(spark, folder, 0), _dims(spark, folder, 1), 0.02, (2, 4), 0.05)
    return a.select("in_footprint", *rows(["median_units", "within_2", "within_4"]))


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
p AS (SELECT a.vec_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM p),
m AS (SELECT vec_id, avg(d) AS m FROM k WHERE k <= 5 GROUP BY vec_id)
SELECT vec_id FROM m WHERE m <= (SELECT avg(m) + 1.0 * stddev(m) FROM m)""")
def remove_outliers(spark, folder):
    return spatial.remove_outliers(_dims(spark, folder, 0).unionByName(_dims(spark, folder, 1)), 5, 1.0).select("vec_id")


# -- descriptors, pairs, tracks


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings),
q AS (SELECT vec_id, list_transform(v, lambda x: sqrt(x / (list_sum(v) + 1e-8))) AS v FROM s)
SELECT vec_id, round(v[1], 6) + 0.0 AS first, round(v[64], 6) + 0.0 AS last, round(list_sum(v), 6) + 0.0 AS total FROM q""")
def root_sift(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", cameras.root_sift(F.transform("embedding", F.abs)).alias("v"))
    return v.select("vec_id", r(at(F.col("v"), 0)).alias("first"), r(at(F.col("v"), 63)).alias("last"), r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_MATCH = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
m AS (SELECT i, j FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k, lead(d) OVER (PARTITION BY i ORDER BY d, j) AS s FROM p) WHERE k = 1 AND d < 0.95 * s)"""


def _sides(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    return e.filter("idx % 2 = 0"), e.filter("idx % 2 = 1")


@query(f"WITH {_MATCH} SELECT i, j FROM m")
def match_ratio(spark, folder):
    return matching.match_sets(*_sides(spark, folder), 0.95, False).select("i", "j")


@query(f"WITH {_MATCH}, b AS (SELECT j, arg_min(i, (d, i)) AS i FROM p GROUP BY j) SELECT m.i, m.j FROM m JOIN b ON m.i = b.i AND m.j = b.j")
def match_mutual(spark, folder):
    return matching.match_sets(*_sides(spark, folder), 0.95, True).select("i", "j")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.label < b.label),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY la, lb, i ORDER BY d, j) AS k, lead(d) OVER (PARTITION BY la, lb, i ORDER BY d, j) AS s FROM p) WHERE k = 1 AND d < 0.97 * s),
b AS (SELECT la, lb, j, arg_min(i, (d, i)) AS i FROM p GROUP BY ALL)
SELECT CAST(m.la AS BIGINT) AS image_a, CAST(m.lb AS BIGINT) AS image_b, m.i AS kp_a, m.j AS kp_b FROM m JOIN b ON m.la = b.la AND m.lb = b.lb AND m.i = b.i AND m.j = b.j""")
def match_descriptors(spark, folder):
    e = table(spark, folder, "embeddings")
    d = e.select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("kp_idx"), F.col("embedding").cast("array<double>").alias("vec"))
    return matching.match_descriptors(d, matching.image_pairs(d.select("image_id").distinct()), 0.97)


@query("SELECT a.s_suppkey AS image_a, b.s_suppkey AS image_b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey - a.s_suppkey <= 7")
def image_pairs_band(spark, folder):
    return matching.image_pairs(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("image_id")), 7)


def _rounds(edges: str, n: int) -> str:
    """SQL tables l0 to l<n>: each node's smallest label after so many rounds with its neighbours (e: x, y, both ways)."""
    rounds = [f"l{i} AS MATERIALIZED (SELECT l.x, least(any_value(l.c), min(m.c)) AS c FROM l{i - 1} l JOIN n ON n.x = l.x JOIN l{i - 1} m ON m.x = n.y GROUP BY l.x)" for i in range(1, n + 1)]
    return ", ".join([f"e AS ({edges})", "n AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e)", "l0 AS (SELECT DISTINCT x, x AS c FROM n)", *rounds])


# the graph is so dense that labels settle in a few rounds
@query(f"WITH {_rounds("SELECT 'p' || l_partkey AS x, 's' || l_suppkey AS y FROM lineitem", 12)} SELECT x AS node, c AS component FROM l12")
def components(spark, folder):
    li = table(spark, folder, "lineitem")
    return graph.components(li.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


# keypoints of lines in order; three orders share theirs, and some lines lead on to the next three
@query(f"""WITH {_rounds("SELECT CAST(a.l_linenumber AS BIGINT) * 1000000000 + a.l_orderkey // 3 AS x, CAST(b.l_linenumber AS BIGINT) * 1000000000 + (b.l_orderkey + CASE WHEN b.l_suppkey % 40 = 0 THEN 1 ELSE 0 END) // 3 AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1", 60)},
good AS (SELECT c FROM l60 GROUP BY c HAVING count(*) = count(DISTINCT x // 1000000000) AND count(*) >= 3)
SELECT CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS track_id, CAST(x // 1000000000 AS BIGINT) AS image_id, CAST(x % 1000000000 AS BIGINT) AS kp_idx FROM l60 JOIN good USING (c)""")
def tracks(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("image"), "l_suppkey")
    a = li.select("o", F.col("image").alias("image_a"), F.floor(F.col("o") / 3).alias("kp_a"))
    b = li.select("o", F.col("image").alias("image_b"), F.floor((F.col("o") + F.when(F.col("l_suppkey") % 40 == 0, 1).otherwise(0)) / 3).alias("kp_b"))
    return graph.tracks(a.join(b, "o").filter("image_b = image_a + 1").select("image_a", "kp_a", "image_b", "kp_b").distinct(), 3)


_CENTER = "CAST(s_suppkey * 10 % 97 AS DOUBLE) AS cx, CAST(s_suppkey * 10 % 89 AS DOUBLE) AS cy, CAST(5 AS DOUBLE) AS cz"


def _supplier_views(spark, folder):
    eye = vec(F.col("s_suppkey") * 10 % 97, F.col("s_suppkey") * 10 % 89, 5.0)
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("image_id"), poses.from_center(const(poses.EYE), eye).alias("pose"))


@query(f"""WITH o AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), v AS (SELECT s_suppkey AS s, {_CENTER} FROM supplier),
x AS (SELECT p_partkey AS p, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(0 AS DOUBLE) AS z FROM part),
f AS (SELECT o.p, o.s, cx - x AS dx, cy - y AS dy, cz - z AS dz FROM o JOIN v USING (s) JOIN x USING (p)),
a AS (SELECT a.s AS image_id, b.s AS neighbor, count(*) AS shared, median(degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz) * sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz))))))) AS angle
  FROM f a JOIN f b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(shared * least(1, angle / 5), 6) DESC, neighbor DESC) AS rank FROM a WHERE angle >= 1)
SELECT image_id, neighbor, CAST(rank AS INTEGER) AS rank, shared FROM s WHERE rank <= 4""")
def view_neighbors(spark, folder):
    observations = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("image_id"))
    points = table(spark, folder, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), F.lit(0.0).alias("z"))
    return matching.view_neighbors(observations, points, _supplier_views(spark, folder), 4, 1.0, 2).select("image_id", "neighbor", "rank", "shared")


_COUNTS = "c AS (SELECT l_suppkey AS image_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)"


@query(f"WITH {_COUNTS} SELECT image_id, n FROM c WHERE n >= 20 ORDER BY n DESC, image_id LIMIT 1")
def next_image(spark, folder):
    return frames.next_image(table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.count_distinct("l_partkey").alias("n")))


@query("""WITH p AS (SELECT l_suppkey AS image_a, l_linenumber + 100000 AS image_b, count(*) AS n_inliers, CAST(l_suppkey % 9 AS DOUBLE) AS median_angle_deg FROM lineitem GROUP BY ALL)
SELECT image_a, CAST(image_b AS BIGINT) AS image_b, n_inliers, median_angle_deg FROM p WHERE median_angle_deg >= 4 ORDER BY n_inliers DESC, image_a DESC, image_b DESC LIMIT 1""")
def initial_pair(spark, folder):
    p = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("image_a"), (F.col("l_linenumber") + 100000).cast("long").alias("image_b")).agg(F.count("*").alias("n_inliers"))
    return frames.initial_pair(p.withColumn("median_angle_deg", (F.col("image_a") % 9).cast("double"))).select("image_a", "image_b", "n_inliers", "median_angle_deg")


@query("SELECT s_suppkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey AS s_suppkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def largest_keypoints(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("s_suppkey"), "o_orderkey", "o_totalprice")
    return frames.largest(o, "s_suppkey", "o_totalprice", "o_orderkey", 3).select("s_suppkey", "o_orderkey", "rank")


@query("""SELECT 'both' AS part, n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'train', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 6)
UNION ALL SELECT 'all', n_nationkey FROM nation""")
def set_operations(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"))
    c, s = table(spark, folder, "customer").select(F.col("c_nationkey").alias("id")), table(spark, folder, "supplier")
    both = n.intersect(c).intersect(s.select(F.col("s_nationkey").alias("id"))).select(F.lit("both").alias("part"), "id")
    train = n.exceptAll(n.join(s.filter("s_suppkey < 6").select(F.col("s_nationkey").alias("id")).distinct(), "id", "left_semi")).select(F.lit("train").alias("part"), "id")
    return both.unionByName(train).unionByName(n.select(F.lit("all").alias("part"), "id"))


# -- frames

_FRAMES = "f AS (SELECT user_id, event_id, value, CAST(floor(value) AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"


def _frames(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", "event_id", "ts", "value", (F.row_number().over(w) - 1).cast("long").alias("frame"))


@query(f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1),
p AS (SELECT user_id, k, value, coalesce(sum(d) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM f),
j AS (SELECT a.user_id, a.k, min(b.k) AS j FROM p a JOIN p b ON a.user_id = b.user_id AND b.k > a.k AND b.m - a.m >= 300 GROUP BY 1, 2),
t AS (SELECT j.user_id, j.k, arg_max(p.k, (p.value, -p.k)) AS next FROM j JOIN p ON p.user_id = j.user_id AND p.k >= j.j AND p.k < j.j + 5 GROUP BY 1, 2),
g(user_id, frame, pick) AS (SELECT user_id, arg_max(k, (value, -k)), CAST(0 AS BIGINT) FROM p WHERE k < 5 GROUP BY 1 UNION ALL SELECT g.user_id, t.next, g.pick + 1 FROM g JOIN t ON t.user_id = g.user_id AND t.k = g.frame)
SELECT user_id, CAST(frame AS BIGINT) AS frame, pick FROM g""")
def keyframes(spark, folder):
    f = _frames(spark, folder).select("user_id", "frame", F.col("value").alias("sharpness"), F.floor("value").cast("double").alias("displacement_to_next"))
    return keyframe_picks.select_keyframes(f, "user_id", "frame", 300.0, 5)


@query("""WITH RECURSIVE f AS (SELECT value, CAST(floor(value) AS BIGINT) AS d, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events),
p AS MATERIALIZED (SELECT k, value, coalesce(sum(d) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM f),
u AS (SELECT m, min(k) AS k FROM p GROUP BY m),
j AS (SELECT a.k, u.k AS j FROM (SELECT k, m + 300 AS v FROM p) a ASOF JOIN u ON u.m >= a.v),
t AS MATERIALIZED (SELECT w.k, arg_max(p.k, (p.value, -p.k)) AS next FROM (SELECT k, unnest(range(j, j + 9)) AS near FROM j) w JOIN p ON p.k = w.near GROUP BY 1),
g(frame, pick) AS (SELECT arg_max(k, (value, -k)), CAST(0 AS BIGINT) FROM p WHERE k < 9 UNION ALL SELECT t.next, g.pick + 1 FROM g JOIN t ON t.k = g.frame)
SELECT 0 AS video, CAST(frame AS BIGINT) AS frame, pick FROM g""")
def keyframes_one_video(spark, folder):
    """All events as one video: its frames are ranked and picked by ranges."""
    f = with_ranks(table(spark, folder, "events").select("ts", "event_id", "value"), ["ts", "event_id"], "frame")
    return keyframe_picks.select_keyframes(f.select(F.lit(0).alias("video"), "frame", F.col("value").alias("sharpness"), F.floor("value").cast("double").alias("displacement_to_next")), "video", "frame", 300.0, 9)


_MOVED = f"{_FRAMES}, m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY k)) AS displacement FROM f)"


@query(f"WITH {_MOVED} SELECT event_id, round(displacement, 6) + 0.0 AS displacement FROM m")
def frame_displacement(spark, folder):
    return frames.displacement_to_previous(_frames(spark, folder), "user_id", ["frame"], F.col("value")).select("event_id", r(F.col("displacement")).alias("displacement"))


@query(f"WITH {_MOVED} SELECT user_id, round(sum(displacement) / 10, 4) + 0.0 AS min_displacement FROM m GROUP BY 1")
def motion_threshold(spark, folder):
    f = frames.displacement_to_previous(_frames(spark, folder), "user_id", ["frame"], F.col("value"))
    return frames.motion_threshold(f, "user_id", 10).select("user_id", r(F.col("min_displacement"), 4).alias("min_displacement"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 8 = 0 AS is_test FROM documents")
def holdout_split(spark, folder):
    return frames.holdout_split(table(spark, folder, "documents").select("doc_id"), "doc_id", 8)


# -- metrics


@query("SELECT t.threshold, round(avg(greatest(0, 1 - abs(s_acctbal) / 400 / t.threshold)), 6) + 0.0 AS auc FROM supplier, (VALUES (CAST(3 AS DOUBLE)), (5), (10), (30)) t(threshold) GROUP BY 1")
def pose_auc(spark, folder):
    return metrics.pose_auc(table(spark, folder, "supplier").select((F.abs("s_acctbal") / 400).alias("error")), (3, 5, 10, 30)).select("threshold", r(F.col("auc")).alias("auc"))


def _turn(a: Column) -> Column:
    return vec(F.cos(a), -F.sin(a), 0.0, F.sin(a), F.cos(a), 0.0, 0.0, 0.0, 1.0)


@query("""WITH v AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS name, 0.1 * s_suppkey AS a, 0.1 * s_suppkey + 0.01 * (s_suppkey % 3) AS b,
  CAST(s_suppkey AS DOUBLE) AS x, CAST(s_suppkey * s_suppkey % 17 AS DOUBLE) AS y, CAST(s_suppkey % 5 AS DOUBLE) AS z FROM supplier),
p AS (SELECT i.name AS name_i, j.name AS name_j, (j.b - i.b) - (j.a - i.a) AS da,
  j.x - (cos(j.a - i.a) * i.x - sin(j.a - i.a) * i.y) AS tx, j.y - (sin(j.a - i.a) * i.x + cos(j.a - i.a) * i.y) AS ty, j.z - i.z AS tz,
  j.x - (cos(j.b - i.b) * i.x - sin(j.b - i.b) * i.y) AS ex, j.y - (sin(j.b - i.b) * i.x + cos(j.b - i.b) * i.y) AS ey FROM v i JOIN v j ON i.name < j.name)
SELECT name_i, name_j, round(degrees(acos(greatest(-1, least(1, cos(da))))), 4) + 0.0 AS rot_deg,
  round(degrees(acos(greatest(-1, least(1, (tx * ex + ty * ey + tz * tz) / (sqrt(tx * tx + ty * ty + tz * tz) * sqrt(ex * ex + ey * ey + tz * tz)))))), 4) + 0.0 AS trans_deg FROM p""")
def relative_pose_errors(spark, folder):
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    t = vec(k, k * k % 17, k % 5)
    name = F.lpad(k.cast("string"), 6, "0").alias("name")
    truth = s.select(name, poses.pose(_turn(0.1 * k), t).alias("pose"))
    estimate = s.select(name, poses.pose(_turn(0.1 * k + 0.01 * (k % 3)), t).alias("pose"))
    return metrics.relative_pose_errors(estimate, truth).select("name_i", "name_j", *[r_many(F.col(c), 4).alias(c) for c in ("rot_deg", "trans_deg")])


@query("SELECT l_returnflag, round(10 * log10(1.0 / avg((l_tax - l_discount) * (l_tax - l_discount))), 6) + 0.0 AS psnr FROM lineitem GROUP BY 1")
def psnr(spark, folder):
    e = F.col("l_tax") - F.col("l_discount")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(r(metrics.psnr(e * e)).alias("psnr"))


_RESIDUALS = "(SELECT value AS e, CAST(user_id AS DOUBLE) AS n, value * 0.01 + event_id % 7 AS de, user_id * 0.02 - event_id % 5 AS dn, value * 0.03 - user_id * 0.01 + event_id % 3 AS du FROM events)"


def _residuals(spark, folder):
    i = F.col("event_id")
    return table(spark, folder, "events").select(F.col("value").alias("e"), F.col("user_id").cast("double").alias("n"), (F.col("value") * 0.01 + i % 7).alias("de"), (F.col("user_id") * 0.02 - i % 5).alias("dn"), (F.col("value") * 0.03 - F.col("user_id") * 0.01 + i % 3).alias("du"))


@query(f"""SELECT count(*) AS num_images, round(sqrt(avg(de * de + dn * dn + du * du)), 5) + 0.0 AS rmse_3d, round(sqrt(avg(de * de + dn * dn)), 5) + 0.0 AS rmse_horizontal,
round(sqrt(avg(du * du)), 5) + 0.0 AS rmse_vertical, round(sqrt(max(de * de + dn * dn + du * du)), 5) + 0.0 AS max_3d FROM {_RESIDUALS}""")
def georef_summary(spark, folder):
    return metrics.georef_summary(_residuals(spark, folder)).select("num_images", *rows(["rmse_3d", "rmse_horizontal", "rmse_vertical", "max_3d"], 5))


@query(f"WITH x AS (SELECT * FROM {_RESIDUALS}), m AS (SELECT avg(e) AS me, avg(n) AS mn FROM x) SELECT round(regr_slope(du, sqrt((e - me) * (e - me) + (n - mn) * (n - mn))), 5) + 0.0 AS slope FROM x, m")
def trend_slope(spark, folder):
    return metrics.trend_slope(_residuals(spark, folder)).select(r(F.col("slope"), 5).alias("slope"))


@query(f"""WITH x AS (SELECT * FROM {_RESIDUALS}), l AS (SELECT e, n, 'de' AS axis, de AS v FROM x UNION ALL SELECT e, n, 'dn', dn FROM x UNION ALL SELECT e, n, 'du', du FROM x),
s AS (SELECT axis, var_pop(e) AS ee, covar_pop(e, n) AS en, var_pop(n) AS nn, covar_pop(e, v) AS ev, covar_pop(n, v) AS nv, var_pop(v) AS vv FROM l GROUP BY 1)
SELECT axis, round((ev * ev * nn - 2 * ev * nv * en + nv * nv * ee) / (ee * nn - en * en) / vv, 5) + 0.0 AS r2 FROM s""")
def planar_r2(spark, folder):
    return metrics.planar_r2(_residuals(spark, folder)).select("axis", r(F.col("r2"), 5).alias("r2"))


def _depths(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_extendedprice") / 1000 - 20).alias("z"), (500.0 + F.col("l_suppkey")).alias("fx"))


@query("""SELECT l_suppkey AS image_id, round(0.8 * quantile_cont(z, 0.01), 5) + 0.0 AS lo, round(1.25 * quantile_cont(z, 0.99), 5) + 0.0 AS hi
FROM (SELECT l_suppkey, l_extendedprice / 1000 - 20 AS z, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE z > 0 AND n >= 10 GROUP BY 1""")
def depth_range(spark, folder):
    return metrics.depth_ranges(_depths(spark, folder)).select("image_id", *rows(["lo", "hi"], 5))


@query("""SELECT round(median(g), 8) + 0.0 AS gsd FROM (SELECT median(z) / (500.0 + l_suppkey) AS g FROM (SELECT l_suppkey, l_extendedprice / 1000 - 20 AS z, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
WHERE z > 0 AND n >= 10 GROUP BY l_suppkey)""")
def ground_sampling_distance(spark, folder):
    return metrics.ground_sampling_distance(_depths(spark, folder)).select(r(F.col("gsd"), 8).alias("gsd"))


@query("SELECT round(sqrt(avg(d * d)), 4) + 0.0 AS rmse, round(median(d), 4) + 0.0 AS median, round(max(d), 4) + 0.0 AS max, count(*) AS n, CAST(2.5 AS DOUBLE) AS scale FROM (SELECT CAST(0 AS DOUBLE) AS d FROM supplier)")
def trajectory_error(spark, folder):
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    name = k.cast("string").alias("name")
    a = s.select(name, poses.from_center(_turn(0.1 * k), vec(k % 13, k * k % 17, k % 7)).alias("pose"))
    moved = align.move_images(a, align.Similarity(2.5, align.rotation_to_z(np.array([0.6, 0.0, 0.8])), np.array([3.0, -2.0, 1.0])))
    return metrics.trajectory_error(a, moved).select(*rows(["rmse", "median", "max"], 4), "n", r(F.col("scale"), 6).alias("scale"))


# -- expressions

_POINT = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 10 AS DOUBLE) AS z FROM part"
_SEEN = f"""w AS ({_POINT}), c AS (SELECT id, cos(0.3) * x - sin(0.3) * y - 10 AS a, sin(0.3) * x + cos(0.3) * y - 5 AS b, z + 80 AS d FROM w),
s AS (SELECT id, d AS depth, a / d AS a, b / d AS b, 1 - 0.1 * (a * a + b * b) / (d * d) + 0.01 * ((a * a + b * b) / (d * d)) * ((a * a + b * b) / (d * d)) AS f FROM c)"""


def _points(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), vec(F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_partkey") % 10).alias("p"))


def _view() -> tuple[Column, Column]:
    return cameras.camera(640, 480, 500, 510, 320, 240, -0.1, 0.01), poses.pose(_turn(F.lit(0.3)), vec(-10.0, -5.0, 80.0))


@query(f"WITH {_SEEN} SELECT id, round(500 * a * f + 320, 6) + 0.0 AS u, round(510 * b * f + 240, 6) + 0.0 AS v, round(depth, 6) + 0.0 AS z FROM s")
def project_points(spark, folder):
    c, p = _view()
    s = _points(spark, folder).select("id", cameras.project(c, p, F.col("p")).alias("s"))
    return s.select("id", *items(F.col("s.uv"), ["u", "v"]), r(F.col("s.z")).alias("z"))


@query(f"WITH w AS ({_POINT}) SELECT id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM w")
def project_and_back(spark, folder):
    c, p = _view()
    s = _points(spark, folder).select("id", cameras.project(c, p, F.col("p")).alias("s"))
    return s.select("id", cameras.unproject(c, p, F.col("s.uv"), F.col("s.z")).alias("b")).select("id", *items(F.col("b"), ["x", "y", "z"], 5))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, (p_size - 25) / 50.0 AS a, (p_partkey % 41 - 20) / 50.0 AS b FROM part),
g(id, a, b, x, y, k) AS (SELECT id, a, b, a, b, 0 FROM s UNION ALL SELECT id, a, b, a / (1 - 0.1 * (x * x + y * y) + 0.01 * (x * x + y * y) * (x * x + y * y)), b / (1 - 0.1 * (x * x + y * y) + 0.01 * (x * x + y * y) * (x * x + y * y)), k + 1 FROM g WHERE k < 20)
SELECT id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM g WHERE k = 20""")
def undistort(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), vec((F.col("p_size") - 25) / 50.0, (F.col("p_partkey") % 41 - 20) / 50.0).alias("d"))
    return p.select("id", cameras.undistort(_view()[0], F.col("d")).alias("n")).select("id", *items(F.col("n"), ["x", "y"]))


@query(f"WITH {_SEEN} SELECT round(sqrt(avg(pow(500 * a * f + 320 - 300 - id % 50, 2) + pow(510 * b * f + 240 - 200 - id % 70, 2))), 5) + 0.0 AS rmse FROM s")
def reprojection_rmse(spark, folder):
    c, p = _view()
    one = spark.range(1).select(F.lit(1).cast("long").alias("image_id"), F.lit(1).cast("long").alias("camera_id"), F.lit("a").alias("name"), p.alias("pose"))
    cams = spark.range(1).select(F.lit(1).cast("long").alias("camera_id"), c.alias("c")).select("camera_id", "c.*")
    points = _points(spark, folder).select(F.col("id").alias("point_id"), *[at(F.col("p"), i).alias(n) for i, n in enumerate("xyz")])
    seen = points.select("point_id", F.lit(1).cast("long").alias("image_id"), F.col("point_id").alias("kp_idx"))
    kps = seen.select("image_id", "kp_idx", (300 + F.col("kp_idx") % 50).cast("double").alias("u"), (200 + F.col("kp_idx") % 70).cast("double").alias("v"))
    return metrics.rmse(metrics.reprojection(seen, one, cams, points, kps)).select(r(F.col("rmse"), 5).alias("rmse"))


_ORIGIN = (41.31, -81.5, 250.0)


def _enu_sql() -> str:
    axes, o = geodesy.enu_axes(*_ORIGIN[:2]), geodesy.ecef_point(*_ORIGIN)
    lat, lon, h = "radians(c_nationkey * 3.0 - 30)", "radians(c_custkey % 360 - 180)", "c_acctbal"
    n = f"({geodesy.WGS84_A!r} / sqrt(1 - {geodesy.WGS84_E2!r} * sin({lat}) * sin({lat})))"
    e = [f"(({n} + {h}) * cos({lat}) * cos({lon}) - ({o[0]!r}))", f"(({n} + {h}) * cos({lat}) * sin({lon}) - ({o[1]!r}))", f"(({n} * (1 - {geodesy.WGS84_E2!r}) + {h}) * sin({lat}) - ({o[2]!r}))"]
    cast = lambda v: f"CAST({v!r} AS DOUBLE)"
    return "SELECT c_custkey, " + ", ".join(f"round({' + '.join(f'{cast(axes[3 * i + k])} * {e[k]}' for k in range(3))}, 3) + 0.0 AS {c}" for i, c in enumerate("enu")) + " FROM customer"


@query(_enu_sql())
def lla_to_enu(spark, folder):
    c = table(spark, folder, "customer")
    p = geodesy.to_enu(F.col("c_nationkey") * 3.0 - 30, (F.col("c_custkey") % 360 - 180).cast("double"), F.col("c_acctbal"), _ORIGIN)
    return c.select("c_custkey", p.alias("p")).select("c_custkey", *items(F.col("p"), list("enu"), 3))


@query("SELECT p_partkey AS id, round(degrees(acos(greatest(-1, least(1, (cos(a) + cos(b) + cos(a) * cos(b) - 1) / 2)))), 5) + 0.0 AS angle FROM (SELECT p_partkey, p_size * 0.05 AS a, p_partkey % 30 * 0.1 + 0.05 AS b FROM part)")
def rotation_angle(spark, folder):
    a, b = F.col("p_size") * 0.05, F.col("p_partkey") % 30 * 0.1 + 0.05
    rx = vec(1.0, 0.0, 0.0, 0.0, F.cos(b), F.sin(b), 0.0, -F.sin(b), F.cos(b))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), r(poses.angle_deg(_turn(-a), rx), 5).alias("angle"))


@query("SELECT p_partkey AS id, round((p_size - 25) * 0.04, 5) + 0.0 AS x, round((p_partkey % 41 - 20) * 0.05, 5) + 0.0 AS y, round((p_partkey % 7) * 0.3, 5) + 0.0 AS z FROM part")
def rotation_exp_log(spark, folder):
    w = vec((F.col("p_size") - 25) * 0.04, (F.col("p_partkey") % 41 - 20) * 0.05, (F.col("p_partkey") % 7) * 0.3)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), poses.log(poses.exp(w)).alias("w")).select("id", *items(F.col("w"), list("xyz"), 5))


@query("""WITH q AS (SELECT p_partkey AS id, 1.0 + p_size % 7 AS w, p_size - 20.0 AS x, p_partkey % 11 - 5.0 AS y, p_partkey % 5 - 2.0 AS z FROM part), n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q)
SELECT id, round(w / n, 6) + 0.0 AS w, round(x / n, 6) + 0.0 AS x, round(y / n, 6) + 0.0 AS y, round(z / n, 6) + 0.0 AS z FROM n""")
def quaternions(spark, folder):
    q = vec(1.0 + F.col("p_size") % 7, F.col("p_size") - 20.0, F.col("p_partkey") % 11 - 5.0, F.col("p_partkey") % 5 - 2.0)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), poses.to_quaternion(poses.from_quaternion(q)).alias("q")).select("id", *items(F.col("q"), list("wxyz")))


_H = np.array([[1.1, 0.05, 3.0], [-0.02, 0.95, -2.0], [1e-3, 5e-4, 1.0]])
_HI = np.linalg.inv(_H)


def _h_sql(h: np.ndarray, x: str, y: str) -> tuple[str, str]:
    row = lambda i: f"({h[i, 0]:.17g} * {x} + ({h[i, 1]:.17g}) * {y} + ({h[i, 2]:.17g}))"
    return f"{row(0)} / {row(2)}", f"{row(1)} / {row(2)}"


@query(f"""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 60 AS DOUBLE) AS y, p_size + 4.0 AS u, p_partkey % 60 - 1.0 AS v FROM part)
SELECT id, round(0.5 * (sqrt(pow({_h_sql(_H, 'x', 'y')[0]} - u, 2) + pow({_h_sql(_H, 'x', 'y')[1]} - v, 2)) + sqrt(pow({_h_sql(_HI, 'u', 'v')[0]} - x, 2) + pow({_h_sql(_HI, 'u', 'v')[1]} - y, 2))), 5) + 0.0 AS error FROM p""")
def homography_transfer(spark, folder):
    a, b = vec(F.col("p_size"), F.col("p_partkey") % 60), vec(F.col("p_size") + 4.0, F.col("p_partkey") % 60 - 1.0)
    e = cameras.transfer_error(const(_H.ravel().tolist()), const(_HI.ravel().tolist()), a, b)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), r(e, 5).alias("error"))


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 60 AS DOUBLE) AS y, p_size + 4.0 AS u, p_partkey % 60 + 2.0 AS v FROM part),
l AS (SELECT *, -0.002 * y + 0.3 AS l0, 0.002 * x - 0.5 AS l1, -0.3 * x + 0.5 * y + 0.1 AS l2, 0.002 * v - 0.3 AS m0, -0.002 * u + 0.5 AS m1 FROM p)
SELECT id, round(abs(u * l0 + v * l1 + l2) / sqrt(l0 * l0 + l1 * l1 + m0 * m0 + m1 * m1), 6) + 0.0 AS d FROM l""")
def sampson_distance(spark, folder):
    f = const([0, -0.002, 0.3, 0.002, 0, -0.5, -0.3, 0.5, 0.1])
    a, b = vec(F.col("p_size"), F.col("p_partkey") % 60), vec(F.col("p_size") + 4.0, F.col("p_partkey") % 60 + 2.0)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), r(cameras.sampson(f, a, b)).alias("d"))


@query(f"""WITH w AS ({_POINT}), d AS (SELECT id, 0 - x AS ax, 0 - y AS ay, 60 - z AS az, 20 - x AS bx, 5 - y AS by_, 62 - z AS bz FROM w)
SELECT id, round(degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_ + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + by_ * by_ + bz * bz)))))), 5) + 0.0 AS angle FROM d""")
def triangulation_angle(spark, folder):
    return _points(spark, folder).select("id", r(cameras.ray_angle_deg(const((0, 0, 60)), const((20, 5, 62)), F.col("p")), 5).alias("angle"))


@query("""SELECT p_partkey AS id, CAST(CASE WHEN w >= 1 THEN 1 WHEN w <= 0 THEN 1000000000 ELSE least(ceil(ln(1 - 0.99) / ln(1 - pow(w, 4))), 1000000000) END AS BIGINT) AS n FROM (SELECT p_partkey, p_size / 50.0 AS w FROM part)""")
def required_iterations(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), cameras.required_iterations(F.col("p_size") / 50.0, 4, 0.99).alias("n"))


@query("SELECT c_custkey, round(CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END * (c_custkey % 90 + (c_custkey % 60) / 60.0 + (c_custkey % 37) / 3600.0), 8) + 0.0 AS degrees FROM customer")
def dms_to_degrees(spark, folder):
    k = F.col("c_custkey")
    d = geodesy.dms_to_degrees((k % 90).cast("double"), (k % 60).cast("double"), (k % 37).cast("double"), F.when(F.col("c_nationkey") % 2 == 1, "W").otherwise("E"))
    return table(spark, folder, "customer").select("c_custkey", r(d, 8).alias("degrees"))


@query("""SELECT * FROM (VALUES ('PINHOLE', CAST(10 AS DOUBLE), CAST(11 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 'PINHOLE'), ('SIMPLE_PINHOLE', 10, 10, 0, 0, 'PINHOLE'), ('SIMPLE_RADIAL', 10, 10, 0.5, 0, 'RADIAL'),
('RADIAL', 10, 10, 0.5, 0.25, 'RADIAL'), ('OPENCV', 10, 11, 0.5, 0.25, 'OPENCV')) t(model, fx, fy, k1, k2, written)""")
def camera_models(spark, folder):
    given = [("PINHOLE", [10.0, 11, 5, 6]), ("SIMPLE_PINHOLE", [10.0, 5, 6]), ("SIMPLE_RADIAL", [10.0, 5, 6, 0.5]), ("RADIAL", [10.0, 5, 6, 0.5, 0.25]), ("OPENCV", [10.0, 11, 5, 6, 0.5, 0.25, 0, 0])]
    df = spark.createDataFrame([(m, [float(v) for v in p]) for m, p in given], "model string, p array<double>")
    c = df.select("model", cameras.model_parameters(F.col("model"), F.lit(20), F.lit(10), F.col("p")).alias("c"))
    return c.select("model", "c.fx", "c.fy", "c.k1", "c.k2", cameras.model_of(F.col("c"))["model"].alias("written"))


@query("""SELECT i + 1 AS image_id, round(60 * cos(radians(360) * i / 12), 6) + 0.0 AS x, round(60 * sin(radians(360) * i / 12), 6) + 0.0 AS y, round(CAST(40 AS DOUBLE), 6) + 0.0 AS z,
round(-cos(radians(360) * i / 12) * 60 / sqrt(5200), 6) + 0.0 AS fx, round(-sin(radians(360) * i / 12) * 60 / sqrt(5200), 6) + 0.0 AS fy, round(-40 / sqrt(5200), 6) + 0.0 AS fz FROM range(12) t(i)""")
def orbit(spark, folder):
    v = synthetic.orbit(spark, 12)
    return v.select("image_id", poses.center(F.col("pose")).alias("c"), F.slice("pose.R", 7, 3).alias("f")).select("image_id", *items(F.col("c"), list("xyz")), *items(F.col("f"), ["fx", "fy", "fz"]))


@query("""SELECT i + 1 AS image_id, round(((CASE WHEN i // 4 % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END) - 1.5) * 10, 6) + 0.0 AS x, round((i // 4 - 1.0) * 10, 6) + 0.0 AS y, CAST(50 AS DOUBLE) AS z FROM range(12) t(i)""")
def survey(spark, folder):
    v = synthetic.survey(spark, 3, 4, 10.0, 50.0)
    return v.select("image_id", poses.center(F.col("pose")).alias("c")).select("image_id", *items(F.col("c"), list("xyz")))


@query("SELECT p_partkey AS id, round(2.0 * (sin(2 * pi() * p_size / 40) * cos(2 * pi() * (p_partkey % 40) / 40)), 6) + 0.0 AS z FROM part")
def terrain_height(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), r(synthetic.terrain_height(F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double"), 2.0, 40.0)).alias("z"))


# -- kernels on generated scenes; unit tests check them against the truth


def _scene(spark: SparkSession, views: int = 8, noise: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    cams = synthetic.default_camera(spark)
    images = synthetic.orbit(spark, views, 60.0, 40.0, arc=100.0)
    points = synthetic.terrain(spark, 500, buildings=2, per_building=100)
    keypoints, observations = synthetic.scene(images, cams, points, noise)
    return cams, images, points, keypoints.cache(), observations


@query("SELECT i + 1 AS image_a, j + 1 AS image_b, true AS enough, true AS true_ones, true AS turned, true AS shifted FROM range(5) a(i), range(5) b(j) WHERE j > i AND j - i <= 2")
def verify_pairs(spark, folder):
    """Of each pair: are there inliers, are they the true matches, and is the relative pose the scene's?"""
    cams, images = synthetic.default_camera(spark), synthetic.orbit(spark, 5, 60.0, 40.0, arc=100.0)
    keypoints, _ = synthetic.scene(images, cams, synthetic.terrain(spark, 500, 40.0, 10.0, 4, 100), 0.3)
    pairs = matching.image_pairs(images, 2)
    matches = matching.simulated_matches(keypoints, pairs, 0.2)
    found = sfm.verify_pairs(matches, keypoints.cache(), images, cams)
    point = lambda s: keypoints.select(F.col("image_id").alias(f"image_{s}"), F.col("kp_idx").alias(f"kp_{s}"), F.col("point3d_id").alias(f"point_{s}"))
    marked = lambda m: m.join(point("a"), ["image_a", "kp_a"]).join(point("b"), ["image_b", "kp_b"]).groupBy("image_a", "image_b").agg(F.sum((F.col("point_a") == F.col("point_b")).cast("int")).alias("true_"), F.count("*").alias("n"))
    kept = marked(found.select("image_a", "image_b", F.explode("inliers").alias("m")).select("image_a", "image_b", "m.*"))
    given = marked(matches).select("image_a", "image_b", F.col("true_").alias("all_true"))
    side = lambda s: images.select(F.col("image_id").alias(f"image_{s}"), F.col("pose").alias(f"pose_{s}"))
    both = found.join(side("a"), "image_a").join(side("b"), "image_b").withColumn("truth", poses.relative(F.col("pose_a"), F.col("pose_b")))
    both = both.join(kept, ["image_a", "image_b"]).join(given, ["image_a", "image_b"])
    return both.select(
        "image_a", "image_b", (F.col("n_inliers") >= 0.9 * F.col("all_true")).alias("enough"), (F.col("true_") >= 0.95 * F.col("n")).alias("true_ones"),
        (poses.angle_deg(F.col("pose.R"), F.col("truth.R")) < 1).alias("turned"), (dot(F.col("pose.t"), F.col("truth.t")) > 0.99 * norm(F.col("truth.t"))).alias("shifted"),
    )


@query("SELECT CAST(1 AS BIGINT) AS cameras, CAST(6 AS BIGINT) AS registered, CAST(6 AS BIGINT) AS images, true AS most_points, true AS long_tracks, true AS close_fit, true AS right_poses, true AS right_centers")
def reconstruct(spark, folder):
    """Growth of a generated scene, held against its truth."""
    cams, images, points, keypoints, _ = _scene(spark, 6)
    model = sfm.reconstruct(matching.simulated_matches(keypoints, matching.image_pairs(images, 3), 0.1), keypoints, images, cams)
    seen = keypoints.filter("point3d_id is not null").groupBy("point3d_id").agg(F.count("*").alias("n")).filter("n >= 2").agg(F.count("*").alias("visible"))
    fit = metrics.rmse(metrics.reprojection(model.observations, model.images, model.cameras, model.points, model.keypoints))
    turned = metrics.relative_pose_errors(model.images, images).agg(F.max("rot_deg").alias("rot"), F.max("trans_deg").alias("trans"))
    path = metrics.trajectory_error(model.images, images).select(F.col("rmse").alias("path"))
    s = metrics.model_summary(model.cameras, model.images, model.points, model.observations).crossJoin(seen).crossJoin(fit).crossJoin(turned).crossJoin(path)  # single rows
    return s.select("cameras", "registered", "images", (F.col("points") >= 0.8 * F.col("visible")).alias("most_points"), (F.col("mean_track") > 2).alias("long_tracks"), (F.col("rmse") < 1).alias("close_fit"), ((F.col("rot") < 0.5) & (F.col("trans") < 2)).alias("right_poses"), (F.col("path") < 0.5).alias("right_centers"))


@query("SELECT true AS far_at_first, true AS close_at_last, true AS all_observations, true AS points_moved_back")
def bundle_adjust(spark, folder):
    """A scene whose points were shifted at random, adjusted over the cluster."""
    cams, images, points, keypoints, observations = _scene(spark, 6)
    shifted = points.withColumns({c: F.col(c) + 0.3 * synthetic.gauss(i, "point_id") for i, c in enumerate("xyz")})
    out, report = sfm.bundle_adjust(Model(cams, images, keypoints, shifted, observations), (1, 2), rounds=6)
    off = out.points.join(observations.select("point_id").distinct(), "point_id").join(points.select("point_id", *[F.col(c).alias(f"t{c}") for c in "xyz"]), "point_id")
    off = off.agg(F.median(F.sqrt(sum((F.col(c) - F.col(f"t{c}")) ** 2 for c in "xyz"))).alias("off"))
    whole = observations.agg(F.count("*").alias("n"))
    return off.crossJoin(whole).select(F.lit(report["initial_rmse"] > 1).alias("far_at_first"), F.lit(report["final_rmse"] < 0.5).alias("close_at_last"), (F.col("n") == report["observations"]).alias("all_observations"), (F.col("off") < 0.2).alias("points_moved_back"))


def _slab_views(spark: SparkSession):
    from .kernels.rigid import Cam

    slabs = [(-8, 2, -6, 4, 8.0), (4, 12, 2, 10, 4.0)]
    cams = synthetic.default_camera(spark, 80, 60, 60.0)
    images = synthetic.survey(spark, 2, 2, 6.0, 40.0)
    cam = Cam.of(cams.first())
    rasters, truth = [], []
    for v in images.collect():
        gray, depth = synthetic.render(cam, (np.array(v["pose"]["R"]).reshape(3, 3), np.array(v["pose"]["t"])), slabs)
        rasters.append((v["image_id"], 60, 80, gray.tobytes()))
        truth.append((v["image_id"], 60, 80, depth.tobytes(), depth.tobytes()))
    return cams, images, spark.createDataFrame(rasters, "image_id long, height int, width int, gray binary"), spark.createDataFrame(truth, mvs.TILE)


@query("SELECT i + 1 AS image_id, true AS mostly_valid, true AS mostly_right FROM range(4) t(i)")
def plane_sweep(spark, folder):
    """Of each view: the share of pixels with a depth, and of these the share within 3 % of the rendered depth."""
    cams, images, rasters, truth = _slab_views(spark)
    points = synthetic.terrain(spark, 300, 30.0, 2.0, 2, 60)
    keypoints, observations = synthetic.scene(images, cams, points)
    model = Model(cams, images, keypoints, points, observations)
    neighbors = matching.view_neighbors(observations, points, images, 3)
    swept = mvs.sweep(model, rasters, neighbors, mvs.Options(sources=3, hypotheses=48))
    both = swept.select("image_id", "depth").join(truth.select("image_id", F.col("depth").alias("true_depth")), "image_id")

    def compared(frames):
        for f in frames:
            rows_ = []
            for t in f.itertuples():
                z, want = (np.frombuffer(b, np.float32) for b in (t.depth, t.true_depth))
                fine = np.isfinite(z) & (z > 0)
                rows_.append((t.image_id, bool(fine.mean() > 0.5), bool((np.abs(z[fine] - want[fine]) < 0.03 * want[fine]).mean() > 0.8)))
            yield pd.DataFrame(rows_, columns=["image_id", "mostly_valid", "mostly_right"])

    return both.mapInPandas(compared, "image_id long, mostly_valid boolean, mostly_right boolean")


@query("SELECT true AS many, true AS on_surfaces, true AS on_roof, true AS on_ground")
def fuse_depths(spark, folder):
    """Rendered depths fused: the points lie on the ground or the slabs' faces."""
    cams, images, _, truth = _slab_views(spark)
    pairs = matching.image_pairs(images)
    both = pairs.union(pairs.select("image_b", "image_a")).toDF("image_id", "neighbor").withColumn("rank", F.lit(1))
    fused = mvs.fuse(truth, images, cams, both)
    near = lambda z: F.abs(F.col("z") - z) < 0.05
    share = lambda c: F.avg(c.cast("double"))
    s = fused.agg(F.count("*").alias("n"), share(near(0) | near(4) | near(8)).alias("surface"), share(near(8)).alias("roof"), share(near(0)).alias("ground"))
    return s.select((F.col("n") > 4 * 60 * 80 // 4).alias("many"), (F.col("surface") > 0.98).alias("on_surfaces"), (F.col("roof") > 0.05).alias("on_roof"), (F.col("ground") > 0.2).alias("on_ground"))


@query("SELECT * FROM (VALUES (CAST(0.1 AS DOUBLE), true, true), (CAST(0.5 AS DOUBLE), true, true)) t(threshold, sound, better)")
def icp_evaluation(spark, folder):
    """A tilted and shifted cloud against its reference, before and after alignment by closest points."""
    truth = synthetic.terrain(spark, 4000, 40.0, 2.0, 0, 0)
    moved = align.move_cloud(synthetic.terrain(spark, 2000, 38.0, 2.0, 0, 0, seed=50), align.Similarity(1.0, align.rotation_to_z(np.array([0.01, 0.0, 1.0])), np.array([0.2, -0.1, 1.0])))
    both = align.evaluate(moved, truth, (0.1, 0.5), largest=3.0, smallest=0.5, rounds=4).groupBy("threshold").pivot("stage", ["before", "after"]).agg(F.first("f_score"))
    return both.select("threshold", F.col("before").between(0, 1).alias("sound"), (F.col("after") >= F.col("before")).alias("better"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Clouds from the tables: crop to the footprint, one mean a voxel, then metrics at three thresholds."""
    a, b = (_dims(spark, folder, k).drop("vec_id") for k in (0, 1))
    kept = spatial.footprint_crop(a, b, 0.05)
    return spatial.geometry_metrics(spatial.voxel_downsample(kept, 0.01).select("x", "y", "z"), b, (0.02, 0.05, 0.1), 0.2)


from . import queries_algebra  # noqa: E402, F401  registers more of them
