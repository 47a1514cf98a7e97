"""More registered queries: one way through each piece of algebra, and joins and aggregates of models.

Each operator is applied to values of the tables, and the SQL states its result in closed form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import cameras, poses
from .functions.linear import at, total, vec
from .operators import frames, matching, metrics
from .plans import mapper
from .queries import items, query, r, rows, table

# -- rotations and poses, by part

_TURNS = "p_size * 0.03 + 0.01 AS a, p_partkey % 30 * 0.1 + 0.05 AS b"


def _z(a):
    """About z: row by row."""
    return vec(F.cos(a), -F.sin(a), 0.0, F.sin(a), F.cos(a), 0.0, 0.0, 0.0, 1.0)


def _zx(a, b):
    """About x by b, then about z by a."""
    return vec(F.cos(a), -F.sin(a) * F.cos(b), F.sin(a) * F.sin(b), F.sin(a), F.cos(a) * F.cos(b), -F.cos(a) * F.sin(b), 0.0, F.sin(b), F.cos(b))


def _turned(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 0.03 + 0.01).alias("a"), (F.col("p_partkey") % 30 * 0.1 + 0.05).alias("b"), F.col("p_size").cast("double").alias("size"))


_NINE = [f"r{i}{j}" for i in range(3) for j in range(3)]


def _sql(columns: dict[str, str], source: str, digits: int = 6) -> str:
    return "SELECT id, " + ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) + 0.0 AS {k}" for k, v in columns.items()) + f" FROM ({source})"


@query(
    _sql(
        dict(zip(_NINE, ("1 - b * (y * y + z * z)", "b * x * y - a * z", "b * x * z + a * y", "b * x * y + a * z", "1 - b * (x * x + z * z)", "b * y * z - a * x", "b * x * z - a * y", "b * y * z + a * x", "1 - b * (x * x + y * y)"), strict=True)),
        "SELECT *, sin(t) / t AS a, (1 - cos(t)) / (t * t) AS b FROM (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM (SELECT p_partkey AS id, (p_size - 25) * 0.04 + 0.003 AS x, (p_partkey % 41 - 20) * 0.05 + 0.002 AS y, (p_partkey % 7) * 0.3 + 0.001 AS z FROM part))",
    )
)
def rotation_of_axis(spark, folder):
    w = vec((F.col("p_size") - 25) * 0.04 + 0.003, (F.col("p_partkey") % 41 - 20) * 0.05 + 0.002, (F.col("p_partkey") % 7) * 0.3 + 0.001)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), poses.exp(w).alias("m")).select("id", *items(F.col("m"), _NINE))


@query(
    _sql(
        {"x": "(sin(b) + cos(a) * sin(b)) * k", "y": "sin(a) * sin(b) * k", "z": "(sin(a) + sin(a) * cos(b)) * k"},
        f"SELECT *, t / (2 * sin(t)) AS k FROM (SELECT *, acos((cos(a) + cos(a) * cos(b) + cos(b) - 1) / 2) AS t FROM (SELECT p_partkey AS id, {_TURNS} FROM part))",
    )
)
def axis_of_rotation(spark, folder):
    return _turned(spark, folder).select("id", poses.log(_zx(F.col("a"), F.col("b"))).alias("w")).select("id", *items(F.col("w"), list("xyz")))


@query(
    _sql(
        dict(zip(_NINE, ("w * w + x * x - y * y - z * z", "2 * (x * y - w * z)", "2 * (x * z + w * y)", "2 * (x * y + w * z)", "w * w - x * x + y * y - z * z", "2 * (y * z - w * x)", "2 * (x * z - w * y)", "2 * (y * z + w * x)", "w * w - x * x - y * y + z * z"), strict=True)),
        "SELECT id, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM (SELECT p_partkey AS id, 1.0 + p_size % 7 AS w, p_size - 20.0 AS x, p_partkey % 11 - 5.0 AS y, p_partkey % 5 - 2.0 AS z FROM part))",
    )
)
def rotation_of_quaternion(spark, folder):
    q = vec(1.0 + F.col("p_size") % 7, F.col("p_size") - 20.0, F.col("p_partkey") % 11 - 5.0, F.col("p_partkey") % 5 - 2.0)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), poses.from_quaternion(q).alias("m")).select("id", *items(F.col("m"), _NINE))


@query(_sql({"w": "cos(a / 2) * cos(b / 2)", "x": "cos(a / 2) * sin(b / 2)", "y": "sin(a / 2) * sin(b / 2)", "z": "sin(a / 2) * cos(b / 2)"}, f"SELECT p_partkey AS id, {_TURNS} FROM part"))
def quaternion_of_rotation(spark, folder):
    return _turned(spark, folder).select("id", poses.to_quaternion(_zx(F.col("a"), F.col("b"))).alias("q")).select("id", *items(F.col("q"), list("wxyz")))


@query(
    _sql(
        {
            "cx": "cos(a) * (id % 3) - sin(a) * 1 + 1", "cy": "sin(a) * (id % 3) + cos(a) * 1 + id % 5", "cz": "id % 7 + 2.0", "c00": "cos(a + b)", "c10": "sin(a + b)",
            "ix": "-(cos(a) * 1 + sin(a) * (id % 5))", "iy": "-(cos(a) * (id % 5) - sin(a) * 1)", "iz": "-2.0", "i10": "-sin(a)", "m03": "1.0", "m13": "CAST(id % 5 AS DOUBLE)", "m33": "1.0",
            "rx": "id % 3 - (cos(b - a) * 1 - sin(b - a) * (id % 5))", "ry": "1 - (sin(b - a) * 1 + cos(b - a) * (id % 5))", "rz": "id % 7 - 2.0",
        },
        f"SELECT p_partkey AS id, {_TURNS} FROM part",
    )
)
def pose_algebra(spark, folder):
    """Composition, inverse, 4x4 matrix and relative pose of two poses that turn about z."""
    k = F.col("id")
    p, q = poses.pose(_z(F.col("a")), vec(1.0, k % 5, 2.0)), poses.pose(_z(F.col("b")), vec(k % 3, 1.0, k % 7))
    s = _turned(spark, folder).select("id", poses.compose(p, q).alias("c"), poses.inverse(p).alias("i"), poses.matrix(p).alias("m"), poses.relative(p, q).alias("r"))
    values = {"c00": at(F.col("c.R"), 0), "c10": at(F.col("c.R"), 3), "i10": at(F.col("i.R"), 3), "m03": at(F.col("m"), 3), "m13": at(F.col("m"), 7), "m33": at(F.col("m"), 15)}
    shifts = [c for n in "cir" for c in items(F.col(f"{n}.t"), [f"{n}{x}" for x in "xyz"])]
    return s.select("id", *shifts, *[r(v).alias(n) for n, v in values.items()])


@query(
    _sql(
        {"x": "s * (cos(a) * (id % 5) - sin(a) * (id % 7)) + 1", "y": "s * (sin(a) * (id % 5) + cos(a) * (id % 7)) + 2", "z": "s * 3 + 3", "r00": "cos(b - a)", "r10": "sin(b - a)"},
        f"SELECT p_partkey AS id, {_TURNS}, 1 + p_size / 50.0 AS s FROM part",
    )
)
def moved_poses(spark, folder):
    """The center and rotation of a pose after its world was scaled, turned and shifted."""
    k = F.col("id")
    p = poses.from_center(_z(F.col("b")), vec(k % 5, k % 7, 3.0))
    moved = _turned(spark, folder).select("id", poses.similarity_pose(1 + F.col("size") / 50.0, _z(F.col("a")), vec(1.0, 2.0, 3.0), p).alias("p"))
    return moved.select("id", *items(poses.center(F.col("p")), list("xyz")), r(at(F.col("p.R"), 0)).alias("r00"), r(at(F.col("p.R"), 3)).alias("r10"))


# -- cameras


@query(
    """SELECT id, CAST(round_even(w * 0.5, 0) AS INTEGER) AS width, CAST(round_even(h * 0.5, 0) AS INTEGER) AS height, round(fx * 0.5, 6) + 0.0 AS fx, round(w / 4.0, 6) + 0.0 AS cx, id % 3 = 0 AS distorted,
round(fx, 6) + 0.0 AS k00, round(w / 2.0, 6) + 0.0 AS k02, round(h / 2.0, 6) + 0.0 AS k12, round(1 / fx, 9) + 0.0 AS i00, round(-w / 2.0 / fx, 6) + 0.0 AS i02, round(-h / 2.0 / fx, 6) + 0.0 AS i12
FROM (SELECT *, 0.5 * w / tan(radians(40 + size) / 2) AS fx FROM (SELECT p_partkey AS id, 600 + p_partkey % 51 AS w, 400 + p_partkey % 31 AS h, p_size AS size FROM part))"""
)
def camera_matrices(spark, folder):
    """A camera by its field of view, halved; its matrix, the matrix's inverse, and whether it distorts."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (600 + F.col("p_partkey") % 51).alias("w"), (400 + F.col("p_partkey") % 31).alias("h"), "p_size")
    c = p.select("id", cameras.from_fov(F.col("w"), F.col("h"), 40 + F.col("p_size")).alias("c"))
    c = c.select("id", "c", cameras.scaled(F.col("c"), 0.5).alias("s"), F.col("c").withField("k1", F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.0)).alias("d"))
    c = c.select("*", cameras.intrinsics(F.col("c")).alias("k"), cameras.inverse_intrinsics(F.col("c")).alias("i"))
    k, i = (lambda n: r(at(F.col("k"), n))), (lambda n, d: r(at(F.col("i"), n), d))
    return c.select("id", "s.width", "s.height", r(F.col("s.fx")).alias("fx"), r(F.col("s.cx")).alias("cx"), cameras.has_distortion(F.col("d")).alias("distorted"), k(0).alias("k00"), k(2).alias("k02"), k(5).alias("k12"), i(0, 9).alias("i00"), i(2, 6).alias("i02"), i(5, 6).alias("i12"))


@query(
    _sql(
        {"x": "cos(a) * (xc - 1) + sin(a) * (yc - 2)", "y": "cos(a) * (yc - 2) - sin(a) * (xc - 1)", "z": "z - 3"},
        f"SELECT *, (id % 640 - 320) / 500.0 * z AS xc, (size * 9 - 240) / 510.0 * z AS yc FROM (SELECT p_partkey AS id, {_TURNS}, p_size AS size, 5.0 + p_partkey % 10 AS z FROM part)",
        5,
    )
)
def back_projection(spark, folder):
    """Pixels with depths to world points."""
    k = F.col("id")
    c, p = cameras.camera(640, 480, 500, 510, 320, 240), poses.pose(_z(F.col("a")), vec(1.0, 2.0, 3.0))
    return _turned(spark, folder).select("id", cameras.unproject(c, p, vec(k % 640, F.col("size") * 9), 5.0 + k % 10).alias("x")).select("id", *items(F.col("x"), list("xyz"), 5))


def _plane() -> str:
    m = [["500 * cos(a)", "-500 * sin(a)", "500 * tx / d + 320 * (1 + 0.1 / d)"], ["500 * sin(a)", "500 * cos(a)", "500 * 0.2 / d + 240 * (1 + 0.1 / d)"], ["0", "0", "1 + 0.1 / d"]]
    h = {}
    for i in range(3):
        x, y, z = m[i]
        h |= {f"r{i}0": f"({x}) / 500.0", f"r{i}1": f"({y}) / 500.0", f"r{i}2": f"({z}) - ({x}) * 320 / 500.0 - ({y}) * 240 / 500.0"}
    return _sql(h, f"SELECT p_partkey AS id, {_TURNS}, 0.1 * (p_partkey % 7) AS tx, 10.0 + p_size AS d FROM part")


@query(_plane())
def plane_homographies(spark, folder):
    c = cameras.camera(640, 480, 500, 500, 320, 240)
    h = cameras.plane_homography(cameras.inverse_intrinsics(c), cameras.intrinsics(c), _z(F.col("a")), vec(0.1 * (F.col("id") % 7), 0.2, 0.1), vec(0.0, 0.0, 1.0), 10.0 + F.col("size"))
    return _turned(spark, folder).select("id", h.alias("h")).select("id", *items(F.col("h"), _NINE))


# -- joins and aggregates of models

_KEYPOINTS = "k AS (SELECT l_linenumber AS image, CAST(l_orderkey AS BIGINT) AS kp, CASE WHEN l_partkey % 5 > 0 THEN l_partkey END AS p FROM lineitem)"


def _keypoints(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_linenumber").cast("long").alias("image_id"), F.col("l_orderkey").cast("long").alias("kp_idx"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey")).alias("point3d_id"))


@query(f"WITH {_KEYPOINTS} SELECT a.kp AS kp_a, b.kp AS kp_b, a.p AS point3d_id FROM k a JOIN k b ON a.image = 5 AND b.image = 7 AND a.p = b.p")
def shared_keypoints(spark, folder):
    return matching.shared_points(_keypoints(spark, folder), 5, 7)


@query(f"WITH {_KEYPOINTS}, m AS (SELECT a.image AS image_a, b.image AS image_b, a.kp AS kp_a, b.kp AS kp_b FROM k a JOIN k b ON a.p = b.p AND b.image IN (a.image + 1, a.image + 2)) SELECT image_a, image_b, count(*) AS n, sum(kp_a) AS sum_a, sum(kp_b) AS sum_b FROM m GROUP BY 1, 2 HAVING count(*) >= 3000")
def true_matches(spark, folder):
    """Matches without wrong ones, of pairs of images that share enough points."""
    k = _keypoints(spark, folder)
    m = matching.simulated_matches(k, matching.image_pairs(k.select("image_id").distinct(), 2), 0.0, 3000)
    return m.groupBy("image_a", "image_b").agg(F.count("*").alias("n"), F.sum("kp_a").alias("sum_a"), F.sum("kp_b").alias("sum_b")).select(F.col("image_a").cast("int").alias("image_a"), F.col("image_b").cast("int").alias("image_b"), "n", "sum_a", "sum_b")


@query("SELECT l_partkey AS point_id, round(avg(l_quantity), 4) + 0.0 AS error FROM lineitem GROUP BY 1")
def point_errors(spark, folder):
    residuals = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_quantity").alias("error"))
    return metrics.point_errors(residuals).select("point_id", r(F.col("error"), 4).alias("error"))


@query(
    """SELECT (SELECT count(*) FROM nation) AS cameras, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 > 0) AS registered, (SELECT count(*) FROM supplier) AS images, (SELECT count(*) FROM part) AS points,
round((SELECT count(*) FROM lineitem) / CAST((SELECT count(*) FROM part) AS DOUBLE), 6) + 0.0 AS mean_track"""
)
def model_summary(spark, folder):
    images = table(spark, folder, "supplier").select(F.when(F.col("s_suppkey") % 4 > 0, poses.identity()).alias("pose"))
    s = metrics.model_summary(table(spark, folder, "nation"), images, table(spark, folder, "part"), table(spark, folder, "lineitem"))
    return s.select("cameras", "registered", "images", "points", *rows(["mean_track"]))


@query(
    """WITH f AS (SELECT DISTINCT l_partkey AS p, l_suppkey * 10 % 97 - p_size AS x, l_suppkey * 10 % 89 - p_retailprice / 100 AS y, 5.0 AS z FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT p, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM f))
SELECT a.p AS point_id, round(degrees(acos(greatest(-1, least(1, min(a.x * b.x + a.y * b.y + a.z * b.z))))), 3) + 0.0 AS angle FROM u a JOIN u b ON a.p = b.p GROUP BY 1"""
)
def widest_angles(spark, folder):
    """The largest angle of two rays to each point."""
    seen = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rays = seen.select(F.col("l_partkey").alias("point_id"), vec(F.col("l_suppkey") * 10 % 97, F.col("l_suppkey") * 10 % 89, 5.0).alias("c"), vec(F.col("p_size"), F.col("p_retailprice") / 100, 0.0).alias("p"))
    return metrics.max_ray_angle(rays).select("point_id", r(F.col("angle"), 3).alias("angle"))


@query("SELECT s_suppkey, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey) AS point_id FROM supplier")
def new_point_ids(spark, folder):
    existing = table(spark, folder, "part").select(F.col("p_partkey").alias("point_id"))
    return metrics.numbered_points(existing, table(spark, folder, "supplier").select("s_suppkey"), ["s_suppkey"]).select("s_suppkey", F.col("point_id").cast("long").alias("point_id"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 12")
def first_frames(spark, folder):
    return frames.first_frames(table(spark, folder, "events"), "user_id", ["ts", "event_id"], 12).select("event_id")


# -- all poses from pairs

_MAPPED = "s_suppkey AS id, s_suppkey * 0.1 AS a, s_suppkey % 7 * 0.2 AS b, s_suppkey * 37 % 101 / 10.0 AS x, s_suppkey * 53 % 89 / 10.0 AS y, s_suppkey * 29 % 61 / 10.0 AS z"
_MAPPED_R = ["cos(a)", "-sin(a) * cos(b)", "sin(a) * sin(b)", "sin(a)", "cos(a) * cos(b)", "-cos(a) * sin(b)", "0", "sin(b)", "cos(b)"]
_BY_FIRST = [" + ".join(f"v.r{3 * i + k} * f.r{3 * j + k}" for k in range(3)) for i in range(3) for j in range(3)]
_FROM_FIRST = [" + ".join(f"f.r{3 * i + k} * (v.{c} - f.{c})" for k, c in enumerate("xyz")) for i in range(3)]


def _mapped_views(spark, folder):
    k = F.col("s_suppkey")
    center = vec(k * 37 % 101 / 10.0, k * 53 % 89 / 10.0, k * 29 % 61 / 10.0)
    return table(spark, folder, "supplier").select(k.alias("id"), poses.from_center(_zx(k * 0.1, k % 7 * 0.2), center).alias("pose"))


@query(
    f"""WITH v AS (SELECT *, {", ".join(f"{e} AS r{i}" for i, e in enumerate(_MAPPED_R))} FROM (SELECT {_MAPPED} FROM supplier)),
s AS (SELECT sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS s FROM v), f AS (SELECT * FROM v ORDER BY id LIMIT 1)
SELECT v.id AS image_id, {", ".join(f"round(({e}) / s, 5) + 0.0 AS {c}" for e, c in zip(_FROM_FIRST, "xyz", strict=True))},
  {", ".join(f"round({e}, 5) + 0.0 AS r{i}" for i, e in enumerate(_BY_FIRST))} FROM v, f, s"""
)
def averaged_poses(spark, folder):
    """Poses of suppliers from pairs of suppliers in an order, of which every tenth is grossly wrong.

    The pairs know no lengths of their shifts; the poses found are the true ones."""
    items_of = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = items_of.withColumnRenamed("l_suppkey", "image_a").join(items_of.withColumnRenamed("l_suppkey", "image_b"), "l_orderkey").filter("image_a < image_b")
    pairs = pairs.groupBy("image_a", "image_b").agg(F.count("*").alias("n_inliers"))
    side = lambda s: _mapped_views(spark, folder).select(F.col("id").alias(f"image_{s}"), F.col("pose").alias(s))
    both = pairs.join(side("a"), "image_a").join(side("b"), "image_b")
    # numbers in plain columns, as there are very many pairs: r of b against a, then t
    r = [total([at(F.col("b.R"), 3 * i + k) * at(F.col("a.R"), 3 * j + k) for k in range(3)]).alias(f"r{3 * i + j}") for i in range(3) for j in range(3)]
    flat = both.select("image_a", "image_b", "n_inliers", *[at(F.col(f"{s}.t"), k).alias(f"{s}{k}") for s in "ab" for k in range(3)], *r)
    flat = flat.select("*", *[(F.col(f"b{i}") - total([F.col(f"r{3 * i + k}") * F.col(f"a{k}") for k in range(3)])).alias(f"t{i}") for i in range(3)])
    wrong = (F.col("image_a") * 7 + F.col("image_b") * 13) % 10 == 0
    flat = flat.select("*", F.when(wrong, math.cos(1.0)).otherwise(1.0).alias("c"), F.when(wrong, math.sin(1.0)).otherwise(0.0).alias("s"), F.try_divide(F.when(wrong, -1.0).otherwise(1.0), F.sqrt(total([F.col(f"t{k}") * F.col(f"t{k}") for k in range(3)]))).alias("u"))
    given_r = [*(F.col("c") * F.col(f"r{k}") - F.col("s") * F.col(f"r{3 + k}") for k in range(3)), *(F.col("s") * F.col(f"r{k}") + F.col("c") * F.col(f"r{3 + k}") for k in range(3)), *(F.col(f"r{k}") for k in (6, 7, 8))]
    given = poses.pose(vec(*given_r), vec(*[F.col("u") * F.col(f"t{k}") for k in range(3)]))
    found = mapper.averaged(flat.select("image_a", "image_b", "n_inliers", given.alias("pose")), close=1e-9)
    return found.select("image_id", *items(poses.center(F.col("pose")), list("xyz"), 5), *items(F.col("pose.R"), [f"r{i}" for i in range(9)], 5))
