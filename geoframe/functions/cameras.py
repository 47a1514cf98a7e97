"""Cameras (structs of width, height, fx, fy, cx, cy, k1, k2), projection and two-view residuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import poses
from .linear import Number, at, bound, col, divide, dot, let, matmul, matvec, minus, norm, plus, safe_acos, transpose, vec

FIELDS = ("width", "height", "fx", "fy", "cx", "cy", "k1", "k2")
TYPE = "struct<width:int,height:int,fx:double,fy:double,cx:double,cy:double,k1:double,k2:double>"
UNDISTORT_ROUNDS = 20


def camera(width: Number, height: Number, fx: Number, fy: Number, cx: Number, cy: Number, k1: Number = 0.0, k2: Number = 0.0) -> Column:
    values = (width, height, fx, fy, cx, cy, k1, k2)
    return F.struct(*[col(v).cast("int" if n in ("width", "height") else "double").alias(n) for n, v in zip(FIELDS, values, strict=True)])


def from_fov(width: Number, height: Number, degrees: Number) -> Column:
    f = 0.5 * col(width) / F.tan(F.radians(col(degrees)) / 2)
    return camera(width, height, f, f, col(width) / 2, col(height) / 2)


def intrinsics(c: Column) -> Column:
    return vec(c["fx"], 0.0, c["cx"], 0.0, c["fy"], c["cy"], 0.0, 0.0, 1.0)


def inverse_intrinsics(c: Column) -> Column:
    return vec(1 / c["fx"], 0.0, -c["cx"] / c["fx"], 0.0, 1 / c["fy"], -c["cy"] / c["fy"], 0.0, 0.0, 1.0)


def has_distortion(c: Column) -> Column:
    return (c["k1"] != 0) | (c["k2"] != 0)


def scaled(c: Column, f: Number) -> Column:
    """Sizes are rounded half to even."""
    return camera(F.bround(c["width"] * col(f)), F.bround(c["height"] * col(f)), c["fx"] * col(f), c["fy"] * col(f), c["cx"] * col(f), c["cy"] * col(f), c["k1"], c["k2"])


def _factor(c: Column, xy: Column) -> Column:
    return let(dot(xy, xy, 2), lambda r2: 1 + c["k1"] * r2 + c["k2"] * r2 * r2)


@bound
def distort(c: Column, xy: Column) -> Column:
    return let(xy, lambda p: let(_factor(c, p), lambda d: vec(at(p, 0) * d, at(p, 1) * d)))


def undistort(c: Column, xy: Column, rounds: int = UNDISTORT_ROUNDS) -> Column:
    """Fixed point of xy = distorted / factor(xy), a fixed number of rounds."""
    return let(xy, lambda start: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: let(_factor(c, p), lambda d: vec(divide(at(start, 0), d), divide(at(start, 1), d)))))


@bound
def to_pixel(c: Column, xy: Column) -> Column:
    return let(distort(c, xy), lambda p: vec(c["fx"] * at(p, 0) + c["cx"], c["fy"] * at(p, 1) + c["cy"]))


@bound
def to_normalized(c: Column, uv: Column) -> Column:
    return undistort(c, vec((at(uv, 0) - c["cx"]) / c["fx"], (at(uv, 1) - c["cy"]) / c["fy"]))


@bound
def project(c: Column, p: Column, x: Column) -> Column:
    """Struct of uv and z; points behind the camera have meaningless pixels."""
    return let(poses.apply(p, x), lambda v: F.struct(to_pixel(c, vec(divide(at(v, 0), at(v, 2)), divide(at(v, 1), at(v, 2)))).alias("uv"), at(v, 2).alias("z")))


@bound
def unproject(c: Column, p: Column, uv: Column, z: Column) -> Column:
    return let(to_normalized(c, uv), lambda n: matvec(transpose(p["R"]), minus(vec(at(n, 0) * z, at(n, 1) * z, z), p["t"])))


@bound
def reprojection_error(c: Column, p: Column, x: Column, uv: Column) -> Column:
    return let(project(c, p, x), lambda s: F.hypot(at(s["uv"], 0) - at(uv, 0), at(s["uv"], 1) - at(uv, 1)))


@bound
def apply_homography(h: Column, xy: Column) -> Column:
    return let(matvec(h, vec(at(xy, 0), at(xy, 1), 1.0)), lambda v: vec(divide(at(v, 0), at(v, 2)), divide(at(v, 1), at(v, 2))))


@bound
def transfer_error(h: Column, h_inverse: Column, a: Column, b: Column) -> Column:
    """Half the forward plus half the backward distance."""
    forward = let(minus(apply_homography(h, a), b, 2), lambda d: norm(d, 2))
    backward = let(minus(apply_homography(h_inverse, b), a, 2), lambda d: norm(d, 2))
    return 0.5 * (forward + backward)


@bound
def sampson(f: Column, a: Column, b: Column) -> Column:
    """Distance of a pair from the epipolar constraint (not squared)."""
    one, two = vec(at(a, 0), at(a, 1), 1.0), vec(at(b, 0), at(b, 1), 1.0)

    def body(s: Column) -> Column:
        below = at(s["l"], 0) ** 2 + at(s["l"], 1) ** 2 + at(s["m"], 0) ** 2 + at(s["m"], 1) ** 2
        return divide(F.abs(dot(two, s["l"])), F.sqrt(below))

    return let(F.struct(matvec(f, one).alias("l"), matvec(transpose(f), two).alias("m")), body)


@bound
def ray_angle_deg(c1: Column, c2: Column, x: Column) -> Column:
    """Angle in which two camera centers see a point."""
    return let(F.struct(minus(c1, x).alias("a"), minus(c2, x).alias("b")), lambda s: F.degrees(safe_acos(divide(dot(s["a"], s["b"]), norm(s["a"]) * norm(s["b"])))))


@bound
def plane_homography(k_ref_inverse: Column, k_src: Column, r: Column, t: Column, normal: Column, distance: Column) -> Column:
    """Reference pixels to source pixels by the plane normal . x = distance."""
    inner = vec(*[at(r, 3 * i + j) + at(t, i) * at(normal, j) / distance for i in range(3) for j in range(3)])
    return let(inner, lambda m: let(matmul(k_src, m), lambda km: matmul(km, k_ref_inverse)))


def model_parameters(model: Column, width: Column, height: Column, p: Column) -> Column:
    """A camera from a model name and its parameters; unknown names raise an error."""
    g = lambda i: F.get(p, F.lit(i))
    cases = {
        "SIMPLE_PINHOLE": camera(width, height, g(0), g(0), g(1), g(2)),
        "PINHOLE": camera(width, height, g(0), g(1), g(2), g(3)),
        "SIMPLE_RADIAL": camera(width, height, g(0), g(0), g(1), g(2), g(3)),
        "RADIAL": camera(width, height, g(0), g(0), g(1), g(2), g(3), g(4)),
        "OPENCV": camera(width, height, g(0), g(1), g(2), g(3), g(4), g(5)),
    }
    out = None
    for name, made in cases.items():
        out = F.when(model == name, made) if out is None else out.when(model == name, made)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown camera model "), model)).cast(TYPE))


def model_of(c: Column) -> Column:
    """Struct of the model's name and parameters to write a camera with."""
    pinhole = F.struct(F.lit("PINHOLE").alias("model"), vec(c["fx"], c["fy"], c["cx"], c["cy"]).alias("params"))
    radial = F.struct(F.lit("RADIAL").alias("model"), vec(c["fx"], c["cx"], c["cy"], c["k1"], c["k2"]).alias("params"))
    full = F.struct(F.lit("OPENCV").alias("model"), vec(c["fx"], c["fy"], c["cx"], c["cy"], c["k1"], c["k2"], 0.0, 0.0).alias("params"))
    return F.when(~has_distortion(c), pinhole).when(c["fx"] == c["fy"], radial).otherwise(full)


def root_sift(v: Column, eps: float = 1e-8) -> Column:
    """Square roots of the shares of the sum of absolute values."""
    return let(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), lambda s: F.transform(v, lambda x: F.sqrt(x.cast("double") / (s + eps))))


def required_iterations(share: Column, sample: int, confidence: float) -> Column:
    """Draws until one is free of outliers with the given confidence, at most 1e9."""
    cap = F.lit(10**9).cast("long")
    below = F.log1p(-F.pow(share, F.lit(sample)))
    wanted = F.ceil(F.try_divide(F.log1p(F.lit(-confidence)), below))
    return F.when(share >= 1, F.lit(1).cast("long")).when((share <= 0) | (below == 0), cap).otherwise(F.least(wanted.cast("long"), cap))


@bound
def lift(p: Column, x: Column) -> Column:
    return plus(matvec(transpose(p["R"]), x), poses.center(p))
