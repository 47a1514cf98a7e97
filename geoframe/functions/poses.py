"""Rotations and world-to-camera poses.  A pose is a struct of R (nine numbers) and t (three)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linear import Number, at, bound, col, const, cross, divide, dot, let, matmul, matvec, minus, norm, plus, safe_acos, scale, trace, transpose, vec

EYE = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def pose(r: Column, t: Column) -> Column:
    return F.struct(r.alias("R"), t.alias("t"))


def identity() -> Column:
    return pose(const(EYE), const((0, 0, 0)))


def from_center(r: Column, center: Column) -> Column:
    return let(r, lambda m: pose(m, scale(matvec(m, center), -1.0)))


@bound
def from_matrix(m: Column) -> Column:
    """From a 3x4 or 4x4 matrix, row by row."""
    return pose(vec(*[at(m, 4 * i + k) for i in range(3) for k in range(3)]), vec(*[at(m, 4 * i + 3) for i in range(3)]))


def is_registered(p: Column) -> Column:
    return p.isNotNull()


@bound
def center(p: Column) -> Column:
    return scale(matvec(transpose(p["R"]), p["t"]), -1.0)


@bound
def matrix(p: Column) -> Column:
    """4x4."""
    rows = [v for i in range(3) for v in (*[at(p["R"], 3 * i + k) for k in range(3)], at(p["t"], i))]
    return vec(*rows, 0.0, 0.0, 0.0, 1.0)


@bound
def projection(k: Column, p: Column) -> Column:
    """3x4 matrix K [R | t]."""
    return let(matmul(k, p["R"]), lambda kr: let(matvec(k, p["t"]), lambda kt: vec(*[v for i in range(3) for v in (*[at(kr, 3 * i + j) for j in range(3)], at(kt, i))])))


@bound
def inverse(p: Column) -> Column:
    return pose(transpose(p["R"]), center(p))


@bound
def compose(a: Column, b: Column) -> Column:
    """b first, then a."""
    return pose(matmul(a["R"], b["R"]), plus(matvec(a["R"], b["t"]), a["t"]))


@bound
def apply(p: Column, x: Column) -> Column:
    return plus(matvec(p["R"], x), p["t"])


@bound
def relative(reference: Column, source: Column) -> Column:
    """Takes coordinates of the reference camera to those of the source camera."""
    return let(matmul(source["R"], transpose(reference["R"])), lambda r: pose(r, minus(source["t"], matvec(r, reference["t"]))))


@bound
def hat(w: Column) -> Column:
    zero = F.lit(0.0)
    return vec(zero, -at(w, 2), at(w, 1), at(w, 2), zero, -at(w, 0), -at(w, 1), at(w, 0), zero)


def exp(w: Column) -> Column:
    """Rotation of an axis-angle vector; series for angles under 1e-8."""

    def body(k: Column, a: Column, b: Column) -> Column:
        k2 = matmul(k, k)
        return vec(*[F.lit(float(EYE[i])) + a * at(k, i) + b * at(k2, i) for i in range(9)])

    small = lambda t: t < 1e-8
    a = lambda t: F.when(small(t), 1 - t * t / 6).otherwise(divide(F.sin(t), t))
    b = lambda t: F.when(small(t), 0.5 - t * t / 24).otherwise(divide(1 - F.cos(t), t * t))
    return let(w, lambda v: let(norm(v), lambda t: let(hat(v), lambda k: let(F.struct(a(t).alias("a"), b(t).alias("b")), lambda c: body(k, c["a"], c["b"])))))


def log(r: Column) -> Column:
    """Axis-angle vector of a rotation; near a half turn the axis comes from the symmetric part."""

    def half_turn(m: Column, c: Column, theta: Column, v: Column) -> Column:
        outer = vec(*[((at(m, 3 * i + k) + at(m, 3 * k + i)) / 2 - (c if i == k else F.lit(0.0))) / (1 - c) for i in range(3) for k in range(3)])

        def axis(o: Column) -> Column:
            columns = [vec(*[at(o, 3 * k + i) for k in range(3)]) for i in range(3)]
            d = [at(o, 4 * i) for i in range(3)]
            best = F.when((d[0] >= d[1]) & (d[0] >= d[2]), columns[0]).when(d[1] >= d[2], columns[1]).otherwise(columns[2])
            return let(best, lambda u: let(scale(u, divide(F.lit(1.0), norm(u))), lambda n: scale(n, F.when(dot(n, v) < 0, -theta).otherwise(theta))))

        return let(outer, axis)

    def body(m: Column) -> Column:
        v = vec(at(m, 7) - at(m, 5), at(m, 2) - at(m, 6), at(m, 3) - at(m, 1))
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace(m) - 1) / 2))

        def cases(s: Column) -> Column:
            theta = s["theta"]
            return (
                F.when(theta < 1e-8, scale(s["v"], 0.5 + theta * theta / 12))
                .when(math.pi - theta < 1e-3, half_turn(m, s["c"], theta, s["v"]))
                .otherwise(scale(s["v"], divide(theta, 2 * F.sin(theta))))
            )

        return let(F.struct(v.alias("v"), c.alias("c"), F.acos(c).alias("theta")), cases)

    return let(r, body)


@bound
def angle_deg(a: Column, b: Column) -> Column:
    """Angle between two rotations in degrees."""
    inner = dot(a, b, 9)  # trace of the transpose of a times b
    return F.degrees(safe_acos((inner - 1) / 2))


def from_quaternion(q: Column) -> Column:
    """(w, x, y, z), of any length but zero."""

    def body(u: Column) -> Column:
        w, x, y, z = (at(u, i) for i in range(4))
        return vec(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(scale(q, divide(F.lit(1.0), norm(q, 4)), 4), body)


def to_quaternion(r: Column) -> Column:
    """(w, x, y, z) with w >= 0, by the largest of the four squares."""

    def body(m: Column) -> Column:
        a = [at(m, i) for i in range(9)]
        squares = [1 + a[0] + a[4] + a[8], 1 + a[0] - a[4] - a[8], 1 - a[0] + a[4] - a[8], 1 - a[0] - a[4] + a[8]]
        terms = [
            (squares[0], a[7] - a[5], a[2] - a[6], a[3] - a[1]),
            (a[7] - a[5], squares[1], a[1] + a[3], a[2] + a[6]),
            (a[2] - a[6], a[1] + a[3], squares[2], a[5] + a[7]),
            (a[3] - a[1], a[2] + a[6], a[5] + a[7], squares[3]),
        ]
        rows = [vec(*t) for t in terms]
        top = F.greatest(*squares)
        best = F.when(squares[0] == top, rows[0]).when(squares[1] == top, rows[1]).when(squares[2] == top, rows[2]).otherwise(rows[3])
        return let(best, lambda v: let(scale(v, divide(F.lit(1.0), norm(v, 4)), 4), lambda q: F.when(at(q, 0) < 0, scale(q, -1.0, 4)).otherwise(q)))

    return let(r, body)


def look_at(eye: Column, target: Column, up: Column) -> Column:
    """World-to-camera pose that looks from ``eye`` to ``target``; x right, y down, z forward.
    Where the view is nearly along ``up`` the image's up is +y."""

    def with_forward(f: Column) -> Column:
        guide = F.when(F.abs(dot(f, up)) < 0.99, up).otherwise(const((0, 1, 0)))

        def with_right(x: Column) -> Column:
            y = cross(f, x)
            return from_center(vec(*[at(x, i) for i in range(3)], *[at(y, i) for i in range(3)], *[at(f, i) for i in range(3)]), eye)

        return let(cross(f, guide), lambda u: let(scale(u, divide(F.lit(1.0), norm(u))), with_right))

    return let(minus(target, eye), lambda d: let(scale(d, divide(F.lit(1.0), norm(d))), with_forward))


def similarity_point(s: Number, r: Column, t: Column, x: Column) -> Column:
    return plus(scale(matvec(r, x), col(s)), t)


@bound
def similarity_pose(s: Number, r: Column, t: Column, p: Column) -> Column:
    """The pose after the world was moved by x' = s R x + t."""
    return from_center(matmul(p["R"], transpose(r)), similarity_point(s, r, t, center(p)))
