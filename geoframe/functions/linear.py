"""Small vectors and matrices as array columns (matrices row by row)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | int | Column


def col(v: Number) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def vec(*items: Number) -> Column:
    return F.array(*[col(v).cast("double") for v in items])


def const(values: Sequence[float]) -> Column:
    return vec(*[float(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Computes column arguments once, however often the body uses them; else nested calls grow
    the expression exponentially."""

    @functools.wraps(f)
    def run(*args, **options):
        given = {f"a{i}": v for i, v in enumerate(args) if isinstance(v, Column)}
        if not given:
            return f(*args, **options)
        body = lambda s: f(*[s[f"a{i}"] if isinstance(v, Column) else v for i, v in enumerate(args)], **options)
        return let(F.struct(*[v.alias(k) for k, v in given.items()]), body)

    return run


def at(a: Column, i: int) -> Column:
    return a.getItem(i)


def total(items: Sequence[Column]) -> Column:
    out = items[0]
    for v in items[1:]:
        out = out + v
    return out


@bound
def dot(a: Column, b: Column, n: int = 3) -> Column:
    return total([at(a, i) * at(b, i) for i in range(n)])


@bound
def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(total([at(a, i) * at(a, i) for i in range(n)]))


@bound
def cross(a: Column, b: Column) -> Column:
    return vec(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)])


@bound
def plus(a: Column, b: Column, n: int = 3) -> Column:
    return vec(*[at(a, i) + at(b, i) for i in range(n)])


@bound
def minus(a: Column, b: Column, n: int = 3) -> Column:
    return vec(*[at(a, i) - at(b, i) for i in range(n)])


@bound
def scale(a: Column, s: Number, n: int = 3) -> Column:
    return vec(*[at(a, i) * col(s) for i in range(n)])


@bound
def matvec(m: Column, v: Column, rows: int = 3, cols: int = 3) -> Column:
    return vec(*[total([at(m, r * cols + k) * at(v, k) for k in range(cols)]) for r in range(rows)])


@bound
def matmul(a: Column, b: Column) -> Column:
    return vec(*[total([at(a, 3 * r + k) * at(b, 3 * k + c) for k in range(3)]) for r in range(3) for c in range(3)])


@bound
def transpose(m: Column) -> Column:
    return vec(*[at(m, 3 * c + r) for r in range(3) for c in range(3)])


def trace(m: Column) -> Column:
    return at(m, 0) + at(m, 4) + at(m, 8)


def divide(a: Column, b: Column) -> Column:
    """a / b, with an infinity of a's sign (NaN for 0 / 0) where b is 0, as in floating point."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan"))))


def safe_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
