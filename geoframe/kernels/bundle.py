"""Bundle adjustment by damped least squares; points are eliminated block by block.

``part`` linearizes a set of points and returns what they add to the reduced system of the
cameras, so parts can be computed anywhere and added up; ``move`` puts a camera step back into
the points of a part."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .resection import point_jacobian, soft_cost, soft_weights
from .rigid import Cam, closest_rotation, pixels, rotation, skew


@dataclass
class Views:
    """Cameras and poses of all images, and which are free (-1: fixed)."""

    cams: list[Cam]
    R: np.ndarray
    t: np.ndarray
    free: np.ndarray

    def moved(self, step: np.ndarray) -> Views:
        r, t = self.R.copy(), self.t.copy()
        for i in np.flatnonzero(self.free >= 0):
            d = step[6 * self.free[i] : 6 * self.free[i] + 6]
            r[i] = closest_rotation(rotation(d[:3]) @ r[i])
            t[i] = t[i] + d[3:]
        return Views(self.cams, r, t, self.free)


@dataclass
class Observations:
    """Arrays: image (index into views), point (index into points) and pixel."""

    image: np.ndarray
    point: np.ndarray
    uv: np.ndarray


def errors(v: Views, points: np.ndarray, o: Observations) -> tuple[np.ndarray, np.ndarray]:
    """Camera-frame points and pixel residuals."""
    seen = np.einsum("nij,nj->ni", v.R[o.image], points[o.point]) + v.t[o.image]
    seen[:, 2] = np.where(np.abs(seen[:, 2]) < 1e-9, 1e-9, seen[:, 2])
    e = np.empty((len(seen), 2))
    for k in np.unique(o.image):
        at = o.image == k
        e[at] = pixels(v.cams[k], seen[at]) - o.uv[at]
    return seen, e


def cost(v: Views, points: np.ndarray, o: Observations, scale: float) -> float:
    return soft_cost((errors(v, points, o)[1] ** 2).sum(1), scale)


def _blocks(v: Views, points: np.ndarray, o: Observations, scale: float):
    seen, e = errors(v, points, o)
    jp = np.empty((len(seen), 2, 3))
    for k in np.unique(o.image):
        at = o.image == k
        jp[at] = point_jacobian(v.cams[k], seen[at])
    w = np.sqrt(soft_weights((e**2).sum(1), scale))[:, None]
    jc = np.concatenate([jp @ -skew(seen - v.t[o.image]), jp], axis=2) * w[..., None]
    jx = jp @ v.R[o.image] * w[..., None]
    jc[v.free[o.image] < 0] = 0
    return jc, jx, e * w


#: Free views up to which the reduced system is solved as one matrix.
DENSE = 300


@dataclass
class Reduced:
    """The cameras' reduced system: 6x6 blocks of the pairs of free views that see a point in common, and the right side."""

    n: int
    key: np.ndarray  # n * row + column, ascending, each once
    block: np.ndarray
    g: np.ndarray

    @classmethod
    def of(cls, n: int, key: np.ndarray, block: np.ndarray, g: np.ndarray) -> Reduced:
        """Adds up blocks that have one key."""
        every, at = np.unique(key, return_inverse=True)
        out = np.zeros((len(every), 6, 6))
        np.add.at(out, at, block)
        return cls(n, every, out, g)

    def matrix(self) -> np.ndarray:
        h = np.zeros((self.n * self.n, 6, 6))
        h[self.key] = self.block
        return h.reshape(self.n, self.n, 6, 6).transpose(0, 2, 1, 3).reshape(6 * self.n, 6 * self.n)

    def solved(self, rounds: int = 500, close: float = 1e-10) -> np.ndarray:
        """The step: by least squares of the whole matrix or, for many views, by conjugate gradients
        over the blocks, with the inverse diagonal blocks as preconditioner."""
        if self.n <= DENSE:
            return np.linalg.lstsq(self.matrix(), self.g.ravel(), rcond=None)[0] if self.n else self.g.ravel()
        i, j = np.divmod(self.key, self.n)
        diagonal = np.tile(np.eye(6) * 1e-12, (self.n, 1, 1))
        diagonal[i[i == j]] += self.block[i == j]
        inverse = np.linalg.inv(diagonal)
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])  # keys ascend, so rows are runs

        def times(x: np.ndarray) -> np.ndarray:
            out = np.zeros_like(x)
            out[i[starts]] = np.add.reduceat(np.einsum("kab,kb->ka", self.block, x[j]), starts)
            return out

        x, rest = np.zeros((self.n, 6)), self.g.reshape(self.n, 6).copy()
        z = np.einsum("nab,nb->na", inverse, rest)
        way, size = z, (rest * z).sum()
        stop = close * size
        for _ in range(rounds):
            if not size > stop:
                break
            ahead = times(way)
            length = size / (way * ahead).sum()
            x, rest = x + length * way, rest - length * ahead
            z = np.einsum("nab,nb->na", inverse, rest)
            new = (rest * z).sum()
            way, size = z + new / size * way, new
        return x.ravel()


def part(v: Views, points: np.ndarray, o: Observations, scale: float, damping: float, fixed_points: bool = False):
    """What some points add to the reduced camera system, and what ``move`` needs."""
    n = int(v.free.max(initial=-1)) + 1
    jc, jx, e = _blocks(v, points, o, scale)
    free = np.maximum(v.free[o.image], 0)
    g = np.zeros((n, 6))
    keys, blocks = [], []
    if n:
        own = np.einsum("nij,nik->njk", jc, jc)
        k = np.arange(6)
        own[:, k, k] += damping * np.einsum("nii->ni", own)
        keys += [free * n + free, np.arange(n) * n + np.arange(n)]
        blocks += [own, np.tile(1e-12 * np.eye(6), (n, 1, 1))]
        np.add.at(g, free, -np.einsum("nij,ni->nj", jc, e))
    back = None
    if not fixed_points:
        m = len(points)
        hx, gx = np.zeros((m, 3, 3)), np.zeros((m, 3))
        np.add.at(hx, o.point, np.einsum("nij,nik->njk", jx, jx))
        np.add.at(gx, o.point, -np.einsum("nij,ni->nj", jx, e))
        k = np.arange(3)
        hx[:, k, k] += damping * np.einsum("nii->ni", hx) + 1e-12
        inverse = np.linalg.inv(hx)
        mixed = np.einsum("nij,nik->njk", jc, jx)
        y = np.einsum("nij,njk->nik", mixed, inverse[o.point])
        if n and len(o.point):
            np.add.at(g, free, -np.einsum("nij,nj->ni", y, gx[o.point]))
            order = np.argsort(o.point, kind="stable")
            counts = np.bincount(o.point, minlength=m)
            first = np.cumsum(counts) - counts
            for size in np.unique(counts[counts > 0]):  # points with as many views are one stack
                at = order[first[counts == size][:, None] + np.arange(size)]
                keys.append((free[at][:, :, None] * n + free[at][:, None, :]).ravel())
                blocks.append(-np.einsum("paij,pbkj->pabik", y[at], mixed[at]).reshape(-1, 6, 6))
        back = (inverse, gx, mixed)
    empty = (np.zeros(0, np.int64), np.zeros((0, 6, 6)))
    return Reduced.of(n, *((np.concatenate(keys), np.concatenate(blocks)) if keys else empty), g), back


def move(v: Views, points: np.ndarray, o: Observations, back, step: np.ndarray) -> np.ndarray:
    if back is None:
        return points
    inverse, gx, mixed = back
    right = gx.copy()
    if len(step):
        d = step.reshape(-1, 6)[np.maximum(v.free[o.image], 0)] * (v.free[o.image] >= 0)[:, None]
        np.add.at(right, o.point, -np.einsum("nij,ni->nj", mixed, d))
    return points + np.einsum("nij,nj->ni", inverse, right)


def stages(rmse: float, scale: float) -> list[float]:
    """Loss scales, a wide one first where the start is far off."""
    return [3 * rmse, scale] if rmse > 3 * scale else [scale]


def adjust(v: Views, points: np.ndarray, o: Observations, scale: float = 1.0, rounds: int = 50, fixed_points: bool = False) -> tuple[Views, np.ndarray, int]:
    """Views and points after adjustment, and the number of rounds."""
    if not len(o.image):
        return v, points, 0
    rmse = float(np.sqrt((errors(v, points, o)[1] ** 2).sum(1).mean()))
    used = 0
    for s in stages(rmse, scale):
        now, damping = cost(v, points, o, s), 1e-4
        for _ in range(rounds):
            used += 1
            system, back = part(v, points, o, s, damping, fixed_points)
            step = system.solved()
            trial, trial_points = v.moved(step), move(v, points, o, back, step)
            new = cost(trial, trial_points, o, s)
            if np.isfinite(new) and new < now:
                done = now - new < 1e-7 * now
                v, points, now, damping = trial, trial_points, new, max(damping / 5, 1e-9)
                if done:
                    break
            else:
                damping *= 8
                if damping > 1e6:
                    break
    return v, points, used
