"""Corners of an image, and where they are in another."""

from __future__ import annotations

import numpy as np

from .stereo import box_mean, sampled

#: Corners at most, their least strength against the strongest, and their least distance.
CORNERS, QUALITY, APART = 400, 0.01, 7
#: Window, coarser levels, rounds at a level, and the step (pixels) that ends them.
WINDOW, LEVELS, ROUNDS, STEP = 21, 3, 30, 0.01


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives along x and y, smoothed across, borders mirrored."""
    g = np.pad(np.asarray(gray, float), 1, mode="symmetric")
    across, down = g[:, 2:] - g[:, :-2], g[2:] - g[:-2]
    return (across[:-2] + 2 * across[1:-1] + across[2:]) / 8, (down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]) / 8


def corners(gray: np.ndarray, most: int = CORNERS) -> np.ndarray:
    """(x, y) of the pixels whose structure tensor has the largest least eigenvalues: local maxima,
    from the strongest on, none nearer than APART to one before."""
    dx, dy = gradients(gray)
    xx, yy, xy = (box_mean(m, 3) for m in (dx * dx, dy * dy, dx * dy))
    strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    around = np.pad(strength, 1, constant_values=-np.inf)
    h, w = strength.shape
    top = np.max([around[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    y, x = np.nonzero((strength >= top) & (strength > max(QUALITY * strength.max(initial=0), 1e-12)))
    order = np.argsort(-strength[y, x], kind="stable")
    free, out = np.ones((h, w), bool), []
    far = np.arange(-APART + 1, APART)
    disc = np.argwhere(far[:, None] ** 2 + far[None] ** 2 < APART**2) - (APART - 1)
    for i, j in zip(y[order], x[order], strict=True):
        if free[i, j]:
            out.append((j, i))
            if len(out) == most:
                break
            near = disc + (i, j)
            near = near[((near >= 0) & (near < (h, w))).all(1)]
            free[near[:, 0], near[:, 1]] = False
    return np.array(out, float).reshape(-1, 2)


def halved(gray: np.ndarray) -> np.ndarray:
    """Every second pixel of the smoothed image."""
    taps = np.array([1, 4, 6, 4, 1]) / 16
    g = np.pad(gray, 2, mode="symmetric")
    g = sum(t * g[i : i + gray.shape[0]] for i, t in enumerate(taps))
    return sum(t * g[:, i : i + gray.shape[1]] for i, t in enumerate(taps))[::2, ::2]


def tracked(a: np.ndarray, b: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifts of the points from a to b, from coarse to fine, and which were found.  All points of a
    level move together; each solves the two equations of its window again and again."""
    levels = [(np.asarray(a, float), np.asarray(b, float))]
    while len(levels) <= LEVELS and min(levels[-1][0].shape) > WINDOW:
        levels.append(tuple(halved(g) for g in levels[-1]))
    shift, found = np.zeros_like(points), np.ones(len(points), bool)
    oy, ox = np.mgrid[: WINDOW, : WINDOW] - WINDOW // 2
    for level in reversed(range(len(levels))):
        here, there = levels[level]
        shift = 2 * shift if level < len(levels) - 1 else shift
        at = points / 2**level
        x, y = at[:, 0, None, None] + ox, at[:, 1, None, None] + oy
        want, inside = sampled(here, x, y)
        gx, gy = (np.where(inside, sampled(g, x, y)[0], 0.0) for g in gradients(here))
        xx, yy, xy = ((m).sum((1, 2)) for m in (gx * gx, gy * gy, gx * gy))
        det = xx * yy - xy * xy
        solvable = det > 1e-12
        moving = solvable.copy()
        for _ in range(ROUNDS):
            k = np.flatnonzero(moving)
            if not len(k):
                break
            got, seen = sampled(there, x[k] + shift[k, 0, None, None], y[k] + shift[k, 1, None, None])
            off = np.where(seen & inside[k], want[k] - got, 0.0)
            ex, ey = (off * gx[k]).sum((1, 2)), (off * gy[k]).sum((1, 2))
            step = np.stack([yy[k] * ex - xy[k] * ey, xx[k] * ey - xy[k] * ex], axis=1) / det[k, None]
            shift[k] += step
            moving[k] = np.hypot(*step.T) >= STEP
        found &= solvable if level == 0 else True
    end = points + shift
    return shift, found & np.isfinite(shift).all(1) & (end >= 0).all(1) & (end <= np.array(a.shape[::-1]) - 1).all(1)


def displacement(a: np.ndarray, b: np.ndarray, most: int = CORNERS) -> float:
    """The median shift (pixels) of the corners of a that are found in b; 0 without any."""
    points = corners(a, most)
    shift, found = tracked(a, b, points) if len(points) else (points, np.zeros(0, bool))
    return float(np.median(np.hypot(*shift[found].T))) if found.any() else 0.0
