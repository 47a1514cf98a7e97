"""Warping, windowed correlation and plane sweep."""

from __future__ import annotations

import numpy as np

from .rigid import Cam


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values at pixel coordinates (centers at whole numbers), and where all four
    neighbours that count lie in the image."""
    h, w = image.shape[:2]
    fine = np.isfinite(x) & np.isfinite(y) & (x >= -1e-3) & (y >= -1e-3) & (x <= w - 1 + 1e-3) & (y <= h - 1 + 1e-3)
    x, y = np.clip(np.where(fine, x, 0), 0, w - 1), np.clip(np.where(fine, y, 0), 0, h - 1)
    i, j = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    a, b = y - i, x - j
    if image.ndim == 3:
        a, b = a[..., None], b[..., None]
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    out = (image[i, j] * (1 - b) + image[i, j1] * b) * (1 - a) + (image[i1, j] * (1 - b) + image[i1, j1] * b) * a
    return np.where(fine if image.ndim == 2 else fine[..., None], out, 0.0), fine


def centers(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)


def warp(source: np.ndarray, m: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """out(p) = source(m p), pixel centers at +0.5."""
    x, y = centers(*shape)
    z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z
    return sampled(source, np.where(z > 0, u - 0.5, np.nan), v - 0.5)


def undistort_image(image: np.ndarray, cam) -> tuple[np.ndarray, Cam]:
    c = Cam.of(cam)
    plain = Cam(c.width, c.height, c.fx, c.fy, c.cx, c.cy)
    if c.k1 == 0 and c.k2 == 0:
        return image, plain
    x, y = centers(*image.shape[:2])
    a, b = (x - c.cx) / c.fx, (y - c.cy) / c.fy
    d = 1 + c.k1 * (a * a + b * b) + c.k2 * (a * a + b * b) ** 2
    return sampled(image, a * d * c.fx + c.cx - 0.5, b * d * c.fy + c.cy - 0.5)[0], plain


def box_mean(a: np.ndarray, window: int) -> np.ndarray:
    """Mean over a square window, borders mirrored, from running sums."""
    left = window // 2
    p = np.pad(np.asarray(a, float), ((left, window - 1 - left),) * 2, mode="symmetric")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2


class Windows:
    """Window means and variances of one image, kept for many comparisons."""

    def __init__(self, a: np.ndarray, window: int):
        self.a, self.window = np.asarray(a, float), window
        self.mean = box_mean(self.a, window)
        self.variance = box_mean(self.a**2, window) - self.mean**2

    def zncc(self, other: Windows, eps: float = 1e-6) -> np.ndarray:
        covariance = box_mean(self.a * other.a, self.window) - self.mean * other.mean
        fine = (self.variance > eps) & (other.variance > eps)
        below = np.sqrt(np.where(fine, self.variance * other.variance, 1.0))
        return np.where(fine, np.clip(covariance / below, -1, 1), 0.0)


def zncc(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    return Windows(a, window).zncc(Windows(b, window))


def plane_sweep(ref: np.ndarray, cam, pose, sources: list[tuple], depths: np.ndarray, window: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Depth and score of each pixel.  ``sources``: (image, cam, (R, t)); poses take world to camera.

    A source counts where the plane's image of a pixel lies in it; a pixel that no source sees
    scores -1.  The best depth is moved by a parabola through its neighbours' scores."""
    base = Windows(ref, window)
    k0 = np.linalg.inv(Cam.of(cam).K)
    scores = np.empty((len(depths), *base.a.shape))
    for n, d in enumerate(depths):
        sums, seen = np.zeros(base.a.shape), np.zeros(base.a.shape)
        for image, c, (r, t) in sources:
            turn = r @ pose[0].T
            shift = t - turn @ pose[1]
            moved, fine = warp(np.asarray(image, float), Cam.of(c).K @ (turn + np.outer(shift, [0, 0, 1]) / d) @ k0, base.a.shape)
            sums += np.where(fine, base.zncc(Windows(moved, window)), 0.0)
            seen += fine
        scores[n] = np.where(seen > 0, sums / np.maximum(seen, 1), -1.0)
    best = scores.argmax(0)
    rows, cols = np.indices(best.shape)
    top = scores[best, rows, cols]
    inner = (best > 0) & (best < len(depths) - 1)
    a, b = scores[np.maximum(best - 1, 0), rows, cols], scores[np.minimum(best + 1, len(depths) - 1), rows, cols]
    curve = a - 2 * top + b
    bend = inner & (curve < -1e-9)
    offset = np.where(bend, np.clip((a - b) / np.where(bend, 2 * curve, 1.0), -0.5, 0.5), 0.0)
    return np.interp(best + offset, np.arange(len(depths)), depths), top


def back_project(depth: np.ndarray, cam, pose) -> tuple[np.ndarray, np.ndarray]:
    """World points of pixels with a depth, row by row, and their flat indices."""
    from .rigid import undistorted

    at = np.flatnonzero(depth.ravel() > 0)
    uv = np.column_stack([at % depth.shape[1], at // depth.shape[1]]) + 0.5
    z = depth.ravel()[at][:, None].astype(float)
    return (np.hstack([undistorted(cam, uv) * z, z]) - pose[1]) @ pose[0], at


def agreeing_views(depth: np.ndarray, cam, pose, sources: list[tuple], max_pixels: float = 1.0, max_relative: float = 0.01) -> np.ndarray:
    """How many sources (depth, cam, pose) confirm each pixel: its point's pixel there leads back
    to it, near in pixels and in depth."""
    from .rigid import pixels, undistorted

    x, at = back_project(depth, cam, pose)
    out = np.zeros(depth.size, int)
    here = np.column_stack([at % depth.shape[1], at // depth.shape[1]]) + 0.5
    z0 = depth.ravel()[at].astype(float)
    for d, c, (r, t) in sources:
        seen = x @ r.T + t
        uv = np.floor(pixels(c, seen))
        fine = (seen[:, 2] > 0) & np.isfinite(uv).all(1)
        uv = np.where(fine[:, None], uv, -1).astype(int)
        fine &= (uv >= 0).all(1) & (uv[:, 0] < d.shape[1]) & (uv[:, 1] < d.shape[0])
        i = np.flatnonzero(fine)
        z = d[uv[i, 1], uv[i, 0]].astype(float)
        i, z = i[z > 0], z[z > 0]
        back = (np.hstack([undistorted(c, uv[i] + 0.5) * z[:, None], z[:, None]]) - t) @ r @ pose[0].T + pose[1]
        good = (np.linalg.norm(pixels(cam, back) - here[i], axis=1) < max_pixels) & (np.abs(back[:, 2] - z0[i]) < max_relative * z0[i])
        out[at[i[good]]] += 1
    return out.reshape(depth.shape)
