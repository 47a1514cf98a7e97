"""Growing a scene from a pair of views, as arrays over all observations.

The state of an attempt is which views have poses, which tracks have points, and which
observations count.  A round places several views at once, then all points that can be placed;
every step works on all tracks together."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import bundle
from .resection import robust_pose
from .rigid import Cam, undistorted


@dataclass(frozen=True)
class Rules:
    least_views: int = 20  # points that a view must see, and agree with, to be placed
    view_threshold: float = 4.0
    max_error: float = 4.0
    min_angle: float = 1.5
    adjust_every: int = 5
    #: Views that see this part of what the best one sees are placed in the same round.
    together: float = 0.5
    seed: int = 0


@dataclass
class Scene:
    """Views by number; observations (view, track, pixel), sorted by track."""

    cams: list[Cam]
    view: np.ndarray
    track: np.ndarray
    uv: np.ndarray
    xn: np.ndarray = field(init=False)
    lens: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.view, self.track))
        self.view, self.track, self.uv = self.view[order], self.track[order], self.uv[order]
        self.xn = np.empty_like(self.uv)
        for v, cam in enumerate(self.cams):
            at = self.view == v
            self.xn[at] = undistorted(cam, self.uv[at])
        self.lens = np.array([(c.fx, c.fy, c.cx, c.cy, c.k1, c.k2) for c in self.cams], float).reshape(-1, 6)
        self.tracks = int(self.track.max(initial=-1)) + 1


@dataclass
class State:
    R: np.ndarray
    t: np.ndarray
    posed: np.ndarray
    fixed: int
    xyz: np.ndarray
    known: np.ndarray  # tracks with a point
    used: np.ndarray  # observations that count


def begun(scene: Scene, a: int, b: int, r: np.ndarray, t: np.ndarray) -> State:
    n = len(scene.cams)
    s = State(np.tile(np.eye(3), (n, 1, 1)), np.zeros((n, 3)), np.zeros(n, bool), a, np.zeros((scene.tracks, 3)), np.zeros(scene.tracks, bool), np.zeros(len(scene.view), bool))
    s.R[b], s.t[b] = r, t
    s.posed[[a, b]] = True
    return s


def offsets(scene: Scene, s: State, rows: np.ndarray, xyz: np.ndarray | None = None) -> np.ndarray:
    """Pixel distances of observations from their projected points; infinite behind the view."""
    view, x = scene.view[rows], (s.xyz if xyz is None else xyz)[scene.track[rows]]
    seen = np.einsum("nij,nj->ni", s.R[view], x) + s.t[view]
    fx, fy, cx, cy, k1, k2 = scene.lens[view].T
    with np.errstate(all="ignore"):
        p = seen[:, :2] / seen[:, 2:]
        r2 = (p**2).sum(1)
        p = p * (1 + k1 * r2 + k2 * r2**2)[:, None] * np.stack([fx, fy], 1) + np.stack([cx, cy], 1)
        return np.where(seen[:, 2] > 0, np.linalg.norm(p - scene.uv[rows], axis=1), np.inf)


def widest(scene: Scene, s: State, rows: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    """Largest angle in degrees between two rays of each track; 0 with fewer than two.  ``rows``: ascending."""
    track, view = scene.track[rows], scene.view[rows]
    ray = -np.einsum("nji,nj->ni", s.R[view], s.t[view]) - xyz[track]
    with np.errstate(invalid="ignore"):
        ray /= np.linalg.norm(ray, axis=1, keepdims=True)
    out = np.zeros(scene.tracks)
    for gap in range(1, int(np.bincount(track).max(initial=0))):  # pairs of a track that are so far apart in its list
        near = np.flatnonzero(track[gap:] == track[:-gap])
        angle = np.degrees(np.arccos(np.clip((ray[near] * ray[near + gap]).sum(1), -1, 1)))
        np.maximum.at(out, track[near], np.nan_to_num(angle))
    return out


def intersections(scene: Scene, s: State, rows: np.ndarray) -> np.ndarray:
    """The point of each track that has two of the observations or more, by one linear system; else not a number."""
    track, view = scene.track[rows], scene.view[rows]
    p = np.concatenate([s.R[view], s.t[view][:, :, None]], axis=2)
    eq = scene.xn[rows][:, :, None] * p[:, 2:3] - p[:, :2]
    out = np.full((scene.tracks, 3), np.nan)
    counts = np.bincount(track, minlength=scene.tracks)
    place = np.arange(len(track)) - np.repeat(np.cumsum(counts) - counts, counts)
    for size in np.unique(counts[counts >= 2]):  # tracks of one size are one stack
        those = counts == size
        at = those[track]
        stack = np.zeros((int(those.sum()), int(size), 2, 4))
        number = np.cumsum(those) - 1
        stack[number[track[at]], place[at]] = eq[at]
        v = np.linalg.svd(stack.reshape(len(stack), -1, 4))[2][:, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[those] = v[:, :3] / v[:, 3:]
    return out


def place_points(scene: Scene, s: State, rules: Rules) -> int:
    """Points of tracks that have none yet.  Observations that miss a track's first point are left
    out of the second; a track is taken if all that are left agree and their rays are wide enough."""
    rows = np.flatnonzero(s.posed[scene.view] & ~s.known[scene.track])
    for last in (False, True):
        xyz = intersections(scene, s, rows)
        misses = ~(offsets(scene, s, rows, xyz) <= rules.max_error)
        failed = np.zeros(scene.tracks, bool)
        failed[scene.track[rows[misses]]] = True
        if last:
            rows = rows[~failed[scene.track[rows]]]
        else:
            sound = np.isfinite(xyz).all(1)[scene.track[rows]]
            rows = rows[sound & ~misses]
    wide = widest(scene, s, rows, xyz) >= rules.min_angle
    new = wide & np.isfinite(xyz).all(1) & ~s.known
    s.xyz[new] = xyz[new]
    s.known |= new
    s.used[rows[new[scene.track[rows]]]] = True
    return int(new.sum())


def prune(scene: Scene, s: State, rules: Rules) -> None:
    """Drops observations that miss their points, then points without two observations or a wide enough angle."""
    rows = np.flatnonzero(s.used)
    s.used[rows] = offsets(scene, s, rows) <= rules.max_error
    rows = np.flatnonzero(s.used)
    s.known &= (np.bincount(scene.track[rows], minlength=scene.tracks) >= 2) & (widest(scene, s, rows, s.xyz) >= rules.min_angle)
    s.used &= s.known[scene.track]


def place_views(scene: Scene, s: State, rules: Rules) -> int:
    """Poses of the views that see the most points, several at once; the number of views placed."""
    open_rows = np.flatnonzero(~s.posed[scene.view] & s.known[scene.track])
    counts = np.bincount(scene.view[open_rows], minlength=len(scene.cams))
    done = 0
    order = [v for v in np.lexsort((np.arange(len(counts)), -counts)).tolist() if counts[v] >= rules.least_views]
    for v in order:
        if done and counts[v] < rules.together * counts[order[0]]:
            break
        rows = open_rows[scene.view[open_rows] == v]
        pose, inside = robust_pose(s.xyz[scene.track[rows]], scene.uv[rows], scene.cams[v], rules.view_threshold, np.random.default_rng([rules.seed, v, int(s.posed.sum())]))
        if pose is not None and inside.sum() >= rules.least_views:
            s.R[v], s.t[v] = pose
            s.posed[v] = True
            s.used[rows[inside]] = True
            done += 1
    return done


def adjust(scene: Scene, s: State, rules: Rules, rounds: int) -> None:
    rows = np.flatnonzero(s.used)
    if not len(rows):
        return
    views, view = np.unique(scene.view[rows], return_inverse=True)
    tracks, track = np.unique(scene.track[rows], return_inverse=True)
    free = np.where(views == s.fixed, -1, np.cumsum(views != s.fixed) - 1)
    v, x, _ = bundle.adjust(bundle.Views([scene.cams[i] for i in views], s.R[views], s.t[views], free), s.xyz[tracks], bundle.Observations(view, track, scene.uv[rows]), rounds=rounds)
    s.R[views], s.t[views], s.xyz[tracks] = v.R, v.t, x
    prune(scene, s, rules)


def grow(scene: Scene, a: int, b: int, r: np.ndarray, t: np.ndarray, rules: Rules) -> State:
    """From the pair (a, b), whose second view has the pose (r, t) against the first."""
    s = begun(scene, a, b, r, t)
    adjusted = 0
    while True:
        place_points(scene, s, rules)
        posed = int(s.posed.sum())
        if posed <= 6 or posed - adjusted >= rules.adjust_every:
            adjust(scene, s, rules, 50)
            adjusted = posed
        if s.known.sum() < rules.least_views or not place_views(scene, s, rules):
            break
    for _ in range(2):
        place_points(scene, s, rules)
        adjust(scene, s, rules, 100)
    return s
