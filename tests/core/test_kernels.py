import numpy as np
import pytest

from geoframe import synthetic
from geoframe.kernels import bundle, stereo
from geoframe.kernels.consensus import consensus, draws_needed
from geoframe.kernels.resection import linear, refine, residuals, robust_pose, three_points
from geoframe.kernels.rigid import Cam, align, angle_deg, closest_rotation, pixels, ray_angles, rotation, skew, undistorted
from geoframe.kernels.twoview import essential, five_points, fundamental, homography, mapped, motions, relative_pose, robust_homography, sampson, transfer_error, triangulate, triangulate_many
from geoframe.kernels import flow
from geoframe.operators.frames import pick_keyframes, sharpness
from geoframe.operators.matching import match_kernel

CAM = Cam(640, 480, 500.0, 505.0, 320.0, 240.0, -0.05, 0.01)
PLAIN = Cam(640, 480, 500.0, 500.0, 320.0, 240.0)


def some(seed=0, n=120, flat=False):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-10, 10, (n, 3)) * (1, 1, 0 if flat else 0.4) + (0, 0, 40)
    return rng, x, rotation(rng.normal(size=3) * 0.1), rng.normal(size=3)


def test_rotations():
    w = np.random.default_rng(0).normal(size=(50, 3))
    r = rotation(w)
    np.testing.assert_allclose(r @ r.transpose(0, 2, 1), np.broadcast_to(np.eye(3), r.shape), atol=1e-12)
    assert abs(angle_deg(np.eye(3), rotation([0, 0, np.pi / 3])) - 60) < 1e-9
    np.testing.assert_allclose(closest_rotation(rotation([0.1, 0.2, 0.3]) * 1.7), rotation([0.1, 0.2, 0.3]), atol=1e-12)


def test_undistort_inverts_projection():
    x = np.random.default_rng(1).uniform(-0.4, 0.4, (100, 2))
    np.testing.assert_allclose(undistorted(CAM, pixels(CAM, np.column_stack([x, np.ones(100)]))), x, atol=1e-9)


@pytest.mark.parametrize(("share", "size", "confidence", "n"), [(0.5, 4, 0.99, 72), (1, 8, 0.999, 1), (0, 8, 0.999, 10**9), (0.0014, 6, 0.999, 10**9)])
def test_draws(share, size, confidence, n):
    assert draws_needed(share, size, confidence) == n


def test_consensus_line():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 200)
    y = 2 * x + 1 + rng.normal(size=200) * 0.01
    y[:80] = rng.uniform(-30, 30, 80)
    model, inside = consensus(200, 2, lambda i: np.polyfit(x[i], y[i], 1), lambda m: np.abs(np.polyval(m, x) - y), 0.05, rng)
    assert np.allclose(model, [2, 1], atol=0.01) and inside[80:].mean() > 0.95
    assert consensus(1, 2, None, None, 1.0, rng)[0] is None


def test_homography():
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [1e-4, 2e-4, 1]])
    a = rng.uniform(0, 640, (100, 2))
    b = mapped(h, a)
    np.testing.assert_allclose(homography(a, b), h, atol=1e-7)
    assert homography(np.array([[0, 0], [1, 1], [2, 2], [5, 0.0]]), b[:4]) is None
    b[:40] += rng.uniform(20, 60, (40, 2))
    found, inside = robust_homography(a, b, 1.0, rng)
    assert inside.sum() == 60 and transfer_error(found, a, b)[40:].max() < 1e-6


def test_two_views():
    rng, x, r, t = some(3)
    seen = x @ r.T + t
    a, b = pixels(PLAIN, x), pixels(PLAIN, seen)
    f = fundamental(a, b)
    assert abs(np.linalg.det(f)) < 1e-12 and sampson(f, a, b).max() < 1e-6
    assert any(np.allclose(q, r, atol=1e-5) for q, _ in motions(essential(f, PLAIN.K, PLAIN.K)))
    b2 = b.copy()
    b2[:30] += rng.uniform(20, 60, (30, 2))
    q, s, mask = relative_pose(a, b2, PLAIN, PLAIN, 1.0, rng)
    assert angle_deg(q, r) < 0.1 and s @ t / np.linalg.norm(t) > 0.999 and mask[30:].mean() > 0.95
    p1, p2 = PLAIN.K @ np.eye(3, 4), PLAIN.K @ np.column_stack([r, t])
    np.testing.assert_allclose(triangulate(p1, p2, a, b), x, atol=1e-5)
    np.testing.assert_allclose(triangulate_many(np.broadcast_to(np.stack([p1, p2, p1]), (len(x), 3, 3, 4)), np.stack([a, b, a], 1)), x, atol=1e-5)
    assert abs(ray_angles(np.array([1.0, 0, 1]), np.array([-1.0, 0, 1]), np.array([[0.0, 0, 0]]))[0] - 90) < 1e-9


@pytest.mark.parametrize("flat", [False, True])
def test_five_points(flat):
    """Also on flat ground, where eight points don't do."""
    rng, x, r, t = some(7, 200, flat)
    t = 8 * t / np.linalg.norm(t)
    a, b = pixels(PLAIN, x), pixels(PLAIN, x @ r.T + t)
    na, nb = ((v - (320.0, 240.0)) / 500.0 for v in (a, b))
    truth = skew(t) @ r
    truth /= np.linalg.norm(truth)
    found = five_points(na[:10].reshape(2, 5, 2), nb[:10].reshape(2, 5, 2))
    assert min(min(np.abs(e - truth).max(), np.abs(e + truth).max()) for e in found) < 1e-6
    for e in found:
        np.testing.assert_allclose(np.linalg.svd(e)[1], [np.sqrt(0.5), np.sqrt(0.5), 0], atol=1e-6)
    b = b + rng.normal(size=b.shape) * 0.2
    b[:80] = rng.uniform(0, 480, (80, 2))
    q, s, mask = relative_pose(a, b, PLAIN, PLAIN, 1.0, rng, method="five")
    assert mask[80:].mean() > 0.95 and mask[:80].mean() < 0.1
    if not flat:  # a plane alone allows two motions
        assert angle_deg(q, r) < 0.6 and s @ t / np.linalg.norm(t) > 0.99
    with pytest.raises(ValueError, match="unknown"):
        relative_pose(a, b, PLAIN, PLAIN, 1.0, rng, method="six")


@pytest.mark.parametrize("flat", [False, True])
def test_resection(flat):
    rng, x, r, t = some(4, 300, flat)
    uv = pixels(CAM, x @ r.T + t)
    uv[:90] = rng.uniform(0, 480, (90, 2))
    pose, inside = robust_pose(x, uv, CAM, 2.0, rng)
    assert angle_deg(pose[0], r) < 1e-3 and np.abs(pose[1] - t).max() < 1e-2 and inside[90:].all()
    xn = undistorted(CAM, pixels(CAM, x @ r.T + t))
    assert any(angle_deg(q, r) < 1e-3 for q, _ in three_points(x[:3], xn[:3]))
    if flat:
        assert linear(x, xn) is None or residuals(CAM, linear(x, xn), x, uv)[90:].max() > 0
    else:
        assert angle_deg(linear(x, xn)[0], r) < 1e-4
    with pytest.raises(ValueError, match="unknown"):
        robust_pose(x, uv, CAM, 2.0, rng, method="x")


def test_refine():
    _, x, r, t = some(5)
    uv = pixels(CAM, x @ r.T + t)
    q, s = refine(CAM, (rotation([0.02, -0.01, 0.03]) @ r, t + 0.4), x, uv, 2.0)
    assert angle_deg(q, r) < 1e-4 and np.abs(s - t).max() < 1e-3


def test_alignment_of_points():
    rng, x, r, t = some(6)
    s, q, v = align(x, 1.7 * x @ r.T + t, True)
    assert abs(s - 1.7) < 1e-9 and np.allclose(q, r) and np.allclose(v, t)


def test_bundle_adjustment():
    rng = np.random.default_rng(7)
    x = rng.uniform(-10, 10, (150, 3)) * (1, 1, 0.3) + (0, 0, 40)
    n = 6
    r = rotation(rng.normal(size=(n, 3)) * 0.1)
    t = rng.normal(size=(n, 3)) * 3
    image, point = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(150), indexing="ij"))
    uv = pixels(CAM, np.einsum("nij,nj->ni", r[image], x[point]) + t[image])
    free = np.array([-1, -1, 0, 1, 2, 3])
    v = bundle.Views([CAM] * n, r.copy(), t.copy(), free)
    for i in range(2, n):
        v.R[i] = rotation(rng.normal(size=3) * 0.015) @ r[i]
        v.t[i] = t[i] + rng.normal(size=3) * 0.5
    out, y, _ = bundle.adjust(v, x + rng.normal(size=x.shape) * 0.3, bundle.Observations(image, point, uv), rounds=60)
    assert max(angle_deg(a, b) for a, b in zip(out.R, r, strict=True)) < 1e-3 and np.abs(y - x).max() < 1e-2
    # the reduced system, against the whole one with numeric derivatives
    o = bundle.Observations(image, point, uv)
    system, back = bundle.part(v, x, o, 1.0, 0.0)
    step = system.solved()
    before = bundle.cost(v, x, o, 1.0)
    assert bundle.cost(v.moved(0.01 * step), x + 0.01 * (bundle.move(v, x, o, back, step) - x), o, 1.0) < before
    fixed, same, _ = bundle.adjust(v, x, o, fixed_points=True, rounds=60)
    assert same is x and max(angle_deg(a, b) for a, b in zip(fixed.R, r, strict=True)) < 1e-3


SLABS = [(-8, 2, -6, 4, 8.0), (4, 12, 2, 10, 4.0)]


def views():
    cam = Cam(160, 120, 138.6, 138.6, 80.0, 60.0)
    down = np.array([[1.0, 0, 0], [0, -1, 0], [0, 0, -1]])
    poses = [(down, -down @ np.array([x, y, 40.0])) for x, y in ((0, 0), (5, 0), (0, 5), (-5, 0))]
    return cam, poses, [synthetic.render(cam, p, SLABS) for p in poses]


def test_plane_sweep_and_fusion():
    cam, poses, images = views()
    depth, score = stereo.plane_sweep(images[0][0], cam, poses[0], [(images[i][0], cam, poses[i]) for i in (1, 2, 3)], 1 / np.linspace(1 / 28, 1 / 44, 60), 7)
    inner = np.s_[8:-8, 8:-8]
    assert (np.abs(depth - images[0][1])[inner] < 0.5).mean() > 0.8 and score[inner].mean() > 0.7
    count = stereo.agreeing_views(images[0][1], cam, poses[0], [(images[i][1], cam, poses[i]) for i in (1, 2, 3)], 1.0, 0.02)
    assert (count[inner] >= 1).mean() > 0.9
    x, at = stereo.back_project(images[0][1], cam, poses[0])
    assert len(at) == 19200 and set(np.round(x[:, 2], 3)) <= {0.0, 4.0, 8.0}


def test_stereo_parts():
    rng = np.random.default_rng(8)
    a = rng.random((30, 40))
    assert np.allclose(stereo.zncc(a, 2 * a + 3)[3:-3, 3:-3], 1) and np.allclose(stereo.zncc(a, -a)[3:-3, 3:-3], -1)
    assert (stereo.zncc(np.ones((9, 9)), a[:9, :9]) == 0).all()
    moved, valid = stereo.warp(a, np.array([[1, 0, 2.0], [0, 1, 0], [0, 0, 1]]), a.shape)
    assert np.allclose(moved[:, :-2], a[:, 2:]) and not valid[:, -1].any()
    pad = np.pad(a, 3, mode="symmetric")
    want = np.array([[pad[i : i + 7, j : j + 7].mean() for j in range(40)] for i in range(30)])
    np.testing.assert_allclose(stereo.box_mean(a, 7), want)
    same, plain = stereo.undistort_image(a, Cam(40, 30, 30, 30, 20, 15))
    assert same is a and plain.k1 == 0
    bent, _ = stereo.undistort_image(a, Cam(40, 30, 30, 30, 20, 15, -0.1))
    assert bent.shape == a.shape


@pytest.mark.parametrize(("sharp", "moved", "least", "window", "want"), [
    (np.ones(31), np.ones(30), 10, 1, [0, 10, 20, 30]),
    (np.where(np.arange(31) == 1, 2, np.where(np.arange(31) == 11, 0.1, 1.0)), np.ones(30), 10, 3, [1, 12]),
    (np.ones(50), np.r_[np.zeros(40), np.full(9, 3.0)], 9, 1, [0, 43, 46, 49]),
])
def test_keyframe_picks(sharp, moved, least, window, want):
    assert pick_keyframes(sharp, np.r_[moved, np.nan], least, window)[: len(want)] == want
    assert pick_keyframes(np.zeros(0), np.zeros(0), 1, 3) == []


def test_frame_scores():
    rng = np.random.default_rng(9)
    a = rng.random((64, 64))
    assert sharpness(a) > sharpness(stereo.box_mean(a, 5)) and abs(sharpness(a) - sharpness(a + 5)) < 1e-9


def test_matching_kernel():
    a, b = np.array([[0, 0], [0.1, 0], [5, 5.0]]), np.array([[0.12, 0], [5, 5.1], [20, 20.0]])
    assert match_kernel(a, b, 1.0, False).tolist() == [[0, 0], [1, 0], [2, 1]]
    assert match_kernel(a, b, 1.0, True).tolist() == [[1, 0], [2, 1]]
    assert len(match_kernel(a, b[:1], 1.0, True)) == 0 and len(match_kernel(a[:0], b, 1.0, True)) == 0


def test_reduced_system_by_blocks(monkeypatch):
    """Conjugate gradients over the blocks give the dense solution; 2,000 views in a chain are solved, too."""
    rng = np.random.default_rng(0)
    for n in (7, 2000):
        key, block = [], []
        for i in range(n):
            for j in (i - 1, i, i + 1):
                if 0 <= j < n:
                    key.append(i * n + j)
                    a = rng.normal(size=(6, 6)) if j > i else None
                    block.append(4 * np.eye(6) if i == j else a * 0.3 / 6 if j > i else None)
        lookup = dict(zip(key, block, strict=True))
        block = [lookup[(k % n) * n + k // n].T if b is None else b for k, b in zip(key, block, strict=True)]
        r = bundle.Reduced.of(n, np.array(key), np.array(block), rng.normal(size=(n, 6)))
        monkeypatch.setattr(bundle, "DENSE", 0)
        x = r.solved().reshape(n, 6)
        i, j = np.divmod(r.key, n)
        back = np.zeros((n, 6))
        np.add.at(back, i, np.einsum("kab,kb->ka", r.block, x[j]))
        np.testing.assert_allclose(back, r.g, atol=1e-3)
        if n < 10:
            monkeypatch.setattr(bundle, "DENSE", 300)
            np.testing.assert_allclose(r.solved().reshape(n, 6), x, atol=1e-4)


def textured(h, w, seed=1):
    """Smooth random texture with coarse and fine structure, as photos have; large shifts are found by
    the coarse one (with the fine one alone, shifts beyond a few pixels can't be)."""
    rng, out = np.random.default_rng(seed), np.zeros((h, w))
    y, x = np.mgrid[:h, :w].astype(float)
    for size in (4, 8, 16, 32):
        coarse = rng.random((h // size + 3, w // size + 3))
        out += size**0.5 * flow.sampled(coarse, x / size, y / size)[0]
    for _ in range(2):
        out = sum(np.roll(out, s, a) for s, a in ((0, 0), (1, 0), (-1, 0), (1, 1), (-1, 1))) / 5
    return (out - out.min()) / np.ptp(out)


def test_corners_are_apart_and_strong():
    x = np.zeros((60, 80))
    x[20:40, 30:60] = 1
    found = flow.corners(x)
    assert len(found) == 4 and all(np.hypot(*(found - c).T).min() <= 2 for c in ((30, 20), (59, 20), (30, 39), (59, 39)))
    many = flow.corners(textured(120, 160), 50)
    d = np.hypot(*(many[:, None] - many[None]).transpose(2, 0, 1)) + 99 * np.eye(len(many))
    assert len(many) == 50 and d.min() >= flow.APART
    assert len(flow.corners(np.full((30, 30), 0.4))) == 0


@pytest.mark.parametrize("shift", [(5, 3), (0, 0), (-11, 6), (17, -20)])
def test_corners_are_tracked(shift):
    big = textured(200, 240)
    a, b = big[40:160, 40:200], big[40 - shift[1] : 160 - shift[1], 40 - shift[0] : 200 - shift[0]]
    assert abs(flow.displacement(a, b) - np.hypot(*shift)) < 0.05
    assert flow.displacement(a * 0, b) == 0


def test_parts_of_pixels_are_tracked():
    big = textured(100, 130)
    y, x = np.mgrid[10:90, 10:120].astype(float)
    a, b = big[10:90, 10:120], flow.sampled(big, x - 2.5, y + 1.25)[0]
    assert abs(flow.displacement(a, b) - np.hypot(2.5, 1.25)) < 0.05
