import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe import cli, datasets, queries, synthetic
from geoframe.functions import cameras, geodesy, poses
from geoframe.functions.linear import at, const, vec
from geoframe.kernels import bundle
from geoframe.kernels.rigid import Cam, angle_deg, rotation
from geoframe.operators import align, frames, graph, keyframes, matching, metrics, spatial
from geoframe.plans import conjugate, mvs, sfm
from geoframe.plans.model import Model
from geoframe.sources import clouds, colmap, photos
from geoframe.streaming import voxels

CLOUD = "x double, y double, z double"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_voxels(spark):
    c = spark.createDataFrame([(0.01, 0.01, 0.01, 0.0), (0.03, 0.03, 0.03, 100.0), (1.0, 1.0, 1.0, 255.0)], CLOUD + ", g double")
    got = sorted((round(r.x, 6), round(r.g, 6), r.n) for r in spatial.voxel_downsample(c, 0.1, ("x", "y", "z", "g")).collect())
    assert got == [(0.02, 50.0, 2), (1.0, 255.0, 1)]


def test_nearest_and_metrics(spark):
    ref = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0)], CLOUD)
    q = spark.createDataFrame([(1.0, 0.0, 0.0), (7.0, 0.0, 0.0)], CLOUD)
    assert sorted(r.d for r in spatial.nearest(q, ref, 20.0).collect()) == [1, 3]
    assert sorted(r.d for r in spatial.nearest(q, ref, 2.0).collect()) == [1, 2]
    truth = spark.createDataFrame([(i / 100, 0.0, 0.0) for i in range(101)], CLOUD)
    pred = spark.createDataFrame([(i / 100, 0.0, 0.005) for i in range(51)], CLOUD)
    m = {r.threshold: r for r in spatial.geometry_metrics(pred, truth, (0.001, 0.01), 1.0).collect()}
    assert m[0.01].precision == 1 and abs(m[0.01].recall - 51 / 101) < 0.011 and m[0.001].f_score == 0 and abs(m[0.01].accuracy - 0.005) < 1e-9


def test_sparse_dense(spark):
    dense = spark.createDataFrame([(i / 10, j / 10, 0.0) for i in range(100) for j in range(100)], CLOUD)
    sparse = spark.createDataFrame([(5.0, 5.0, z) for z in (0.0, 0.1, 0.3, 0.6)] + [(50.0, 50.0, 0.0)], CLOUD)
    r = spatial.sparse_dense_agreement(sparse, dense, 0.1, (2, 4), 1.0).first()
    assert r.in_footprint == 4 and abs(r.median_units - 2) < 1e-9 and (r.within_2, r.within_4) == (0.5, 0.75)


def test_empty_clouds(spark):
    none = spark.createDataFrame([], CLOUD)
    some = spark.createDataFrame([(0.0, 0.0, 0.0)], CLOUD)
    assert spatial.footprint_crop(some, none).collect() == [] and np.isnan(spatial.vertical_offset(none, some).first().dz)
    assert spatial.geometry_metrics(none, some, (0.1,), 1.0).first().f_score == 0
    assert metrics.pose_auc(spark.createDataFrame([], "error double"), (5,)).first().auc == 0


def test_tracks(spark):
    rows = [(1, 0, 2, 5), (1, 1, 2, 6), (2, 5, 3, 9), (2, 6, 3, 7), (1, 1, 3, 8)]
    m = spark.createDataFrame(rows, "image_a long, kp_a long, image_b long, kp_b long")
    assert sorted((r.track_id, r.image_id, r.kp_idx) for r in graph.tracks(m).collect()) == [(0, 1, 0), (0, 2, 5), (0, 3, 9)]
    rows = [(1, 0, 2, 0), (3, 0, 4, 0), (4, 0, 5, 0)]
    m = spark.createDataFrame(rows, "image_a long, kp_a long, image_b long, kp_b long")
    assert sorted((r.image_id, r.kp_idx) for r in graph.tracks(m, 3).collect()) == [(3, 0), (4, 0), (5, 0)]


def test_numbered_points(spark):
    old = spark.createDataFrame([(7,)], "point_id long")
    got = metrics.numbered_points(old, spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "x double"), ["x"])
    assert sorted((r.x, r.point_id) for r in got.collect()) == [(1.0, 8), (2.0, 9), (3.0, 10)]


def test_widest_ray(spark):
    rows = [(1, [1.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (1, [-1.0, 0.0, 1.0], [0.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0], [0.0, 0.0, 0.0])]
    got = metrics.max_ray_angle(spark.createDataFrame(rows, "point_id long, c array<double>, p array<double>")).first()
    assert abs(got.angle - 90) < 1e-9


def test_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(e).collect()} == {0}


@pytest.mark.parametrize(("errors", "t", "want"), [([0.0, 0.0], 5, 1), ([5.0], 10, 0.5), ([1.0, 20.0], 10, 0.45)])
def test_auc(spark, errors, t, want):
    assert abs(metrics.pose_auc(spark.createDataFrame([(e,) for e in errors], "error double"), (t,)).first().auc - want) < 1e-12


def test_geodesy(spark):
    a, f = geodesy.WGS84_A, geodesy.WGS84_F
    p = lambda *v: one(spark, geodesy.to_ecef(*[F.lit(float(x)) for x in v]))
    np.testing.assert_allclose(p(0, 0, 0), [a, 0, 0], atol=1e-6)
    np.testing.assert_allclose(p(90, 0, 0), [0, 0, a * (1 - f)], atol=1e-6)
    np.testing.assert_allclose(p(0, 90, 100), [0, a + 100, 0], atol=1e-6)
    e = one(spark, geodesy.to_enu(F.lit(41.3101), F.lit(-81.5), F.lit(260.0), (41.31, -81.5, 250.0)))
    assert abs(e[1] - 11.1) < 0.05 and abs(e[2] - 10) < 0.01


def test_rotation_columns_near_half_turn(spark):
    for w in ([0.0, 0.0, np.pi - 1e-7], [1e-9, 0, 0], [2.0, -1.0, 0.5], [0.0, 0.0, 0.0]):
        got = one(spark, poses.log(poses.exp(const(w))))
        np.testing.assert_allclose(rotation(got), rotation(w), atol=1e-6)
        np.testing.assert_allclose(one(spark, poses.exp(const(w))), rotation(w).ravel(), atol=1e-12)


def test_pose_columns(spark):
    r = rotation([0.1, 0.2, -0.3])
    p = poses.pose(const(r.ravel().tolist()), const([1, 2, 3]))
    np.testing.assert_allclose(one(spark, poses.center(p)), -r.T @ [1, 2, 3], atol=1e-12)
    same = one(spark, poses.compose(p, poses.inverse(p)))
    np.testing.assert_allclose(same["R"], np.eye(3).ravel(), atol=1e-12)
    np.testing.assert_allclose(same["t"], 0, atol=1e-12)
    np.testing.assert_allclose(np.array(one(spark, poses.matrix(p))).reshape(4, 4)[:3, 3], [1, 2, 3])
    k = np.array([[500, 0, 320], [0, 510, 240], [0, 0, 1.0]])
    np.testing.assert_allclose(np.array(one(spark, poses.projection(const(k.ravel().tolist()), p))).reshape(3, 4), k @ np.column_stack([r, [1, 2, 3]]))
    look = one(spark, poses.look_at(const([0, -10, 5]), const([0, 0, 5]), const([0, 0, 1])))
    np.testing.assert_allclose(np.array(look["R"]).reshape(3, 3), [[1, 0, 0], [0, 0, -1], [0, 1, 0]], atol=1e-12)
    np.testing.assert_allclose(one(spark, poses.apply(poses.from_center(const(r.ravel().tolist()), const([4, 5, 6])), const([4, 5, 6]))), 0, atol=1e-12)


def test_camera_columns(spark):
    c = cameras.scaled(cameras.camera(5, 7, 10, 11, 2, 3, 0.1), 0.5)
    got = one(spark, c)
    assert (got["width"], got["height"], got["fx"]) == (2, 4, 5.0)  # half to even
    assert one(spark, cameras.has_distortion(c)) is True
    h = one(spark, cameras.plane_homography(const(np.eye(3).ravel().tolist()), const(np.eye(3).ravel().tolist()), const(np.eye(3).ravel().tolist()), const([1, 0, 0]), const([0, 0, 1]), F.lit(2.0)))
    np.testing.assert_allclose(h, [1, 0, 0.5, 0, 1, 0, 0, 0, 1])
    seen = one(spark, cameras.project(cameras.camera(6, 4, 5, 5, 3, 2), poses.identity(), const([1, 1, 0])))
    assert not np.isfinite(seen["uv"][0])
    with pytest.raises(Exception, match="unknown camera model"):
        one(spark, cameras.model_parameters(F.lit("FISHEYE"), F.lit(1), F.lit(1), vec(1.0)))


def test_selection(spark):
    pairs = spark.createDataFrame([(1, 2, 50, 1.0), (1, 3, 40, 6.0), (2, 3, 40, 6.0)], "image_a long, image_b long, n_inliers int, median_angle_deg double")
    assert tuple(frames.initial_pair(pairs).first())[:2] == (2, 3)
    assert tuple(frames.initial_pair(pairs.filter("image_b = 2")).first())[:2] == (1, 2)
    assert frames.next_image(spark.createDataFrame([(3, 30), (2, 30), (1, 5)], "image_id long, n long")).first().image_id == 2
    names = spark.createDataFrame([(f"{i:03d}",) for i in range(17)], "name string")
    assert sorted(r["name"] for r in frames.holdout_split(names, "name", 8).filter("is_test").collect()) == ["000", "008", "016"]
    assert frames.sample_rows(names, 5, "name").count() == 5
    got = keyframes.select_keyframes(spark.createDataFrame([("v", i, 1.0, 1.0) for i in range(31)], "video string, f long, sharpness double, displacement_to_next double"), "video", "f", 10.0, 1)
    assert sorted(r.f for r in got.collect()) == [0, 10, 20, 30]


def scene(spark, views=6, noise=0.2):
    cams = synthetic.default_camera(spark)
    images = synthetic.orbit(spark, views, 60.0, 40.0, arc=90.0)
    points = synthetic.terrain(spark, 400, buildings=2, per_building=80)
    keypoints, observations = synthetic.scene(images, cams, points, noise)
    return Model(cams, images, keypoints.cache(), points, observations)


def test_reconstruction(spark):
    m = scene(spark)
    matches = matching.simulated_matches(m.keypoints, matching.image_pairs(m.images, 3), 0.1)
    got = sfm.reconstruct(matches, m.keypoints, m.images, m.cameras)
    s = metrics.model_summary(got.cameras, got.images, got.points, got.observations).first()
    assert s.registered == 6 and s.points > 200
    errors = metrics.relative_pose_errors(got.images, m.images).agg(F.max("rot_deg"), F.max("trans_deg")).first()
    assert errors[0] < 0.5 and errors[1] < 2
    assert metrics.trajectory_error(got.images, m.images).first().rmse < 0.5


@pytest.mark.parametrize("dense", [300, 0])
def test_distributed_adjustment(spark, monkeypatch, dense):
    """The driver solves for the step as one matrix, or by conjugate gradients."""
    monkeypatch.setattr(bundle, "DENSE", dense)
    m = scene(spark, 5, 0.0)
    moved = m.with_(points=m.points.withColumns({c: F.col(c) + 0.3 * synthetic.gauss(i, "point_id") for i, c in enumerate("xyz")}))
    out, report = sfm.bundle_adjust(moved, (1, 2), rounds=12)
    assert report["initial_rmse"] > 1 and report["final_rmse"] < 0.05
    residuals = metrics.reprojection(out.observations, out.images, out.cameras, out.points, out.keypoints)
    assert abs(metrics.rmse(residuals).first().rmse - report["final_rmse"]) < 1e-3
    assert metrics.point_errors(residuals).count() == m.observations.select("point_id").distinct().count()


def test_blocks_that_stay_a_table_give_the_same_step(spark, monkeypatch):
    m = scene(spark, 4, 0.0)
    moved = m.with_(points=m.points.withColumns({c: F.col(c) + 0.3 * synthetic.gauss(i, "point_id") for i, c in enumerate("xyz")}))
    here, report = sfm.bundle_adjust(moved, (1, 2), rounds=1)
    monkeypatch.setattr(sfm, "SPREAD", 0)
    spread, other = sfm.bundle_adjust(moved, (1, 2), rounds=1)
    assert abs(report["final_rmse"] - other["final_rmse"]) < 1e-6 and report["final_rmse"] < report["initial_rmse"]
    a, b = (np.array([r.pose.t for r in x.images.orderBy("image_id").collect()]) for x in (here, spread))
    assert np.allclose(a, b, atol=1e-5)


def test_conjugate_gradients_by_joins(spark):
    dice, n = np.random.default_rng(3), 40
    whole = np.zeros((6 * n, 6 * n))
    for i in range(n):
        for j in {i, (i + 1) % n, (i + 7) % n}:
            a = dice.normal(size=(6, 6)) * (0.15 if i != j else 0)
            whole[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] += a
            whole[6 * j : 6 * j + 6, 6 * i : 6 * i + 6] += a.T
    whole += 4 * np.eye(6 * n)
    rows = [(i, j, whole[6 * i : 6 * i + 6, 6 * j : 6 * j + 6].ravel().tolist()) for i in range(n) for j in range(n) if whole[6 * i : 6 * i + 6, 6 * j : 6 * j + 6].any()]
    g = dice.normal(size=(n, 6))
    g[5] = 0
    got = conjugate.Spread(spark.createDataFrame(rows, "i long, j long, block array<double>"), g).solved()
    assert np.allclose(got, np.linalg.solve(whole, g.ravel()), atol=1e-4)


def test_fusion_forms_agree(spark):
    cam = synthetic.default_camera(spark, 40, 30, 60.0)
    images = synthetic.survey(spark, 1, 3, 5.0, 40.0)
    c = Cam.of(cam.first())
    tiles, pixels = [], []
    for v in images.collect():
        _, depth = synthetic.render(c, (np.array(v["pose"]["R"]).reshape(3, 3), np.array(v["pose"]["t"])), [(-8, 2, -6, 4, 8.0)])
        tiles.append((v["image_id"], 30, 40, depth.tobytes(), depth.tobytes()))
        pixels += [(v["image_id"], i, j, float(depth[i, j])) for i in range(30) for j in range(40)]
    depths = spark.createDataFrame(tiles, mvs.TILE)
    pairs = matching.image_pairs(images)
    near = pairs.union(pairs.select("image_b", "image_a")).toDF("image_id", "neighbor").withColumn("rank", F.lit(1))
    dense = mvs.fuse(depths, images, cam, near, mvs.Options(min_consistent=2))
    rows = mvs.consistent_pixels(spark.createDataFrame(pixels, "image_id long, row long, col long, z double"), images, cam, near, 2)
    a, b = ({(r.image_id, r.row, r.col) for r in d.collect()} for d in (dense, rows))
    assert a and len(a ^ b) <= 0.01 * len(a)


def test_icp(spark):
    truth = synthetic.terrain(spark, 3000, 40.0, 2.0, 0, 0)
    shifted = align.move_cloud(synthetic.terrain(spark, 1500, 38.0, 2.0, 0, 0, seed=9), align.Similarity(1.0, np.eye(3), np.array([0.0, 0.0, 1.0])))
    s = align.icp(shifted, truth, largest=3.0, smallest=1.0, rounds=3)
    assert abs(s.t[2] + 1.0) < 0.3


def test_georeference_and_level(spark):
    images = synthetic.orbit(spark, 8)
    centers = images.select("name", poses.center(F.col("pose")).alias("c")).collect()
    origin = (41.31, -81.5, 250.0)
    per = (111_320 * np.cos(np.radians(41.31)), 111_090)
    fixes = spark.createDataFrame([(r["name"], float(origin[0] + r["c"][1] / per[1]), float(origin[1] + r["c"][0] / per[0]), float(origin[2] + r["c"][2])) for r in centers] + [("x", 0.0, 0.0, None)], "name string, latitude double, longitude double, altitude double")
    g = align.georeference(images, fixes)
    s = metrics.georef_summary(g.residuals).first()
    assert s.num_images == 8 and s.rmse_3d < 0.5 and abs(g.similarity.s - 1) < 0.01
    assert align.read_origin(align.georeference_json(g, s.asDict())) == g.origin
    with pytest.raises(ValueError, match="three"):
        align.georeference(images.limit(2), fixes)
    tilt = align.Similarity(1.0, rotation([0.3, 0.2, 0.0]), np.zeros(3))
    points = synthetic.terrain(spark, 300)
    up = align.estimate_up(align.move_images(images, tilt), align.move_cloud(points, tilt))
    np.testing.assert_allclose(up, tilt.R[:, 2], atol=1e-6)
    _, flat, summary = align.level(align.move_images(images, tilt), align.move_cloud(points, tilt))
    assert summary.first().max_roll < 1e-3 and abs(flat.agg(F.median("z")).first()[0]) < 1e-6


def test_text_model_round_trip(spark, tmp_path):
    m = scene(spark, 4)
    linked = m.with_(points=m.points.select("point_id", "x", "y", "z", *[F.lit(7).cast("short").alias(c) for c in "rgb"], F.lit(0.5).alias("error")), images=m.images.withColumn("name", F.concat(F.lit("a b "), "name")))
    colmap.write_model_files(linked, str(tmp_path / "one"))
    colmap.write_model(linked, str(tmp_path / "parts"))
    back = colmap.read_model(spark, str(tmp_path / "one"))
    assert back.images.count() == 4 and back.images.filter("name like 'a b view%'").count() == 4
    assert metrics.relative_pose_errors(back.images, linked.images).agg(F.max("rot_deg")).first()[0] < 1e-4
    assert back.keypoints.count() == m.keypoints.count() and back.observations.count() == m.observations.count()
    d = back.points.join(linked.points.select("point_id", F.col("x").alias("x2")), "point_id").agg(F.max(F.abs(F.col("x") - F.col("x2")))).first()[0]
    assert d < 1e-9 and abs(back.cameras.first().fx - linked.cameras.first().fx) < 1e-9
    assert colmap.read_cameras(spark, str(tmp_path / "parts" / "cameras.txt")).count() == 1


def test_ply(spark, tmp_path):
    c = spark.createDataFrame([(0.5, 1.0, 2.0, 0.0, 0.5, 1.0), (3.0, 4.0, -5.0, 0.1, 0.2, 0.3)], CLOUD + ", r double, g double, b double")
    clouds.write_ply_file(c, str(tmp_path / "c.ply"))
    got = sorted(tuple(r) for r in clouds.load_points(spark, str(tmp_path / "c.ply")).collect())
    assert got == [(0.5, 1.0, 2.0, 0, 128, 255), (3.0, 4.0, -5.0, 26, 51, 76)]
    clouds.write_ply(c, str(tmp_path / "p.ply"))
    assert clouds.read_ply(spark, str(tmp_path / "p.ply")).count() == 2


def jpeg(gps: bool) -> bytes:
    """A JPEG header with EXIF: 41 deg 18' 36" N, 81 deg 30' W, 250.5 m."""
    r = lambda *v: b"".join(struct.pack("<II", int(x * 100), 100) for x in v)
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
    at = 8 + 2 + 12 + 4
    data = at + 2 + 12 * 6 + 4
    body = r(41, 18, 36) + r(81, 30, 0) + r(250.5)
    main = struct.pack("<H", 1) + entry(0x8825, 4, 1, struct.pack("<I", at)) + b"\0" * 4
    sub = struct.pack("<H", 6) + entry(1, 2, 2, b"N\0") + entry(2, 5, 3, struct.pack("<I", data)) + entry(3, 2, 2, b"W\0") + entry(4, 5, 3, struct.pack("<I", data + 24)) + entry(5, 1, 1, b"\0") + entry(6, 5, 1, struct.pack("<I", data + 48)) + b"\0" * 4
    block = b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + main + sub + body
    return b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block if gps else b"") + b"\xff\xd9"


def test_photos(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(True))
    (tmp_path / "b.jpg").write_bytes(jpeg(False))
    got = {r["name"]: r for r in photos.read_photos(spark, f"{tmp_path}/*.jpg").collect()}
    assert abs(got["a.jpg"].latitude - 41.31) < 1e-9 and abs(got["a.jpg"].longitude + 81.5) < 1e-9 and got["a.jpg"].altitude == 250.5
    assert got["b.jpg"].latitude is None and got["b.jpg"].altitude is None


def test_streams(spark, tmp_path):
    c = spark.createDataFrame([(0.01 * i, 0.0, 0.0) for i in range(40)], CLOUD)
    c.write.parquet(f"{tmp_path}/cloud")
    stream = voxels.voxel_means(spark.readStream.schema(c.schema).parquet(f"{tmp_path}/cloud"), 0.1)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.vx, r.n) for r in spark.table("means").collect()} == {(r.vx, r.n) for r in spatial.voxel_downsample(c, 0.1).collect()}
    f = spark.createDataFrame([("v", i, 1.0) for i in range(25)], "video string, frame_idx long, displacement double").coalesce(1)
    f.write.parquet(f"{tmp_path}/frames")
    q = voxels.keyframes(spark.readStream.schema(f.schema).parquet(f"{tmp_path}/frames"), 10.0).writeStream.outputMode("append").format("memory").queryName("picks").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frame_idx for r in spark.table("picks").collect()) == [0, 10, 20]


def test_command_line_and_registry(spark, tmp_path, capsys):
    assert cli.main(["mesh"]) == 2
    with pytest.raises(KeyError):
        datasets.locate([("a", "u", "n")], "b", str(tmp_path))
    assert datasets.registry(spark, [("a", "u", "n")]).count() == 1
    colmap.write_model_files(scene(spark, 4), str(tmp_path / "m"))
    capsys.readouterr()
    assert cli.main(["compare-poses", str(tmp_path / "m"), str(tmp_path / "m")]) == 0
    assert '"auc": 0.99999' in capsys.readouterr().out


def test_angles_match_kernels(spark):
    a, b = rotation([0.1, 0.2, 0.3]), rotation([-0.2, 0.1, 0.0])
    assert abs(one(spark, poses.angle_deg(const(a.ravel().tolist()), const(b.ravel().tolist()))) - angle_deg(a, b)) < 1e-9
    assert abs(one(spark, at(cameras.root_sift(vec(1.0, 3.0)), 0)) - 0.5) < 1e-6


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Small tables whose ids lie beyond the bounds of the queries with SQL."""
    folder = tmp_path_factory.mktemp("whole")
    rng = np.random.default_rng(5)
    items = [(o, i, int(rng.integers(0, 60)), int(rng.integers(0, 80))) for o in range(390, 490) for i in range(1, int(rng.integers(2, 6)))]
    vectors = rng.normal(size=(60, 4)) * 0.12
    tables = {
        "lineitem": spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
        "embeddings": spark.createDataFrame([(i, i % 6, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>"),
        "supplier": spark.createDataFrame([(k,) for k in range(55, 75)], "s_suppkey long"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder), items, vectors


def reached(edges):
    label = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(i * 7919 % 300, (i + 1) * 7919 % 300) for i in range(250)], [(i * i % 391, i * 17 % 401) for i in range(220)], [(1, 1), (2, 2), (3, 2)]])
def test_components_of_chains_and_tangles(spark, edges):
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reached(edges)


def test_whole_graphs(spark, whole):
    folder, items, _ = whole
    got = {r.node: r.component for r in queries.components(spark, folder).collect()}
    assert got == reached([(f"p{p}", f"s{s}") for _, _, p, s in items])
    on = {(o, i): (o + (s % 40 == 0)) // 3 for o, i, _, s in items}
    label = reached([((i, o // 3), (i + 1, on[o, i + 1])) for o, i in on if (o, i + 1) in on])
    groups = {}
    for node, low in label.items():
        groups.setdefault(low, []).append(node)
    good = sorted(k for k, g in groups.items() if len(g) >= 3 and len({i for i, _ in g}) == len(g))
    want = sorted((n, i, p) for n, k in enumerate(good) for i, p in groups[k])
    assert good and sorted((r.track_id, r.image_id, r.kp_idx) for r in queries.tracks(spark, folder).collect()) == want


def test_whole_vectors(spark, whole):
    folder, _, v = whole
    want = set()
    for a in range(6):
        for b in range(a + 1, 6):
            d = np.linalg.norm(v[a::6, None] - v[None, b::6], axis=2)
            for i, row in enumerate(d):
                first, second = np.sort(row)[:2]
                j = int(row.argmin())
                if first < 0.97 * second and d[:, j].argmin() == i:
                    want.add((a, b, a + 6 * i, b + 6 * j))
    got = [(r.image_a, r.image_b, r.kp_a, r.kp_b) for r in queries.match_descriptors(spark, folder).collect()]
    assert want and set(got) == want and len(got) == len(want)
    d = np.linalg.norm(v[:, None, :3] - v[None, :, :3], axis=2) + np.diag(np.full(len(v), np.inf))
    mean = np.sort(d, axis=1)[:, :5].mean(axis=1)
    keep = np.flatnonzero(mean <= mean.mean() + mean.std(ddof=1))
    assert sorted(r.vec_id for r in queries.remove_outliers(spark, folder).collect()) == keep.tolist()


def test_whole_pose_pairs(spark, whole):
    got = {(int(r.name_i), int(r.name_j)): r.rot_deg for r in queries.relative_pose_errors(spark, whole[0]).collect()}
    assert set(got) == {(i, j) for i in range(55, 75) for j in range(i + 1, 75)}
    assert all(abs(d - np.degrees(0.01 * abs(j % 3 - i % 3))) < 2e-4 for (i, j), d in got.items())


def test_rounding_of_very_many_rows(spark):
    """Equal to Spark's own to the bit, ties, signs and numbers without digits included; decimal digits only near a half."""
    rng = np.random.default_rng(12)
    ties = np.r_[np.arange(-40, 40) / 20000, 179.99995, 0.00005, 2.67495, 1.00005]
    v = np.r_[rng.uniform(-180, 180, 20_000), rng.integers(-(10**6), 10**6, 500) / 1e4, ties, np.nextafter(ties, 9), np.nextafter(ties, -9), 1e7 + ties, 1e15 + 0.3, 1e300, np.inf, -np.inf, np.nan, -0.0, 1e-300, -1e-9]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    got = df.select(queries.r_many(F.col("x"), 4).alias("a"), queries.r(F.col("x"), 4).alias("b")).toArrow()
    a, b = (np.array([np.nan if x is None else x for x in got.column(c).to_pylist()]) for c in "ab")
    assert got.column("a").null_count == got.column("b").null_count
    assert np.array_equal(a, b, equal_nan=True) and not np.signbit(a[a == 0]).any()
    assert "CASE WHEN" in queries.relative_pose_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_binary_model(spark, tmp_path):
    """A binary model written here value by value reads like the text model of the same values."""
    import struct

    from geoframe.sources import colmap

    with open(tmp_path / "cameras.bin", "wb") as f:
        f.write(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 500, 505, 320, 240) + struct.pack("<iiQQ5d", 2, 3, 64, 48, 50, 32, 24, 0.1, 0.01))
    with open(tmp_path / "images.bin", "wb") as f:
        f.write(struct.pack("<Q", 2))
        f.write(struct.pack("<i7di", 7, 1, 0, 0, 0, 1, 2, 3, 1) + b"a b.jpg\0" + struct.pack("<Q", 2) + struct.pack("<ddq", 1.5, 2.5, 9) + struct.pack("<ddq", 3.5, 4.5, -1))
        f.write(struct.pack("<i7di", 8, 0, 0, 0, 1, 4, 5, 6, 2) + b"c.jpg\0" + struct.pack("<Q", 0))
    with open(tmp_path / "points3D.bin", "wb") as f:
        f.write(struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 9, 0.5, 1.5, 2.5, 10, 20, 255, 0.25, 2) + struct.pack("<4i", 7, 0, 8, 3))
    m = colmap.read_model(spark, str(tmp_path))
    c = {r.camera_id: (r.width, r.height, r.fx, r.fy, r.cx, r.cy, r.k1, r.k2) for r in m.cameras.collect()}
    assert c == {1: (640, 480, 500, 505, 320, 240, 0, 0), 2: (64, 48, 50, 50, 32, 24, 0.1, 0.01)}
    i = {r.image_id: (r.camera_id, r.name, r.pose.R, r.pose.t) for r in m.images.collect()}
    assert i[7] == (1, "a b.jpg", [1, 0, 0, 0, 1, 0, 0, 0, 1], [1, 2, 3]) and i[8][:2] == (2, "c.jpg") and i[8][2][:2] == [-1, 0]
    assert sorted((r.image_id, r.kp_idx, r.u, r.v, r.point3d_id or -1) for r in m.keypoints.collect()) == [(7, 0, 1.5, 2.5, 9), (7, 1, 3.5, 4.5, -1)]
    assert [tuple(r) for r in m.points.collect()] == [(9, 0.5, 1.5, 2.5, 10, 20, 255, 0.25)]
    assert sorted(tuple(r) for r in m.observations.collect()) == [(9, 7, 0), (9, 8, 3)]


def _png(pixels, kinds):
    """A PNG of bytes (h, w, c), each row filtered as asked."""
    import struct
    import zlib

    h, w, c = pixels.shape
    flat = pixels.reshape(h, w * c).astype(int)
    body = b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left, corner = np.r_[np.zeros(c, int), flat[y][:-c]], np.r_[np.zeros(c, int), up[:-c]]
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][kinds[y]]
        body += bytes([kinds[y]]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_rasters(spark, tmp_path):
    from geoframe.sources import rasters

    rng = np.random.default_rng(0)
    for c in (1, 2, 3, 4):
        x = rng.integers(0, 256, (10, 7, c))
        want = x[..., 0] / 255 if c < 3 else x[..., :3] @ rasters.GRAY / 255
        np.testing.assert_allclose(rasters.gray(_png(x, [k % 5 for k in range(10)])), want, atol=1e-6)
    x = rng.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    (tmp_path / "b.ppm").write_bytes(b"P6\n# a comment\n5 4\n255\n" + x.tobytes())
    (tmp_path / "a.pgm").write_bytes(b"P2 3 2 15\n0 5 15\n1 2 3\n")
    got = {r["name"]: np.frombuffer(r["gray"], np.float32).reshape(r["height"], r["width"]) for r in rasters.read_gray(spark, str(tmp_path)).collect()}
    np.testing.assert_allclose(got["b.ppm"], x @ rasters.GRAY / 255, atol=1e-6)
    np.testing.assert_allclose(got["a.pgm"], np.array([[0, 5, 15], [1, 2, 3]]) / 15, atol=1e-6)
    images = spark.createDataFrame([(4, "a.pgm")], "image_id long, name string")
    assert [(r.image_id, r.height, r.width) for r in rasters.read_rasters(spark, str(tmp_path), images).collect()] == [(4, 2, 3)]
    with pytest.raises(NotImplementedError):
        rasters.gray(b"\xff\xd8jpeg")


def test_download_list(capsys):
    from geoframe.cli import main

    assert main(["download", "list"]) == 0 and capsys.readouterr().out.count("\n") == 4
    assert main(["download", "aukerman", "--root", "/nowhere"]) == 2


def test_pose_errors_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PAIRED", 7)
    rng = np.random.default_rng(2)
    turns, shifts = [np.linalg.qr(rng.normal(size=(30, 3, 3)))[0] for _ in "et"], [rng.normal(size=(30, 3)) for _ in "et"]
    shifts[0][4] = shifts[0][3] = shifts[1][4] = shifts[1][3]
    turns[0][4] = turns[0][3]
    models = [spark.createDataFrame([(f"n{k:02d}", (r[k].ravel().tolist(), t[k].tolist())) for k in range(30)], "name string, pose struct<R:array<double>,t:array<double>>") for r, t in zip(turns, shifts, strict=True)]
    found = metrics.relative_pose_errors(*models)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair with both poses in it
    got = {(r.name_i, r.name_j): (r.rot_deg, r.trans_deg) for r in found.collect()}
    assert len(got) == 435 and got["n03", "n04"][1] == 180
    for i in range(30):
        for j in range(i + 1, 30):
            (re, te), (rt, tt) = ((r[j] @ r[i].T, t[j] - r[j] @ r[i].T @ t[i]) for r, t in zip(turns, shifts, strict=True))
            want = np.degrees(np.arccos(np.clip((np.trace(re.T @ rt) - 1) / 2, -1, 1))), np.degrees(np.arccos(np.clip(te @ tt / max(1e-300, np.linalg.norm(te) * np.linalg.norm(tt)), -1, 1)))
            assert np.allclose(got[f"n{i:02d}", f"n{j:02d}"], want, atol=1e-6) or (i, j) == (3, 4)


def test_matches_of_few_pairs_stay_where_they_are(spark):
    rows = spark.createDataFrame([(i, 10 * i + p, p) for i in range(4) for p in range(9)], "image_id long, kp_idx long, point3d_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 3)], "image_a long, image_b long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = matching.simulated_matches(rows, pairs, 0.0, 5)
        assert sorted(map(tuple, found.collect())) == sorted((a, b, 10 * a + p, 10 * b + p) for a, b in ((0, 1), (1, 3)) for p in range(9))
        assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_hubs_of_a_graph_are_told_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 10)
    rows = spark.createDataFrame([(k, 1) for k in range(40)] + [(k, k) for k in range(40, 45)] + [(50, 99)], "node long, root long")
    told = spark.createDataFrame([(k, k - 1) for k in range(50)], "via long, far long")
    found = graph.looked_up(rows, "root", told)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(k, 1, 0) for k in range(40)] + [(k, k, k - 1) for k in range(40, 45)] + [(50, 99, None)], key=str)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(50)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(k, 0) for k in range(60)} | {(k, 100) for k in range(100, 151)}


def test_tracks_of_packed_keypoints(spark, monkeypatch):
    kinds = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda e: kinds.append(e.schema["a"].dataType.simpleString()) or whole(e))
    for far in (0, -5):
        got = graph.tracks(spark.createDataFrame([(1, 7, 2, 8), (2, 8, 3, 9), (far, 1, 4, 2)], "image_a int, kp_a long, image_b int, kp_b long")).collect()
        assert len(got) == 5 and {(r.image_id, r.kp_idx) for r in got if r.track_id == 1} == {(1, 7), (2, 8), (3, 9)}
    assert kinds[0] == "bigint" and kinds[1].startswith("struct")


def test_view_neighbors_of_odd_rows(spark, monkeypatch):
    """Against all pairs one by one: points with missing or no numbers, a point in a view's center, unknown
    views and points, repeated rows; the only join is that with the points."""
    monkeypatch.setattr(matching, "ANGLES", 50)
    monkeypatch.setattr(matching, "BUCKET", 40)
    rng = np.random.default_rng(12)
    c = {7 * i - 20: rng.normal(0, 3, 3) for i in range(9)}
    p = {i: rng.normal(0, 1, 3).tolist() for i in range(40)} | {40: [None, 0.0, 0.0], 41: [float("nan"), 0.0, 0.0], 42: c[1].tolist()}
    rows = [(i, v) for i in p for v in c if rng.random() < 0.6] + [(42, 1), (3, 999), (77, 1), (77, 8), (None, 1), (4, None)]
    rows += rows[:9]
    images = spark.createDataFrame([(v, ([1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], (-x).tolist())) for v, x in c.items()] + [(500, None)], "image_id long, pose struct<R:array<double>,t:array<double>>")
    points = spark.createDataFrame([(i, *x) for i, x in p.items()], "point_id long, x double, y double, z double")
    found = matching.view_neighbors(spark.createDataFrame(rows, "point_id long, image_id long"), points, images, 3, 1.0, 4)
    want = {}
    for a in c:
        scored = []
        for b in c:
            both = [i for i in p if (i, a) in rows and (i, b) in rows and a != b]
            angles = []
            for i in both:
                u, v = (np.array([np.inf if k is None else k for k in p[i]]) - c[w] for w in (a, b))
                if None not in p[i] and u.any() and v.any():
                    angles.append(0.0 if np.isnan(u).any() else np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))))
            if len(both) >= 4 and angles and np.median(angles) >= 1:
                scored.append((len(both) * min(1, np.median(angles) / 5), b, len(both), np.median(angles)))
        want[a] = [(b, n, rank + 1, round(m, 9)) for rank, (_, b, n, m) in enumerate(sorted(scored, reverse=True)[:3])]
    got = {a: [] for a in c}
    for r in sorted(found.collect(), key=lambda r: (r.image_id, r["rank"])):
        got[r.image_id].append((r.neighbor, r.shared, r["rank"], round(r.angle, 9)))
    assert got == want and found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert matching.view_neighbors(spark.createDataFrame(rows, "point_id long, image_id long"), points, images.limit(0), 3).collect() == []


def test_descriptors_of_images_in_tiles(spark, monkeypatch):
    """Images of many tiles match like whole ones, and no group holds more than two tiles; equal distances
    go to the first, and nothing matches an image of one descriptor or none."""
    sizes = {1: 70, 2: 55, 3: 1, 5: 40}
    rng = np.random.default_rng(13)
    v = {i: rng.integers(0, 4, (n, 5)).astype(float) for i, n in sizes.items()}
    v[2][:20] = v[1][:20] + 0.1
    rows = [(i, 100 - k, x.tolist()) for i, m in v.items() for k, x in enumerate(m)] + [(5, 7, None)]
    d = spark.createDataFrame(rows, "image_id long, kp_idx long, vec array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 5), (2, 5), (1, 4), (1, 2)], "image_a long, image_b long")
    want = {m: set() for m in (True, False)}
    for a, b in ((1, 2), (2, 5), (3, 5)):
        for mutual, out in want.items():
            out |= {(a, b, 100 - (len(v[a]) - 1 - i), 100 - (len(v[b]) - 1 - j)) for i, j in matching.match_kernel(v[a][::-1], v[b][::-1], 0.9, mutual).tolist()}
    monkeypatch.setattr(matching, "ROWS", 16)
    for mutual in (True, False):
        got = [tuple(r) for r in matching.match_descriptors(d, pairs, 0.9, mutual).select("image_a", "image_b", "kp_a", "kp_b").collect()]
        assert want[mutual] and set(got) == want[mutual] and len(got) == len(set(got))
