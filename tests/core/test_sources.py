"""Files by ranges of records."""

import struct

import numpy as np
import pytest

from geoframe.operators import frames
from geoframe.sources import clouds, records


def las(points, form=2, minor=2, colours=None, scale=0.001, offset=(100.0, 200.0, 50.0), packed=False):
    """A LAS file, value by value."""
    length = {0: 20, 2: 26, 3: 34, 6: 30, 7: 36}[form]
    head = bytearray(375 if minor == 4 else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, minor])
    struct.pack_into("<HI", head, 94, len(head), len(head) + 10)
    struct.pack_into("<BHI", head, 104, form | (0x80 if packed else 0), length, 0 if minor == 4 else len(points))
    struct.pack_into("<6d", head, 131, *[scale] * 3, *offset)
    if minor == 4:
        struct.pack_into("<Q", head, 247, len(points))
    body = bytearray()
    for i, p in enumerate(points):
        row = bytearray(length)
        struct.pack_into("<3iH", row, 0, *(round((v - o) / scale) for v, o in zip(p, offset, strict=True)), i % 60_000)
        row[15 if form < 6 else 16] = 2 + i % 3
        if form in records.COLOURS:
            struct.pack_into("<3H", row, records.COLOURS[form], *(256 * int(c) + 7 for c in colours[i]))
        body += row
    return bytes(head) + b"\0" * 10 + bytes(body)


@pytest.mark.parametrize(("form", "minor"), [(0, 2), (2, 2), (3, 3), (6, 4), (7, 4)])
def test_las_points_in_ranges(spark, tmp_path, form, minor):
    dice = np.random.default_rng(form)
    points, colours = np.round(dice.normal(size=(500, 3)) * 40 + 100, 3), dice.integers(0, 256, (500, 3))
    path = tmp_path / "p.las"
    path.write_bytes(las(points.tolist(), form, minor, colours))
    df = records.read(spark, records.LasPoints, str(path), 1000)
    assert df.rdd.getNumPartitions() >= 10
    got = df.orderBy("intensity").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in got], points, atol=1e-9) and [r.classification for r in got] == [2 + i % 3 for i in range(500)]
    assert [(r.r, r.g, r.b) for r in got] == ([tuple(c) for c in colours.tolist()] if form in records.COLOURS else [(None,) * 3] * 500)
    assert clouds.load_points(spark, str(path)).count() == 500


def test_las_files_that_are_empty_packed_or_cut(spark, tmp_path):
    (tmp_path / "e.las").write_bytes(las([]))
    assert records.read(spark, records.LasPoints, str(tmp_path / "e.las")).collect() == []
    whole = las([(1, 2, 3)] * 9, 0)
    for name, data, error in (("z.las", las([(1, 2, 3)], 0, packed=True), "LAZ"), ("c.las", whole[:-5], "last point"), ("n.las", b"PK" + whole[2:], "no LAS")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=error):
            records.read(spark, records.LasPoints, str(tmp_path / name)).collect()


def test_binary_models_in_ranges(spark, tmp_path):
    dice = np.random.default_rng(1)
    images = [(i, dice.normal(size=7).tolist(), 1, f"{'n' * (i % 300)}ü{i}.jpg", [(float(k), float(i), -1 if k % 2 else k) for k in range(i % 40)]) for i in range(200)]
    data = struct.pack("<Q", len(images))
    for i, pose, camera, name, spots in images:
        data += struct.pack("<i7di", i, *pose, camera) + name.encode() + b"\0" + struct.pack("<Q", len(spots)) + b"".join(struct.pack("<2dq", *s) for s in spots)
    (tmp_path / "images.bin").write_bytes(data)
    df = records.read(spark, records.ModelImages, str(tmp_path / "images.bin"), 5000)
    assert df.rdd.getNumPartitions() >= 10
    got = df.orderBy("image_id").collect()
    assert [(r.image_id, [*r.q, *r.t], r.camera_id, r.name, [tuple(s) for s in r.spots]) for r in got] == images
    points = [(i, 1.0 * i, 2.0, 3.0, 1, 2, 250, 0.5, [(k, i) for k in range(i % 20)]) for i in range(300)]
    data = struct.pack("<Q", len(points)) + b"".join(struct.pack("<Q3d3BdQ", *p[:8], len(p[8])) + b"".join(struct.pack("<2i", *s) for s in p[8]) for p in points)
    (tmp_path / "points3D.bin").write_bytes(data)
    df = records.read(spark, records.ModelPoints, str(tmp_path / "points3D.bin"), 3000)
    assert df.rdd.getNumPartitions() > 5
    assert [(*tuple(r)[:8], [tuple(s) for s in r.seen]) for r in df.orderBy("point_id").collect()] == points
    (tmp_path / "cut.bin").write_bytes(data[:-3])
    with pytest.raises(Exception, match="within a record"):
        records.read(spark, records.ModelPoints, str(tmp_path / "cut.bin")).collect()


def test_displacement_of_a_table_of_frames(spark):
    big = np.random.default_rng(1).random((120, 150))
    for _ in range(3):
        big = sum(np.roll(big, s, a) for s, a in ((0, 0), (1, 0), (-1, 0), (1, 1), (-1, 1))) / 5
    cut = lambda k: big[20 + k : 100 + k, 20 + 2 * k : 130 + 2 * k].astype(np.float32)
    rows = [(v, k, 80, 110, cut(k * (v + 1)).tobytes()) for v in range(2) for k in range(4)]
    table = spark.createDataFrame(rows, "video int, f long, height int, width int, gray binary")
    got = {(r.video, r.f): r.displacement_to_next for r in frames.tracked_displacement(table, "video", "f").collect()}
    assert len(got) == 8 and got[0, 3] is None and got[1, 3] is None
    assert all(abs(d - (v + 1) * np.hypot(1, 2)) < 0.1 for (v, k), d in got.items() if k < 3)
