"""Command line: python -m geoframe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("geoframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df) -> str:
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, default=str)


def compare_poses(a) -> None:
    from .operators import metrics
    from .sources import colmap

    s = session()
    est, ref = (colmap.read_model(s, p).images for p in (a.estimate, a.reference))
    errors = metrics.relative_pose_errors(est, ref).withColumn("error", F.greatest("rot_deg", "trans_deg"))
    print(_rows(metrics.pose_auc(errors, (3, 5, 10, 30))))
    print(_rows(metrics.trajectory_error(est, ref)))


def georef(a) -> None:
    from .operators import align, metrics
    from .sources import colmap, photos

    s = session()
    model = colmap.read_model(s, a.model)
    g = align.georeference(model.images, photos.read_photos(s, a.photos))
    summary = metrics.georef_summary(g.residuals).first().asDict()
    with open(f"{a.out}.json", "w") as f:
        f.write(align.georeference_json(g, summary))
    colmap.write_model_files(model.with_(images=g.images, points=align.move_cloud(model.points, g.similarity)), a.out)
    print(json.dumps(summary, indent=2))


def level(a) -> None:
    from .operators import align
    from .sources import colmap

    model = colmap.read_model(session(), a.model)
    images, points, summary = align.level(model.images, model.points, a.scale)
    colmap.write_model_files(model.with_(images=images, points=points), a.out)
    print(_rows(summary))


def eval_geometry(a) -> None:
    from .operators import align
    from .sources import clouds

    s = session()
    print(_rows(align.evaluate(clouds.load_points(s, a.prediction), clouds.load_points(s, a.reference), a.thresholds, not a.no_icp)))


def crosscheck(a) -> None:
    from .operators import metrics, spatial
    from .plans.mvs import view_depths
    from .sources import clouds, colmap

    s = session()
    model = colmap.read_model(s, a.model)
    gsd = metrics.ground_sampling_distance(view_depths(model)).first()["gsd"]
    print(_rows(spatial.sparse_dense_agreement(model.points, clouds.load_points(s, a.cloud), gsd, (2, 4, 8), 10 * gsd)))


def keyframes(a) -> None:
    from .operators import frames, keyframes

    table = session().read.parquet(a.frames)
    least = a.min_displacement
    if least is None:
        least = table.agg(F.sum("displacement_to_next")).first()[0] / a.target
    print(_rows(keyframes.select_keyframes(table, "video_id", "frame_idx", least, a.window).orderBy("video_id", "pick")))


def sfm(a) -> None:
    from .operators import matching, metrics
    from .plans import sfm as plan
    from .sources import colmap

    s = session()
    t = {n: s.read.parquet(f"{a.tables}/{n}.parquet") for n in ("cameras", "images", "keypoints", "descriptors")}
    pairs = matching.image_pairs(t["images"], a.sequential)
    found = matching.match_descriptors(matching.rooted(t["descriptors"]), pairs)
    enough = found.groupBy("image_a", "image_b").agg(F.count("*").alias("n")).filter("n >= 15").select("image_a", "image_b")
    model = plan.reconstruct(found.join(enough, ["image_a", "image_b"]), t["keypoints"], t["images"], t["cameras"])
    colmap.write_model_files(model, a.out)
    print(_rows(metrics.model_summary(model.cameras, model.images, model.points, model.observations)))


def mvs(a) -> None:
    from .plans import mvs as plan
    from .sources import clouds, colmap, rasters

    s = session()
    model = colmap.read_model(s, a.model)
    given = rasters.read_rasters(s, a.rasters, model.images) if a.images else s.read.parquet(a.rasters)
    tiles, cloud = plan.dense(model, given, plan.Options(voxel=a.voxel))
    tiles.write.mode("overwrite").parquet(f"{a.out}/depth")
    cloud.write.mode("overwrite").parquet(f"{a.out}/fused")
    clouds.write_ply_file(cloud.select("x", "y", "z"), f"{a.out}/fused.ply")


def download(a) -> None:
    """Lists the known photo sets, or says that one is there; fetching needs a network."""
    from .datasets import KNOWN, locate

    if a.dataset == "list":
        for name, address, images, size, terms in KNOWN:
            print(f"{name:16} {images:4} {size:>8}  {terms:16} {address}")
    else:
        print(locate([k[:3] for k in KNOWN], a.dataset, a.root))


def outside(a) -> None:
    raise NotImplementedError(f"{a.command}: needs codecs, a mesher, a network or another program")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="geoframe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, **options):
        q = sub.add_parser(name)
        q.set_defaults(run=run)
        for k, v in options.items():
            q.add_argument(k if v.pop("place", True) else f"--{k.replace('_', '-')}", **v)

    add("compare-poses", compare_poses, estimate={}, reference={})
    add("georef", georef, model={}, photos={}, out={})
    add("level", level, model={}, out={}, scale={"place": False, "type": float, "default": 1.0})
    add("eval-geometry", eval_geometry, prediction={}, reference={}, thresholds={"place": False, "type": float, "nargs": "+", "default": [0.1, 0.2, 0.5]}, no_icp={"place": False, "action": "store_true"})
    add("crosscheck", crosscheck, model={}, cloud={})
    add("keyframes", keyframes, frames={}, target={"place": False, "type": int, "default": 150}, min_displacement={"place": False, "type": float, "default": None}, window={"place": False, "type": int, "default": 9})
    add("sfm", sfm, tables={}, out={}, sequential={"place": False, "type": int, "default": 0})
    add("mvs", mvs, model={}, rasters={}, out={}, images={"place": False, "action": "store_true", "help": "the rasters are PGM, PPM or PNG files instead of a table"}, voxel={"place": False, "type": float, "default": 0.05})
    add("download", download, dataset={}, root={"place": False, "default": "data"})
    for name in ("extract-frames", "colmap", "mesh", "status"):
        q = sub.add_parser(name)
        q.add_argument("rest", nargs="*")
        q.set_defaults(run=outside)
    a = p.parse_args(argv)
    try:
        a.run(a)
    except NotImplementedError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
