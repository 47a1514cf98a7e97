"""Metadata of photos: GPS fixes and focal lengths from EXIF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy

# Sensor widths in mm by camera model.
SENSOR_WIDTH_MM = {"FC300S": 6.17, "FC300X": 6.17, "FC330": 6.17, "FC6310": 13.2, "DSC-WX220": 6.17}
# EXIF tag numbers and value sizes.
_MODEL, _EXIF, _GPS = 0x0110, 0x8769, 0x8825
_FOCAL, _PLANE_X, _PLANE_UNIT, _WIDTH = 0x920A, 0xA20E, 0xA210, 0xA002
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _values(data: bytes, end: str, kind: int, count: int, at: int) -> list:
    if kind == 2:
        return [data[at : at + count].split(b"\0")[0].decode("latin-1")]
    if kind in (5, 10):
        flat = struct.unpack_from(f"{end}{2 * count}{'I' if kind == 5 else 'i'}", data, at)
        return [a / b if b else None for a, b in zip(flat[::2], flat[1::2], strict=True)]
    code = {1: "B", 7: "B", 3: "H", 4: "I", 9: "i"}.get(kind)
    return list(struct.unpack_from(f"{end}{count}{code}", data, at)) if code else []


def _directory(data: bytes, end: str, at: int) -> dict[int, list]:
    out = {}
    for i in range(struct.unpack_from(f"{end}H", data, at)[0]):
        tag, kind, count = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * i)
        where = at + 10 + 12 * i
        if _SIZES.get(kind, 0) * count > 4:
            where = struct.unpack_from(f"{end}I", data, where)[0]
        try:
            out[tag] = _values(data, end, kind, count, where)
        except struct.error:
            continue
    return out


def exif(content: bytes) -> dict:
    """The fields that are used here, from a JPEG's APP1 segment; {} if there is none."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            data = content[at + 10 : at + 2 + size]
            end = "<" if data[:2] == b"II" else ">"
            main = _directory(data, end, struct.unpack_from(f"{end}I", data, 4)[0])
            more = _directory(data, end, main[_EXIF][0]) if _EXIF in main else {}
            gps = _directory(data, end, main[_GPS][0]) if _GPS in main else {}
            one = lambda d, k: d[k][0] if d.get(k) else None
            out = {"model": one(main, _MODEL), "focal_mm": one(more, _FOCAL), "plane_x": one(more, _PLANE_X), "plane_unit": one(more, _PLANE_UNIT), "width_px": one(more, _WIDTH)}
            if gps.get(2) and gps.get(4) and None not in [*gps[2], *gps[4]]:
                out |= {"lat": gps[2], "lat_ref": one(gps, 1), "lon": gps[4], "lon_ref": one(gps, 3), "alt": one(gps, 6), "alt_ref": one(gps, 5)}
            return out
        at += 2 + size
    return {}


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """name, latitude, longitude, altitude, model, focal_px; missing values are null.  Altitudes
    with reference 1 are below sea level; a focal length needs the focal plane's resolution
    (unit 2: inch, 3: cm) or a known sensor width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["lat", "lat_ref", "lon", "lon_ref", "alt", "alt_ref", "model", "focal_mm", "plane_x", "plane_unit", "width_px"]
        for f in frames:
            found = [exif(bytes(c)) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], **{k: [x.get(k) for x in found] for k in fields}})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, lat array<double>, lat_ref string, lon array<double>, lon_ref string, alt double, alt_ref int, model string, focal_mm double, plane_x double, plane_unit int, width_px double")
    part = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    degrees = lambda c, ref: F.when(F.col(c).isNotNull(), geodesy.dms_to_degrees(part(c, 0), part(c, 1), part(c, 2), F.col(ref)))
    sensors = spark.createDataFrame(list(SENSOR_WIDTH_MM.items()), "model string, sensor_mm double")
    per_mm = F.when(F.col("plane_unit") == 2, F.col("plane_x") / 25.4).when(F.col("plane_unit") == 3, F.col("plane_x") / 10)
    focal = F.coalesce(F.col("focal_mm") * per_mm, F.try_divide(F.col("focal_mm") * F.col("width_px"), F.col("sensor_mm")))
    return raw.join(F.broadcast(sensors), "model", "left").select(F.element_at(F.split("path", "/"), -1).alias("name"), degrees("lat", "lat_ref").alias("latitude"), degrees("lon", "lon_ref").alias("longitude"), F.when(F.col("alt_ref") == 1, -F.col("alt")).otherwise(F.col("alt")).alias("altitude"), "model", focal.alias("focal_px"))
