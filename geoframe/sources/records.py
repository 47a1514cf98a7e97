"""Binary files read by ranges of records: LAS points, and the images and points of binary models.

These are Python data sources.  Planning reads a file's header, and for records of varying length
the few bytes that tell each record's length; a partition is a range of bytes, read by its own task,
so a file of any size is spread over the cluster.  Files are opened by Arrow's file systems: local
paths and any URI that these know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, unless the reader's option ``bytes`` says otherwise.
BYTES = 64 << 20


def opened(path: str):
    """A stream with random access, and the file's size."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name), system.get_file_info(name).size


class Span(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class _Ranged(DataSourceReader):
    def __init__(self, path: str, size: int, schema: pa.Schema) -> None:
        self.path, self.size, self.schema = path, size, schema

    def span(self, part: Span) -> bytes:
        stream, _ = opened(self.path)
        with stream:
            stream.seek(part.start)
            return stream.read(part.end - part.start)


# -- LAS

#: Fixed values of the format: where a point format has red, green and blue.
COLOURS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_LAS = pa.schema([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("intensity", pa.int32()), ("classification", pa.int32()), ("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32())])


class LasHeader:
    """Of an uncompressed LAS file: where the points are, their format, and their scale."""

    def __init__(self, path: str) -> None:
        stream, size = opened(path)
        with stream:
            head = stream.read(375)
        if head[:4] != b"LASF" or len(head) < 227:
            raise ValueError(f"{path} is no LAS file")
        self.format = head[104]
        if self.format & 0xC0:
            raise NotImplementedError("compressed points (LAZ) need a codec that isn't installed here")
        self.at, self.length = struct.unpack_from("<I", head, 96)[0], struct.unpack_from("<H", head, 105)[0]
        self.n = struct.unpack_from("<I", head, 107)[0] or (struct.unpack_from("<Q", head, 247)[0] if head[25] >= 4 and len(head) >= 255 else 0)
        numbers = struct.unpack_from("<6d", head, 131)
        self.scale, self.offset = np.array(numbers[:3]), np.array(numbers[3:])
        if self.at + self.n * self.length > size:
            raise ValueError(f"{path} ends before its last point")


class _LasReader(_Ranged):
    def __init__(self, path: str, size: int, schema: pa.Schema) -> None:
        super().__init__(path, size, schema)
        self.head = LasHeader(path)

    def partitions(self) -> list[Span]:
        h, step = self.head, max(1, self.size // self.head.length)
        return [Span(h.at + i * h.length, h.at + min(h.n, i + step) * h.length) for i in range(0, h.n, step)] or [Span(h.at, h.at)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        h, data = self.head, self.span(part)
        for i in range(0, len(data) // h.length, 100_000):
            raw = np.frombuffer(data, np.uint8)[i * h.length : (i + 100_000) * h.length]
            rows = raw[: len(raw) // h.length * h.length].reshape(-1, h.length)
            of = lambda at, kind, n=1: np.ascontiguousarray(rows[:, at : at + n * np.dtype(kind).itemsize]).view(kind)  # noqa: B023, E731
            xyz = of(0, "<i4", 3) * h.scale + h.offset
            kind = of(15, "u1")[:, 0] & 31 if h.format < 6 else of(16, "u1")[:, 0]
            rgb = of(COLOURS[h.format], "<u2", 3) if h.format in COLOURS else None
            columns = [*xyz.T, of(12, "<u2")[:, 0], kind, *([None] * 3 if rgb is None else (rgb >> 8).T)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) if c is None else pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


class LasPoints(DataSource):
    """``spark.read.format("las").load(path)``: x, y, z, intensity, classification and r, g, b (eight
    bits, null if the format has none), in the file's own coordinates."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double, intensity int, classification int, r int, g int, b int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _LasReader(self.options["path"], int(self.options.get("bytes", BYTES)), _LAS)


# -- binary models

_SPOT = np.dtype([("x", "<f8"), ("y", "<f8"), ("p", "<i8")])
_SEEN = np.dtype([("image", "<i4"), ("spot", "<i4")])


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode(), end + 1


def _image(data: bytes, at: int) -> tuple[tuple, int]:
    image_id, *pose, camera_id = struct.unpack_from("<i7di", data, at)
    name, at = _text(data, at + 64)
    (n,) = struct.unpack_from("<Q", data, at)
    s = np.frombuffer(data, _SPOT, n, at + 8)
    spots = [dict(zip("uvp", v, strict=True)) for v in zip(s["x"].tolist(), s["y"].tolist(), s["p"].tolist(), strict=True)]
    return (image_id, pose[:4], pose[4:], camera_id, name, spots), at + 8 + n * _SPOT.itemsize


def _point(data: bytes, at: int) -> tuple[tuple, int]:
    *row, n = struct.unpack_from("<Q3d3BdQ", data, at)
    s = np.frombuffer(data, _SEEN, n, at + 51)
    return (*row, [{"image_id": i, "kp_idx": k} for i, k in zip(s["image"].tolist(), s["spot"].tolist(), strict=True)]), at + 51 + n * _SEEN.itemsize


def _image_length(stream, at: int) -> int:
    """Bytes of the record at ``at``, from its name and its number of keypoints."""
    stream.seek(at + 64)
    head, size = b"", 256
    while b"\0" not in head or len(head) < head.index(b"\0") + 9:
        more = stream.read(size)
        if not more:
            raise ValueError("the file ends within a record")
        head += more
    name = head.index(b"\0")
    return 64 + name + 1 + 8 + struct.unpack_from("<Q", head, name + 1)[0] * _SPOT.itemsize


def _point_length(stream, at: int) -> int:
    stream.seek(at + 43)
    return 51 + struct.unpack("<Q", stream.read(8))[0] * _SEEN.itemsize


class _ModelReader(_Ranged):
    def __init__(self, path: str, size: int, schema: pa.Schema, length, parse) -> None:
        super().__init__(path, size, schema)
        self.length, self.parse = length, parse

    def partitions(self) -> list[Span]:
        stream, size = opened(self.path)
        with stream:
            (n,) = struct.unpack("<Q", stream.read(8))
            spans, begin, at = [], 8, 8
            for _ in range(n):
                at += self.length(stream, at)
                if at - begin >= self.size:
                    spans.append(Span(begin, at))
                    begin = at
        if at > size:
            raise ValueError(f"{self.path} ends within a record")
        return [*spans, Span(begin, at)] if at > begin or not spans else spans

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        data, at, rows = self.span(part), 0, []
        while at < len(data):
            row, at = self.parse(data, at)
            rows.append(row)
            if len(rows) == 1000 or at == len(data):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)
                rows = []


class ModelImages(DataSource):
    """``images.bin`` of a binary model: image_id, q, t, camera_id, name and spots."""

    @classmethod
    def name(cls) -> str:
        return "model_images"

    def schema(self) -> str:
        return "image_id long, q array<double>, t array<double>, camera_id long, name string, spots array<struct<u:double,v:double,p:long>>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        list_ = pa.list_(pa.float64())
        kinds = pa.schema([("image_id", pa.int64()), ("q", list_), ("t", list_), ("camera_id", pa.int64()), ("name", pa.string()), ("spots", pa.list_(pa.struct([("u", pa.float64()), ("v", pa.float64()), ("p", pa.int64())])))])
        return _ModelReader(self.options["path"], int(self.options.get("bytes", BYTES)), kinds, _image_length, _image)


class ModelPoints(DataSource):
    """``points3D.bin`` of a binary model: point_id, x, y, z, r, g, b, error and seen."""

    @classmethod
    def name(cls) -> str:
        return "model_points"

    def schema(self) -> str:
        return "point_id long, x double, y double, z double, r short, g short, b short, error double, seen array<struct<image_id:long,kp_idx:long>>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        double, short, seen = pa.float64(), pa.int16(), pa.list_(pa.struct([("image_id", pa.int64()), ("kp_idx", pa.int64())]))
        kinds = pa.schema([("point_id", pa.int64()), ("x", double), ("y", double), ("z", double), ("r", short), ("g", short), ("b", short), ("error", double), ("seen", seen)])
        return _ModelReader(self.options["path"], int(self.options.get("bytes", BYTES)), kinds, _point_length, _point)


def read(spark: SparkSession, source: type[DataSource], path: str, size: int = BYTES) -> DataFrame:
    """A file by one of these sources, in partitions of about ``size`` bytes."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("bytes", str(size)).load(path)
