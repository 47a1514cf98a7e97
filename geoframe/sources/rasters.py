"""Gray rasters from image files: PGM, PPM and PNG.  Other formats need a codec."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of red, green and blue in a gray value; PNG's signature and channels by color type.
GRAY = np.array([0.299, 0.587, 0.114])
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([2356])(?:\s+(?:#[^\n]*\n\s*)*)(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", data)
    if head is None:
        raise ValueError("not a gray or color netpbm image")
    kind, (w, h, top) = int(head[1]), map(int, head.groups()[1:])
    c = 3 if kind in (3, 6) else 1
    if kind in (2, 3):
        flat = np.array(data[head.end() :].split()[: w * h * c], float)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * c, head.end())
    return flat.reshape(h, w, c) / top


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filter that each row names in its first byte; ``step``: bytes of a pixel."""
    h, n = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((h + 1, n + step), np.int64)  # a row of zeros above, a pixel of zeros on the left
    for y in range(h):
        kind, line, up, now = rows[y, 0], rows[y, 1:].astype(np.int64), out[y], out[y + 1]
        if kind in (0, 2):
            now[step:] = (line + (up[step:] if kind == 2 else 0)) & 255
        elif kind == 1:
            now[step:] = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind in (3, 4):
            for i in range(n):
                a, b, c = int(now[i]), int(up[i + step]), int(up[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i + step] = (line[i] + guess) & 255
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:, step:].astype(np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, body, palette = len(_PNG), [], None
    w = h = depth = color = 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
            if interlaced or depth not in (8, 16) or color not in _CHANNELS:
                raise NotImplementedError("PNG images with under 8 bits a channel, or interlaced")
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        at += 12 + size
    c, wide = _CHANNELS[color], depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c * wide)
    flat = _unfiltered(rows, c * wide)
    pixels = (flat.copy().view(">u2") if wide == 2 else flat).reshape(h, w, c)
    if color == 3:
        return palette[pixels[..., 0]] / 255
    return pixels[..., : 3 if c >= 3 else 1] / (2**depth - 1)


def gray(data: bytes) -> np.ndarray:
    """Gray values from 0 to 1 (rows, columns); alpha is left out."""
    pixels = _png(data) if data.startswith(_PNG) else _netpbm(data) if data[:1] == b"P" else None
    if pixels is None:
        raise NotImplementedError("images other than PGM, PPM and PNG need a codec")
    return (pixels @ GRAY if pixels.shape[2] == 3 else pixels[..., 0]).astype(np.float32)


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [gray(bytes(c)) for c in frame["content"]]
        yield pd.DataFrame({"name": frame["name"], "height": [g.shape[0] for g in found], "width": [g.shape[1] for g in found], "gray": [g.tobytes() for g in found]})


def read_gray(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file), height, width and gray (32-bit floats, row by row) of the images that ``path`` names; none is an error."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(_decoded, "name string, height int, width int, gray binary")


def read_rasters(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """image_id, height, width and gray of the images whose names the model has."""
    return read_gray(spark, path).join(images.select("image_id", "name"), "name").select("image_id", "height", "width", "gray")
