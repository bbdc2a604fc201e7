"""Byte codecs that have no built-in form, as Arrow batches: polylines, gzip. And the bbox parser."""

from __future__ import annotations

import gzip as _gzip
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POINTS = T.ArrayType(T.StructType([T.StructField("lon_e7", T.LongType()), T.StructField("lat_e7", T.LongType())]))


def _put(n: int, out: bytearray) -> None:
    """A signed integer, zigzagged, seven bits to a byte, low bits first."""
    v = n * 2 if n >= 0 else -n * 2 - 1
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


def pack_line(points: list[tuple[int, int]]) -> bytes:
    """The first point as two little-endian 32-bit integers, the others as differences."""
    if not points:
        return b""
    out = bytearray(struct.pack("<ii", *points[0]))
    for (a, b), (c, d) in zip(points, points[1:]):
        _put(c - a, out)
        _put(d - b, out)
    return bytes(out)


def unpack_line(blob: bytes) -> list[tuple[int, int]]:
    if len(blob) < 8:
        return []
    points, numbers, value, shift = [struct.unpack_from("<ii", blob)], [], 0, 0
    for byte in blob[8:]:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            numbers.append(value // 2 if value % 2 == 0 else -(value // 2) - 1)
            value = shift = 0
    for dlon, dlat in zip(numbers[::2], numbers[1::2]):
        points.append((points[-1][0] + dlon, points[-1][1] + dlat))
    return points


@F.pandas_udf(T.BinaryType())
def encode_line(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: None if line is None else pack_line([(p["lon_e7"], p["lat_e7"]) for p in line]))


@F.pandas_udf(_POINTS)
def decode_line(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else [{"lon_e7": x, "lat_e7": y} for x, y in unpack_line(bytes(b))])


@F.pandas_udf(T.BinaryType())
def gzip(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else _gzip.compress(bytes(b), mtime=0))


def _plain(b):
    if b is None or bytes(b[:2]) != b"\x1f\x8b":
        return b
    try:
        return _gzip.decompress(bytes(b))
    except (OSError, EOFError, ValueError):
        return None


@F.pandas_udf(T.BinaryType())
def gunzip(blobs: pd.Series) -> pd.Series:
    """Unpacked where the magic bytes say gzip, else as it is; damaged input gives null."""
    return blobs.map(_plain)


def parse_bbox(text: Column) -> Column:
    """struct<lon, lat, zoom> of "west,south,east,north": centre and a first zoom by extent; null if it isn't four numbers."""
    part = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    w, s, e, n = (F.get(part, F.lit(i)) for i in range(4))
    extent = F.greatest(e - w, n - s)
    zoom = F.lit(13)
    for least, z in ((0.1, 12), (0.2, 11), (0.5, 10), (1, 9), (2, 8), (5, 7), (10, 6), (50, 4)):
        zoom = F.when(extent > least, z).otherwise(zoom)
    whole = (F.size(part) == 4) & F.forall(part, lambda x: x.isNotNull())
    return F.when(whole, F.struct(((w + e) / 2).alias("lon"), ((s + n) / 2).alias("lat"), zoom.alias("zoom")))
