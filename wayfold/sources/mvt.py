"""Vector tiles to features: gzip or plain protobuf bytes in, one row per feature out, in Arrow batches.

features() explodes tiles(z, x, y, data) to (z, x, y, layer, extent, kind, props, parts), parts being an array of lines or rings of [px, py] in tile
pixels, y downwards; searchable() keeps the named ones and puts each at its representative point, as rows of the search feed. Damaged tiles give no rows.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rules
from ..functions.bits import lookup

SCHEMA = "z int, x int, y int, layer string, extent int, kind string, props map<string,string>, parts array<array<array<double>>>"
KINDS = {1: "Point", 2: "LineString", 3: "Polygon"}


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, wire, varint()
        elif wire == 2:
            size = varint()
            if at + size > end:
                raise ValueError("a field ends after the message")
            at += size
            yield key >> 3, wire, data[at - size : at]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            at += size
            yield key >> 3, wire, data[at - size : at]
        else:
            raise ValueError(f"wire type {wire}")


def numbers(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def signed(v: int) -> int:
    return v // 2 if v % 2 == 0 else -(v // 2) - 1


def scalar(data: bytes) -> str | None:
    """A tagged value as text."""
    for number, _, v in fields(data):
        if number == 1:
            return v.decode()
        if number == 2:
            return repr(struct.unpack("<f", v)[0])
        if number == 3:
            return repr(struct.unpack("<d", v)[0])
        if number in (4, 5):
            return str(v)
        if number == 6:
            return str(signed(v))
        if number == 7:
            return "true" if v else "false"
    return None


def geometry(codes: list[int]) -> list[list[list[float]]]:
    """Lines or rings of a command stream: 1 moves and starts a part, 2 draws on, 7 closes."""
    parts, x, y, at = [], 0, 0, 0
    while at < len(codes):
        command, count = codes[at] & 7, codes[at] >> 3
        at += 1
        if command == 7:
            if parts and parts[-1]:
                parts[-1].append(list(parts[-1][0]))
            continue
        for _ in range(count):
            x, y = x + signed(codes[at]), y + signed(codes[at + 1])
            at += 2
            if command == 1:
                parts.append([])
            parts[-1].append([float(x), float(y)])
    return parts


def decode(data: bytes) -> list[tuple]:
    """(layer, extent, kind, props, parts) of each feature of a tile."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out = []
    for number, _, layer in fields(data):
        if number != 3:
            continue
        name, extent, keys, values, found = "", 4096, [], [], []
        for n, _, v in fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                found.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                values.append(scalar(v))
            elif n == 5:
                extent = v
        for feature in found:
            tags, kind, codes = [], 0, []
            for n, _, v in fields(feature):
                if n == 2:
                    tags = numbers(v)
                elif n == 3:
                    kind = v
                elif n == 4:
                    codes = numbers(v)
            parts = geometry(codes)
            label = KINDS.get(kind, "Unknown")
            many = len(parts) > 1 and label in ("Point", "LineString")
            if label == "Point":
                parts = [[p for part in parts for p in part]]
            out.append((name, extent, ("Multi" if many else "") + label, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, parts))
    return out


def features(tiles: DataFrame) -> DataFrame:
    """One row per feature of tiles(z, x, y, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for z, x, y, data in zip(batch["z"], batch["x"], batch["y"], batch["data"]):
                try:
                    rows += [(z, x, y, *f) for f in decode(bytes(data or b""))]
                except (ValueError, IndexError, OSError, EOFError, UnicodeDecodeError, struct.error):
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "extent", "kind", "props", "parts"])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, SCHEMA)


def searchable(found: DataFrame) -> DataFrame:
    """(name, type, subtype, lat, lon) of named features of search layers, one row per name, type and place."""
    prop = lambda k: F.coalesce(F.col("props")[k], F.lit(""))
    name = rules.first_of(prop("name:latin"), prop("name"))
    point = geo.representative_point(F.col("kind"), F.col("parts"))
    rows = found.select(name.alias("name"), lookup(rules.SEARCH_TYPES, F.col("layer"), None).alias("type"), rules.first_of(prop("subclass"), prop("class")).alias("subtype"), "z", "x", "y", "extent", point.alias("p"))
    rows = rows.where("char_length(name) >= 2 and type is not null and p is not null")
    lat, lon = geo.pixel_lat(F.col("z"), F.col("y"), F.col("p")[1], F.col("extent")), geo.pixel_lon(F.col("z"), F.col("x"), F.col("p")[0], F.col("extent"))
    rows = rows.select("name", "type", "subtype", F.rint(lat * 1e6).alias("la"), F.rint(lon * 1e6).alias("lo"))
    keys = ["name", "type", F.rint(F.col("la") / 100).alias("_a"), F.rint(F.col("lo") / 100).alias("_b")]
    one = rows.groupBy(*keys).agg(F.min(F.struct("subtype", "la", "lo")).alias("r"))
    return one.select("name", "type", "r.subtype", (F.col("r.la") / 1e6).alias("lat"), (F.col("r.lo") / 1e6).alias("lon"))
