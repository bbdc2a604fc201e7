"""MBTiles files as a data source: spark.read.format("mbtiles").option("path", ...).load() gives (z, x, y, data).

Options: path (a file that every executor can read), min_zoom, max_zoom, west, south, east, north, columns (tile columns in one partition, default 256).
The driver reads the file's zooms and column ranges only; partitions are runs of columns of one zoom, each read by one task in order of its index. Rows are
numbered from the south in the file and from the north in the result.
"""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "z int, x int, y int, data binary"


class Columns(InputPartition):
    """Columns first to last, and rows from the south low to high, of one zoom."""

    def __init__(self, zoom: int, first: int, last: int, low: int, high: int) -> None:
        self.zoom, self.first, self.last, self.low, self.high = zoom, first, last, low, high


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.least, self.most = int(options.get("min_zoom", 0)), int(options.get("max_zoom", 30))
        self.step = max(1, int(options.get("columns", 256)))
        sides = [options.get(s) for s in ("west", "south", "east", "north")]
        self.box = None if None in sides else tuple(map(float, sides))

    def _limits(self, zoom: int) -> tuple[int, int, int, int]:
        """First and last column, and lowest and highest row from the south, of the box at a zoom."""
        n = 1 << zoom
        if self.box is None:
            return 0, n - 1, 0, n - 1
        west, south, east, north = self.box

        def row(lat: float) -> int:
            r = math.radians(max(-85.05112878, min(85.05112878, lat)))
            return int((1 - math.asinh(math.tan(r)) / math.pi) / 2 * n)

        inside = lambda v: max(0, min(n - 1, v))
        return inside(int((west + 180) / 360 * n)), inside(int((east + 180) / 360 * n)), n - 1 - inside(row(south)), n - 1 - inside(row(north))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            ranges = db.execute("select zoom_level, min(tile_column), max(tile_column) from tiles where zoom_level between ? and ? group by zoom_level order by zoom_level", (self.least, self.most)).fetchall()
        out: list[InputPartition] = []
        for zoom, low, high in ranges:
            first, last, south, north = self._limits(zoom)
            low, high = max(low, first), min(high, last)
            out += [Columns(zoom, x, min(high, x + self.step - 1), south, north) for x in range(low, high + 1, self.step)]
        return out or [Columns(-1, 0, -1, 0, -1)]

    def read(self, partition: Columns) -> Iterator[tuple]:
        db = _open(self.path)
        rows = db.execute(
            "select zoom_level, tile_column, tile_row, tile_data from tiles where zoom_level = ? and tile_column between ? and ? and tile_row between ? and ? order by tile_column, tile_row",
            (partition.zoom, partition.first, partition.last, partition.low, partition.high),
        )
        for z, x, y, data in rows:
            yield z, x, (1 << z) - 1 - y, data
        db.close()


class MBTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """(z, x, y, data) of an MBTiles file."""
    spark.dataSource.register(MBTiles)
    return spark.read.format("mbtiles").options(path=path, **options).load()


def metadata(path: str) -> dict[str, str]:
    """The file's own description."""
    with _open(path) as db:
        return dict(db.execute("select name, value from metadata"))
