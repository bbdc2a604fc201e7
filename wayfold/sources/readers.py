"""Sources: tolerant line formats, directories of tiles and chunks, archives, tables of map elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One search feature: core columns and optional ones, which are null where a record doesn't have them.
FEATURE = "name string, type string, subtype string, lat double, lon double, location string, cat string, ws string, p string, soc array<string>, brand string, wd string, source string"
#: Map elements as tables; a conversion of the binary format writes these.
NODES = "id long, lat double, lon double, tags map<string,string>"
WAYS = "id long, refs array<long>, tags map<string,string>"
RELATIONS = "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"


def elements(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a folder with osm_nodes, osm_ways and osm_relations."""
    return tuple(spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in (("osm_nodes", NODES), ("osm_ways", WAYS), ("osm_relations", RELATIONS)))


def stats_table(spark: SparkSession, path: str, name: str, numbers: list[str]) -> DataFrame:
    """(name, numbers) of a table that writers.stats() wrote, its totals included."""
    from .writers import NAME_WIDTH, NUMBER_WIDTH

    at = lambda i: NAME_WIDTH + 2 + i * (NUMBER_WIDTH + 1)
    number = lambda i: F.replace(F.trim(F.substring("value", at(i), NUMBER_WIDTH)), F.lit(","), F.lit("")).cast("long")
    lines = spark.read.schema("value string, part int").text(path).where("part > 0")
    return lines.select(F.trim(F.substring("value", 1, NAME_WIDTH)).alias(name), *[number(i).alias(x) for i, x in enumerate(numbers)])


def located(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with `line`, their points in order; ways with a node that isn't there are left out, as they have no place."""
    at = ways.select("id", F.size("refs").alias("_n"), F.posexplode("refs").alias("pos", "ref"))
    points = at.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref").groupBy("id", "_n").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "lat", "lon"))).alias("line"))
    return ways.join(points.where(F.size("line") == F.col("_n")).select("id", "line"), "id")


def feed(spark: SparkSession, path: str, only: str | None = None, schema: str = FEATURE) -> DataFrame:
    """A feed of one JSON object per line. Lines that aren't are skipped; `only` keeps lines that contain a text, before they are parsed."""
    lines = spark.read.text(path)
    if only:
        lines = lines.where(F.contains("value", F.lit(only)))
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(props map, kind, coords) of a file of features, each line with or without a record separator in front."""
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", "^[\x1e\\s]+", ""), schema).alias("f"))
    return rows.where("f.geometry is not null").select(F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coords"))


def bucket_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the JSON bucket files of a cache folder, without its manifest and id lists."""
    rows = spark.read.schema(schema).json(path, pathGlobFilter="*.json", recursiveFileLookup=True)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return rows.where((name != "manifest.json") & ~name.startswith("qids_"))


def tile_folder(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, ext, size, modified) of a folder {z}/{x}/{y}.{ext}; contents aren't read.

    The file source leaves out files of 0 bytes, so empty tiles count as missing ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    part = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.(\w+)$", i)
    rows = files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), part(4).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where("z <> ''").select(*[F.col(c).cast("int").alias(c) for c in "zxy"], "ext", "size", "modified")


def tile_range(tiles: DataFrame, box: tuple[float, float, float, float] | None = None, zoom: int | None = None, max_zoom: int | None = None) -> DataFrame:
    """Tiles of one zoom, up to a zoom, or of a box: range predicates on z, x, y, so they reach a partitioned table's files."""
    from ..functions import geo

    if zoom is not None:
        tiles = tiles.where(F.col("z") == zoom)
    if max_zoom is not None:
        tiles = tiles.where(F.col("z") <= max_zoom)
    if box is not None and not (box[0] <= -180 and box[2] >= 180 and box[1] <= -85 and box[3] >= 85):
        r = geo.tile_range(*box, F.col("z"))
        tiles = tiles.where(F.col("x").between(r["x0"], r["x1"]) & F.col("y").between(r["y0"], r["y1"]))
    return tiles


def whole_chunks(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, n, body) of chunked blobs put together in order; a blob with a missing, torn or wrong chunk has a null body.

    parts(name, idx, data), manifest(name, idx, size, sha256).
    """
    both = manifest.join(parts, ["name", "idx"], "left")
    good = (F.length("data") == F.col("size")) & (F.sha2("data", 256) == F.col("sha256"))
    out = both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("_good"), F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("_parts"))
    body = F.aggregate("_parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["data"]))
    return out.select("name", "n", F.when(F.col("_good"), body).alias("body"))


def side_sources(spark: SparkSession, folder: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Tables beside each other in a folder as one, with `layer`; of each only the wanted columns are read, and others of them are null."""
    parts = [spark.read.parquet(f"{folder}/{layer}").select(*columns, F.lit(layer).alias("layer")) for layer, columns in wanted.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
