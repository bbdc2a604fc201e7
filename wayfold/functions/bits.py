"""Packed integers: edges, access bits, elevation codes, delta and zigzag coding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinals of road classes in the access word, from 1 in this order.
ROAD_CLASSES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "residential", "living_street", "unclassified", "service", "track", "path", "footway", "cycleway", "pedestrian", "steps",
)
#: km/h by road class, and for others.
SPEEDS = {
    "motorway": 100, "motorway_link": 60, "trunk": 80, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 50, "secondary_link": 35, "tertiary": 40, "tertiary_link": 30,
    "residential": 30, "living_street": 20, "unclassified": 40, "service": 20, "track": 15, "path": 5, "footway": 5, "cycleway": 15, "pedestrian": 5, "steps": 3,
}
DEFAULT_SPEED = 30
#: Road classes that nothing travels on.
NOT_NAVIGABLE = ("proposed", "construction", "raceway", "bus_guideway", "platform", "elevator", "razed", "abandoned")
FOOT_NO, BICYCLE_NO, ONEWAY, ROUNDABOUT = 0x20, 0x40, 0x80, 0x100


def lookup(values: dict, key: Column, default) -> Column:
    """A small fixed table as an expression."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def speed_of(highway: Column) -> Column:
    return lookup(SPEEDS, highway, DEFAULT_SPEED)


def navigable(highway: Column) -> Column:
    return F.coalesce((highway != "") & ~highway.isin(*NOT_NAVIGABLE), F.lit(False))


def oneway_of(tag: Column) -> Column:
    return F.when(tag.isin("yes", "1", "true"), 1).when(tag == "-1", -1).otherwise(0)


def access_word(highway: Column, foot: Column, bicycle: Column, oneway: Column, junction: Column) -> Column:
    """Class ordinal in bits 0 to 4; foot=no, bicycle=no, one way forwards, roundabout above."""
    bit = lambda yes, value: F.when(yes, value).otherwise(0)
    ordinal = lookup({c: i for i, c in enumerate(ROAD_CLASSES, 1)}, highway, 0)
    round_ = F.trim(F.coalesce(junction, F.lit(""))).isin("roundabout", "circular", "mini_roundabout")
    return ordinal.bitwiseOR(bit(foot == "no", FOOT_NO)).bitwiseOR(bit(bicycle == "no", BICYCLE_NO)).bitwiseOR(bit(oneway_of(oneway) == 1, ONEWAY)).bitwiseOR(bit(round_, ROUNDABOUT))


def pack_edge(speed: Column, dist_dm: Column) -> Column:
    """Speed in the upper 8 of 32 bits, distance, cut off at 24 bits, below."""
    return F.shiftleft(speed.cast("long").bitwiseAND(F.lit(255)), 24).bitwiseOR(F.least(dist_dm.cast("long"), F.lit(0xFFFFFF)))


def unpack_edge(word: Column) -> Column:
    return F.struct(F.shiftrightunsigned(word, 24).alias("speed"), word.bitwiseAND(F.lit(0xFFFFFF)).alias("dist_dm"))


def zigzag(n: Column) -> Column:
    """Signed 32-bit to unsigned: small absolute values become small numbers."""
    return F.when(n >= 0, n * 2).otherwise(-n * 2 - 1).cast("long")


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor(v / 2) - 1).cast("long")


def elevation_code(metres: Column) -> Column:
    """Terrain code of an elevation quantised to 10 m: tenths of a metre above -10,000, 24 bits."""
    return F.greatest(F.lit(0), F.least(F.lit(0xFFFFFF), (F.rint(metres / 10) * 10 + 10000) * 10)).cast("long")


def rgb(code: Column) -> Column:
    return F.struct(F.shiftright(code, 16).bitwiseAND(F.lit(255)).alias("r"), F.shiftright(code, 8).bitwiseAND(F.lit(255)).alias("g"), code.bitwiseAND(F.lit(255)).alias("b"))


def elevation_of(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) * 0.1 - 10000


def piece_size(n: Column) -> Column:
    """Power of two that cuts n bytes into some 1,500 pieces, between 256 KiB and 8 MiB."""
    raw = F.greatest(F.floor(n / 1500), F.lit(16 * 1024))
    power = F.lit(2**24)
    for k in range(23, 13, -1):
        power = F.when(raw <= 2**k, 2**k).otherwise(power)
    return F.least(F.greatest(power, F.lit(256 * 1024)), F.lit(8 * 1024 * 1024)).cast("long")
