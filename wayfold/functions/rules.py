"""Rules as data, compiled to CASE ladders: layers, classes, ranks and zooms of tagged features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import lookup

NONE = 99  # a zoom that no tile has


def number(tag: Column) -> Column:
    """A tag as a number, null if it isn't one."""
    return tag.try_cast("double")


def first_of(*tags: Column) -> Column:
    """The first non-empty of several tags, '' if there is none."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tags], F.lit(""))


# -- places -------------------------------------------------------------------------------------------------------------------


def capital_level(capital: Column) -> Column:
    return F.nullif(F.when(capital == "yes", 2.0).otherwise(F.coalesce(number(capital), F.lit(0.0))), F.lit(0.0)).cast("int")


#: Population above which a city or town has the rank of its position.
CITY_RANKS = (3_000_000, 1_000_000, 500_000, 200_000, 100_000, 75_000, 50_000, 25_000, 10_000)


def place_rank(place: Column, population: Column, capital: Column) -> Column:
    """Capitals of levels 2 to 4 rank by level, moved by population and class; else cities and towns rank by population."""
    moved = capital + F.when(population > 3e6, -2).when(population > 1e6, -1).when(population < 100_000, 2).otherwise(0)
    moved = moved + F.when(place == "city", 0).when(place == "town", 3).otherwise(5)
    by_size = F.lit(10)
    for rank, least in reversed(list(enumerate(CITY_RANKS, 1))):
        by_size = F.when(population > least, rank).otherwise(by_size)
    return F.when(capital.between(2, 4), moved).when(place.isin("city", "town"), by_size)


#: First zoom by place class; classes that depend on population are in place_zoom().
PLACE_ZOOMS = {
    "continent": 0, "state": 4, "province": 5, "city": 5, "town": 8, "village": 10, "borough": 10, "suburb": 11, "quarter": 12, "hamlet": 12, "neighbourhood": 13,
    "isolated_dwelling": 13, "locality": 13, "island": 12,
}


def country_rank(population: Column) -> Column:
    return F.when(population > 50_000_000, 1).when(population > 20_000_000, 2).otherwise(3)


def place_zoom(place: Column, population: Column) -> Column:
    return F.when(place == "country", country_rank(population)).when((place == "town") & (population > 8000), 7).when((place == "village") & (population > 2000), 9).otherwise(lookup(PLACE_ZOOMS, place, 13))


#: Classes of aerodromes that are told apart.
AERODROMES = ("international", "public", "regional", "military", "private")


def aerodrome_class(aerodrome: Column) -> Column:
    return F.when(aerodrome.isin(*AERODROMES), aerodrome).otherwise("other")


# -- roads and rails ------------------------------------------------------------------------------------------------------------

#: First zoom by road class, from which classes are merged, links, paved and unpaved surfaces.
ROAD_ZOOMS = {
    "motorway": 4, "trunk": 4, "primary": 4, "secondary": 9, "motorway_link": 9, "trunk_link": 9, "primary_link": 10, "secondary_link": 10, "tertiary": 11, "tertiary_link": 11, "busway": 11, "bus_guideway": 11,
    "unclassified": 12, "residential": 12, "road": 12, "living_street": 12, "raceway": 12, "track": 13, "service": 13, "footway": 14, "cycleway": 14, "bridleway": 14, "path": 14, "steps": 14, "pedestrian": 14, "platform": 14,
}
MINOR = ("unclassified", "residential", "road", "living_street")
PATHS = ("footway", "cycleway", "bridleway", "path", "steps", "pedestrian", "platform")
LINKS = ("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
PAVED = ("paved", "asphalt", "cobblestone", "concrete", "concrete:lanes", "concrete:plates", "metal", "paving_stones", "sett", "unhewn_cobblestone", "wood")
UNPAVED = ("unpaved", "compacted", "dirt", "earth", "fine_gravel", "grass", "grass_paver", "gravel", "gravel_turf", "ground", "ice", "mud", "pebblestone", "salt", "sand", "snow", "woodchips")
NAME_ZOOMS = {"motorway": 7, "trunk": 8, "primary": 10, "secondary": 11, "minor": 13, "track": 13, "tertiary": 13}


def road(highway: Column, construction: Column, is_area: Column) -> Column:
    """struct<class, subclass, minzoom, ramp, name_zoom>; a road under construction is what it will be, with a suffix."""
    building = (highway == "construction") & (construction != "")
    h = F.when(building, construction).otherwise(highway)
    zoom = lookup(ROAD_ZOOMS, h, NONE)
    sub = F.when(h.isin(*MINOR, *PATHS), h)
    merged = F.when(h.isin(*MINOR), "minor").when(h.isin(*PATHS), "path").when(h.isin(*LINKS), F.substring_index(highway, "_", 1)).otherwise(h)
    shown = F.concat(merged, F.when(building, "_construction").otherwise(""))
    return F.struct(
        shown.alias("class"), sub.alias("subclass"), F.when(is_area & (shown != "path"), NONE).otherwise(zoom).alias("minzoom"), h.isin(*LINKS).alias("ramp"), lookup(NAME_ZOOMS, shown, 14).alias("name_zoom"),
    )


def surface_class(surface: Column) -> Column:
    return F.when(surface.isin(*PAVED), "paved").when(surface.isin(*UNPAVED), "unpaved")


#: Railway classes.
RAILWAYS = {"rail": "rail", "narrow_gauge": "rail", "preserved": "rail", "funicular": "rail", "subway": "transit", "light_rail": "transit", "monorail": "transit", "tram": "transit"}


def railway(kind: Column, usage: Column, service: Column) -> Column:
    """struct<class, minzoom>, null for what isn't a railway in use."""
    plain = service == ""
    zoom = F.when((kind == "rail") & plain, F.when(usage == "main", 8).otherwise(10)).when((kind == "narrow_gauge") & plain, 10).when((kind == "light_rail") & plain, 11).otherwise(14)
    return F.when(kind.isin(*RAILWAYS), F.struct(lookup(RAILWAYS, kind, None).alias("class"), zoom.alias("minzoom")))


def boundary_zoom(level: Column) -> Column:
    return F.when((level >= 3) & (level < 5), 4).when((level >= 5) & (level < 7), 8).when(level == 7, 10).when(level >= 8, 12).otherwise(0)


# -- water, land, points of interest ----------------------------------------------------------------------------------------------

#: Waterways that are lines, and what else counts as water.
WATERWAYS = ("stream", "river", "canal", "drain", "ditch")
WATERS = (*WATERWAYS, "riverbank", "dock")


def waterway_layer(waterway: Column, is_closed: Column, name: Column) -> Column:
    return (
        F.when(waterway.isin(*WATERWAYS) & ~is_closed, F.when((waterway == "river") & (name != ""), "waterway").otherwise("waterway_detail"))
        .when(waterway.isin("boatyard", "fuel"), "landuse").when(waterway == "dam", "building")
    )


def water_class(natural: Column, leisure: Column, landuse: Column, waterway: Column, is_closed: Column) -> Column:
    """lake or river for water areas, else null."""
    water = (natural == "water") | (leisure == "swimming_pool") | landuse.isin("reservoir", "basin") | waterway.isin(*WATERS)
    return F.when(water & is_closed, F.when(waterway != "", "river").otherwise("lake"))


#: Land cover classes by tag value, and values of land use.
LANDCOVER = {
    "wood": "wood", "forest": "wood", "wetland": "wetland", "beach": "sand", "sand": "sand", "dune": "sand", "farmland": "farmland", "farm": "farmland", "orchard": "farmland", "vineyard": "farmland", "plant_nursery": "farmland",
    "glacier": "ice", "ice_shelf": "ice", "bare_rock": "rock", "scree": "rock", "fell": "grass", "grassland": "grass", "grass": "grass", "heath": "grass", "meadow": "grass", "allotments": "grass", "park": "grass",
    "village_green": "grass", "recreation_ground": "grass", "scrub": "grass", "shrubbery": "grass", "tundra": "grass", "garden": "grass", "golf_course": "grass",
}
LANDUSE = ("school", "university", "kindergarten", "college", "library", "hospital", "railway", "cemetery", "military", "residential", "commercial", "industrial", "retail", "stadium", "pitch", "playground", "theme_park", "bus_station", "zoo")


def land(landuse: Column, natural: Column, leisure: Column, amenity: Column, tourism: Column) -> Column:
    """struct<layer, class, subclass> of land cover, else of land use, else null."""
    cover, use = first_of(landuse, natural, leisure), first_of(landuse, natural, leisure, amenity, tourism)
    as_ = lambda layer, c, s: F.struct(F.lit(layer).alias("layer"), c.alias("class"), s.cast("string").alias("subclass"))
    return F.when(cover.isin(*LANDCOVER), as_("landcover", lookup(LANDCOVER, cover, None), cover)).when(use.isin(*LANDUSE), as_("landuse", use, F.lit(None)))


def park_class(boundary: Column, leisure: Column) -> Column:
    return F.when(boundary == "national_park", boundary).when(leisure == "nature_reserve", leisure)


#: Class by tag value (the key itself for others), rank by class (25 for others), values whose class is the value and whose subclass is another tag.
POI_CLASSES = {
    "townhall": "town_hall", "public_building": "town_hall", "courthouse": "town_hall", "community_centre": "town_hall", "golf": "golf", "golf_course": "golf", "miniature_golf": "golf", "fast_food": "fast_food", "food_court": "fast_food",
    "park": "park", "bbq": "park", "bus_stop": "bus", "bus_station": "bus", "subway_entrance": "entrance", "train_station_entrance": "entrance", "camp_site": "campsite", "caravan_site": "campsite", "laundry": "laundry", "dry_cleaning": "laundry",
    "supermarket": "grocery", "deli": "grocery", "delicatessen": "grocery", "department_store": "grocery", "greengrocer": "grocery", "marketplace": "grocery", "books": "library", "library": "library", "university": "college", "college": "college",
    "hotel": "lodging", "motel": "lodging", "bed_and_breakfast": "lodging", "guest_house": "lodging", "hostel": "lodging", "chalet": "lodging", "alpine_hut": "lodging", "dormitory": "lodging", "chocolate": "ice_cream", "confectionery": "ice_cream",
    "post_box": "post", "post_office": "post", "cafe": "cafe", "school": "school", "kindergarten": "school", "alcohol": "alcohol_shop", "beverages": "alcohol_shop", "wine": "alcohol_shop", "bar": "bar", "nightclub": "bar", "marina": "harbor", "dock": "harbor",
    "car": "car", "car_repair": "car", "taxi": "car", "hospital": "hospital", "nursing_home": "hospital", "clinic": "hospital", "grave_yard": "cemetery", "cemetery": "cemetery", "attraction": "attraction", "viewpoint": "attraction", "biergarten": "beer", "pub": "beer",
    "music": "music", "musical_instrument": "music", "american_football": "stadium", "stadium": "stadium", "soccer": "stadium", "art": "art_gallery", "artwork": "art_gallery", "gallery": "art_gallery", "arts_centre": "art_gallery",
    "bag": "clothing_store", "clothes": "clothing_store", "swimming_area": "swimming", "swimming": "swimming", "castle": "castle", "ruins": "castle",
}
POI_RANKS = {
    "hospital": 1, "railway": 2, "bus": 3, "attraction": 4, "harbor": 5, "college": 6, "school": 7, "stadium": 8, "zoo": 9, "town_hall": 10, "campsite": 11, "cemetery": 12, "park": 13, "library": 14, "police": 15, "post": 16, "golf": 17,
    "shop": 18, "grocery": 19, "fast_food": 20, "clothing_store": 21, "bar": 22,
}
POI_SUBCLASSES = {"information": "information", "place_of_worship": "religion", "pitch": "sport"}
#: Keys in order of precedence, with the values that make a point of interest. A parameter of poi(). Any other shop is one too, of class shop.
POI_KEYS: dict[str, tuple[str, ...]] = {
    "aerialway": (
        "station",
    ),
    "amenity": (
        "arts_centre", "bank", "bar", "bbq", "bicycle_parking", "bicycle_rental", "biergarten", "bus_station", "cafe", "cinema", "clinic", "college", "community_centre",
        "courthouse", "dentist", "doctors", "embassy", "fast_food", "ferry_terminal", "fire_station", "food_court", "fuel", "grave_yard", "hospital", "ice_cream",
        "kindergarten", "library", "marketplace", "motorcycle_parking", "nightclub", "nursing_home", "parking", "pharmacy", "place_of_worship", "police", "post_box",
        "post_office", "prison", "pub", "public_building", "recycling", "restaurant", "school", "shelter", "swimming_pool", "taxi", "telephone", "theatre", "toilets",
        "townhall", "university", "veterinary", "waste_basket",
    ),
    "barrier": (
        "bollard", "border_control", "cycle_barrier", "gate", "lift_gate", "sally_port", "stile", "toll_booth",
    ),
    "building": (
        "dormitory",
    ),
    "highway": (
        "bus_stop",
    ),
    "historic": (
        "monument", "castle", "ruins",
    ),
    "landuse": (
        "basin", "brownfield", "cemetery", "reservoir", "winter_sports",
    ),
    "leisure": (
        "dog_park", "escape_game", "garden", "golf_course", "ice_rink", "hackerspace", "marina", "miniature_golf", "park", "pitch", "playground", "sports_centre", "stadium",
        "swimming_area", "swimming_pool", "water_park",
    ),
    "railway": (
        "halt", "station", "subway_entrance", "train_station_entrance", "tram_stop",
    ),
    "shop": (
        "accessories", "alcohol", "antiques", "art", "bag", "bakery", "beauty", "bed", "beverages", "bicycle", "books", "boutique", "butcher", "camera", "car", "car_repair",
        "carpet", "charity", "chemist", "chocolate", "clothes", "coffee", "computer", "confectionery", "convenience", "copyshop", "cosmetics", "deli", "delicatessen",
        "department_store", "doityourself", "dry_cleaning", "electronics", "erotic", "fabric", "florist", "frozen_food", "furniture", "garden_centre", "general", "gift",
        "greengrocer", "hairdresser", "hardware", "hearing_aids", "hifi", "ice_cream", "interior_decoration", "jewelry", "kiosk", "lamps", "laundry", "mall", "massage",
        "mobile_phone", "motorcycle", "music", "musical_instrument", "newsagent", "optician", "outdoor", "perfume", "perfumery", "pet", "photo", "second_hand", "shoes",
        "sports", "stationery", "supermarket", "tailor", "tattoo", "ticket", "tobacco", "toys", "travel_agency", "video", "video_games", "watches", "weapons", "wholesale",
        "wine",
    ),
    "sport": (
        "american_football", "archery", "athletics", "australian_football", "badminton", "baseball", "basketball", "beachvolleyball", "billiards", "bmx", "boules", "bowls",
        "boxing", "canadian_football", "canoe", "chess", "climbing", "climbing_adventure", "cricket", "cricket_nets", "croquet", "curling", "cycling", "disc_golf", "diving",
        "dog_racing", "equestrian", "fatsal", "field_hockey", "free_flying", "gaelic_games", "golf", "gymnastics", "handball", "hockey", "horse_racing", "horseshoes",
        "ice_hockey", "ice_stock", "judo", "karting", "korfball", "long_jump", "model_aerodrome", "motocross", "motor", "multi", "netball", "orienteering", "paddle_tennis",
        "paintball", "paragliding", "pelota", "racquet", "rc_car", "rowing", "rugby", "rugby_league", "rugby_union", "running", "sailing", "scuba_diving", "shooting",
        "shooting_range", "skateboard", "skating", "skiing", "soccer", "surfing", "swimming", "table_soccer", "table_tennis", "team_handball", "tennis", "toboggan",
        "volleyball", "water_ski", "yoga",
    ),
    "tourism": (
        "alpine_hut", "aquarium", "artwork", "attraction", "bed_and_breakfast", "camp_site", "caravan_site", "chalet", "gallery", "guest_house", "hostel", "hotel",
        "information", "motel", "museum", "picnic_site", "theme_park", "viewpoint", "zoo",
    ),
    "waterway": (
        "dock",
    ),
}


def poi(tags: dict[str, Column], keys: dict[str, tuple[str, ...]] = POI_KEYS) -> Column:
    """struct<rank, class, subclass, layer> of the first key whose value makes a point of interest, else null."""

    def found(rank: Column, cls: Column, sub: Column) -> Column:
        return F.struct(rank.alias("rank"), cls.alias("class"), sub.alias("subclass"), F.when(rank > 4, "poi_detail").otherwise("poi").alias("layer"))

    shop = tags.get("shop", F.lit(""))
    out = F.when(shop != "", found(F.lit(POI_RANKS["shop"]), F.lit("shop"), shop))
    for key, values in reversed(list(keys.items())):
        if key not in tags:
            continue
        v = tags[key]
        cls = lookup(POI_CLASSES, v, key)
        special = lookup(POI_SUBCLASSES, v, "")
        sub = v
        for s in sorted(set(POI_SUBCLASSES.values())):
            sub = F.when(special == s, tags.get(s, F.lit(""))).otherwise(sub)
        out = F.when(v.isin(*values), found(lookup(POI_RANKS, cls, 25), F.when(special != "", v).otherwise(cls), sub)).otherwise(out)
    return out


# -- attributes that many layers share ---------------------------------------------------------------------------------------------


def brunnel(bridge: Column, tunnel: Column, ford: Column) -> Column:
    return F.when(bridge == "yes", "bridge").when(tunnel == "yes", "tunnel").when(ford == "yes", "ford")


#: Metres per pixel of a 256-pixel tile at zooms 5 to 12.
METRES = {5: 4891.97, 6: 2445.98, 7: 1222.99, 8: 611.5, 9: 305.7, 10: 152.9, 11: 76.4, 12: 38.2}


def zoom_by_area(area: Column, least: int = 0) -> Column:
    """First zoom of a polygon: one more than that at which its area exceeds a pixel's."""
    out = F.lit(14)
    for z, m in reversed(METRES.items()):
        if least <= z + 1:
            out = F.when(area > m * m, z + 1).otherwise(out)
    return out


#: Fixed value: metres of a storey.
FLOOR = 3.66


def building_height(height: Column, min_height: Column, levels: Column, min_level: Column) -> Column:
    """struct<top, bottom> in metres; floors count where no height is given, and a top below the bottom is a height above it."""
    top = F.coalesce(number(height), number(levels) * FLOOR, F.lit(FLOOR))
    bottom = F.coalesce(number(min_height), number(min_level) * FLOOR, F.lit(0.0))
    return F.struct(F.when(top < bottom, top + bottom).otherwise(top).alias("top"), bottom.alias("bottom"))


#: Weight of a road class in the drawing order, 3 for others.
DRAW_ORDER = {"motorway": 9, "trunk": 8, "primary": 6, "secondary": 5, "tertiary": 4}


def z_order(highway: Column, layer: Column, bridge: Column, tunnel: Column) -> Column:
    up = F.when((bridge != "") & (bridge != "no"), 10).when((tunnel != "") & (tunnel != "no"), -10).otherwise(0)
    return up + F.coalesce(F.greatest(F.lit(-7.0), F.least(F.lit(7.0), number(layer))), F.lit(0.0)) * 10 + lookup(DRAW_ORDER, highway, 3)


def names(name: Column, preferred: Column) -> Column:
    """struct<latin, local>: the preferred language's name, and the base name where it differs."""
    has = preferred != ""
    return F.struct(F.when(has, preferred).otherwise(name).alias("latin"), F.when(has & (preferred != name), name).alias("local"))


def remapped(featurecla: Column, layer: Column) -> Column:
    """struct<class, subclass> of features from side sources."""
    as_ = lambda c, s: F.struct(F.lit(c).cast("string").alias("class"), F.lit(s).cast("string").alias("subclass"))
    return F.when(featurecla == "Glaciated areas", as_(None, "glacier")).when(featurecla == "Antarctic Ice Shelf", as_(None, "ice_shelf")).when(featurecla == "Urban area", as_("residential", None)).when(layer == "ocean", as_("ocean", None))


def feature_type(tags: dict[str, Column], geometry: Column) -> Column:
    """Type of a feature with a knowledge-base id: the first of several tags, else its geometry."""
    # fixed values: the order of tags
    order = ("tourism", "historic", "natural", "amenity", "leisure", "aeroway")
    return first_of(tags["place"], F.when(tags["boundary"] == "administrative", "admin").otherwise(""), *[tags[k] for k in order], geometry)


#: Search type by layer; raster road class by class.
SEARCH_TYPES = {"place": "place", "poi": "poi", "transportation_name": "street", "water_name": "water", "waterway": "water", "park": "park", "mountain_peak": "peak", "aerodrome_label": "airport", "building": "building", "landuse": "area"}
RASTER_ROADS = {
    **{f"{c}{s}": c for c in ("motorway", "trunk", "primary", "secondary", "tertiary") for s in ("", "_link")}, "service": "service", "track": "service", "rail": "rail",
    **dict.fromkeys(("path", "footway", "cycleway", "bridleway", "steps"), "path"),
}
#: Zooms of a layer, and the layer that it is written to.
LAYERS = {
    "place": (0, 14, None), "boundary": (0, 14, None), "poi": (12, 14, None), "poi_detail": (14, 14, "poi"), "housenumber": (14, 14, None), "waterway": (8, 14, None), "waterway_detail": (12, 14, "waterway"), "transportation": (4, 14, None),
    "transportation_name": (8, 14, None), "building": (13, 14, None), "water": (6, 14, None), "ocean": (0, 14, "water"), "water_name": (14, 14, None), "water_name_detail": (14, 14, "water_name"), "aeroway": (11, 14, None), "aerodrome_label": (10, 14, None),
    "park": (11, 14, None), "landuse": (4, 14, None), "urban_areas": (4, 8, "landuse"), "landcover": (0, 14, None), "ice_shelf": (0, 9, "landcover"), "glacier": (2, 9, "landcover"), "mountain_peak": (11, 14, None),
}

#: Layers that are simplified, the zoom below which, the tolerance in degrees just below it, and the rule.
SIMPLIFIED = {
    "boundary": (12, 0.0003, "visvalingam"), "waterway": (12, 0.0003, "douglas-peucker"), "transportation": (13, 0.0003, "douglas-peucker"), "water": (12, 0.0003, "visvalingam"), "ocean": (13, 0.0001, "visvalingam"),
    "landuse": (13, 0.0003, "visvalingam"), "urban_areas": (7, 0.0003, "visvalingam"), "landcover": (13, 0.0003, "visvalingam"), "ice_shelf": (13, 0.0005, "visvalingam"), "glacier": (13, 0.0005, "visvalingam"),
}


# -- category chips ------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chip:
    """A category of the search page: records of one type, by subtype, by a pattern of it, or by a pattern of the name in generic subtypes."""

    id: str
    kind: str
    subtypes: tuple[str, ...] = ()
    pattern: str | None = None
    generic: tuple[str, ...] = ()
    name_pattern: str | None = None

    def matches(self, t: Column, s: Column, n: Column) -> Column:
        sub, name = F.coalesce(s, F.lit("")), F.coalesce(n, F.lit(""))
        if not (self.subtypes or self.pattern):
            return t == self.kind
        hit = sub.isin(*self.subtypes)
        if self.pattern:
            hit = hit | sub.rlike(self.pattern)
        if self.name_pattern:
            hit = hit | (sub.isin(*self.generic) & name.rlike(self.name_pattern))
        return (t == self.kind) & hit


#: The chips.
CHIPS = (
    Chip("restaurants", "poi", ("restaurant", "fast_food", "food_court", "ice_cream"), "_restaurant$|^food_"),
    Chip("cafes", "poi", ("cafe", "coffee_shop", "bakery", "tea_room", "ice_cream_parlor")),
    Chip("bars", "poi", ("bar", "pub", "biergarten", "nightclub", "beer", "alcohol_shop", "wine_bar", "sports_bar", "cocktail_bar", "dive_bar", "beer_bar", "brewery", "wine_store", "liquor_store")),
    Chip("hotels", "poi", ("hotel", "motel", "hostel", "bed_and_breakfast", "lodging", "inn", "guest_house", "resort", "campsite")),
    Chip("museums", "poi", ("museum", "art_gallery", "planetarium", "observatory"), "_museum$|_gallery$", ("tourism", "attraction"), r"(?i)\b(museum|gallery|exhibit|planetarium)\b"),
    Chip("landmarks", "poi", ("historic", "castle", "monument", "historical_landmark", "landmark_and_historical_building", "memorial"), None, ("tourism", "attraction"), r"(?i)\b(landmark|monument|memorial|historic)\b"),
    Chip("parks", "park"),
    Chip("libraries", "poi", ("library", "public_library")),
    Chip("health", "poi", ("hospital", "pharmacy", "clinic", "doctors", "dentist", "urgent_care_clinic", "veterinary")),
    Chip("shops", "poi", ("shop", "supermarket", "mall", "marketplace", "department_store", "convenience", "grocery", "clothing_store", "jewelry_store"), "_store$|^store$"),
    Chip("fuel", "poi", ("fuel", "charging_station", "gas_station", "ev_charging_station")),
)


def chips_of(t: Column, s: Column, n: Column, chips: tuple[Chip, ...] = CHIPS) -> Column:
    """Array of the ids of the chips that a record is in."""
    return F.filter(F.array(*[F.when(c.matches(t, s, n), c.id) for c in chips]), lambda x: x.isNotNull())
