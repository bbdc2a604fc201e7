"""Road graph queries (inventory section 2.11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits, geo, text
from ..graph import build, codec, corpus, geometry, routes, sample, search
from ..operators import nearest
from .. import shared
from ..shared import cut
from .aggregates import JUNCTIONS, junctions, roads  # noqa: F401
from .registry import query

c = F.col


def n_():
    return F.count(F.lit(1)).alias("n")


def pieces(t, own=None, shapes=False):
    """Segments of the roads `own`, by default roads(t)."""
    ways, nodes, meeting = own or roads(t)
    return build.segments(t.dealt(ways, "ref"), nodes, meeting, shapes=shapes, parts=t.parts())


def edges(t, own=None):
    return build.edges(pieces(t, own))


def shapes(t, own=None):
    return pieces(t, own, shapes=True)


_HV = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
_PIECES = f"""jn as ({JUNCTIONS}), wn as (select x.*, j.ref is not null as is_j, min(pos) over (partition by way_id) as f, max(pos) over (partition by way_id) as l from geo_way_node x left join jn j on j.ref = x.ref where highway not in ('', 'construction', 'proposed')),
 bn as (select *, case when is_j and pos > f and pos < l then 1 else 0 end as b from wn), nn as (select *, sum(b) over (partition by way_id order by pos) as n from bn), sg as (select *, cast(unnest(case when b = 1 then [n - 1, n] else [n] end) as bigint) as segment from nn),
 ll as (select sg.*, lat_e7, lon_e7, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo, lag(lat_e7 / 1e7) over w as pla, lag(lon_e7 / 1e7) over w as plo from sg join geo_node on id = ref window w as (partition by way_id, segment order by pos)),
 dd as (select *, pow(sin(radians(la - pla) / 2), 2) + cos(radians(pla)) * cos(radians(la)) * pow(sin(radians(lo - plo) / 2), 2) as a from ll),
 pc as (select way_id, segment, min_by(ref, pos) as src, max_by(ref, pos) as dst, cast(sum(coalesce(cast(round_even({_HV} * 10, 0) as bigint), 0)) as bigint) as dist_dm, count(*) as points, string_agg(cast(lat_e7 as varchar) || ',' || cast(lon_e7 as varchar), ';' order by pos) as line, min(highway) as highway, min(oneway) as oneway, min(name) as name, min(rf) as rf, min(foot) as foot, min(bicycle) as bicycle, min(junction) as junction from dd group by way_id, segment having count(*) >= 2)"""
_PIECED = f"with {_PIECES}"
_SPEED = "case highway " + " ".join(f"when '{k}' then {v}" for k, v in bits.SPEEDS.items()) + " else 30 end"
_CLASS = "case highway " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(bits.ROAD_CLASSES, 1)) + " else 0 end"
_ACCESS = f"{_CLASS} + case when foot = 'no' then 32 else 0 end + case when bicycle = 'no' then 64 else 0 end + case when oneway in ('yes', '1', 'true') then 128 else 0 end + case when junction in ('roundabout', 'circular', 'mini_roundabout') then 256 else 0 end"
_LABEL = "case when name <> '' and rf <> '' then name || ' (' || rf || ')' when name <> '' then name else rf end"
_OUT = f"dist_dm, {_SPEED} as speed, highway, {_ACCESS} as access, {_LABEL} as label"
_EDGES = f"""with {_PIECES}, ed as (select way_id, segment, src, dst, 0 as back, {_OUT} from pc where src <> dst and oneway <> '-1' union all select way_id, segment, dst, src, 1, {_OUT} from pc where src <> dst and oneway not in ('yes', '1', 'true'))"""


@query("g1_graph_edges", f"{_EDGES} select way_id, segment, src, dst, back, dist_dm, speed, access, label, cast(round_even(dist_dm * 360.0 / speed, 0) as bigint) as time_ms from ed")
def g1(t):
    return edges(t).select("way_id", "segment", "src", "dst", "back", "dist_dm", "speed", "access", "label", "time_ms")


#: Road junctions that ways share have ids below this.
_SHARED = 100_000_000
#: Pairs that are routed, and where each takes three searches or is a sample only; metres between their nodes, seed, cells to a degree and draws for each pair.
_N, _FEW, _LEAST_M, _MOST_M, _SEED, _SCALE, _TRIES = 100, 20, 5_000.0, 60_000.0, 42, 10, 50


def network(t):
    """(edges, nodes) of the road graph that g1 extracts, written once."""
    own = edges(t)
    return cut(own.select("src", "dst", "time_ms", "dist_dm", "access", "speed")), cut(t.geo_node)


def component(t, main: bool = False):
    """(edges, nodes) of the road graph that g1 extracts, or of its main roads, that pairs are drawn from, the least of parallel edges: nodes that all reach each other. A way between two of them meets no other node, so searches need no more."""
    roads_ = roads(t)
    own = edges(t, roads_)
    own = routes.main_roads(own) if main else own
    least = cut(search.least_edges(own))
    ids = sample.connected(least)
    inside = least.join(shared.side(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(shared.side(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")
    return cut(inside.select("src", "dst", c("w").alias("time_ms"), c("dm").alias("dist_dm"))), cut(roads_[1].join(shared.side(ids), "id", "left_semi"))


def pairs_of(nodes, n=_N):
    return sample.pairs_among(nodes, n, _LEAST_M, _MOST_M, _SEED, _SCALE, _TRIES)


def _sampled(edge: str, n: int = _N) -> str:
    """SQL for pr(pair, s, e, metres), as sample.valid_pairs() draws them over edges `edge`(src, dst)."""
    h = lambda name: f"cast('0x' || substr(md5('{_SEED}:' || cast(k as varchar) || ':{name}'), 1, 8) as bigint)"
    away, turn = f"({_LEAST_M} + {_MOST_M - _LEAST_M} * ({h('away')} / 4294967296.0))", f"(2 * pi() * ({h('turn')} / 4294967296.0))"
    hav = "pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)"
    return f"""hub as (select src as id from (select src, count(*) as c from (select distinct src, dst from {edge}) x group by src) x order by c desc, src limit 1),
 fw(id) as (select id from hub union select x.dst from fw join {edge} x on x.src = fw.id), bw(id) as (select id from hub union select x.src from bw join {edge} x on x.dst = bw.id),
 nd as (select id, lat_e7 / 1e7 as lat, lon_e7 / 1e7 as lon, cast(floor(lat_e7 * {_SCALE} / 1e7) as bigint) as cy, cast(floor(lon_e7 * {_SCALE} / 1e7) as bigint) as cx from geo_node where id in (select id from fw) and id in (select id from bw)),
 nx as (select *, row_number() over (order by cy, cx, id) - 1 as i from nd), cl as (select cy, cx, min(i) as f, count(*) as m from nx group by cy, cx),
 dr as (select k, {h('start')} % (select count(*) from nd) as i, {away} as away, {turn} as turn, {h('end')} as z from range({n * _TRIES}) r(k)),
 d1 as (select k, z, x.id as s, x.lat as la, x.lon as lo, x.cy as sy, x.cx as sx, cast(floor((x.lat + away * cos(turn) / 111195.0) * {_SCALE}) as bigint) as cy, cast(floor((x.lon + away * sin(turn) / (111195.0 * cos(radians(x.lat)))) * {_SCALE}) as bigint) as cx from dr join nx x on x.i = dr.i),
 d2 as (select d1.*, f + z % m as j from d1 join cl on cl.cy = d1.cy and cl.cx = d1.cx), d3 as (select d2.*, x.id as e, {hav.replace('lat', 'x.lat').replace('lon', 'x.lon')} as a from d2 join nx x on x.i = d2.j),
 d4 as (select *, 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) as metres from d3 where s <> e), d5 as (select *, row_number() over (partition by sy, sx, cy, cx order by k) as r from d4 where metres between {_LEAST_M} and {_MOST_M}),
 pr as (select row_number() over (order by k) - 1 as pair, s, e, metres from (select * from d5 where r = 1 order by k limit {n}) x)"""


def _least(name: str, edge: str, start: str) -> str:
    """SQL for least costs (pair, node, cost) by keyed recursion over edges (src, dst, w)."""
    return f"""{name}(pair, node, cost) using key (pair, node) as (select pair, node, cast(0 as bigint) from ({start}) z union
 select n.pair, n.node, n.cost from (select r.pair, x.dst as node, min(r.cost + x.w) as cost from {name} r join {edge} x on x.src = r.node group by 1, 2) n left join recurring.{name} k on k.pair = n.pair and k.node = n.node where k.cost is null or n.cost < k.cost)"""


_WT = "wt as (select src, dst, min(cast(round_even(dist_dm * 360.0 / speed, 0) as bigint)) as w from ed group by src, dst)"
_MAIN = "mn as (select src, dst, min(cast(round_even(dist_dm * 360.0 / speed, 0) as bigint)) as w from ed where highway in ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link') group by src, dst)"
_ROUTED = _EDGES.replace("with ", "with recursive ", 1) + f", {_WT}, {_sampled('wt')}, {_least('rec', 'wt', 'select pair, s as node from pr')}"
_ROUTED_FEW = _EDGES.replace("with ", "with recursive ", 1) + f", {_WT}, {_sampled('wt', _FEW)}, {_least('rec', 'wt', 'select pair, s as node from pr')}"
_STATUS = "select pr.pair, case when cost is null then 'unreachable' else 'ok' end as status, cost as time_ms from pr left join rec on rec.pair = pr.pair and rec.node = pr.e"


@query("g2_astar_cost", f"{_ROUTED} {_STATUS}")
def g2(t):
    """Times of sampled pairs by searches from both ends over the plain graph."""
    own, nodes = component(t)
    return search.times(pairs_of(nodes), search.Graph.of(own, nodes))


@query("g3_astar_by_cell", f"{_ROUTED} {_STATUS}")
def g3(t):
    """As g2, over the overlay of cells: only the cells of a pair's ends are searched inside; times are those of the ways' own edges, shortcuts taken apart."""
    own, nodes = component(t)
    graph = search.Graph.of(own, nodes, (_SCALE,))
    found = search.meet(pairs_of(nodes), graph)
    times = search.hops(found).join(graph.levels[0].select("src", "dst", "w"), ["src", "dst"]).groupBy("pair").agg(F.sum("w").alias("time_ms"))
    return found.ends.select("pair", "status").join(times, "pair", "left")


_MAINLY = _EDGES.replace("with ", "with recursive ", 1) + f", {_MAIN}, {_sampled('mn')}, {_least('rec', 'mn', 'select pair, s as node from pr')}"


@query("g4_astar_main_roads", f"{_MAINLY} {_STATUS}")
def g4(t):
    """Pairs and ways over main roads alone."""
    own, nodes = component(t, main=True)
    return search.times(pairs_of(nodes), search.Graph.of(own, nodes))


_NEAREST = f"(select min_by(n.id, row(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), n.id)) from (select m.id, pow(sin(radians(m.la - p.la) / 2), 2) + cos(radians(p.la)) * cos(radians(m.la)) * pow(sin(radians(m.lo - p.lo) / 2), 2) as h from ms m) n)"
_LEGS = f"""ms as (select id, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_node where id in (select src from mn)), en as (select pair, s as id from pr union select pair, e from pr), ep as (select distinct en.id, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from en join geo_node g on g.id = en.id),
 nr as (select p.id, {_NEAREST} as near from ep p), lg as (select pair, s, e, x.near as a, y.near as b from pr join nr x on x.id = pr.s join nr y on y.id = pr.e)"""
_TWO = _EDGES.replace("with ", "with recursive ", 1) + f", {_WT}, {_MAIN}, {_sampled('wt', _FEW)}, {_LEGS}, {_least('r0', 'wt', 'select pair, s as node from lg')}, {_least('r1', 'mn', 'select pair, a as node from lg')}, {_least('r2', 'wt', 'select pair, b as node from lg')}"


@query("g5_two_pass_route", f"{_TWO} select lg.pair, a, b, r0.cost + r1.cost + r2.cost as time_ms from lg left join r0 on r0.pair = lg.pair and r0.node = lg.a left join r1 on r1.pair = lg.pair and r1.node = lg.b left join r2 on r2.pair = lg.pair and r2.node = lg.e")
def g5(t):
    """Local roads to the nearest node that a main road leaves, main roads to the one nearest to the end, local roads to the end; null where a leg has no way."""
    own, nodes = network(t)
    main = cut(routes.main_roads(own))
    pairs = cut(sample.valid_pairs(own, nodes, _FEW, _LEAST_M, _MOST_M, _SEED, _SCALE, _TRIES))
    place = lambda ids: nodes.join(ids, "id", "left_semi").select("id", (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"))
    gates = place(main.select(c("src").alias("id")).distinct()).withColumn("gate", c("id"))
    ends = place(pairs.select(F.explode(F.array("start", "end")).alias("id")).distinct())
    near = cut(nearest.nearest(ends, gates, ["id"], "gate", "id", sphere=True))
    legs = pairs.join(near.toDF("start", "a"), "start").join(near.toDF("end", "b"), "end")
    legs = cut(legs)
    every, over = search.Graph.of(own, nodes), search.Graph.of(main, nodes)
    local = legs.select(c("pair").alias("_p"), F.explode(F.array(F.struct(F.lit(0).alias("leg"), c("start"), c("a").alias("end")), F.struct(F.lit(2).alias("leg"), c("b").alias("start"), "end"))).alias("_l"))
    first = search.times(local.select((c("_p") * 4 + c("_l.leg")).alias("pair"), "_l.start", "_l.end"), every)
    middle = search.times(legs.select((c("pair") * 4 + 1).alias("pair"), c("a").alias("start"), c("b").alias("end")), over)
    times = first.unionByName(middle).groupBy(F.floor(c("pair") / 4).alias("pair")).agg(F.when(F.count("time_ms") == 3, F.sum("time_ms")).alias("time_ms"))
    return legs.select("pair", "a", "b").join(times, "pair", "left")


@query("g6_measure_path", f"{_PIECED} select way_id as path, count(*) as hops, cast(sum(d) as bigint) as dist_dm from (select p.way_id, p.segment, min_by(q.dist_dm, row(q.way_id, q.segment)) as d from pc p join pc q on q.src = p.src and q.dst = p.dst group by p.way_id, p.segment) x group by way_id")
def g6(t):
    """Each way's whole path over its junctions is measured again; a hop takes the first of parallel pieces."""
    own = cut(pieces(t).select("way_id", "segment", "src", "dst", "dist_dm"))
    ends = F.array_sort(F.collect_list(F.struct("segment", "src", "dst")))
    path = F.concat(F.transform("_s", lambda x: x["src"]), F.array(F.element_at("_s", -1)["dst"]))
    paths = t.dealt(own.withColumnRenamed("way_id", "path"), "path").groupBy("path").agg(ends.alias("_s")).select("path", path.alias("nodes"))
    return build.measure(paths, own.withColumn("back", F.lit(0)), t.parts())


@query("w6_coalesce_roads", f"""{_PIECED}, st as (select way_id // 40 as route, way_id, segment, dist_dm, {_LABEL} as label, {_ACCESS} as access from pc), fl as (select *, access & 256 <> 0 as roundabout, access & 31 in (2, 4, 6, 8, 10) as link from st),
 x as (select *, case when lag(label) over w is not distinct from label and lag(roundabout) over w is not distinct from roundabout and lag(link) over w is not distinct from link then 0 else 1 end as s from fl window w as (partition by route order by way_id, segment)),
 y as (select *, sum(s) over (partition by route order by way_id, segment) - 1 as road from x) select route, cast(road as bigint) as road, label, roundabout, link, cast(sum(dist_dm) as bigint) as dist_dm, count(*) as edges from y group by all""")  # fmt: skip
def w6(t):
    """Roads along corridors of forty ways each, one piece after the other: stretches of one label and the same flags, with their lengths."""
    access = bits.access_word(*[c(x) for x in ("highway", "foot", "bicycle", "oneway", "junction")])
    steps = pieces(t).select(F.floor(c("way_id") / 40).alias("route"), "way_id", "segment", "dist_dm", text.road_label(c("name"), c("rf")).alias("label"), access.alias("access"))
    return routes.roads(steps, ["route"], ["way_id", "segment"]).withColumn("road", c("road").cast("long"))


@query("g7_shortest_distances", f"{_EDGES.replace('with ', 'with recursive ', 1)}, {_WT}, {_least('rec', 'wt', f'select min(src) as pair, min(src) as node from ed where src < {_SHARED}')} select pair as source, node, cost from rec")
def g7(t):
    """All distances from one junction, however many hops."""
    own = edges(t)
    return routes.distances(own, own.where(c("src") < _SHARED).agg(F.min("src").alias("source")))


_STEPS = f"select way_id // 40 as route, way_id, segment, src, dst, dist_dm, cast(round_even(dist_dm * 360.0 / {_SPEED}, 0) as bigint) as time_ms, case when points > 2 then way_id * 100 + segment else -1 end as shape, {_LABEL} as label, {_ACCESS} as access from pc"
_PARTS = "case when a.{x} <> b.{x} then coalesce(list_position(list_transform(range(least(len(a.{x}), len(b.{x}))), lambda i: a.{x}[i + 1] <> b.{x}[i + 1]), true) - 1, least(len(a.{x}), len(b.{x}))) end as at_{x}"


@query("g8_route_corpus_diff", f"""{_PIECED}, st as ({_STEPS}), bo as (select 'a' as k, * from st where route % 19 <> 0 union all select 'b', * replace (case when way_id % 389 = 0 then 'renamed' else label end as label) from st where route % 17 <> 0 and way_id % 411 <> 0),
 fl as (select *, access & 256 <> 0 as roundabout, access & 31 in (2, 4, 6, 8, 10) as link from bo), x as (select *, case when lag(label) over w is not distinct from label and lag(roundabout) over w is not distinct from roundabout and lag(link) over w is not distinct from link then 0 else 1 end as s from fl window w as (partition by k, route order by way_id, segment)),
 y as (select *, sum(s) over (partition by k, route order by way_id, segment) as road from x), ro as (select k, route, road, label, roundabout, link, sum(dist_dm) as d from y group by all), rd as (select k, route, list(label || '|' || roundabout || '|' || link || '|' || d order by road) as rd from ro group by k, route),
 fp as (select k, route, arg_min(src, way_id * 1000 + segment) as s, arg_max(dst, way_id * 1000 + segment) as e, cast(sum(dist_dm) as bigint) as d, cast(sum(time_ms) as bigint) as t, list(dst order by way_id, segment) as ds, list(shape order by way_id, segment) as g from bo group by k, route),
 fr as (select k, route, s, e, d + case when k = 'b' and route % 15 = 0 then 20 when k = 'b' and route % 5 = 0 then 2 else 0 end as d, t, list_prepend(s, ds) as n, g, rd from fp join rd using (k, route)), a as (select * from fr where k = 'a'), b as (select * from fr where k = 'b')
 select coalesce(a.route, b.route) as route, case when b.route is null then 'missing' when a.route is null then 'extra' when a.s = b.s and a.e = b.e and a.n = b.n and a.g = b.g and a.rd = b.rd then case when a.d = b.d and a.t = b.t then 'same' when abs(a.d - b.d) < 5 and abs(a.t - b.t) < 500 then 'drift' else 'differs' end else 'differs' end as status,
 concat_ws(',', case when a.s <> b.s then 's' end, case when a.e <> b.e then 'e' end, case when a.d <> b.d then 'd' end, case when a.t <> b.t then 't' end, case when a.n <> b.n then 'n' end, case when a.g <> b.g then 'g' end, case when a.rd <> b.rd then 'rd' end) as fields, {', '.join(_PARTS.format(x=x) for x in ('n', 'g', 'rd'))} from a full join b on a.route = b.route""")  # fmt: skip
def g8(t):
    """Fingerprints of corridors of forty ways, and of a second corpus of them in which some routes and pieces are missing, some roads are renamed and some lengths are off; half a metre is drift."""
    access, speed = bits.access_word(*[c(x) for x in ("highway", "foot", "bicycle", "oneway", "junction")]), bits.speed_of(c("highway"))
    shape = F.when(c("points") > 2, c("way_id") * 100 + c("segment"))
    steps = pieces(t).select(
        F.floor(c("way_id") / 40).alias("route"), "way_id", "segment", "src", "dst", "dist_dm", F.rint(c("dist_dm") * 360.0 / speed).cast("long").alias("time_ms"), shape.alias("shape"),
        text.road_label(c("name"), c("rf")).alias("label"), access.alias("access"),
    )
    steps = cut(steps)
    other = steps.where("route % 17 <> 0 and way_id % 411 <> 0").withColumn("label", F.when(c("way_id") % 389 == 0, "renamed").otherwise(c("label")))
    off = F.when(c("route") % 15 == 0, 2.0).when(c("route") % 5 == 0, 0.2).otherwise(0.0)
    golden = corpus.fingerprints(steps.where("route % 19 <> 0"), ["way_id", "segment"])
    candidate = corpus.fingerprints(other, ["way_id", "segment"]).withColumn("d", F.round(c("d") + off, 3))
    return corpus.differences(golden, candidate, 0.5)


@query("g9_valid_pairs", f"{_EDGES.replace('with ', 'with recursive ', 1)}, {_WT}, {_sampled('wt')} select pair, s as start, e as end, cast(round_even(metres, 0) as bigint) as metres from pr")
def g9(t):
    """Seeded pairs of nodes that reach each other, within a window of distances, no two between the same two cells."""
    own = roads(t)
    ids = sample.connected(edges(t, own))
    return pairs_of(own[1].join(shared.side(ids), "id", "left_semi")).select("pair", "start", "end", F.rint("metres").cast("long").alias("metres"))


@query("g9_cell_diverse_sample", "select cy, cx, id from (select cy, cx, id, row_number() over (partition by cy, cx order by md5(cast(id as varchar)), id) as r from (select distinct cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, id from geo_node) q) x where r <= 5")
def g9_cells(t):
    """Five nodes of each cell, by a hash: the least five are kept task by task, so a dense cell is no large window."""
    cells = t.geo_node.select(geo.cell(c("lat_e7"), 10).alias("cy"), geo.cell(c("lon_e7"), 10).alias("cx"), F.struct(F.md5(c("id").cast("string").cast("binary")).alias("h"), "id").alias("m"))
    rank = F.row_number().over(Window.partitionBy("cy", "cx").orderBy("m"))
    return cells.withColumn("r", rank).where("r <= 5").select("cy", "cx", "m.id")


@query("g10_cell_partitions", f"{_EDGES} select cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, count(*) as n, cast(sum(dist_dm) as bigint) as dm from ed join geo_node on id = src group by 1, 2")
def g10(t):
    return build.partition(edges(t), t.geo_node).groupBy("cy", "cx").agg(n_(), F.sum("dist_dm").alias("dm"))


@query("g11_edges_of_node", f"{_EDGES} select src, dst, dist_dm, way_id from ed where src in (select min(src) from ed union all select max(src) from ed)")
def g11(t):
    e = edges(t)
    asked = e.agg(F.array(F.min("src"), F.max("src")).alias("s")).select(F.explode("s").alias("src"))
    return e.join(F.broadcast(asked), "src", "left_semi").select("src", "dst", "dist_dm", "way_id")  # two rows


@query("g13_sample_route_health", f"{_ROUTED_FEW} select pr.pair, cost is not null as ok from pr left join rec on rec.pair = pr.pair and rec.node = pr.e where pr.pair < 3")
def g13(t):
    """Three sample pairs and whether their ways can be followed edge by edge."""
    own, nodes = component(t)
    ways = search.routes(pairs_of(nodes, _FEW).where("pair < 3"), search.Graph.of(own, nodes))
    return ways.select("pair", ((c("status") == "ok") & (F.size("path") == c("hops") + 1)).alias("ok"))


@query("g14_link_and_oneway_counts", f"{_EDGES} select count(*) as edges, count(*) filter (where access & 128 <> 0) as oneway, count(*) filter (where access & 31 in (2, 4, 6, 8, 10)) as links, count(*) filter (where access & 256 <> 0) as roundabouts from ed")
def g14(t):
    bit = lambda b: c("access").bitwiseAND(F.lit(b))
    return edges(t).agg(F.count(F.lit(1)).alias("edges"), F.count_if(bit(bits.ONEWAY) != 0).alias("oneway"), F.count_if(bit(31).isin(2, 4, 6, 8, 10)).alias("links"), F.count_if(bit(bits.ROUNDABOUT) != 0).alias("roundabouts"))


@query("g15_distance_by_class", f"{_EDGES} select access & 31 as class, cast(sum(dist_dm) as bigint) as dm, cast(coalesce(sum(dist_dm) filter (where access & 32 <> 0), 0) as bigint) as no_foot_dm, cast(coalesce(sum(dist_dm) filter (where access & 64 <> 0), 0) as bigint) as no_bicycle_dm from ed group by 1")
def g15(t):
    """Distance by road class, and how much of it is forbidden on foot and by bicycle, from each edge's own bits."""
    held = lambda bit: F.sum(F.when(c("access").bitwiseAND(F.lit(bit)) != 0, c("dist_dm")).otherwise(0))
    return edges(t).groupBy(c("access").bitwiseAND(F.lit(31)).alias("class")).agg(F.sum("dist_dm").alias("dm"), held(bits.FOOT_NO).alias("no_foot_dm"), held(bits.BICYCLE_NO).alias("no_bicycle_dm"))


@query("sk8_geometry_dictionary", f"""{_EDGES}, tl as (select way_id, segment, line, points from pc), gd as (select line, row_number() over (order by w) - 1 as gid from (select line, min(row(way_id, segment)) as w from tl group by line) x),
 us as (select ed.way_id, ed.segment, back, cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, gid, points, tl.line from ed join tl on tl.way_id = ed.way_id and tl.segment = ed.segment join gd on gd.line = tl.line join geo_node g on g.id = ed.src),
 lo as (select cy, cx, gid, row_number() over (partition by cy, cx order by w) - 1 as lid from (select cy, cx, gid, min(row(way_id, segment, back)) as w from us group by cy, cx, gid) x)
 select way_id, segment, back, us.cy, us.cx, lid, us.gid, points, md5(us.line) as line from us join lo on lo.cy = us.cy and lo.cx = us.cx and lo.gid = us.gid""")  # fmt: skip
def sk8(t):
    """Every edge's polyline, joined back from the dictionaries."""
    roads_ = roads(t)
    own = cut(shapes(t, roads_))
    every = build.edges(own).select("way_id", "segment", "back", "src")
    lines, local, placed = geometry.dictionaries(every, own.select("way_id", "segment", "line"), roads_[1])
    text = F.array_join(F.transform("line", lambda p: F.concat_ws(",", p["lat_e7"], p["lon_e7"])), ";")
    told = lines.select("gid", F.size("line").cast("long").alias("points"), F.md5(text.cast("binary")).alias("line"))  # once for each polyline
    found = geometry.restored(told, local, placed)
    return found.select("way_id", "segment", "back", "cy", "cx", c("lid").cast("long").alias("lid"), "gid", "points", "line")


#: Edges in a blob of sc13, about; a source's edges are in one blob.
_BLOCK = 50_000


@query("sc13_graph_roundtrip", f"{_EDGES} select cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, count(*) as edges, cast(sum(dist_dm) as bigint) as dm, cast(sum(speed) as bigint) as speeds, count(distinct src) as sources from ed join geo_node on id = src group by 1, 2")
def sc13(t):
    """The edges of each cell of the graph are encoded to blobs, one for each block of about _BLOCK edges, dealt by source; what is reported is counted from the decoded blobs."""
    cells = cut(build.partition(edges(t), t.geo_node).select("cy", "cx", "src", "dst", "dist_dm", "speed", "access"))
    blocks = cells.groupBy("cy", "cx").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    dealt = cells.join(blocks, ["cy", "cx"]).withColumn("block", F.pmod(F.xxhash64("src"), c("blocks"))).drop("blocks")

    def run(es: pd.DataFrame) -> pd.DataFrame:
        es = es.sort_values(["src", "dst", "dist_dm", "speed", "access"])
        ids = np.unique(es[["src", "dst"]].to_numpy(np.int64))
        none = np.full(len(es), -1, np.int64)
        table = np.column_stack([np.searchsorted(ids, es["src"]), np.searchsorted(ids, es["dst"]), es["speed"], es["dist_dm"], none, none + 1]).astype(np.int64)
        back = codec.decode(codec.encode(codec.Graph(np.zeros((len(ids), 2), np.int32), table, es["access"].to_numpy().astype(np.uint32))))
        row = (es["cy"].iloc[0], es["cx"].iloc[0], len(back.edges), int(back.edges[:, 3].sum()), int(back.edges[:, 2].sum()), len(np.unique(back.edges[:, 0])))
        return pd.DataFrame([row], columns=["cy", "cx", "edges", "dm", "speeds", "sources"])

    found = dealt.groupBy("cy", "cx", "block").applyInPandas(run, "cy long, cx long, edges long, dm long, speeds long, sources long")
    return found.groupBy("cy", "cx").agg(*[F.sum(x).alias(x) for x in ("edges", "dm", "speeds", "sources")])
