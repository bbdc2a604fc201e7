"""Points in polygons by covers: cells that a polygon fills answer by an equi-join, cells that its border crosses by ray casting over the few edges that matter there.

A ring's edges are placed in the cells that they cross. A cell without edges is inside or outside as a whole; which one is told by the edges of its own row of cells alone, as a ray from its
centre to the west meets no others: the fill is a running parity along the row. In a border cell, a point's parity is that of the cell's west side at the point's latitude, counted with
the row's edges west of it. So no point meets a polygon's whole ring, and no polygon is one task's: edges are rows, dealt by row of cells.

Rings are closed by their first point; holes are rings of the same polygon (even-odd rule). A point exactly on an edge counts as the ray rule says: edges hold their lower end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def edges_of(rings: DataFrame) -> DataFrame:
    """rings(poly, ring, pos, lat, lon) to (poly, ay, ax, by, bx): edges from their lower to their upper end. Level ones are met by no ray, but cells that they cross are border cells."""
    order = Window.partitionBy("poly", "ring").orderBy("pos")
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = lambda c: F.coalesce(F.lead(c).over(order), first(c))
    rows = rings.select("poly", F.col("lat").alias("y0"), F.col("lon").alias("x0"), nxt("lat").alias("y1"), nxt("lon").alias("x1"))
    up = F.col("y0") < F.col("y1")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return rows.select("poly", pick("y0", "y1").alias("ay"), pick("x0", "x1").alias("ax"), pick("y1", "y0").alias("by"), pick("x1", "x0").alias("bx"))


def crossing(y: Column) -> Column:
    """Longitude at which an edge is at latitude y."""
    return F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))


def stretches(edges: DataFrame, scale: int) -> tuple[DataFrame, DataFrame]:
    """(filled(cy, first, last, poly), border(cy, cx, poly)): stretches of cells of 1 / scale degrees that polygons fill, and cells that their edges cross."""
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor(F.col("ay") * scale), F.floor(F.col("by") * scale))))
    low, high = F.greatest("ay", F.col("cy") / scale), F.least("by", (F.col("cy") + 1) / scale)
    left = F.coalesce(F.least(crossing(low), crossing(high)), F.least("ax", "bx"))
    right = F.coalesce(F.greatest(crossing(low), crossing(high)), F.greatest("ax", "bx"))
    # a margin of a thousandth of a cell covers rounding: a border cell too many costs time only
    spans = rows.withColumn("cx", F.explode(F.sequence(F.floor(left * scale - 0.001), F.floor(right * scale + 0.001))))
    border = spans.select("cy", "cx", "poly").distinct()
    # along a row, cells between two border cells are filled or not together: parity of the edges that the row's middle meets to the west
    middle = (F.col("cy") + 0.5) / scale
    met = rows.where((F.col("ay") <= middle) & (middle < F.col("by"))).select("poly", "cy", F.floor(crossing(middle) * scale).alias("cx"), F.lit(1).alias("_n"))
    marks = met.unionByName(border.select("poly", "cy", "cx", F.lit(0).alias("_n"))).groupBy("poly", "cy", "cx").agg(F.sum("_n").alias("_n"))
    along = Window.partitionBy("poly", "cy").orderBy("cx")
    marks = marks.withColumns({"_west": F.sum("_n").over(along), "_next": F.lead("cx").over(along)})
    gaps = marks.where((F.col("_west") % 2 == 1) & (F.col("_next") > F.col("cx") + 1))
    return gaps.select("cy", (F.col("cx") + 1).alias("first"), (F.col("_next") - 1).alias("last"), "poly"), border


def cover(edges: DataFrame, scale: int) -> tuple[DataFrame, DataFrame]:
    """(filled(cy, cx, poly), border(cy, cx, poly)): cells of 1 / scale degrees that polygons fill, and those that their edges cross."""
    filled, border = stretches(edges, scale)
    return filled.select("cy", F.explode(F.sequence("first", "last")).alias("cx"), "poly"), border


def in_border_cells(at: DataFrame, edges: DataFrame, border: DataFrame, key: str, scale: int) -> DataFrame:
    """(key, poly) of points at(key, lat, lon, cy, cx) in border cells, by ray casting over the edges of their row."""
    unsure = at.join(border, ["cy", "cx"])
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor(F.col("ay") * scale), F.floor(F.col("by") * scale))))
    hit = (F.col("ay") <= F.col("lat")) & (F.col("lat") < F.col("by")) & (crossing(F.col("lat")) < F.col("lon"))
    odd = unsure.join(rows.select("poly", "cy", "ay", "ax", "by", "bx"), ["poly", "cy"]).where(hit).groupBy(key, "poly").count().where("count % 2 = 1")
    return odd.select(key, "poly")


def containing(points: DataFrame, rings: DataFrame, key: str, scale: int) -> DataFrame:
    """(key, poly) for each polygon of rings(poly, ring, pos, lat, lon) that a point of points(key, lat, lon) lies in."""
    edges = edges_of(rings)
    filled, border = cover(edges, scale)
    at = _in_cells(points, key, scale)
    inside = at.join(filled, ["cy", "cx"]).select(key, "poly")
    return inside.unionByName(in_border_cells(at, edges, border, key, scale))


def _in_cells(points: DataFrame, key: str, scale: int) -> DataFrame:
    return points.select(key, "lat", "lon", F.floor(F.col("lat") * scale).alias("cy"), F.floor(F.col("lon") * scale).alias("cx"))


#: Points of a band of latitudes, and edges of a slice of polygons, that a task of counts() holds together; and slices that there are at least, where each still has some edges.
BAND, SLICE, LEAST_SLICES, LEAST_EDGES = 500_000, 200_000, 24, 5_000
#: Values that held() works on at once.
_AT_ONCE = 400_000


def held(la: np.ndarray, lo: np.ndarray, edges: np.ndarray, poly: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(polygons, points in each) by the even-odd rule: points la, lo; edges[4, :] (ay, ax, by, bx) of polygons poly.

    As counts() says, over cells of 1 / scale degrees or of one point each, whichever is larger. Edges come sorted by polygon; polygons with the same number of edges go together, as rows of a matrix.
    """
    n, la0, lo0 = len(la), la.min(), lo.min()
    high, wide = la.max() - la0, lo.max() - lo0
    side = max(1 / scale, (high * wide / n) ** 0.5, max(high, wide) / (n + 1000))
    rows, cols = int(high / side) + 1, int(wide / side) + 1
    at = np.minimum(((la - la0) / side).astype(np.int64), rows - 1) * cols + np.minimum(((lo - lo0) / side).astype(np.int64), cols - 1)
    order = np.argsort(at, kind="stable")
    la, lo = la[order], lo[order]
    first = np.zeros(rows * cols + 1, np.int64)  # of the points of each cell
    np.cumsum(np.bincount(at, minlength=rows * cols), out=first[1:])
    starts = np.flatnonzero(np.r_[True, poly[1:] != poly[:-1]])
    many = np.diff(np.r_[starts, len(poly)])
    out = np.zeros(len(starts), np.int64)
    for k in np.unique(many):
        own = np.flatnonzero(many == k)
        ay, ax, by, bx = edges[:, starts[own][:, None] + np.arange(k)]
        low = np.maximum(np.floor((ay.min(1) - la0) / side - 0.001), 0).astype(np.int64)
        top = np.minimum(np.floor((by.max(1) - la0) / side + 0.001), rows - 1).astype(np.int64)
        count = np.maximum(top - low + 1, 0)
        ends = np.cumsum(count)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] * k + _AT_ONCE, _AT_ONCE) // k, side="left"))
        for a, b in zip(cuts, [*cuts[1:], len(own)]):
            if b > a and count[a:b].any():
                out[own[a:b]] = _of_rows(la, lo, first, cols, la0, lo0, side, ay[a:b], ax[a:b], by[a:b], bx[a:b], low[a:b], count[a:b])
    return poly[starts], out


def _of_rows(la, lo, first, cols, la0, lo0, side, ay, ax, by, bx, low, count) -> np.ndarray:
    """Points in each of some polygons, ay ... bx by polygon and edge, that begin at rows `low` of cells and have `count` of them."""
    p = np.repeat(np.arange(len(low)), count)
    row = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + low[p]
    with np.errstate(divide="ignore", invalid="ignore"):
        steep = np.where(by > ay, (bx - ax) / (by - ay), 0.0)
    y = la0 + row[:, None] * side
    eay, eax, eby, slope = ay[p], ax[p], by[p], steep[p]
    # a margin of a thousandth of a cell covers rounding: a border cell too many costs time only
    here = (eay <= y + side * 1.001) & (eby >= y - side * 0.001)
    level = slope == 0.0
    u = np.where(level, eax, eax + (np.maximum(eay, y - side * 0.001) - eay) * slope)
    v = np.where(level, bx[p], eax + (np.minimum(eby, y + side * 1.001) - eay) * slope)
    c0 = np.clip(np.floor((np.minimum(u, v) - lo0) / side - 0.001), -1, cols).astype(np.int64)
    c1 = np.clip(np.floor((np.maximum(u, v) - lo0) / side + 0.001), -1, cols).astype(np.int64)
    middle = y + side / 2
    met = here & (eay <= middle) & (middle < eby)
    # (first column, last column, edge, whether the row's middle meets it) as one number, in order along the row; edges of other rows come last
    bits = max(int(ay.shape[1]).bit_length(), 1)
    wide = int(cols + 2).bit_length()
    packed = np.where(here, (((c0 + 1 << wide) + c1 + 1 << bits) + np.arange(ay.shape[1]) << 1) + met, np.iinfo(np.int64).max)
    packed.sort(axis=1)
    here = packed != np.iinfo(np.int64).max
    met, edge = np.where(here, packed & 1, 0), np.where(here, packed >> 1 & (1 << bits) - 1, 0)
    c0 = np.where(here, (packed >> 1 + bits + wide) - 1, cols)
    c1 = np.where(here, (packed >> 1 + bits & (1 << wide) - 1) - 1, -1)
    upto = np.maximum.accumulate(c1, axis=1)
    base = row[:, None] * cols
    # cells between two border cells are in the polygon or not together: parity of the edges that the row's middle meets to the west
    after = np.minimum(upto + 1, cols)
    nxt = np.concatenate([c0[:, 1:], np.full((len(p), 1), cols)], axis=1)
    inside = (np.cumsum(met, axis=1) & 1 == 1) & (np.maximum(nxt, 0) > after)
    total = np.where(inside, first[base + np.maximum(nxt, after)] - first[base + after], 0).sum(1)
    out = np.bincount(p, total, len(low))
    # points in border cells, each once, by the rule itself over the edges of their row
    begin = np.clip(np.maximum(c0, np.concatenate([np.full((len(p), 1), -1), upto[:, :-1]], axis=1) + 1), 0, cols)
    stop = np.clip(c1 + 1, begin, cols)
    s, e = first[base + begin], first[base + stop]
    w, _ = np.nonzero(e > s)
    s, size = s[e > s], (e - s)[e > s]
    if len(s):
        point = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
        of, odd = np.repeat(w, size), np.zeros(len(point), bool)
        left, edges_here = np.arange(len(point)), here.sum(1)
        for j in range(ay.shape[1]):
            left = left[edges_here[of[left]] > j]
            if not len(left):
                break
            q = of[left]
            x = p[q], edge[q, j]
            y, a, b = la[point[left]], ay[x], by[x]
            between = (a <= y) & (y < b)
            left_, x, y, a, b = left[between], (x[0][between], x[1][between]), y[between], a[between], b[between]
            odd[left_] ^= ax[x] + (y - a) * (bx[x] - ax[x]) / (b - a) < lo[point[left_]]
        out = out + np.bincount(p[of[odd]], minlength=len(low))
    return out.astype(np.int64)


def counts(points: DataFrame, rings: DataFrame, key: str, scale: int) -> DataFrame:
    """(poly, points): how many points each polygon of containing() holds, if any; each key is one point.

    Cells that a polygon fills are counted by two running counts of their row's points, and only points in border cells meet its edges: with about sqrt(points) cells to the side of the area, these are
    as many as the cells that a border crosses. That is done in tasks that hold a band of points and a slice of polygons each, so no row stands for a cell: what moves are points once for each slice
    and edges once for each band that their polygon is in.
    """
    edges = cut(edges_of(rings))
    points = cut(points.select("lat", "lon"))
    slices = edges.count()
    slices = max(-(-slices // SLICE), min(LEAST_SLICES, -(-slices // LEAST_EDGES)), 1)
    bands = max(-(-points.count() // BAND), 1)
    bounds = sorted(set(points.approxQuantile("lat", [k / bands for k in range(1, bands)], 0.1 / bands))) if bands > 1 else []
    band = lambda y: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= y)) if bounds else F.lit(0)
    groups = (len(bounds) + 1) * slices
    extent = edges.groupBy("poly").agg(F.min("ay").alias("_low"), F.max("by").alias("_top"))
    own = edges.join(extent, "poly").withColumn("_band", F.explode(F.sequence(band(F.col("_low")), band(F.col("_top")))))
    own = own.withColumn("_group", F.col("_band") * slices + F.pmod(F.xxhash64("poly"), F.lit(slices)).cast("int")).select("_group", "poly", "ay", "ax", "by", "bx")
    at = points.withColumn("_group", F.explode(F.sequence(band(F.col("lat")) * slices, band(F.col("lat")) * slices + slices - 1)))

    def run(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(e):
            return pd.DataFrame({"poly": e["poly"][:0], "points": pd.Series([], dtype="int64")})
        e = e.sort_values("poly", kind="stable")
        poly, n = held(p["lat"].to_numpy(), p["lon"].to_numpy(), e[["ay", "ax", "by", "bx"]].to_numpy().T.copy(), e["poly"].to_numpy(), scale)
        return pd.DataFrame({"poly": poly[n > 0], "points": n[n > 0]})

    both = at.repartition(groups, "_group").groupBy("_group").cogroup(own.repartition(groups, "_group").groupBy("_group"))
    return both.applyInPandas(run, f"poly {dict(rings.dtypes)['poly']}, points long").groupBy("poly").agg(F.sum("points").alias("points"))
