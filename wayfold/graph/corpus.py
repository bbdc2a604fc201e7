"""Corpora of routes: what tells a route apart, and where two corpora over the same pairs differ.

A fingerprint is (route, s, e, d, t, n, g, rd): ends, metres and seconds to three decimals, nodes, shapes and roads in order. It is a row of arrays as long as the route has hops;
nothing is larger than a route. Routes without steps (unreachable pairs) have no steps to fold: `pairs`, where given, adds them with nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routes import roads

#: Fields of a fingerprint, in the order in which differences are named.
FIELDS = ("s", "e", "d", "t", "n", "g", "rd")


def fingerprints(steps: DataFrame, order: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """steps(route, order, src, dst, dist_dm, time_ms, shape, label, access) to fingerprints; a null shape is -1."""
    step = F.struct(*order, "src", "dst", F.coalesce("shape", F.lit(-1)).alias("shape"))
    own = steps.groupBy("route").agg(F.array_sort(F.collect_list(step)).alias("_s"), F.sum("dist_dm").alias("_d"), F.sum("time_ms").alias("_t"))
    road = F.struct("road", "label", "roundabout", "link", F.round(F.col("dist_dm") / 10.0, 3).alias("d"))
    named = roads(steps, ["route"], order).groupBy("route").agg(F.transform(F.array_sort(F.collect_list(road)), lambda r: r.dropFields("road")).alias("rd"))
    first, last = F.element_at("_s", 1)["src"], F.element_at("_s", -1)["dst"]
    nodes = F.concat(F.array(first), F.transform("_s", lambda x: x["dst"]))
    out = own.select("route", first.alias("s"), last.alias("e"), F.round(F.col("_d") / 10.0, 3).alias("d"), F.round(F.col("_t") / 1000.0, 3).alias("t"), nodes.alias("n"), F.transform("_s", lambda x: x["shape"]).alias("g"))
    out = out.join(named, "route")
    if pairs is None:
        return out
    ends = pairs.select("route", F.col("start").alias("_a"), F.col("end").alias("_b"))
    return ends.join(out, "route", "left").select("route", F.coalesce("s", "_a").alias("s"), F.coalesce("e", "_b").alias("e"), *FIELDS[2:])


def _parts_at(a: Column, b: Column) -> Column:
    """The first place, from 0, at which two arrays part; the shorter one's length if it begins the other; null if they are equal. A null array is empty."""
    a, b = F.coalesce(a, F.slice(b, 1, 0)), F.coalesce(b, F.slice(a, 1, 0))
    short = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True)
    return F.when(~a.eqNullSafe(b), F.when(at > 0, at - 1).otherwise(short.cast("long")))


def differences(golden: DataFrame, candidate: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(route, status, fields, at_n, at_g, at_rd): 'missing' and 'extra' routes stand in one corpus only; 'same' ones agree in all fields; 'drift' ones differ in metres or seconds
    by less than epsilon, with nodes, shapes and roads equal; else 'differs'. `fields` names what is unequal, with commas; the rest are places where sequences part."""
    both = golden.withColumn("_in", F.lit(1)).alias("a").join(candidate.withColumn("_in", F.lit(1)).alias("b"), "route", "full")
    a, b = (lambda x: F.col(f"a.{x}")), (lambda x: F.col(f"b.{x}"))
    unequal = {x: ~a(x).eqNullSafe(b(x)) for x in FIELDS}
    close = [F.abs(F.coalesce(a(x), F.lit(0.0)) - F.coalesce(b(x), F.lit(0.0))) < epsilon for x in ("d", "t")]
    strict = [unequal[x] for x in FIELDS if x not in ("d", "t")]
    any_ = F.exists(F.array(*unequal.values()), lambda x: x)
    drift = ~F.exists(F.array(*strict), lambda x: x) & close[0] & close[1]
    status = F.when(b("_in").isNull(), "missing").when(a("_in").isNull(), "extra").when(~any_, "same").when(drift, "drift").otherwise("differs")
    held = a("_in").isNotNull() & b("_in").isNotNull()
    named = F.concat_ws(",", *[F.when(held & u, x) for x, u in unequal.items()])
    return both.select("route", status.alias("status"), named.alias("fields"), *[F.when(held, _parts_at(a(x), b(x))).alias(f"at_{x}") for x in ("n", "g", "rd")])
