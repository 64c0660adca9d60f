"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with more neighbours than this is a hub. There is a hub for so many links at most, so hubs may be broadcast as long as HUBS isn't passed.
HUB, HUBS = 10_000, 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(u, v) with m, u's least neighbour, from least(u, m, degree).

    The root of a large class has all its members as neighbours. Links of such hubs stay where they are and get m by broadcast; all others are joined by node.
    """
    hubs = least.filter(F.col("degree") > HUB).select("u", "m")
    n = hubs.limit(HUBS + 1).count()
    if not 0 < n <= HUBS:
        return edges.join(least.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("degree") <= HUB).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to node and root, the least node it is connected with; nodes without a link don't occur.

    Each step is minima by node, which are combined before they are shuffled, and joins by node but for hubs, so no task holds all neighbours of one; nothing but
    counts and a checksum reaches the driver.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    degree = F.count("*").alias("degree")
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), degree).select("u", F.least("u", "m").alias("m"), "degree"))
        up = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(up.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct())
        discard(least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), degree))
        small = _with_least(large, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, materialize(small.distinct())
        discard(last, large, least)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
