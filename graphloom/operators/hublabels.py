"""Distances between any two nodes by hub labels.

Every node keeps a few (hub, distance) pairs such that on some shortest path of
any two nodes lies a hub of both; their distance is then one join on hubs.  Hubs
are taken in the order of degree, in rounds of growing size.  A round searches
breadth-first from its hubs at once, and goes on from a node only where the labels
of earlier rounds do not give as short a way.  It never goes on from an earlier
hub, whose own search covered that, so later rounds, of many hubs, stay
near them, and compare only labels that are shorter than their own depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import cut, written
from graphloom.operators.structure import ranked_rows
from graphloom.operators.traversal import undirected

#: Hubs of the first round, and how many times more each next round has.
FIRST_HUBS, GROWTH = 16, 4


def hub_order(steps: DataFrame) -> DataFrame:
    """(hub, place): nodes from 0 by falling degree, then id."""
    degree = steps.groupBy(F.col("u").alias("hub")).agg(F.count(F.lit(1)).alias("n"))
    return ranked_rows(degree.withColumn("key", F.struct((-F.col("n")).alias("n"), "hub")).select("hub", "key"), "key", "place").select("hub", "place")


def hub_labels(edges: DataFrame, first: int = FIRST_HUBS, growth: int = GROWTH) -> DataFrame:
    """(id, hub, d) for the undirected graph of ``edges``: labels of every node with an edge to another.

    Parallel edges, directions and self loops do not matter.
    """
    steps = cut(undirected(edges))
    order = written(hub_order(steps), order=("place",))
    count, low, size, labels = order.count(), 0, first, None
    while low < count:
        hubs = order.filter((F.col("place") >= low) & (F.col("place") < low + size)).select("hub")
        found = _round(steps, hubs, order.filter(F.col("place") < low).select(F.col("hub").alias("id")) if low else None, labels)
        labels = found if labels is None else cut(labels.unionByName(found))
        low, size = low + size, size * growth
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, hub long, d int")
    return labels


def _round(steps: DataFrame, hubs: DataFrame, earlier: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    """Labels that the searches from ``hubs`` add to those of ``earlier`` hubs."""
    if earlier is not None:
        steps = steps.join(earlier.withColumnRenamed("id", "v"), "v", "left_anti")
    frontier = cut(hubs.select(F.col("hub").alias("id"), "hub"))
    levels, d = [frontier.withColumn("d", F.lit(0))], 0
    # Ways from a hub of this round to those of earlier ones.
    ways = None if labels is None else cut(labels.join(hubs.select(F.col("hub").alias("id")), "id", "left_semi").select(F.col("id").alias("hub"), F.col("hub").alias("w"), F.col("d").alias("d1")))
    while True:
        d += 1
        moved = frontier.join(steps, F.col("id") == F.col("u")).select(F.col("v").alias("id"), "hub").distinct()
        # A step back leads to one of the last two levels.
        for level in levels[-2:]:
            moved = moved.join(level.select("id", "hub"), ["id", "hub"], "left_anti")
        if ways is not None and d > 1:  # neither end is an earlier hub, so both parts of a way have a step
            moved = cut(moved)
            far = labels.filter((F.col("d") >= 1) & (F.col("d") < d)).select("id", F.col("hub").alias("w"), F.col("d").alias("d2"))
            near = moved.join(ways.filter((F.col("d1") >= 1) & (F.col("d1") < d)), "hub").join(far, ["id", "w"]).filter(F.col("d1") + F.col("d2") <= d)
            moved = moved.join(near.select("id", "hub").distinct(), ["id", "hub"], "left_anti")
        frontier = cut(moved)
        if frontier.isEmpty():
            return cut(reduce(DataFrame.unionByName, levels))
        levels.append(frontier.withColumn("d", F.lit(d)))


def label_distances(labels: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, d) of every source and target that are joined by a path, from the labels alone; a node is at 0 from itself."""
    ahead = sources.select("id").distinct().join(labels, "id").select(F.col("id").alias("src"), "hub", F.col("d").alias("d1"))
    back = targets.select("id").distinct().join(labels, "id").select(F.col("id").alias("dst"), "hub", F.col("d").alias("d2"))
    same = sources.select("id").distinct().join(targets.select("id").distinct(), "id").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("d"))
    pairs = ahead.join(back, "hub").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("d"))
    return pairs.unionByName(same).groupBy("src", "dst").agg(F.min("d").alias("d"))
