"""Connected components of an edge table by alternating large-star and small-star contraction.

Each round is two aggregates and joins on node keys; labels never reach the
driver.  Rounds end when the edges form stars, which takes a logarithmic number
of rounds; what each round leaves is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; a component is named by its smallest node.

    Nulls, self links and repeated edges are ignored.  No edges give no rows.
    """
    current = materialise(_oriented(edges))
    before = None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_star(both, larger=True))  # it is read twice
        small = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), larger=False)
        current = materialise(small)
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        before = seen


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the smaller to the larger node."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours v of each u to the smallest of u and them: the larger ones, or (smaller ones given) all and u itself."""
    # Read back, the minima come to the join by a shuffle of their own, as the pairs do: only then can a hub's pairs be split.
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    moved = pairs.join(least, "u")
    if larger:  # repeated edges may stay until the smaller star's edges are made distinct
        return moved.filter("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return _oriented(out)
