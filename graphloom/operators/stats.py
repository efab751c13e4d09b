"""Statistics of a graph and of workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.indexes import degrees
from graphloom.sources.graph import Graph


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


def types_per_node(g: Graph) -> DataFrame:
    """Per node with edges: its number of distinct edge types and of edges (a self loop counts once)."""
    ends = g.edges.select("eid", "type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    per = ends.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("id").agg(F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n_edges"))


def degree_stats(g: Graph) -> DataFrame:
    """Least, whole mean and greatest total degree."""
    return degrees(g.nodes, g.edges).agg(F.min("degree").alias("min_degree"), F.floor(F.avg("degree")).cast("long").alias("avg_degree"), F.max("degree").alias("max_degree"))


def density(g: Graph) -> DataFrame:
    """Edges / nodes / (nodes - 1); 0 for fewer than two nodes."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = g.nodes.select(one.alias("v"), none.alias("e")).unionByName(g.edges.select(none.alias("v"), one.alias("e")))
    sums = rows.agg(F.coalesce(F.sum("v"), none).alias("n_nodes"), F.coalesce(F.sum("e"), none).alias("n_edges"))
    value = F.when(F.col("n_nodes") > 1, F.col("n_edges") / F.col("n_nodes") / (F.col("n_nodes") - 1)).otherwise(F.lit(0.0))
    return sums.select("n_nodes", "n_edges", F.round(value, 12).alias("density"))


def dataset_stats(g: Graph) -> DataFrame:
    """(key, cnt): sizes, labels, property keys and the histogram of labels per node."""
    label = g.nodes.select(F.explode("labels").alias("label"))
    keys = g.nodes.select(F.explode(F.map_keys("props")).alias("property"))
    one = lambda df, name, c: df.agg(c.alias("cnt")).select(F.lit(name).alias("key"), F.col("cnt").cast("long"))
    count = F.count(F.lit(1))
    parts = [
        one(g.nodes, "nodes", count),
        one(g.edges, "edges", count),
        one(label, "distinct_labels", F.countDistinct("label")),
        one(keys, "distinct_properties", F.countDistinct("property")),
        one(g.edges, "distinct_types", F.countDistinct("type")),
        g.nodes.groupBy(F.size("labels").alias("s")).agg(count.alias("cnt")).select(F.concat(F.lit("nodes_with_labels_"), "s").alias("key"), "cnt"),
        keys.groupBy("property").agg(count.alias("cnt")).select(F.concat(F.lit("property_"), "property").alias("key"), "cnt"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def most_frequent_label(nodes: DataFrame) -> DataFrame:
    """(id, label, frequency): of each node's labels the most frequent in the graph, then the first by name."""
    own = nodes.select("id", F.explode("labels").alias("label")).distinct()
    frequency = own.groupBy("label").agg(F.count(F.lit(1)).alias("frequency"))
    ranked = own.join(frequency, "label").groupBy("id").agg(F.min(F.struct((-F.col("frequency")).alias("f"), "label")).alias("best"))
    return ranked.select("id", F.col("best.label").alias("label"), (-F.col("best.f")).alias("frequency"))


def node_frequency(answers: DataFrame, columns: list[str]) -> DataFrame:
    """How many answers each data node occurs in, at any query node."""
    return answers.select(F.explode(F.array_distinct(F.array(*columns))).alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("frequency"))


def time_series(results: DataFrame, sizes: list[int]) -> DataFrame:
    """Mean time by k, with a column for each query size, of ``results(k, size, ms)``."""
    return results.groupBy("k").pivot("size", sizes).agg(F.avg("ms"))
