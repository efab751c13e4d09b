"""Access paths as exploded tables: label prefixes, labels, properties, values, neighbours, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.similarity import node_terms
from graphloom.operators.structure import ranked_rows

#: Directories of a stored prefix index.
DIRECTORIES = 64


def prefix_entries(nodes: DataFrame, p: int) -> DataFrame:
    """(prefix, id), distinct: the first ``p`` characters of each long enough term of a node."""
    terms = nodes.select("id", F.explode(node_terms()).alias("term")).filter(F.length("term") >= p)
    return terms.select(F.substring("term", 1, p).alias("prefix"), "id").distinct()


def prefix_index(nodes: DataFrame, p: int) -> DataFrame:
    """Per prefix, its number of nodes and the extent of their ids; the ids stay in ``prefix_entries``, which no hot prefix bursts."""
    return prefix_entries(nodes, p).groupBy("prefix").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


class PrefixIndex:
    """A stored access path from label prefixes of ``p`` characters to nodes and what is compared of them.

    Entries (prefix, id, terms) lie in directories by a hash of the prefix and
    are sorted by it there, so a look-up reads the directories of its prefixes,
    and of these the row groups that can hold them.  A directory that a common
    prefix makes large is several files.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        about = spark.read.schema("p int, directories int").parquet(f"{path}/about").first()
        self.p, self.directories = about.p, about.directories
        self.entries = spark.read.schema("prefix string, id long, terms array<string>, directory int").parquet(f"{path}/entries")

    @staticmethod
    def build(nodes: DataFrame, p: int, path: str, directories: int = DIRECTORIES) -> PrefixIndex:
        """Writes the index of ``nodes`` to a folder that is shared and empty."""
        own = nodes.select("id", node_terms().alias("terms"))
        prefixes = F.array_distinct(F.transform(F.filter("terms", lambda t: F.length(t) >= p), lambda t: F.substring(t, 1, p)))
        rows = own.select(F.explode(prefixes).alias("prefix"), "id", "terms")
        rows = rows.withColumn("directory", PrefixIndex._directory(F.col("prefix"), directories)).hint("rebalance", "directory")
        rows.sortWithinPartitions("directory", "prefix", "id").write.partitionBy("directory").parquet(f"{path}/entries")
        nodes.sparkSession.createDataFrame([(p, directories)], "p int, directories int").coalesce(1).write.parquet(f"{path}/about")
        return PrefixIndex(nodes.sparkSession, path)

    @staticmethod
    def _directory(prefix: Column, directories: int) -> Column:
        return F.pmod(F.xxhash64(prefix), F.lit(directories)).cast("int")

    def lookup(self, prefix: str) -> DataFrame:
        """(id, terms) of the nodes of a prefix."""
        here = F.col("directory") == self._directory(F.lit(prefix), self.directories)  # folded to a literal, so directories are pruned
        return self.entries.filter(here & (F.col("prefix") == prefix)).select("id", "terms")


def label_entries(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("labels").alias("label"), "id").distinct()


def label_frequency(nodes: DataFrame) -> DataFrame:
    return label_entries(nodes).groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))


def ids_with_labels(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes that have any of some labels."""
    return label_entries(nodes).filter(F.col("label").isin(labels)).select("id").distinct()


def term_frequency(nodes: DataFrame, least: int = 4) -> DataFrame:
    """Frequency of labels (of property values for unlabelled nodes) that are no URL and have ``least`` characters or more."""
    terms = nodes.select("id", F.explode(node_terms()).alias("label"))
    return terms.filter((F.length("label") >= least) & ~F.col("label").startswith("http://")).groupBy("label").agg(F.count(F.lit(1)).alias("frequency"))


def frequency_histogram(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("frequency").agg(F.count(F.lit(1)).alias("n_labels"))


def property_entries(table: DataFrame, key: str = "id") -> DataFrame:
    """(property, value, key) of nodes or, with key ``eid``, of edges."""
    return table.select(key, F.explode("props").alias("property", "value"))


def property_stats(nodes: DataFrame) -> DataFrame:
    return property_entries(nodes).groupBy("property").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("value").alias("n_values"))


def value_index(table: DataFrame, key: str = "id") -> DataFrame:
    """Per property value, its number of owners and the first."""
    return property_entries(table, key).groupBy("value").agg(F.countDistinct(key).alias("n_owners"), F.min(key).alias("first_owner"))


def nodes_with_all_keys(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that have every one of some property keys: a filter on the map, without a shuffle."""
    wanted = F.array(*[F.lit(k) for k in sorted(set(keys))])
    return nodes.filter(F.size(F.array_intersect(F.map_keys("props"), wanted)) == len(set(keys))).select("id")


def neighbours(edges: DataFrame, outgoing: bool) -> DataFrame:
    """(id, neighbour), distinct."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    return edges.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In-, out- and total degree, and numbers of distinct neighbours, of every node."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("o")))
    pairs = ends.groupBy("id", "other", "o").agg(F.count(F.lit(1)).alias("n"))
    sums = pairs.groupBy("id").agg(
        F.sum(F.when(F.col("o") == 0, F.col("n")).otherwise(0)).alias("in_degree"),
        F.sum(F.when(F.col("o") == 1, F.col("n")).otherwise(0)).alias("out_degree"),
        F.count_if(F.col("o") == 0).alias("in_neighbours"),
        F.count_if(F.col("o") == 1).alias("out_neighbours"),
    )
    zero = {c: 0 for c in ("in_degree", "out_degree", "in_neighbours", "out_neighbours")}
    return nodes.select("id").join(sums, "id", "left").fillna(zero).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def neighbours_to_two(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_neighbours, out_neighbours): distinct neighbours of every node, two standing for more.

    The least and the greatest neighbour tell, so that edges are read and shuffled once, by node.
    """
    none = F.lit(None).cast("long")
    ends = edges.select(F.stack(F.lit(2), "src", none, "dst", "dst", "src", none).alias("id", "before", "after"))
    number = lambda c: F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2).cast("long")
    found = ends.groupBy("id").agg(number("before").alias("in_neighbours"), number("after").alias("out_neighbours"))
    return nodes.select("id").join(found, "id", "left").fillna({"in_neighbours": 0, "out_neighbours": 0})


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(id, dense_id): consecutive numbers from 0 in the order of ids.

    Only the counts of id ranges meet in one place: rows are dealt out by
    range, numbered within their range and moved by the ranges before.
    """
    return ranked_rows(nodes.select("id"), "id", "dense_id").select("id", "dense_id")


def ids_with_label_part(nodes: DataFrame, part: str) -> DataFrame:
    """Nodes that have a label which contains a string."""
    return nodes.filter(F.exists("labels", lambda x: F.contains(x, F.lit(part)))).select("id")
