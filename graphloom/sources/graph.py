"""Property graphs as two DataFrames, and the graph that the relational tables describe."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("props", T.MapType(T.StringType(), T.StringType()))]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("eid", T.LongType()),
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: Node ids are kind * ID_STEP + key; edge ids kind * EID_STEP + key.
ID_STEP, EID_STEP = 10**9, 10**13
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}
EDGE_KINDS = {"IN_REGION": 1, "CUSTOMER_IN": 2, "SUPPLIER_IN": 3, "PLACED_BY": 4, "CONTAINS": 5, "SUPPLIED_BY": 6}


@dataclass(frozen=True)
class Graph:
    """``nodes(id, labels, props)`` and directed multi-edges ``edges(eid, src, dst, type, props)``."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def node(self, node_id: int) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def edge(self, src: int, dst: int) -> DataFrame:
        return self.edges.filter((F.col("src") == src) & (F.col("dst") == dst))

    def write(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Graph:
        return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"))

    @staticmethod
    def from_rows(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
        """Small graphs: nodes (id, labels[, props]) and edges (src, dst[, type[, props]])."""
        full_nodes = [(n[0], list(n[1]), dict(n[2]) if len(n) > 2 else {}) for n in nodes]
        full_edges = [(i, e[0], e[1], e[2] if len(e) > 2 else "RELATED", dict(e[3]) if len(e) > 3 else {}) for i, e in enumerate(edges)]
        return Graph(spark.createDataFrame(full_nodes, NODE_SCHEMA), spark.createDataFrame(full_edges, EDGE_SCHEMA))


def _props(values: Mapping[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _nodes(df: DataFrame, kind: str, key: str, labels: list[str], props: Mapping[str, Column] | None = None) -> DataFrame:
    node_id = F.lit(KINDS[kind] * ID_STEP) + F.col(key).cast("long")
    return df.select(node_id.alias("id"), F.array(*[F.col(c).cast("string") for c in labels]).alias("labels"), _props(props or {}).alias("props"))


def _edges(df: DataFrame, kind: str, key: Column, src: tuple[str, str], dst: tuple[str, str], props: Mapping[str, Column] | None = None) -> DataFrame:
    end = lambda x: F.lit(KINDS[x[0]] * ID_STEP) + F.col(x[1]).cast("long")
    name = "IN_NATION" if kind.endswith("_IN") else kind
    eid = (F.lit(EDGE_KINDS[kind] * EID_STEP) + key.cast("long")).alias("eid")
    return df.select(eid, end(src).alias("src"), end(dst).alias("dst"), F.lit(name).alias("type"), _props(props or {}).alias("props"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relational_graph(spark: SparkSession, sf_dir: str, small: bool = False) -> Graph:
    """Regions, nations, customers and suppliers; unless ``small``, parts and orders too."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    whole = lambda c: F.floor(F.col(c)).cast("long")
    nation, customer, supplier = read("nation"), read("customer"), read("supplier")
    nodes = [
        _nodes(read("region"), "region", "r_regionkey", ["r_name"]),
        _nodes(nation, "nation", "n_nationkey", ["n_name"]),
        _nodes(customer, "customer", "c_custkey", ["c_name", "c_mktsegment"], {"acctbal": whole("c_acctbal")}),
        _nodes(supplier, "supplier", "s_suppkey", ["s_name"], {"acctbal": whole("s_acctbal")}),
    ]
    edges = [
        _edges(nation, "IN_REGION", F.col("n_nationkey"), ("nation", "n_nationkey"), ("region", "n_regionkey")),
        _edges(customer, "CUSTOMER_IN", F.col("c_custkey"), ("customer", "c_custkey"), ("nation", "c_nationkey")),
        _edges(supplier, "SUPPLIER_IN", F.col("s_suppkey"), ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ]
    if not small:
        orders, lines = read("orders"), read("lineitem")
        nodes += [
            _nodes(read("part"), "part", "p_partkey", ["p_name", "p_brand", "p_type"], {"size": F.col("p_size"), "price": whole("p_retailprice")}),
            _nodes(orders, "order", "o_orderkey", ["o_orderpriority", "o_orderstatus"], {"date": F.date_format("o_orderdate", "yyyy-MM-dd")}),
        ]
        pairs = lines.select("l_partkey", "l_suppkey").distinct()
        edges += [
            _edges(orders, "PLACED_BY", F.col("o_orderkey"), ("order", "o_orderkey"), ("customer", "o_custkey")),
            _edges(lines, "CONTAINS", F.col("l_orderkey") * 10 + F.col("l_linenumber"), ("order", "l_orderkey"), ("part", "l_partkey"), {"flag": F.col("l_returnflag")}),
            _edges(pairs, "SUPPLIED_BY", F.col("l_partkey") * 100_000 + F.col("l_suppkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")),
        ]
    return Graph(_union(nodes), _union(edges))


def subgraph_of_kinds(g: Graph, kinds: list[str]) -> Graph:
    """The nodes of some kinds and the edges between them, as range filters that reach the scans."""
    inside = lambda c: F.floor(F.col(c) / ID_STEP).isin([KINDS[k] for k in kinds])
    return Graph(g.nodes.filter(inside("id")), g.edges.filter(inside("src") & inside("dst")))
