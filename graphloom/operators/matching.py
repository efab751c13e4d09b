"""Exact subgraph matching, graph simulation, and what is made of their results."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.indexes import degrees
from graphloom.operators.iterate import written
from graphloom.operators.structure import components
from graphloom.plans.query import Query
from graphloom.sources.graph import Graph

Predicate = Column
_OPERATORS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def attribute_predicate(conditions: list[tuple[str, str, str | int | float]]) -> Predicate:
    """A conjunction of (property, =, < or >, value), numeric where the value is a number."""
    parts = []
    for name, op, value in conditions:
        have = F.try_element_at("props", F.lit(name))
        parts.append(_OPERATORS[op](have if isinstance(value, str) else have.try_cast("double"), F.lit(value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def node_sets(g: Graph, query: Query, predicates: Mapping[str, Predicate] | None = None) -> dict[str, DataFrame]:
    """Per query node the data nodes that have its label (any, for an empty label) and satisfy its predicate."""
    out = {}
    for q, label in query.labels.items():
        own = g.nodes.filter(F.array_contains("labels", label)) if label else g.nodes
        out[q] = own.filter((predicates or {}).get(q, F.lit(True))).select("id")
    return out


def edge_order(query: Query) -> list[tuple[str, str]]:
    """Edges in an order in which each touches those before it where it can."""
    rest, out, seen = list(query.edges), [], set()
    while rest:
        e = next((e for e in rest if seen & set(e)), rest[0])
        rest.remove(e)
        out.append(e)
        seen |= set(e)
    return out


def look_ahead(g: Graph, query: Query, sets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Sets without nodes of fewer out- or in-neighbours than their query node has."""
    n = written(degrees(g.nodes, g.edges).select("id", "out_neighbours", "in_neighbours"))  # each set reads them
    need = {q: (len({b for a, b in query.edges if a == q}), len({a for a, b in query.edges if b == q})) for q in query.ids}
    return {q: s.join(n.filter((F.col("out_neighbours") >= need[q][0]) & (F.col("in_neighbours") >= need[q][1])).select("id"), "id", "left_semi") for q, s in sets.items()}


def candidate_arcs(g: Graph, query: Query, sets: Mapping[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
    """Per query edge (src, dst), of parallel edges repeated: the edges that lie between the least and the greatest node of the ends' sets, a filter that reaches the scans.

    ``sets`` are of some query nodes; the others' ends stay free.
    """
    each = [s.select(F.lit(q).alias("q"), "id") for q, s in sets.items()]
    found = reduce(DataFrame.unionByName, each).groupBy("q").agg(F.min("id").alias("first"), F.max("id").alias("last")).collect() if each else []
    extent = {r.q: (r.first, r.last) for r in found}
    out = {}
    for e in query.edges:
        own = g.edges.select("src", "dst")
        for end, q in zip(("src", "dst"), e, strict=True):
            if q in sets:
                own = own.filter(F.col(end).between(*extent[q]) if q in extent else F.lit(False))
        out[e] = own
    return out


def exact_match(
    g: Graph, query: Query, predicates: Mapping[str, Predicate] | None = None, seed: Mapping[str, int] | None = None, limit: int | None = None, ahead: bool = False
) -> DataFrame:
    """(q..) of all injective matches of labels and directed edges, a chain of edge joins.

    ``seed`` fixes the images of some query nodes; with ``limit`` the matches of
    the least ids are returned; ``ahead`` drops candidates of too few neighbours first.
    """
    sets = node_sets(g, query, predicates)
    bound = {q for q, label in query.labels.items() if label} | set(predicates or {}) | set(seed or {})
    for q, node in (seed or {}).items():
        sets[q] = sets[q].filter(F.col("id") == node)
    arcs = candidate_arcs(g, query, {q: s for q, s in sets.items() if q in bound})
    if ahead:
        sets = look_ahead(g, query, sets)
    rows, seen = None, []
    for a, b in edge_order(query):
        step = arcs[a, b].select(F.col("src").alias(f"q{a}"), F.col("dst").alias(f"q{b}"))
        for q in (a, b):
            if q not in seen or q in bound:  # a set that was met already still leaves few of the edges
                step = step.join(sets[q].select(F.col("id").alias(f"q{q}")), f"q{q}", "left_semi")
        step = step.distinct()
        shared = [f"q{q}" for q in (a, b) if q in seen]
        if rows is None:
            rows = step
        elif shared:
            rows = rows.join(step, shared)
        else:
            raise ValueError("the query graph is not connected")
        seen += [q for q in (a, b) if q not in seen]
        rows = rows.filter(reduce(lambda x, y: x & y, [F.col(f"q{x}") != F.col(f"q{y}") for x, y in combinations(seen, 2)]))
    if rows is None:
        q = query.ids[0]
        rows = sets[q].select(F.col("id").alias(f"q{q}"))
    columns = [f"q{q}" for q in query.ids]
    rows = rows.select(*columns)
    return rows.orderBy(*columns).limit(limit) if limit else rows


def support(matches: DataFrame) -> DataFrame:
    """Least number of distinct images of a query node."""
    counts = matches.agg(*[F.countDistinct(c).alias(c) for c in matches.columns])
    columns = [F.col(c) for c in matches.columns]
    return counts.select((F.least(*columns) if len(columns) > 1 else columns[0]).alias("support"))


def coverage(matches: DataFrame) -> DataFrame:
    """Number of distinct data nodes in any match."""
    return matches.select(F.explode(F.array(*matches.columns)).alias("id")).agg(F.countDistinct("id").alias("coverage"))


def simulation(g: Graph, query: Query, predicates: Mapping[str, Predicate] | None = None, inherited: DataFrame | None = None) -> DataFrame:
    """(qid, id) of the largest graph simulation; no rows if a query node's set empties.

    For each query edge (u, v), a node of u needs an edge into v's set.  Rounds of
    semi joins run until no set shrinks; ``inherited(qid, id)`` narrows the start.
    """
    sets = node_sets(g, query, predicates)
    bound = {q: s for q, s in sets.items() if query.labels[q] or q in (predicates or {})}
    own = []
    for (u, v), arcs in candidate_arcs(g, query, bound).items():
        for end, q in (("src", u), ("dst", v)):
            if q in bound:
                arcs = arcs.join(bound[q].select(F.col("id").alias(end)), end, "left_semi")
        own.append(arcs)
    # Sets only shrink, so other edges never count.
    arcs = written(reduce(DataFrame.unionByName, own).distinct()) if own else None
    start = [s.select(F.lit(q).alias("qid"), "id") for q, s in sets.items()]
    sim = reduce(DataFrame.unionByName, start).distinct()
    if inherited is not None:
        sim = sim.join(inherited, ["qid", "id"], "left_semi")
    sim = written(sim)
    needs = {u: [v for a, v in query.edges if a == u] for u in query.ids}
    before = -1
    while (count := sim.count()) != before:
        before = count
        have = sim.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).count()
        if have < len(query.ids):
            return sim.filter(F.lit(False))
        if arcs is None:
            return sim
        targets = sorted({v for vs in needs.values() for v in vs})
        into = [F.max(F.col("v") == v).alias(f"into_{v}") for v in targets]
        pairs = arcs.join(sim.select(F.col("qid").alias("v"), F.col("id").alias("dst")), "dst").groupBy("src").agg(*into)
        met = [reduce(lambda x, y: x & y, [F.coalesce(f"into_{v}", F.lit(False)) for v in vs]) if vs else F.lit(True) for vs in needs.values()]
        ok = reduce(lambda x, y: x | y, [(F.col("qid") == u) & m for u, m in zip(needs, met, strict=True)])
        sim = written(sim.join(pairs, sim["id"] == pairs["src"], "left").filter(ok).select("qid", "id"))
    return sim


def set_sizes(sim: DataFrame) -> DataFrame:
    return sim.groupBy("qid").agg(F.count(F.lit(1)).alias("n_nodes"))


def edge_cardinality(sim: DataFrame, arcs: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of ``sim`` whose nodes have from ``low`` to ``high`` edges into nodes of any set; repeated until none goes."""
    # Rounds only take nodes away, so the edges between those of the start are all that count.
    ids = written(sim.select("id").distinct())
    arcs = written(arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    while True:
        inner = arcs.join(sim.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        kept = written(sim.join(inner.filter(F.col("n").between(low, high)), "id", "left_semi").select("qid", "id"))
        if kept.count() == sim.count():
            return kept
        sim = kept


def interestingness(sim: DataFrame, query: Query, n_nodes: int) -> DataFrame:
    """Pattern nodes times covered share of the graph's nodes."""
    return sim.agg(F.round(len(query.ids) * F.countDistinct("id") / max(1, n_nodes), 9).alias("interestingness"))


def result_edges(g: Graph, query: Query, sim: DataFrame) -> DataFrame:
    """(src, dst): data edges that realise a query edge between simulated sets."""
    edges = g.spark.createDataFrame([(a, b) for a, b in query.edges], "u string, v string")
    have = g.edges.select("src", "dst").distinct().join(sim.select(F.col("qid").alias("u"), F.col("id").alias("src")), "src")
    have = have.join(sim.select(F.col("qid").alias("v"), F.col("id").alias("dst")), "dst")
    return have.join(F.broadcast(edges), ["u", "v"], "left_semi").select("src", "dst").distinct()  # a query is small


def result_components(edges: DataFrame, bound: str | None = None) -> DataFrame:
    """(component, n_nodes, n_edges) of a result graph; with the column of a bound, its mean too, in whose order components come."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    comp = components(nodes, edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    own = edges.join(comp.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    out = sizes.join(own, "component").select("component", "n_nodes", "n_edges")
    if bound is None:
        return out
    mean = edges.join(comp.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.avg(bound).alias("mean_bound"))
    return out.join(mean, "component").orderBy("mean_bound", "component")


def nodes_with_edge_property(g: Graph, name: str, value: str) -> DataFrame:
    """(id) of nodes that have an edge, in either direction, with a property of some value."""
    own = g.edges.filter(F.try_element_at("props", F.lit(name)) == value)
    return own.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def successors_by_property(g: Graph, ids: DataFrame, name: str, value: str) -> DataFrame:
    """(src, dst): out-neighbours of some nodes over edges with a property of some value."""
    own = g.edges.filter(F.try_element_at("props", F.lit(name)) == value).select("src", "dst").distinct()
    return own.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
