"""Making and pruning query workloads from a data graph."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import cut, written
from graphloom.operators.matching import exact_match
from graphloom.operators.traversal import undirected
from graphloom.plans.query import Query, non_star, runnable
from graphloom.sources.graph import Graph


def sample_queries(g: Graph, size: int, count: int, seed: int = 1) -> list[Query]:
    """Random connected queries of ``size`` nodes: walks that add a random neighbour of a random member, all grown in one plan.

    Queries on equal node sets are returned once; walks that get stuck are dropped.
    """
    steps = undirected(g.edges)
    noise = lambda k: F.xxhash64("walk", "v", F.lit(seed), F.lit(k))
    starts = g.nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count)
    walks = starts.select(F.col("id").alias("walk"), F.array("id").alias("members"))
    for k in range(size - 1):
        ends = walks.select("walk", "members", F.explode("members").alias("u")).join(steps, "u").filter(~F.array_contains("members", F.col("v")))
        best = ends.withColumn("_n", F.row_number().over(Window.partitionBy("walk").orderBy(noise(k), "v"))).filter("_n = 1")
        walks = best.select("walk", F.concat("members", F.array("v")).alias("members"))
    sets = walks.withColumn("members", F.array_sort("members")).dropDuplicates(["members"]).select("members").collect()
    ids = sorted({x for r in sets for x in r.members})
    if not ids:
        return []
    wanted = F.broadcast(g.spark.createDataFrame([(x,) for x in ids], "id long"))  # count * size ids
    labels = {r.id: (r.labels or [""])[0] for r in g.nodes.join(wanted, "id", "left_semi").select("id", "labels").collect()}
    arcs = g.edges.select("src", "dst").join(wanted.withColumnRenamed("id", "src"), "src", "left_semi").join(wanted.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = {(r.src, r.dst) for r in arcs.distinct().collect()}
    out = []
    for k, r in enumerate(sorted(sets, key=lambda r: r.members)):
        names = {x: str(i) for i, x in enumerate(r.members)}
        out.append(Query({names[x]: labels[x] for x in r.members}, tuple((names[a], names[b]) for a in r.members for b in r.members if (a, b) in pairs), k))
    return out


def label_templates(g: Graph, template: Query, stop: tuple[str, ...] = (), p: int = 4) -> Query:
    """A template's nodes labelled from all its structural matches: by the label that most matched nodes have one alike, no stop word and not used yet.

    Labels are alike that share their first ``p`` characters; of those of one
    beginning the commonest is taken, then the least.
    """
    matches = exact_match(g, Query({q: "" for q in template.ids}, template.edges), ahead=True)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{q}").alias("id")) for q in template.ids])).alias("x")
    matched = cut(matches.select(each).select("x.q", "x.id").distinct())  # matches are made once, and only their nodes are kept
    labels, used = {}, set(stop)
    for q in template.ids:
        own = matched.filter(F.col("q") == q).join(g.nodes, "id").select(F.explode("labels").alias("label"))
        counted = own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.substring("label", 1, p))
        alike = counted.groupBy("start").agg(F.sum("n").alias("alike"))
        ranked = counted.join(alike, "start").orderBy(F.desc("alike"), F.desc("n"), "label").limit(len(used) + 1).collect()
        labels[q] = next((r.label for r in ranked if r.label not in used), "")
        used.add(labels[q])
    return Query(labels, template.edges, template.index)


def prune(queries: list[Query], p: int) -> list[Query]:
    """Queries with long enough, distinct labels, numbered anew."""
    return [Query(q.labels, q.edges, k) for k, q in enumerate(q for q in queries if runnable(q, p))]


def not_timed_out(queries: list[Query], p: int, milliseconds: dict[int, float], most: float = 60_000.0) -> list[Query]:
    """Runnable queries whose measured time, by their index, is known and below a cap."""
    return [q for q in queries if runnable(q, p) and milliseconds.get(q.index, most) < most]


def non_stars(queries: list[Query]) -> list[Query]:
    return [q for q in queries if non_star(q)]


def close_a_star(query: Query, seed: int = 1) -> Query | None:
    """A star made a non-star by an edge between two of its leaves; None if it has no two leaves without one."""
    leaves = [q for q in query.ids if len(query.incident(q)) == 1]
    free = [(a, b) for a in leaves for b in leaves if a < b and not any({a, b} == set(e) for e in query.edges)]
    return Query(query.labels, (*query.edges, random.Random(seed).choice(free)), query.index) if free else None


def label_combinations(g: Graph, matches: DataFrame) -> DataFrame:
    """All ways to label the query nodes of matches by labels of their data nodes, all different; repeated ones once.

    A match gives way to its nodes' labels one query node after another, and matches
    that have become alike are one from there on.
    """
    out = written(matches)
    ends = [f(c).alias(f"{k}_{c}") for c in matches.columns for k, f in (("first", F.min), ("last", F.max))]
    extent = out.agg(*ends).first()
    for c in matches.columns:
        near = g.nodes.filter(F.col("id").between(extent[f"first_{c}"], extent[f"last_{c}"]))
        own = near.join(out.select(F.col(c).alias("id")), "id", "left_semi").select(F.col("id").alias(c), F.array_distinct("labels").alias(f"label_{c}"))
        out = out.join(own, c).drop(c).distinct()
    names = [f"label_{c}" for c in matches.columns]
    for n in names:
        out = out.withColumn(n, F.explode(n))
    return out.filter(F.size(F.array_distinct(F.array(*names))) == len(names)).select(*names).distinct()
