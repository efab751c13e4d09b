"""Frequent patterns: level-wise growth under simulation, and diversified choice."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.iterate import cut
from graphloom.operators.stats import most_frequent_label
from graphloom.plans.query import Query
from graphloom.sources.graph import Graph

MOST_NODES, MOST_LEVELS = 10, 10


def edge_patterns(g: Graph, low: int, high: int) -> DataFrame:
    """(src_label, dst_label, n_edges): pairs of most frequent labels along edges, each label's frequency within the bounds."""
    best = most_frequent_label(g.nodes).filter(F.col("frequency").between(low, high)).select("id", "label")
    ends = g.edges.select("src", "dst").distinct()
    ends = ends.join(best.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(best.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    return ends.groupBy("src_label", "dst_label").agg(F.count(F.lit(1)).alias("n_edges"))


@dataclass
class Pattern:
    query: Query
    matches: DataFrame
    interest: float
    #: the sets of all patterns evaluated with it, and its pid there
    together: DataFrame
    pid: int


def evaluate_all(g: Graph, queries: list[Query], n_nodes: int, start: DataFrame) -> list[Pattern]:
    """Every pattern with its largest simulation within ``start(pid, qid, id)``, pid being its place; one run of rounds for all.

    As ``matching.simulation``: a node of u needs an edge into v's set for each
    pattern edge (u, v), and a pattern of which a set empties has no rows.
    """
    spark = g.spark
    needs = spark.createDataFrame([(k, a, b) for k, q in enumerate(queries) for a, b in q.edges], "pid int, qid string, v string")
    sizes = spark.createDataFrame([(k, len(q.labels)) for k, q in enumerate(queries)], "pid int, n_sets int")
    arcs, sim, before = cut(g.edges.select("src", "dst").distinct()), cut(start), -1
    while (count := sim.count()) != before:
        before = count
        into = arcs.join(sim.select("pid", F.col("qid").alias("v"), F.col("id").alias("dst")), "dst").select("pid", "v", F.col("src").alias("id")).distinct()
        lost = sim.join(needs, ["pid", "qid"]).join(into, ["pid", "v", "id"], "left_anti").select("pid", "qid", "id").distinct()
        kept = cut(sim.join(lost, ["pid", "qid", "id"], "left_anti"))
        full = kept.groupBy("pid").agg(F.countDistinct("qid").alias("n_sets")).join(sizes, ["pid", "n_sets"], "left_semi")
        sim = cut(kept.join(full.select("pid"), "pid", "left_semi"))
    covered = {r.pid: r.n for r in sim.groupBy("pid").agg(F.countDistinct("id").alias("n")).collect()}
    return [Pattern(q, sim.filter(F.col("pid") == k).select("qid", "id"), round(len(q.labels) * covered.get(k, 0) / max(1, n_nodes), 9), sim, k) for k, q in enumerate(queries)]


def merge_patterns(a: Query, b: Query) -> Query | None:
    """Union of two patterns whose nodes are named by their labels; None if they share no node or make no larger pattern."""
    if not set(a.labels) & set(b.labels):
        return None
    labels = dict(sorted((a.labels | b.labels).items()))
    out = Query(labels, tuple(sorted(set(a.edges) | set(b.edges))))
    return out if len(out.edges) > max(len(a.edges), len(b.edges)) else None


def mine(g: Graph, low: int, high: int, theta: float, levels: int = MOST_LEVELS) -> list[Pattern]:
    """All patterns of interestingness ``theta`` or more, level by level.

    The first level is the edge patterns; each later one merges every pair of
    patterns that share a node, starts the simulations from the parents' sets and
    keeps patterns of ``MOST_NODES`` nodes at most.  Nothing else bounds their number.
    """
    n_nodes = g.nodes.count()
    seeds = edge_patterns(g, low, high).filter("src_label <> dst_label").orderBy(F.desc("n_edges"), "src_label", "dst_label").collect()
    queries = [Query({r.src_label: r.src_label, r.dst_label: r.dst_label}, ((r.src_label, r.dst_label),)) for r in seeds]
    if not queries:
        return []
    wanted = g.spark.createDataFrame([(k, q) for k, query in enumerate(queries) for q in query.labels], "pid int, qid string")
    start = g.nodes.select("id", F.explode("labels").alias("qid")).distinct().join(wanted, "qid").select("pid", "qid", "id")
    level = [p for p in evaluate_all(g, queries, n_nodes, start) if p.interest >= theta]
    found, known = list(level), {frozenset(q.edges) for q in queries}
    for _ in range(levels - 1):
        merged: list[tuple[Query, Pattern, Pattern]] = []
        for i, a in enumerate(level):
            for b in level[:i]:
                query = merge_patterns(a.query, b.query)
                # Nodes are named by their labels, so equal edges are equal patterns.
                if query is not None and len(query.labels) <= MOST_NODES and frozenset(query.edges) not in known:
                    known.add(frozenset(query.edges))
                    merged.append((query, a, b))
        if not merged:
            break
        parents = g.spark.createDataFrame([(p.pid, k, q, sum(q in x.query.labels for x in (a, b))) for k, (_, a, b) in enumerate(merged) for p in (a, b) for q in p.query.labels], "parent int, pid int, qid string, n int")
        sets = level[0].together.withColumnRenamed("pid", "parent").join(parents, ["parent", "qid"])
        start = sets.groupBy("pid", "qid", "id", "n").agg(F.count(F.lit(1)).alias("have")).filter("have = n").select("pid", "qid", "id")
        level = [p for p in evaluate_all(g, [x[0] for x in merged], n_nodes, start) if p.interest >= theta]
        if not level:
            break
        found += level
    return found


def distance(a: Pattern, b: Pattern) -> float:
    """1 - Jaccard index of the covered nodes, counted without collecting them."""
    x, y = a.matches.select("id").distinct(), b.matches.select("id").distinct()
    both, all_ = x.intersect(y).count(), x.union(y).distinct().count()
    return 1 - both / all_ if all_ else 0.0


def distances(patterns: list[Pattern]) -> dict[tuple[int, int], float]:
    """``distance`` of all pairs (i, j) with i < j, from one join of the covered nodes."""
    if len(patterns) < 2:
        return {}
    batches: list[tuple[DataFrame, list[tuple[int, int]]]] = []
    for i, p in enumerate(patterns):
        if not batches or batches[-1][0] is not p.together:
            batches.append((p.together, []))
        batches[-1][1].append((p.pid, i))
    covers = [sim.join(sim.sparkSession.createDataFrame(pids, "pid int, i int"), "pid").select("i", "id").distinct() for sim, pids in batches]
    cover = cut(reduce(DataFrame.unionByName, covers))
    size = {r.i: r.n for r in cover.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = cover.join(cover.select(F.col("i").alias("j"), "id"), "id").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    shared = {(r.i, r.j): r.n for r in both.collect()}
    every = ((i, j, shared.get((i, j), 0)) for i in range(len(patterns)) for j in range(i + 1, len(patterns)))
    return {(i, j): 1 - n / all_ if (all_ := size.get(i, 0) + size.get(j, 0) - n) else 0.0 for i, j, n in every}


def objective(chosen: list[int], interest: list[float], dist: dict[tuple[int, int], float], alpha: float = 0.5) -> float:
    """alpha * sum of interests + (1 - alpha) / (n - 1) * sum of pairwise distances."""
    pairs = sum(dist[min(i, j), max(i, j)] for k, i in enumerate(chosen) for j in chosen[:k])
    return alpha * sum(interest[i] for i in chosen) + ((1 - alpha) / (len(chosen) - 1) * pairs if len(chosen) > 1 else 0.0)


def diversify_by_swaps(interest: list[float], dist: dict[tuple[int, int], float], k: int, alpha: float = 0.5) -> list[int]:
    """Incremental choice of k patterns: each new one takes the place of the member whose swap gains most, if any gains."""
    chosen: list[int] = []
    for new in range(len(interest)):
        if len(chosen) < k:
            chosen.append(new)
            continue
        now = objective(chosen, interest, dist, alpha)
        gain, at = max((objective([*chosen[:i], new, *chosen[i + 1 :]], interest, dist, alpha) - now, -i) for i in range(k))
        if gain > 1e-12:
            chosen[-at] = new
    return sorted(chosen)


def diversify_by_pairs(interest: list[float], dist: dict[tuple[int, int], float], k: int, alpha: float = 0.5) -> list[int]:
    """Greedy 2-approximation: the best pairs of unused patterns in turn."""
    value = lambda i, j: alpha * (interest[i] + interest[j]) / 2 + (1 - alpha) * dist[i, j]
    chosen: list[int] = []
    pairs = sorted(((value(i, j), -i, -j) for i in range(len(interest)) for j in range(i + 1, len(interest))), reverse=True)
    for _, i, j in pairs:
        if len(chosen) + 2 <= k and -i not in chosen and -j not in chosen:
            chosen += [-i, -j]
    rest = sorted((i for i in range(len(interest)) if i not in chosen), key=lambda i: (-interest[i], i))
    return sorted(chosen + rest[: k - len(chosen)])


def total_coverage(patterns: list[Pattern], chosen: list[int]) -> int:
    """Distinct data nodes that any of the chosen patterns covers."""
    covers = [patterns[i].matches.select("id") for i in chosen]
    return reduce(DataFrame.unionByName, covers).distinct().count() if covers else 0


def pattern_table(g: Graph, patterns: list[Pattern], chosen: list[int]) -> DataFrame:
    rows = [(k, "; ".join(f"{a}->{b}" for a, b in patterns[i].query.edges), len(patterns[i].query.labels), float(patterns[i].interest)) for k, i in enumerate(chosen)]
    return g.spark.createDataFrame(rows, "position int, pattern string, n_nodes int, interestingness double")
