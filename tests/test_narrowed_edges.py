"""Matching, labelling, triangles and components look at the edges that can count, and give what brute force gives."""

import random
from itertools import combinations

from graphloom.operators import iterate, matching, structure, workload
from graphloom.plans.query import Query
from graphloom.sources.graph import Graph

CHAIN = Query({"0": "a", "1": "b", "2": ""}, (("0", "1"), ("1", "2")))


def graph(spark, n=60, seed=5):
    rng = random.Random(seed)
    labels = {k: ["a", "x"] if k < 20 else ["b", f"name{k}"] if k < 40 else ["c"] for k in range(n)}
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(5 * n)]
    return labels, edges, Graph.from_rows(spark, list(labels.items()), edges + edges[:9])


def test_edges_outside_the_sets_reach_no_shuffle(spark):
    _, _, g = graph(spark)
    arcs = matching.candidate_arcs(g, CHAIN, {q: s for q, s in matching.node_sets(g, CHAIN).items() if q != "2"})
    assert all(r.src < 20 <= r.dst < 40 for r in arcs["0", "1"].collect())
    assert all(20 <= r.src < 40 for r in arcs["1", "2"].collect())


def test_matches_and_their_labels(spark):
    labels, edges, g = graph(spark)
    arcs = set(edges)
    want = {(a, b, c) for a, b in arcs for b2, c in arcs if b == b2 and "a" in labels[a] and "b" in labels[b] and len({a, b, c}) == 3}
    found = matching.exact_match(g, CHAIN)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    combos = {(x, y, z) for a, b, c in want for x in labels[a] for y in labels[b] for z in labels[c] if len({x, y, z}) == 3}
    assert sorted(map(tuple, workload.label_combinations(g, found).collect())) == sorted(combos)
    assert workload.label_combinations(g, found.limit(0)).count() == 0


def test_triangles(spark):
    _, edges, g = graph(spark)
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    want = sum(frozenset((a, b)) in pairs and frozenset((b, c)) in pairs and frozenset((a, c)) in pairs for a, b, c in combinations(range(60), 3))
    assert want and structure.triangle_count(g.edges).first().n_triangles == want
    far = g.edges.selectExpr("src * 100000000000000000 - 3000000000000000000 as src", "dst * 100000000000000000 - 3000000000000000000 as dst")
    assert structure.triangle_count(far).first().n_triangles == want
    assert structure.triangle_count(g.edges.limit(0)).first().n_triangles == 0


def test_nodes_off_every_cycle_are_never_coloured(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(30)] + [(10, 8), (40, 41), (41, 40)]
    nodes = spark.createDataFrame([(k,) for k in [*range(31), 40, 41, 50]], "id long")
    tables = []
    monkeypatch.setattr(structure, "written", lambda df: tables.append(iterate.written(df)) or tables[-1])
    found = {r.id: r.component for r in structure.strong_components(nodes, spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert found == {**{k: k for k in [*range(31), 50]}, 9: 8, 10: 8, 40: 40, 41: 40}
    assert max(t.count() for t in tables if "colour" in t.columns) == 5
