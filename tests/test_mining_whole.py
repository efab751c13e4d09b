import random

from graphloom import queries
from graphloom.operators import matching, mining
from graphloom.sources.graph import Graph


def interest(nodes, arcs, edges):
    """Labels times covered share under the largest simulation, by plain code."""
    labels = {x for e in edges for x in e}
    sim = {q: {v for v, own in nodes.items() if own == q} for q in labels}
    while True:
        new = {u: {v for v in s if all(any((v, w) in arcs for w in sim[b]) for a, b in edges if a == u)} for u, s in sim.items()}
        if new == sim:
            return len(labels) * sum(map(len, sim.values())) / len(nodes) if all(sim.values()) else 0
        sim = new


def level_wise(nodes, arcs, theta):
    seeds = {frozenset({(nodes[a], nodes[b])}) for a, b in arcs if nodes[a] != nodes[b]}
    level = {p for p in seeds if interest(nodes, arcs, p) >= theta}
    found, known = set(level), set(seeds)
    for _ in range(9):
        pairs = {a | b for a in level for b in level if {x for e in a for x in e} & {x for e in b for x in e} and len(a | b) > max(len(a), len(b))} - known
        pairs = {p for p in pairs if len({x for e in p for x in e}) <= 10}
        known |= pairs
        level = {p for p in pairs if interest(nodes, arcs, p) >= theta}
        found |= level
    return found


def test_every_pattern_is_mined(spark, monkeypatch):
    """Six edge patterns, the rarest of which counts too, and patterns of more than two seeds."""
    rng = random.Random(3)
    nodes = dict(enumerate("aaabbbcccddde"))
    arcs = {(a, b) for a in range(13) for b in range(13) if (nodes[a] + nodes[b]) in ("ab", "ac", "ad", "bc", "cd") and rng.random() < 0.6} | {(12, 0)}
    g = Graph.from_rows(spark, [(i, [x]) for i, x in nodes.items()], sorted(arcs))
    got = mining.mine(g, 1, 99, 0.3)
    want = level_wise(nodes, arcs, 0.3)
    assert len(got) == len(want) and {frozenset(p.query.edges) for p in got} == want
    assert frozenset({("e", "a")}) in want and max(map(len, want)) > 2
    for p in got[:: max(1, len(got) // 4)]:
        assert abs(p.interest - interest(nodes, arcs, p.query.edges)) < 1e-8
        assert {tuple(r) for r in p.matches.collect()} == {tuple(r) for r in matching.simulation(g, p.query).collect()}
    few = got[:2] + got[-2:]
    assert mining.distances(few) == {(i, j): mining.distance(few[i], few[j]) for i in range(4) for j in range(i + 1, 4)}
    called = []
    monkeypatch.setattr(queries.mining, "mine", lambda *a, **b: called.append(b) or [])
    monkeypatch.setattr(queries, "large", lambda *a: g)
    assert queries.QUERIES["diversified_patterns"](spark, "").count() == 0 and called == [{}]


def test_no_patterns(spark):
    g = Graph.from_rows(spark, [(0, ["a"]), (1, ["a"])], [(0, 1)])
    assert mining.mine(g, 1, 9, 0.1) == [] and mining.distances([]) == {}
