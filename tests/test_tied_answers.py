"""Where all answers tie, the greatest candidates of the first query node are answered, not the whole graph's."""

import itertools
import random

import pytest

from graphloom.operators.indexes import degrees, neighbours_to_two
from graphloom.plans import topk
from graphloom.plans.query import Query
from graphloom.plans.topk import Matcher
from graphloom.sources.graph import Graph

SHAPE = Query({"0": "", "1": "", "2": "", "3": ""}, (("0", "1"), ("1", "2"), ("3", "2")))
RING = Query({"0": "", "1": "", "2": ""}, (("0", "1"), ("2", "1"), ("2", "0")))


def brute(query, nodes, edges, k):
    arcs, ids = set(edges), query.ids
    after = {a: {b for x, b in arcs if x == a} for a in nodes}
    before = {b: {a for a, x in arcs if x == b} for b in nodes}
    need = {q: (sum(e[1] == q for e in query.edges), sum(e[0] == q for e in query.edges)) for q in ids}
    fits = {q: [v for v in nodes if len(before[v]) >= i and len(after[v]) >= o] for q, (i, o) in need.items()}
    found = [m for m in itertools.product(*fits.values()) if len({*m}) == len(ids) and all((m[ids.index(a)], m[ids.index(b)]) in arcs for a, b in query.edges)]
    return [(n + 1, *m, float(len(ids))) for n, m in enumerate(sorted(found, reverse=True)[:k])]


@pytest.mark.parametrize(("query", "k", "n_edges"), [(SHAPE, 7, 60), (RING, 5, 60), (SHAPE, 9, 14), (RING, 500, 50)])
def test_blocks_of_heads_give_the_best_answers(spark, monkeypatch, query, k, n_edges):
    for name, value in (("FIRST_HEADS", 1), ("MORE_HEADS", 2), ("LEADING_ROWS", 2)):
        monkeypatch.setattr(topk, name, value)
    draw = random.Random(k)
    nodes = [3 * v for v in range(16)]
    edges = [tuple(draw.choices(nodes, k=2)) for _ in range(n_edges)]
    g = Graph.from_rows(spark, [(v, []) for v in nodes], edges)
    assert [tuple(r) for r in Matcher(g, query, structural=True).top(k).orderBy("rank").collect()] == brute(query, nodes, edges, k)


def test_labels_that_tie(spark, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_HEADS", 3)
    query = Query({"0": "alpha", "1": "beta", "2": "gamma"}, (("0", "1"), ("2", "1")))
    nodes = [(v, ["alpha" if v % 3 == 0 else "beta" if v % 3 == 1 else "gamma"]) for v in range(30)]
    edges = [(v, w) for v in range(30) for w in range(1, 30, 3) if v % 3 != 1 and v % 5 == w % 5]
    want = sorted(((a, b, c) for a, b in edges for c, d in edges if b == d and a % 3 == 0 and c % 3 == 2), reverse=True)[:8]
    got = Matcher(Graph.from_rows(spark, nodes, edges), query, 4, 0.3).top(8).orderBy("rank").collect()
    assert len(want) == 8 and [tuple(r)[1:4] for r in got] == want


def test_only_pairs_near_the_heads_are_made(spark, monkeypatch):
    """2,000 orders of 20 customers of one nation: 40,000 answers, of which those of the greatest hundred orders decide."""
    made = []
    plain = topk.bucketed
    monkeypatch.setattr(topk, "bucketed", lambda df, *keys, **more: made.append(plain(df, *keys, **more)) or made[-1])
    edges = [(1000 + n, 100 + n % 20) for n in range(2000)] + [(100 + c, 1) for c in range(20)]
    g = Graph.from_rows(spark, [(v, []) for v in {x for e in edges for x in e}], edges)
    got = Matcher(g, SHAPE, structural=True).top(15).orderBy("rank").collect()
    want = sorted(((a, b, 1, c) for a, b in edges[-120:-20] for c in range(100, 120) if c != b), reverse=True)[:15]
    assert [tuple(r)[1:5] for r in got] == want
    assert sum(t.count() for t in made) < 500


def test_neighbours_to_two(spark):
    edges = [(1, 2), (1, 2), (1, 3), (1, 4), (2, 2), (4, 3), (9, 3)]
    g = Graph.from_rows(spark, [(v, []) for v in (1, 2, 3, 4, 5)], edges)
    want = {(r.id, min(r.in_neighbours, 2), min(r.out_neighbours, 2)) for r in degrees(g.nodes, g.edges).collect()}
    assert {tuple(r) for r in neighbours_to_two(g.nodes, g.edges).collect()} == want
