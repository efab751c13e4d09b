import random

from graphloom.operators import traversal
from graphloom.sources.graph import Graph
from test_whole_graph import bfs


def test_a_diameter_takes_few_searches(spark, monkeypatch):
    """Far nodes under eight hubs, seven searches when rims were taken by degree."""
    rng = random.Random(2)
    edges = [(100 + i, i % 2) for i in range(8)] + [(1000 + i, 100 + i % 8) for i in range(80)] + [(2000 + i, 100 + i % 8) for i in range(30)]
    edges += [(4000 + i, 1000 + rng.randrange(80)) for i in range(500)]
    edges += [(4000 + i, 3000 + rng.randrange(120)) for i in range(500) for _ in range(rng.choice((0, 1, 1, 2)))]
    edges = sorted({*edges, *[(3000 + p, 2000 + rng.randrange(30)) for p in range(120)]})
    ids, ways = sorted({v for e in edges for v in e}), edges + [(b, a) for a, b in edges]
    calls, search = [], traversal.shared_search
    monkeypatch.setattr(traversal, "shared_search", lambda *a, **k: calls.append(1) or search(*a, **k))
    g = Graph.from_rows(spark, [(i, []) for i in ids], edges)
    got = max(r.value for r in traversal.eccentricities(g.edges, g.nodes, batch=8, only_greatest=True).collect())
    assert got == max(max(bfs(ways, v).values()) for v in ids) and len(calls) <= 5


def test_diameters_of_graphs_in_pieces(spark):
    """Pieces that no first search meets, single nodes and no edges at all."""
    for n, edges in ((30, [(i, 0) for i in range(1, 9)] + [(i, i + 1) for i in range(10, 20)] + [(25, 26)]), (3, []), (0, [])):
        ways = edges + [(b, a) for a, b in edges]
        g = Graph.from_rows(spark, [(i, []) for i in range(n)], edges)
        want = max((max(bfs(ways, v).values()) for v in range(n)), default=None)
        assert traversal.diameter(g.edges, g.nodes).first()[0] == want
