import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions import similarity as fn
from graphloom.operators import indexes, matching, mining, stats, structure, traversal, workload
from graphloom.plans.query import Query
from graphloom.sources.graph import Graph


def graph(spark, n, edges, labels=None):
    return Graph.from_rows(spark, [(i, [labels[i]] if labels else [f"l{i}"]) for i in range(n)], edges)


def bfs(n, arcs, s):
    d, todo = {s: 0}, deque([s])
    while todo:
        u = todo.popleft()
        for a, b in arcs:
            if a == u and b not in d:
                d[b] = d[u] + 1
                todo.append(b)
    return d


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(8)
    return 12, [(rng.randrange(10), rng.randrange(10)) for _ in range(16)] + [(3, 3), (1, 2), (2, 1), (1, 2), (10, 11)]


def test_paths(spark, mixed):
    n, edges = mixed
    g = graph(spark, n, edges)
    ways = [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    for s in (0, 10):
        assert {(r.dst, r.d) for r in traversal.hop_distance(g.edges, s).collect()} == set(bfs(n, ways, s).items())
        assert {r.id for r in traversal.closure(g.edges, s).collect()} == set(bfs(n, edges, s))
        assert {r.id for r in traversal.closure(g.edges, s, reverse=True).collect()} == {v for v in range(n) if s in bfs(n, edges, v)}
    assert {(r.src, r.dst, r.d) for r in traversal.khop(g.edges, g.nodes.filter("id < 3"), 2).collect()} == {(s, v, d) for s in range(3) for v, d in bfs(n, edges, s).items() if d <= 2}
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(n)], "src long, dst long")
    want = {(a, b, bfs(n, edges, a)[b]) for a in range(4) for b in range(n) if bfs(n, edges, a).get(b, 9) <= 3}
    assert {tuple(r) for r in traversal.within_bound(g.edges, pairs, 3).collect()} == want
    assert traversal.diameter(g.edges, g.nodes).first()[0] == max(d for s in range(n) for d in bfs(n, ways, s).values())
    path = traversal.shortest_path(g.edges, 10, 11).first()
    assert path.path == [10, 11] and path.d == 1
    assert traversal.shortest_path(g.edges, 0, 10).count() == 0 and traversal.shortest_path(g.edges, 4, 4).first().path == [4]


def test_coloured_and_typed(spark):
    edges = [(0, 1, "r"), (1, 2, "r"), (2, 3, "b"), (3, 3, "b"), (3, 4, "b"), (1, 5, "b")]
    g = graph(spark, 6, edges)
    got = traversal.coloured_reach(g.edges, g.nodes.filter("id = 0"), [("r", 2), ("b", 2)])
    assert {r.dst for r in got.collect()} == {3, 4, 5}
    assert {(r.id, r.depth) for r in traversal.typed_bfs(g.edges, 0, "r").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_structure(spark, mixed):
    n, edges = mixed
    g = graph(spark, n, edges)
    ways = edges + [(b, a) for a, b in edges]
    assert {tuple(r) for r in structure.components(g.nodes, g.edges).collect()} == {(v, min(bfs(n, ways, v))) for v in range(n)}
    reach = {v: set(bfs(n, edges, v)) for v in range(n)}
    scc = {(v, min(w for w in reach[v] if v in reach[w])) for v in range(n)}
    found = structure.strong_components(g.nodes, g.edges)
    assert {tuple(r) for r in found.collect()} == scc
    names = dict(scc)
    assert {tuple(r) for r in structure.condensation(g.edges, found).collect()} == {(names[a], names[b]) for a, b in edges if names[a] != names[b]}
    simple = {frozenset(e) for e in edges if e[0] != e[1]}
    triangles = sum(all(frozenset(p) in simple for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(n), 3))
    assert structure.triangle_count(g.edges).first()[0] == triangles
    levels = {r.id: r.level for r in structure.topological_levels(g.nodes, structure.condensation(g.edges, found)).collect()}
    assert all(levels[names[a]] < levels[names[b]] for a, b in edges if names[a] != names[b])


def test_mean_rank(spark):
    edges = [(0, 1), (1, 2), (2, 0), (3, 2), (3, 2)]
    rank = [0.25] * 4
    for _ in range(7):
        into = [[a for a, b in set(edges) if b == v] for v in range(4)]
        raw = [0.15 / 4 + 0.85 * (sum(rank[a] for a in i) / len(i) if i else 0) for i in into]
        rank = [x / sum(raw) for x in raw]
    g = graph(spark, 4, edges)
    assert all(abs(r.value - rank[r.id]) < 1e-12 for r in structure.mean_rank(g.nodes, g.edges, 7).collect())


def test_graphs_from_graphs(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 2), (3, 4)])
    ids = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    assert structure.induced(g, ids).edges.count() == 3 and structure.without_loops(g.edges).count() == 3
    assert structure.remove_nodes(g, ids).edges.count() == 1 and structure.without_isolated(g, 2).nodes.count() == 2
    assert structure.insert_edges(g, spark.createDataFrame([(9, 0, 77, "x", {}), (10, 0, 4, "x", {})], g.edges.schema)).edges.count() == 5
    assert structure.insert_nodes(g, spark.createDataFrame([(0, ["z"], {}), (8, ["z"], {})], g.nodes.schema)).nodes.count() == 6
    assert structure.remove_edges(g, g.edges.filter("src = 3")).edges.count() == 3
    both = structure.merge(g, graph(spark, 6, [(0, 1), (4, 5)]))
    assert both.nodes.count() == 6 and both.edges.count() == 5
    assert structure.sample_nodes(g, 1.0).edges.count() == 4 and structure.sample_nodes(g, 0.0).nodes.count() == 0
    assert structure.edge_induced(g, g.edges.filter("src = 0")).nodes.count() == 2


def test_empty_graph(spark):
    g = Graph.from_rows(spark, [], [])
    assert stats.density(g).first().density == 0 and structure.components(g.nodes, g.edges).count() == 0
    assert structure.triangle_count(g.edges).first()[0] == 0 and structure.strong_components(g.nodes, g.edges).count() == 0
    assert matching.simulation(g, Query({"0": "a", "1": "b"}, (("0", "1"),))).count() == 0
    assert structure.mean_rank(g.nodes, g.edges, 2).count() == 0 and indexes.dense_ids(g.nodes).count() == 0


def test_indexes_and_statistics(spark):
    g = Graph.from_rows(spark, [(5, ["alpha", "beta"], {"k": "v"}), (7, [], {"k": "alphabet", "j": "ab"}), (9, ["alpha"])], [(5, 7, "t"), (5, 7, "t"), (7, 7, "u")])
    assert {tuple(r) for r in indexes.prefix_entries(g.nodes, 4).collect()} == {("alph", 5), ("beta", 5), ("alph", 7), ("alph", 9)}
    assert [r.id for r in indexes.nodes_with_all_keys(g.nodes, ["j", "k"]).collect()] == [7]
    deg = {r.id: (r.in_degree, r.out_degree, r.in_neighbours, r.out_neighbours) for r in indexes.degrees(g.nodes, g.edges).collect()}
    assert deg == {5: (0, 2, 0, 1), 7: (3, 1, 2, 1), 9: (0, 0, 0, 0)}
    assert {tuple(r) for r in stats.types_per_node(g).collect()} == {(5, 1, 2), (7, 2, 3)}
    assert {(r.id, r.label) for r in stats.most_frequent_label(g.nodes).collect()} == {(5, "alpha"), (9, "alpha")}
    assert {(r.id, r.dense_id) for r in indexes.dense_ids(g.nodes).collect()} == {(5, 0), (7, 1), (9, 2)}
    times = spark.createDataFrame([(1, 2, 10.0), (1, 2, 20.0), (5, 3, 7.0)], "k int, size int, ms double")
    assert {(r.k, r["2"], r["3"]) for r in stats.time_series(times, [2, 3]).collect()} == {(1, 15.0, None), (5, None, 7.0)}


def test_functions(spark):
    one = spark.createDataFrame([("abc", "ABD", ["a", "b"], ["b", "c"], [1.0, 2.0], [3.0, 4.0], [5.0, 1.0, 2.0, 9.0, 3.0])], "a string, b string, x array<string>, y array<string>, v array<double>, w array<double>, t array<double>")
    r = one.select(
        fn.lev_norm(F.col("a"), F.col("b")).alias("l"), fn.lev_norm(F.lit(""), F.lit("")).alias("e"), fn.jaccard(F.col("x"), F.col("y")).alias("j"), fn.dot(F.col("v"), F.col("w")).alias("d"),
        fn.vector_difference(F.col("v"), F.col("w")).alias("m"), fn.vector_sum(F.col("v"), F.col("w")).alias("p"), fn.scaled(F.col("v"), 2).alias("s"), fn.trimmed_mean(F.col("t")).alias("t"), fn.kth_smallest(F.col("t"), 2).alias("k"), fn.kth_smallest(F.col("t"), 9).alias("n"),
    ).first()
    assert abs(r.l - 2 / 3) < 1e-12 and r.e == 1 and abs(r.j - 1 / 3) < 1e-12 and r.d == 11 and r.m == [-2, -2] and r.p == [4, 6] and r.s == [2, 4]
    assert r.t == 2.0 == fn.trimmed_mean_of([5.0, 1.0, 2.0, 9.0, 3.0]) and r.k == 2 and r.n is None
    assert [fn.kept_of(n) for n in (2, 3, 5, 7, 9)] == [1, 2, 3, 4, 4]
    uris = spark.createDataFrame([("http://dbpedia.org/resource/Ulm",), ("https://www.example.org:80/x",), ("no uri",)], "u string")
    assert [x[0] for x in uris.select(fn.short_uri(F.col("u"))).collect()] == ["dbp_uri_Ulm", "example.org", None]


LABELS = ["a", "b", "a", "c", "b", "c"]


def test_exact_match_and_simulation(spark):
    rng = random.Random(2)
    for seed in range(3):
        edges = [(rng.randrange(6), rng.randrange(6)) for _ in range(14)]
        g = graph(spark, 6, edges, LABELS)
        query = Query({"0": "a", "1": "b", "2": "c"}, (("0", "1"), ("1", "2"), ("2", "0"))[: 2 + seed % 2])
        arcs = set(edges)
        want = {t for t in itertools.permutations(range(6), 3) if all(LABELS[x] == query.labels[q] for q, x in zip("012", t, strict=True)) and all((t[int(a)], t[int(b)]) in arcs for a, b in query.edges)}
        got = matching.exact_match(g, query)
        assert {tuple(r) for r in got.collect()} == want
        assert matching.support(got).first()[0] == min(len({t[i] for t in want}) for i in range(3))
        sim = {q: {x for x in range(6) if LABELS[x] == query.labels[q]} for q in "012"}
        while True:
            new = {u: {x for x in s if all(any((x, y) in arcs for y in sim[v]) for a, v in query.edges if a == u)} for u, s in sim.items()}
            if new == sim:
                break
            sim = new
        flat = {(q, x) for q, s in sim.items() for x in s} if all(sim.values()) else set()
        assert {tuple(r) for r in matching.simulation(g, query).collect()} == flat


def test_predicates(spark):
    g = Graph.from_rows(spark, [(0, ["x"], {"n": "5", "s": "q"}), (1, ["x"], {"n": "50"}), (2, ["x"])], [])
    keep = lambda c: [r.id for r in g.nodes.filter(matching.attribute_predicate(c)).collect()]
    assert keep([("n", ">", 7)]) == [1] and keep([("n", "<", 7), ("s", "=", "q")]) == [0]


def test_mining(spark):
    g = graph(spark, 6, [(0, 1), (2, 1), (1, 3), (4, 5)], LABELS)
    assert {tuple(r) for r in mining.edge_patterns(g, 1, 9).collect()} == {("a", "b", 2), ("b", "c", 2)}
    found = mining.mine(g, 1, 9, 0.1, levels=2)
    assert [len(p.query.edges) for p in found] == [1, 1, 2] and abs(found[2].interest - 3 * 6 / 6) < 1e-9
    interest, dist = [0.5, 0.4, 0.1], {(0, 1): 0.2, (0, 2): 1.0, (1, 2): 0.9}
    best = max(itertools.combinations(range(3), 2), key=lambda c: mining.objective(list(c), interest, dist))
    assert mining.diversify_by_swaps(interest, dist, 2) == list(best) == mining.diversify_by_pairs(interest, dist, 2)


def test_workload(spark):
    g = graph(spark, 6, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (0, 3)], ["aa", "bb", "cc", "dd", "ee", "ff"])
    made = workload.sample_queries(g, 3, 5)
    assert made and all(q.connected() and len(q.labels) == 3 for q in made)
    assert workload.label_templates(g, Query({"0": "", "1": ""}, (("0", "1"),)), stop=("aa",)).labels["0"] != "aa"
    closed = workload.close_a_star(Query({"0": "a", "1": "b", "2": "c"}, (("0", "1"), ("0", "2"))))
    assert len(closed.edges) == 3 and workload.close_a_star(Query({"0": "a", "1": "b"}, (("0", "1"),))) is None
    assert len(workload.prune([*made, Query({"0": "x"}, ())], 2)) == len(made)
    combos = workload.label_combinations(g, matching.exact_match(g, Query({"0": "aa", "1": ""}, (("0", "1"),))))
    assert {tuple(r) for r in combos.collect()} == {("aa", "bb"), ("aa", "dd")}
