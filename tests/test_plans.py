import itertools
import random

import pytest

from graphloom.plans import learned
from graphloom.plans.anytime import AnytimeEngine, State, round_robin
from graphloom.plans.query import Query, Star, decompose, format_query, isomorphic, make_plan, non_star, parse_queries, runnable, spanning_weight
from graphloom.plans.topk import Matcher
from graphloom.sources.graph import Graph


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_force(nodes, edges, query, p, theta, k):
    def sim(label, labels):
        if not any(len(x) >= p and x[:p] == label[:p] for x in labels) or len(label) < p:
            return 0.0
        return sum(max(0.0, 1 - lev(label.lower(), x.lower()) / max(len(label), len(x))) for x in labels) / len(labels)

    cands = {q: {n: s for n, labels in nodes if (s := sim(label, labels)) > theta} for q, label in query.labels.items()}
    arcs = {(e[0], e[1]) for e in edges}
    out = []
    for image in itertools.product(*(cands[q] for q in query.ids)):
        m = dict(zip(query.ids, image, strict=True))
        if len(set(image)) == len(image) and all((m[a], m[b]) in arcs for a, b in query.edges):
            out.append((round(sum(cands[q][m[q]] for q in query.ids), 6), *image))
    return [(*x[1:], x[0]) for x in sorted(out, reverse=True)[:k]]


WORDS = ["alpha one", "alpha two", "alphb", "beta x", "beta yy", "gamma", "gamme", "delta"]


def random_graph(seed, n=14, e=45):
    rng = random.Random(seed)
    nodes = [(i, rng.sample(WORDS, rng.choice([1, 1, 2]))) for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(e)]
    return nodes, edges + edges[:3]


CASES = [
    Query({"0": "alpha one"}, ()),
    Query({"0": "alpha one", "1": "beta x"}, (("0", "1"),)),
    Query({"0": "alpha one", "1": "beta x", "2": "gamma"}, (("0", "1"), ("2", "0"))),
    Query({"0": "alpha one", "1": "alpha two", "2": "gamma", "3": "beta x", "4": "gamma"}, (("0", "1"), ("1", "2"), ("2", "3"), ("3", "4"))),
    Query({"0": "alpha one", "1": "alpha two", "2": "gamma"}, (("0", "1"), ("1", "2"), ("2", "0"))),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_top_against_brute_force(spark, number):
    nodes, edges = random_graph(number)
    m = Matcher(Graph.from_rows(spark, nodes, edges), CASES[number], p=3, theta=0.2)
    got = m.top(7).orderBy("rank").collect()
    assert [tuple(r)[1:] for r in got] == brute_force(nodes, edges, CASES[number], 3, 0.2, 7)
    assert [r.rank for r in got] == list(range(1, len(got) + 1))


def test_products_are_refused(spark):
    with pytest.raises(ValueError):
        Matcher(Graph.from_rows(spark, [(1, ["alpha one"])], []), Query({"0": "alpha one", "1": "beta x"}, ()))


def test_anytime_schedules_reach_the_batch_result(spark):
    nodes, edges = random_graph(3, 16, 60)
    m = Matcher(Graph.from_rows(spark, nodes, edges), CASES[3], p=3, theta=0.2)
    want = [tuple(r) for r in m.top(4).orderBy("rank").collect()]
    engine = AnytimeEngine(m, 4)
    for choose in (round_robin(9), learned.random_schedule(5, (7, 12))):
        answers, state = engine.run(choose)
        assert [tuple(r) for r in answers.orderBy("rank").collect()] == want and state.fetched <= sum(state.sizes)
    needed = engine.needed_depths()
    goal = [max(r[i] for r in needed) for i in range(len(engine.tables))]
    answers, _ = engine.run(learned.replay_depths(goal))
    assert [tuple(r) for r in answers.orderBy("rank").collect()] == want
    table = learned.compare(engine, {"oracle": learned.replay(learned.beam_search([0] * len(goal), engine.start.sizes, needed)), "round_robin": round_robin(30)})
    assert all(r.quality == 1.0 for r in table.collect())


def test_policy_learns_and_runs(spark):
    nodes, edges = random_graph(3, 16, 60)
    m = Matcher(Graph.from_rows(spark, nodes, edges), CASES[3], p=3, theta=0.2)
    engine = AnytimeEngine(m, 3)
    static = learned.static_features(m)
    assert set(static) >= {"n_nodes", "pivots_0", "estimate_4"}
    policy, table = learned.aggregate(spark, 0, engine, static, rounds=1)
    assert table.filter("star = 0").count() >= 1
    answers, state = engine.run(policy.scheduler(), most_rounds=6)
    assert state.rounds <= 6 and answers.count() <= 3


def test_beam_and_truncation():
    needed = [[5, 1], [30, 2]]
    path = learned.beam_search([0, 0], [100, 50], needed)
    assert sorted(path) == [(0, 60), (1, 20)] or sum(a for s, a in path if s == 0) >= 30
    assert learned.truncated(path, [100, 50], needed, 0.0) == []
    assert learned.k_medoids([[0, 1, 9], [1, 0, 9], [9, 9, 0]], 2) in ([0, 0, 2], [1, 1, 2])
    assert learned.query_distance({"a": 1.0}, {"a": 4.0}, {("star", "path"): 2}, "path", "star") == 5.0
    assert State([1], [1], [0.5], [0.5]).bound() == float("-inf")


def test_decomposition_covers_every_edge_once():
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.randrange(2, 7)
        q = Query({str(i): "x" for i in range(n)}, tuple((str(a), str(b)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6))
        stars = decompose(q, {str(i): rng.randrange(20) for i in range(n)})
        assert sorted(e for s in stars for e in s.edges) == sorted(q.edges)
        assert {x for s in stars for x in s.nodes} == set(q.ids)
        assert all(s.pivot in e for s in stars for e in s.edges)
        assert len(make_plan(q, stars).stars) == len(stars)


def test_query_text_round_trip_and_helpers():
    text = "3\nqueryIndex:7\n0;Customer#000000012;\n1;1-URGENT;other;\n2;small widget;\n0;\n1;0;2;\n2;\n"
    (q,) = parse_queries(text)
    assert q.labels == {"0": "Customer#000000012", "1": "1-URGENT", "2": "small widget"} and q.edges == (("1", "0"), ("1", "2")) and q.index == 7
    assert parse_queries(format_query(q) * 2) == [q, q]
    with pytest.raises(ValueError):
        parse_queries("2\n0;a;\n")
    assert Query({"0": "a", "1": "b"}, (("0", "1"), ("1", "0"))).edges == (("0", "1"),)
    assert isomorphic(Query({"a": "x", "b": "y"}, (("a", "b"),)), Query({"1": "y", "2": "x"}, (("2", "1"),)))
    assert not isomorphic(Query({"a": "x", "b": "y"}, (("a", "b"),)), Query({"1": "y", "2": "x"}, (("1", "2"),)))
    assert spanning_weight(CASES[4], {("0", "1"): 5, ("1", "2"): 1, ("2", "0"): 2}) == 3
    assert non_star(CASES[3]) and not non_star(CASES[2]) and runnable(q, 4) and not runnable(q, 9)
    assert Star("0", (("1", "0"),)).leaves == ["1"]
