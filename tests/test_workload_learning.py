"""Beams of many queries as rows, boosted policies, and similarities kept from query to query."""

import random

import pytest
from test_plans import CASES, random_graph

from graphloom.plans import boosting, learned
from graphloom.plans.anytime import AnytimeEngine
from graphloom.plans.query import Query
from graphloom.plans.topk import Matcher, SimilarityMemo, candidates
from graphloom.sources.graph import Graph


@pytest.mark.parametrize("beam", [1, 3])
def test_beams_of_many_queries_are_those_of_the_list(spark, beam):
    rng = random.Random(beam)
    tasks = []
    for q in range(12):
        n = rng.randrange(1, 4)
        sizes = [rng.randrange(1, 300) for _ in range(n)]
        needed = [[rng.randrange(s + 1) for s in sizes] for _ in range(rng.randrange(5))]
        tasks.append((q, [rng.randrange(1 + s // 2) for s in sizes], sizes, needed))
    table = spark.createDataFrame(tasks, "query int, depth array<int>, sizes array<int>, needed array<array<int>>")
    got = {}
    for r in learned.beam_search_all(table, beam).orderBy("query", "step").collect():
        got.setdefault(r.query, []).append((r.star, r.amount))
    want = {q: learned.beam_search(d, s, n, beam) for q, d, s, n in tasks}
    assert got == {q: p for q, p in want.items() if p} and len(got) > 5
    assert learned.beam_search_all(table.limit(0)).count() == 0


def test_boosted_policies(spark):
    nodes, edges = random_graph(3, 16, 60)
    engine = AnytimeEngine(Matcher(Graph.from_rows(spark, nodes, edges), CASES[2], p=3, theta=0.2), 3)
    static = learned.static_features(engine.m)
    for variant, trees in (("continued", 2), ("scratch", 1)):
        policy, table = learned.boost(spark, [(0, engine, static)], variant, rounds=1, trees=1)
        assert len(policy.selection.fitted.rounds) == trees and table.filter("star = 0").count() >= 1
        losses = policy.selection.fitted.losses
        assert losses[-1] < losses[0] and len(boosting.VARIANTS) == 3
        answers, state = engine.run(policy.scheduler(), most_rounds=4)
        assert state.rounds <= 4 and answers.count() <= 3
    state = engine.start
    off = learned.examples(0, engine, static, engine.needed_depths(), lambda s: (0, 25), only_mistakes=True, tolerance=1000)
    assert all(x.star != 1 for x in off) and state.rounds == 0


def test_a_second_query_of_a_label_computes_no_distance(spark):
    nodes, edges = random_graph(5, 30, 60)
    g = Graph.from_rows(spark, [*nodes, (99, [], {"a": "alpha prop", "b": "zz"})], edges)
    memo = SimilarityMemo()
    one = Query({"0": "alpha one", "1": "beta x"}, (("0", "1"),))
    plain = lambda q: sorted(tuple(r) for r in candidates(g, q, 3, 0.2).collect())
    assert sorted(tuple(r) for r in candidates(g, one, 3, 0.2, memo=memo).collect()) == plain(one) != []
    first = memo.computed
    assert 0 < first <= 2 * 10
    two = Query({"0": "beta x", "1": "alpha one", "2": "alpha one"}, (("0", "1"), ("1", "2")))
    assert sorted(tuple(r) for r in Matcher(g, two, 3, 0.2, memo=memo).cands.collect()) == plain(two)
    assert memo.computed == first
    three = Query({"0": "alpha two"}, ())
    assert sorted(tuple(r) for r in candidates(g, three, 3, 0.2, memo=memo).collect()) == plain(three) and memo.computed > first
    memo.close()
    assert not memo.known
