"""Ranked enumeration of stars, and joins that meet every pair of rows once."""

import random

import pytest
from pyspark.sql import functions as F
from test_plans import CASES, brute_force, random_graph

from graphloom.plans import anytime, enumeration
from graphloom.plans.anytime import AnytimeEngine, round_robin
from graphloom.plans.enumeration import RankedStar, StarTable
from graphloom.plans.query import Query, Star, make_plan
from graphloom.plans.topk import Matcher
from graphloom.sources.graph import Graph

FAN = Query({"0": "hub", "1": "leaf aa", "2": "leaf aa", "3": "leaf bb"}, (("0", "1"), ("0", "2"), ("3", "0")))


def fan(spark, leaves, hubs=1, seed=0):
    rng = random.Random(seed)
    nodes = [(h, ["hub"]) for h in range(hubs)] + [(100 + i, ["leaf " + "".join(rng.choices("ab", k=rng.randrange(1, 9)))]) for i in range(leaves)]
    edges = [(h, 100 + i) for h in range(hubs) for i in range(leaves)] + [(100 + i, h) for h in range(hubs) for i in range(leaves)]
    return Graph.from_rows(spark, nodes, edges)


def rows_of(df, star, n):
    names = [f"q{q}" for q in star.nodes]
    got = [(round(r["share"], 9), *[r[c] for c in names]) for r in df.collect()]
    return sorted(got, reverse=True)[:n]


@pytest.mark.parametrize("leaves,hubs,most", [(7, 1, 60), (9, 4, 3), (5, 9, 300)])
def test_the_best_matches_of_a_star(spark, leaves, hubs, most):
    m = Matcher(fan(spark, leaves, hubs, leaves + most), FAN, p=3, theta=0.1)
    star = Star("0", FAN.edges)
    m.plan = make_plan(FAN, [star])
    every = m.star(star).withColumn("share", m.share(star))
    assert rows_of(RankedStar(m, star).best(most), star, most) == rows_of(every, star, most)


def test_three_leaves_of_a_thousand_without_a_product(spark):
    m = Matcher(fan(spark, 1000, seed=5), FAN, p=3, theta=0.1)
    star = Star("0", FAN.edges)
    m.plan = make_plan(FAN, [star])
    table = StarTable(m, star, [])
    assert table.size > 10**8 and not table.exact and table.built == enumeration.FIRST_BLOCK
    found = RankedStar(m, star).best(10)
    assert found.count() < 2000
    # All sums of the three best lists, by hand: leaf lists of 30 hold the best ten.
    lists = [sorted(((r[f"s{q}"], r[f"q{q}"]) for r in f.collect()), reverse=True)[:30] for q, f in m.leaf_matches(star)]
    own = m.cands.filter("qid = '0'").first()
    want = sorted(((round(own.sim + a[0] + b[0] + c[0], 9), own.id, a[1], b[1], c[1]) for a in lists[0] for b in lists[1] for c in lists[2] if len({a[1], b[1], c[1]}) == 3), reverse=True)[:10]
    assert rows_of(found, star, 10) == want
    assert rows_of(table.slice(0, 10), star, 10) == want and [r["rank"] for r in table.slice(3, 7).orderBy("rank").collect()] == [4, 5, 6, 7]


def test_blocks_of_a_table_are_those_of_the_whole_ranking(spark, monkeypatch):
    monkeypatch.setattr(enumeration, "FIRST_BLOCK", 16)
    m = Matcher(fan(spark, 8, 2, 3), FAN, p=3, theta=0.1)
    star = Star("0", FAN.edges)
    m.plan = make_plan(FAN, [star])
    every = rows_of(m.star(star).withColumn("share", m.share(star)), star, 10**6)
    table = StarTable(m, star, ["1"])
    for high in (5, 40, 41, len(every) + 9):
        got = table.slice(0, high)
        assert rows_of(got, star, high) == every[:high] and sorted(r["rank"] for r in got.collect()) == list(range(1, min(high, len(every)) + 1))
    assert table.exact and table.size == len(every) and len(table.blocks) > 3
    assert rows_of(table.slice(0, 60, [1, 2]), star, 60) == rows_of(table.slice(0, 60).filter("bucket in (1, 2)"), star, 60)


def plain_pairs(engine, depth):
    """Pairs of fetched rows by plain joins of all that was fetched."""
    plan, out, rows = engine.m.plan, [0], None
    rows = engine.slice(0, 0, depth[0]).drop("rank", "share", "bucket")
    for i in range(1, len(plan.stars)):
        part = engine.slice(i, 0, depth[i]).drop("rank", "share", "bucket", *[f"s{q}" for q in plan.shared[i]])
        rows = rows.join(part, [f"q{q}" for q in plan.shared[i]])
        out.append(rows.count())
        rows = rows.filter(engine.m.distinct(engine.covered(list(range(i + 1)))[0]))
    return out, rows.count()


@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_every_pair_of_rows_meets_once(spark, monkeypatch, seed, partial):
    monkeypatch.setattr(anytime, "PIECES", 2)
    monkeypatch.setattr(enumeration, "FIRST_BLOCK", 8)
    nodes, edges = random_graph(seed, 16, 60)
    m = Matcher(Graph.from_rows(spark, nodes, edges), CASES[3], p=3, theta=0.2)
    m.plan = make_plan(CASES[3], [Star("1", (("0", "1"), ("1", "2"))), Star("3", (("2", "3"),)), Star("4", (("3", "4"),))][::-1])
    assert len(m.plan.stars) == 3
    engine = AnytimeEngine(m, 5)
    answers, state = engine.run(round_robin(7), partial=partial)
    pairs, whole = plain_pairs(engine, state.depth)
    assert state.pairs == pairs and state.joined[2] == whole
    assert state.fetched == sum(state.depth) and state.fetch_seconds > 0 and state.join_seconds > 0
    if partial:
        want = [tuple(r) for r in m.top_anytime(5).orderBy("rank").select(*answers.columns).collect()]
        assert [tuple(r) for r in answers.orderBy("rank").collect()] == want
    else:
        assert [tuple(r)[1:] for r in answers.orderBy("rank").collect()] == brute_force(nodes, edges, CASES[3], 3, 0.2, 5)


def test_a_state_can_go_on_in_two_ways(spark):
    nodes, edges = random_graph(3, 16, 60)
    m = Matcher(Graph.from_rows(spark, nodes, edges), CASES[3], p=3, theta=0.2)
    engine = AnytimeEngine(m, 4)
    state, held = engine.fetch(engine.start, 0, 20, None)
    one, _ = engine.fetch(state, 1, 10, held)
    two, _ = engine.fetch(state, 1, 25, held)
    assert engine.start.depth[0] == 0 and state.depth[1] == 0 and one.parent.depth == state.depth
    assert one.pairs == plain_pairs(engine, one.depth)[0] and two.pairs == plain_pairs(engine, two.depth)[0]
    m.close()
    assert not m.cands.is_cached or m.cands.storageLevel.useMemory is False


def test_no_candidates(spark):
    m = Matcher(Graph.from_rows(spark, [(1, ["alpha one"]), (2, ["zzzz"])], [(1, 2)]), CASES[1], p=3, theta=0.2)
    answers, state = AnytimeEngine(m, 3).run(round_robin(5))
    assert answers.count() == 0 and state.rounds == 0
    assert AnytimeEngine(m, 3).start.sizes == [0]
    assert m.star(m.plan.stars[0]).agg(F.count(F.lit(1))).first()[0] == 0
