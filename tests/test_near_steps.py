"""Searches that stay near their start read few steps, and few targets share one way back."""

import random

from graphloom.operators import traversal

STEPS = [("A", 2), ("B", 1)]


def edges(spark, n=150, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), rng.choice("AB")) for _ in range(3 * n)]
    return rows + rows[:20], spark.createDataFrame(rows + rows[:20], "src long, dst long, type string")


def reach(rows, source):
    here, met = {source}, set()
    for _ in range(2):
        here = {b for a, b, t in rows if t == "A" and a in here}
        met |= here
    return {b for a, b, t in rows if t == "B" and a in met}


def test_few_targets_make_no_pairs(spark, monkeypatch):
    rows, table = edges(spark)
    few = [(a, b % 40 if t == "B" else b, t) for a, b, t in rows]
    sources = spark.range(30)
    want = lambda x: sorted((s, d) for s in range(30) for d in reach(x, s))
    got = lambda t: sorted(tuple(r) for r in traversal.coloured_reach(t, sources, STEPS).collect())
    assert got(table) == want(rows)
    monkeypatch.setattr(traversal, "directed_with_loops", None)  # of pairs of sources and nodes alone
    assert got(spark.createDataFrame(few, "src long, dst long, type string")) == want(few)


def test_limited_searches_store_no_steps(spark, monkeypatch):
    rows, table = edges(spark)
    pairs = spark.range(100).selectExpr("id as src", "id % 2 as dst")
    tables = len(spark.catalog.listTables())
    bound = sorted(tuple(r) for r in traversal.within_bound(table, pairs, 3).collect())
    path = [tuple(r) for r in traversal.shortest_path(table, 1, 2, 4).collect()]
    assert len(spark.catalog.listTables()) == tables
    hops = sorted(tuple(r) for r in traversal.hop_distance(table, 5).collect())
    monkeypatch.setattr(traversal, "DIRECT_ROWS", 0)
    assert bound == sorted(tuple(r) for r in traversal.within_bound(table, pairs, 3).collect())
    assert path == [tuple(r) for r in traversal.shortest_path(table, 1, 2, 4).collect()]
    assert hops == sorted(tuple(r) for r in traversal.hop_distance(table, 5).collect())
