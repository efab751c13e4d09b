"""The stored prefix index, the threshold search and hub labels."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from test_plans import CASES, brute_force, random_graph

from graphloom.operators import hublabels, traversal
from graphloom.operators.indexes import PrefixIndex
from graphloom.operators.iterate import shared_dir
from graphloom.plans import threshold
from graphloom.plans.threshold import ThresholdSearch
from graphloom.plans.topk import Matcher, candidates
from graphloom.sources.graph import Graph


def scanned(df):
    """Directories and rows that the file scans of a plan that has run report."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, out = plan.collectLeaves(), []
    for k in range(leaves.size()):
        metrics = leaves.apply(k).metrics()
        if metrics.contains("numPartitions"):
            out.append((metrics.apply("numPartitions").value(), metrics.apply("numOutputRows").value()))
    return out


def test_only_the_query_s_directories_are_read(spark):
    nodes = [(i, [f"w{i % 40:03d} of things", f"x{i}"]) for i in range(800)] + [(900, []), (901, ["w0"]), (902, ["w005 a", "w005 b"])]
    nodes = [(*n, {"a": "w003 prop"} if n[0] == 900 else {}) for n in nodes]
    g = Graph.from_rows(spark, nodes, [(1, 2)])
    index = PrefixIndex.build(g.nodes, 4, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 16)
    assert index.entries.select("directory").distinct().count() > 10
    assert scanned(index.lookup("w005")) == [(1, 21)] or scanned(index.lookup("w005"))[0][0] == 1
    assert sorted(r.id for r in index.lookup("w003").collect()) == sorted([i for i in range(800) if i % 40 == 3] + [900])
    assert index.lookup("none").count() == 0 and index.lookup("w005").filter("id = 902").count() == 1
    query = CASES[1].__class__({"0": "w005 of things", "1": "w011 of things", "2": "w0"}, (("0", "1"), ("1", "2")))
    both = [sorted(tuple(r) for r in candidates(g, query, 4, 0.2, index=i).collect()) for i in (None, index)]
    assert both[0] == both[1] and both[0]
    read = scanned(candidates(g, query, 4, 0.2, index=index))
    assert 1 <= len(read) <= 2 and all(n == 1 for n, _ in read)
    with pytest.raises(ValueError):
        candidates(g, query, 3, 0.2, index=PrefixIndex(spark, index.entries.inputFiles()[0].split("/entries")[0]))


@pytest.mark.parametrize("number,block", [(0, 2), (3, 2), (4, 256)])
def test_threshold_search_against_brute_force(spark, monkeypatch, number, block):
    monkeypatch.setattr(threshold, "FIRST_BLOCK", block)
    nodes, edges = random_graph(number)
    got, seen = ThresholdSearch(Matcher(Graph.from_rows(spark, nodes, edges), CASES[number], p=3, theta=0.2)).top(4)
    assert [tuple(r)[1:] for r in got.orderBy("rank").collect()] == brute_force(nodes, edges, CASES[number], 3, 0.2, 4)
    assert all(seen.read[q] <= n for q, n in seen.sizes.items())


def test_threshold_ends_the_search_early(spark, monkeypatch):
    monkeypatch.setattr(threshold, "FIRST_BLOCK", 8)
    rng = random.Random(2)
    word = lambda s, k: s + "".join(rng.choices("xyz", k=k))
    nodes = [(0, ["alpha one"]), (1, ["beta one"])] + [(i, [word("alpha ", 9) if i % 2 else word("beta ", 9)]) for i in range(2, 600)]
    edges = [(0, 1)] + [(rng.randrange(600), rng.randrange(600)) for _ in range(3000)]
    query = CASES[1].__class__({"0": "alpha one", "1": "beta one"}, (("0", "1"),))
    m = Matcher(Graph.from_rows(spark, nodes, edges), query, p=3, theta=0.0)
    got, seen = ThresholdSearch(m).top(1)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1, 2.0)] == [tuple(r) for r in m.top(1).collect()]
    assert seen.rounds == 1 and all(seen.read[q] == 8 < seen.sizes[q] for q in ("0", "1"))


@pytest.mark.parametrize("n,e,first,growth", [(40, 60, 2, 3), (12, 40, 16, 4)])
def test_labels_give_all_distances(spark, n, e, first, growth):
    rng = random.Random(n + e)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(e)] + [(100 + i, 101 + i) for i in range(6)] + [(7, 7), (100, 101)]
    g = Graph.from_rows(spark, [(i, ["x"]) for i in [*range(n), *range(100, 107), 200]], edges)
    labels = hublabels.hub_labels(g.edges, first, growth).cache()
    want = {(r.src, r.dst): r.d for r in traversal.distances(traversal.undirected(g.edges), g.nodes.select("id"), symmetric=True).collect()}
    got = hublabels.label_distances(labels, g.nodes, g.nodes).collect()
    assert {(r.src, r.dst): r.d for r in got} == want and len(got) == len(want) and (200, 200) in want
    assert labels.groupBy("id", "hub").count().filter("count > 1").isEmpty()
    linked = labels.select("id").distinct().count()
    assert labels.count() < linked * linked * 0.7 or first > 10


def test_labels_of_no_edges(spark):
    g = Graph.from_rows(spark, [(1, ["x"])], [(1, 1)])
    assert hublabels.hub_labels(g.edges).count() == 0
    assert [tuple(r) for r in hublabels.label_distances(hublabels.hub_labels(g.edges.filter(F.lit(False))), g.nodes, g.nodes).collect()] == [(1, 1, 0)]
