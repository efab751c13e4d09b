"""What a query asks of the graph's edges is read from stored pairs of candidates, not from the graph again."""

from graphloom.plans.anytime import AnytimeEngine, round_robin
from graphloom.plans.query import Query
from graphloom.plans.threshold import ThresholdSearch
from graphloom.plans.topk import Matcher
from graphloom.sources.graph import Graph

QUERY = Query({"0": "alpha", "1": "beta", "2": "gamma"}, (("0", "1"), ("0", "2")))


def graph(spark, path):
    nodes = [(k, ["alpha" if k < 20 else "beta" if k < 40 else "gamma"]) for k in range(60)]
    edges = [(a, b) for a in range(20) for b in (20 + a % 20, 20 + (a * 7) % 20, 40 + a % 20, 40 + (a * 3) % 20)] + [(20, 40), (3, 23)]
    Graph.from_rows(spark, nodes, edges).write(path)
    return Graph.read(spark, path)


def test_edges_are_read_once_for_each_query_edge(spark, tmp_path):
    m = Matcher(graph(spark, str(tmp_path / "g")), QUERY, 4, 0.3)
    edges = f"{tmp_path}/g/edges"
    for star in m.plan.stars:
        for rows in [m.star(star), m.star_statistics(star), *[found for _, found in m.leaf_matches(star)]]:
            assert not [f for f in rows.inputFiles() if edges in f]


def test_all_ways_give_the_batch_answers(spark, tmp_path):
    g = graph(spark, str(tmp_path / "g"))
    best = [tuple(r) for r in Matcher(g, QUERY, 4, 0.3).top(7).orderBy("rank").collect()]
    assert len(best) == 7 and all(len({*r[1:4]}) == 3 for r in best)
    for found in (AnytimeEngine(Matcher(g, QUERY, 4, 0.3), 7).run(round_robin(5))[0], ThresholdSearch(Matcher(g, QUERY, 4, 0.3)).top(7)[0]):
        assert [tuple(r) for r in found.orderBy("rank").collect()] == best


def test_no_candidates_no_answers(spark, tmp_path):
    m = Matcher(graph(spark, str(tmp_path / "g")), Query({"0": "alpha", "1": "nowhere"}, (("0", "1"),)), 4, 0.3)
    assert m.top(3).count() == 0
