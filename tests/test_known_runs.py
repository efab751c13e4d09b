import random

import numpy as np
from graphloom import queries
from graphloom.plans import learned
from graphloom.plans.anytime import AnytimeEngine, KnownEngine, _undominated, round_robin
from graphloom.plans.query import Query, Star, make_plan
from graphloom.plans.topk import Matcher
from graphloom.sources.graph import Graph

QUERY = Query({"0": "order red", "1": "client one", "2": "part small", "3": "maker one", "4": "land one"}, (("0", "1"), ("0", "2"), ("2", "3"), ("3", "4")))
STARS = [Star("0", (("0", "1"), ("0", "2"))), Star("3", (("2", "3"), ("3", "4")))]


def engine(spark, k=4):
    rng = random.Random(8)
    kinds = {"order": ["red", "blue", "red one"], "client": ["one", "two", "one two"], "part": ["small", "large"], "maker": ["one", "two", "on"], "land": ["one", "two"]}
    nodes = [(100 * i + j, [f"{kind} {rng.choice(names)}"]) for i, (kind, names) in enumerate(kinds.items()) for j in range(12)]
    edges = [(100 * a + j, 100 * b + rng.randrange(12)) for a, b in ((0, 1), (0, 2), (2, 3), (3, 4)) for j in range(12) for _ in range(2)]
    m = Matcher(Graph.from_rows(spark, nodes, edges), QUERY, 3, 0.3)
    m.plan = make_plan(QUERY, STARS)
    return AnytimeEngine(m, k)


def test_known_runs_equal_runs_that_read_the_stars(spark):
    plain = engine(spark)
    needed = plain.needed_depths()
    known = plain.known(needed)
    assert isinstance(known, KnownEngine)
    for schedule in (lambda: round_robin(7), lambda: learned.random_schedule(3, (1, 5, 9)), lambda: learned.replay([(1, 3), (0, 4), (1, 30)])):
        choose, states = schedule(), {}
        for name, e in (("plain", plain), ("known", known)):
            choose = schedule()
            answers, s = e.run(choose)
            seen = []
            while s is not None:
                seen.append((s.depth, s.sizes, s.first, s.last, s.answers, s.kth, s.rounds, s.fetched, s.previous, s.log, s.bounds, s.least, s.values))
                s = s.parent
            states[name] = [tuple(r) for r in answers.orderBy("rank").collect()], seen
        assert states["plain"] == states["known"] and states["plain"][0]


def test_kept_answers_give_the_best_at_all_depths():
    rng = np.random.default_rng(4)
    ranks = rng.integers(1, 30, (400, 2))
    halves = [_undominated(x, np.empty((0, 2), np.int64), 3)[0] for x in (ranks[::2], ranks[1::2])]
    kept = sorted([2 * i for i in halves[0]] + [2 * i + 1 for i in halves[1]])
    kept = [kept[i] for i in _undominated(ranks[kept], np.empty((0, 2), np.int64), 3)[0]]
    for a in range(30):
        for b in range(30):
            assert [i for i in kept if (ranks[i] <= (a, b)).all()][:3] == [i for i in range(400) if (ranks[i] <= (a, b)).all()][:3]


def test_schedules_are_compared_without_a_job_for_each_round(spark, monkeypatch):
    calls = []
    plain = AnytimeEngine.fetch
    monkeypatch.setattr(AnytimeEngine, "fetch", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows = queries.schedule_comparison(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.rounds for r in rows) and not calls


def test_predictions_of_one_row_are_those_of_a_table(spark):
    rng = random.Random(2)
    rows = [(0, rng.random(), 0.0, rng.random() * 9, float(i % 3), float(i % 7)) for i in range(40)]
    table = spark.createDataFrame(rows, "query int, a double, b double, c double, star double, amount double")
    for kind in ("forest", "tree", "regression_tree", "boosted_regression", "boosted"):
        model = learned.fit_model(table, kind)
        got = [r.prediction for r in model.transform(table).select("prediction").collect()]
        assert [model.predict(spark, {"a": r[1], "b": r[2], "c": r[3]}) for r in rows[:6]] == got[:6], kind
