import random

import numpy as np

from graphloom.llm import quality as Q


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choices("abdeinorst", k=rng.randrange(2, 9))) for _ in range(rng.randrange(30, 200))]
        good = k % 5 != 0
        if good:
            text = ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        else:
            text = [" | ".join(words), (words[0] + " ") * len(words), "%% ".join(words), "!! ".join(words).upper()][k // 5 % 4]
        out.append((k, text, int(good)))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(900, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    positives = spark.createDataFrame([(k, 1) for k, _, y in rows if y and k % 2] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = Q.train(docs, positives)
    assert 0.7 < model.prior < 0.92
    new = texts(300, 2)
    odd = [(1000, None), (1001, ""), (None, "a"), (1003, "\n\n"), (1004, "word " * 60_000)]
    got = {r.doc_id: r.score for r in Q.score(spark.createDataFrame([(k, t) for k, t, _ in new] + odd, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert sum((got[k] >= 0.5) == bool(y) for k, _, y in new) >= 291
    assert all(0 <= x <= 1 for x in got.values()) and len(got) == 305


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score(docs, model, ["doc_id"]).first().score == 0.5
    assert Q.score(docs.limit(0), model, ["doc_id", "text"]).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (4000, 3))
    unlabelled = np.vstack([rng.normal(1.5, 1, (2800, 3)), rng.normal(-1.5, 1, (1200, 3))])
    assert abs(Q.estimate_prior(positive, unlabelled[rng.permutation(4000)]) - 0.7) < 0.06
