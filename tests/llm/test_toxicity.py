import random
import zlib

import numpy as np
import pytest

from graphloom.llm import registry
from graphloom.llm import toxicity as T


def recursive_segments(scores):
    """All maximal segments by definition: take the best one, then do the same on either side."""
    n = len(scores)
    best = max(((sum(scores[i:j]), i, j) for i in range(n) for j in range(i + 1, n + 1)), default=(0, 0, 0), key=lambda x: (round(x[0], 9), -(x[2] - x[1])))
    if best[0] <= 0:
        return []
    _, i, j = best
    left, right = recursive_segments(scores[:i]), recursive_segments(scores[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_segments_against_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(-0.3, 2, rng.integers(0, 14))
        assert [(s, e) for s, e, _ in T.maximal_segments(scores)] == recursive_segments(scores.tolist())


@pytest.mark.parametrize("lam,log_k", [(1.5, -2.0), (4.0, -6.0)])
def test_extreme_values_are_fitted(lam, log_k):
    """Best scores drawn by P(best <= s) = exp(-K n exp(-lambda s)); what would be below 0 is known as none."""
    rng = np.random.default_rng(3)
    tokens = rng.integers(5, 3000, 40_000)
    best = np.maximum(0, (log_k + np.log(tokens) - np.log(-np.log(rng.random(40_000)))) / lam)
    got = T.extreme_value(best, tokens)
    assert got == pytest.approx((lam, log_k), rel=0.05)
    # No worse than any value of a grid.
    def likelihood(a, k):
        some = best > 0
        return float((k + np.log(a) - a * best[some]).sum() - (np.exp(k) * tokens * np.exp(-a * np.where(some, best, 0))).sum())
    assert all(likelihood(*got) >= likelihood(got[0] * a, got[1] + k) for a in (0.8, 0.97, 1, 1.03, 1.2) for k in (-0.3, -0.02, 0, 0.02, 0.3))


def test_extreme_values_of_no_segments():
    assert T.extreme_value(np.zeros(3), np.array([5, 5, 10])) == (1.0, -np.log(20))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    common = [f"w{i}" for i in range(500)]
    out = []
    for k in range(600):
        text = rng.choices(common, k=rng.randrange(20, 200))
        toxic = k % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "Nasty", "foul"]))
        out.append((k, " ".join(text), int(toxic)))
    return out


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = docs.filter("doc_id < 400")
    model = T.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    got = T.score(docs.select("doc_id", "text"), model, ["doc_id"], spans=True).collect()
    assert all((r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in got)
    words = rows[8][1].split()
    spans = next(r.passages for r in got if r.doc_id == 8)
    assert spans and all(any(w in ("vile", "Nasty", "foul") for w in words[s.start : s.end]) for s in spans)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert len({r.score for r in T.score(docs, model, ["doc_id"]).collect()}) == 1
    assert T.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_labels_of_a_row_do_not_score_it_in_the_calibration(spark):
    """A word that marks a single toxic row is no evidence in that row's own fold, so noise gives low confidence."""
    rng = random.Random(9)
    rows = [(k, " ".join([f"only{k}"] * 3 + rng.choices([f"w{i}" for i in range(50)], k=20)), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert max(r.score for r in T.score(docs, model, ["doc_id"]).collect()) < 0.5


def test_columns_of_the_operators_own_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 0.5, 1)] * 2, "doc_id long, text string, evidence int, passages string, score double, toxic int")
    labels = docs.select("doc_id", "toxic")
    model = T.train(docs, labels)
    got = T.score(docs, model, ["evidence", "passages", "score", "text"], spans=True)
    assert got.columns == ["evidence", "passages", "score", "text", "evidence", "passages", "score"]
    assert [tuple(r)[:4] for r in got.collect()] == [(5, "x", 0.5, "a b")] * 2


def test_query_columns_and_folds(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, "xx", "s") for d, t, _ in rows] + [(None, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, x, 1) for d, _, x in rows], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.op5_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + 1
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.98 * len(held)
