"""Toxic passages as maximum-scoring segments of token log-odds.

Each token (a hashed word) has the log-odds of its document frequencies in
toxic and other training texts under a Dirichlet prior, shrunk by its standard
error; a constant drift makes the expected score of ordinary text negative.
The linear-time all-maximal-segments scan finds every toxic passage of a text.
Extreme-value statistics turn a segment's score S in a text of n tokens into
nats of evidence, lambda * S - ln(K * n), where lambda and K are fitted to the
best segments of other texts by maximum likelihood; the positive evidence of a
text's segments adds up, and a logistic fit maps the sum to a probability.  Both
fits use a bounded sample of labelled rows, and cross-fitting: a row of one fold
is scored by log-odds that the other folds' labels give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, materialise, slices, text_or_empty
from .textbuf import ALNUM, Words, words

#: Hashed tokens: the model's size whatever the corpus.
BUCKETS = 1 << 18
#: Prior pseudo-documents per token: a part in proportion to its frequency, and the same for all.
PRIOR_MASS, PRIOR_FLAT = 50.0, 0.5
#: Standard errors by which a log-odds is drawn to 0, and what every token loses.
SHRINK, DRIFT = 2.0, 0.5
#: Labelled rows in the sample to which the logistic calibration is fitted.
SAMPLE_ROWS = 20_000
#: Folds of the cross-fitting.
FOLDS = 3


@dataclass
class Model:
    scores: np.ndarray
    lam: float
    log_k: float
    slope: float = 1.0
    offset: float = -3.0


def token_scores(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Shrunk log-odds per token from its numbers of toxic and other documents, less the drift."""
    prior = PRIOR_MASS * (toxic + other) / max(1, n_toxic + n_other) + PRIOR_FLAT
    a, b = toxic + prior, other + prior
    whole_a, whole_b = n_toxic + 2 * prior, n_other + 2 * prior
    odds = np.log(a) - np.log(np.maximum(whole_a - a, PRIOR_FLAT)) - np.log(b) + np.log(np.maximum(whole_b - b, PRIOR_FLAT))
    error = np.sqrt(1 / a + 1 / b)
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - SHRINK * error) - DRIFT).astype(np.float32)


def extreme_value(best: np.ndarray, tokens: np.ndarray) -> tuple[float, float]:
    """lambda and ln K by maximum likelihood from the best segment scores of some texts and their numbers of tokens.

    The best score of n tokens is at most s with probability exp(-K * n * exp(-lambda * s)).
    Of a text without a positive token only that is known to hold at 0.
    """
    some = best > 0
    s, n, none = best[some].astype(np.float64), tokens[some].astype(np.float64), float(tokens[~some].sum())
    if not len(s):  # as if one more text had had a segment
        return 1.0, -math.log(max(1.0, none))
    log_k = lambda lam: math.log(len(s)) - math.log(float((n * np.exp(-lam * s)).sum()) + none)
    # At the best K the sum of K * n * exp(-lambda * s) is the number of texts, so it drops out.
    value = lambda lam: len(s) * (math.log(lam) + log_k(lam)) - lam * float(s.sum())
    low, high = math.log(0.05), math.log(20.0)
    for _ in range(60):  # the profile has one maximum: thirds close in on it
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if value(math.exp(a)) < value(math.exp(b)) else (low, b)
    lam = math.exp((low + high) / 2)
    return lam, log_k(lam)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time (Ruzzo and Tompa)."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after = i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, i + 1, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, after - before) for s, e, before, after, _ in stack]


def _buckets(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def passages(model: Model, w: Words) -> list[list[tuple[int, int, float]]]:
    """Per text, its significant segments as (first word, end word, nats of evidence)."""
    scores = model.scores[_buckets(w)]
    out: list[list[tuple[int, int, float]]] = [[] for _ in w.counts]
    for d in np.unique(np.searchsorted(w.first, np.flatnonzero(scores > 0), side="right") - 1).tolist():
        a, b = int(w.first[d]), int(w.first[d + 1])
        limit = model.log_k + math.log(b - a)
        out[d] = [(s, e, x) for s, e, v in maximal_segments(scores[a:b]) if (x := model.lam * v - limit) > 0]
    return out


def _count(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents per fold and class, and per fold, class and token, of ``rows(text, fold, toxic)``."""
    groups = 2 * FOLDS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, BUCKETS + 1), np.int64)
        for part in slices(batches, "text"):
            w = words(*bytes_of(part.column("text")), ALNUM)
            group = 2 * part.column("fold").to_numpy(zero_copy_only=False).astype(np.int64) + part.column("toxic").to_numpy(zero_copy_only=False)
            key = np.unique(np.repeat(np.arange(len(group)), w.counts) * BUCKETS + _buckets(w))
            total[:, :-1] += np.bincount(group[key // BUCKETS] * BUCKETS + key % BUCKETS, minlength=groups * BUCKETS).reshape(groups, -1)
            total[:, -1] += np.bincount(group, minlength=groups)
        c = np.flatnonzero(total.any(axis=0))
        for a in range(0, len(c), 1 << 14):
            own = c[a : a + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(total[g, own]) for g in range(groups))], names=["c", *names])

    names = [f"n{g}" for g in range(groups)]
    sums = arrow_map(rows, count, ", ".join(f"{x} long" for x in ["c", *names])).groupBy("c").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    total = np.zeros((groups, BUCKETS + 1))
    total[:, sums["c"].to_numpy()] = [sums[x].to_numpy() for x in names]
    total = total.reshape(FOLDS, 2, -1)
    return total[:, :, -1], total[:, :, :-1]


def _best_segments(sample: DataFrame, scores: np.ndarray) -> DataFrame:
    """(toxic, best, tokens) of ``sample(text, toxic)``: the best segment's score, 0 if there is none, and the number of tokens."""
    sent = sample.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(*bytes_of(part.column("text")), ALNUM)
            values = sent.value[_buckets(w)]
            best = [max((v for *_, v in maximal_segments(values[a:b])), default=0.0) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(best, pa.float64()), pa.array(w.counts, pa.int64())], names=["toxic", "best", "tokens"])

    return arrow_map(sample, run, "toxic int, best double, tokens long")


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps with a weak prior; the slope is not negative."""
    data = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.array([0.1, -1.0]), np.array([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        step = np.linalg.solve(data.T @ (data * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), data.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def evidence(docs: DataFrame, model: Model, carry: list[str], spans: bool = False, text_col: str = "text") -> DataFrame:
    """The columns ``carry`` with the ``evidence`` of each text, and its ``passages`` (first word, end word, nats) if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "nats": pa.float64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = passages(sent.value, words(*bytes_of(part.column("text")), ALNUM))
            columns = [pa.array([math.fsum(x for *_, x in f) for f in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": s, "end": e, "nats": x} for s, e, x in f] for f in found], kind))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, "evidence", *["passages"] * spans])

    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["evidence double"] + ["passages array<struct<start:long,end:long,nats:double>>"] * spans
    return arrow_map(rows, run, ", ".join(fields)).toDF(*carry, "evidence", *["passages"] * spans)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; null labels and unlabelled rows teach nothing.

    Token counts cover all labelled rows.  Without labels of both classes every
    text scores alike.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FOLDS)).cast("int").alias("fold")
    marked = labels.filter("toxic is not null").select("doc_id", fold, (F.col("toxic") > 0).cast("int").alias("toxic"))
    # Labels grow with the corpus, so they are not broadcast, however few they are here.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(marked.hint("merge"), "doc_id")
    classes, tokens = _count(rows.select("text", "fold", "toxic"))
    every, n = classes.sum(axis=0), int(classes.sum())
    model = Model(token_scores(tokens[:, 1].sum(axis=0), tokens[:, 0].sum(axis=0), int(every[1]), int(every[0])), 1.0, 0.0)
    if every.min() > 0:
        share = min(1.0, sample_rows / n)
        picked = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)
        sample = marked.filter(picked).limit(2 * sample_rows)  # bounded, and so may be broadcast
        sample = materialise(docs.filter(picked).select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").drop("doc_id"))
        left = [token_scores(*(np.delete(tokens[:, c], f, axis=0).sum(axis=0) for c in (1, 0)), *(int(np.delete(classes[:, c], f).sum()) for c in (1, 0))) for f in range(FOLDS)]
        best = pd.concat([_best_segments(sample.filter(F.col("fold") == f), left[f]).toPandas() for f in range(FOLDS)])
        ordinary = best[best.toxic == 0]
        model.lam, model.log_k = extreme_value(ordinary.best.to_numpy(), ordinary.tokens.to_numpy())
        crossed = [evidence(sample.filter(F.col("fold") == f), replace(model, scores=left[f]), ["toxic"]).toPandas() for f in range(FOLDS)]
        found = pd.concat(crossed)
        if found.toxic.nunique() == 2:
            model.slope, model.offset = fit_logistic(np.log1p(found.evidence.to_numpy()), found.toxic.to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, carry: list[str], spans: bool = False) -> DataFrame:
    """The columns ``carry`` of each row with ``score`` (0 to 1), ``evidence`` and, if asked for, ``passages``.

    A null or empty text has no evidence, which is the lowest score.  Rows that
    repeat stay; an empty table gives an empty result.
    """
    names = [f"d{k}" for k in range(len(carry))]
    plain = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], docs["text"])
    found = evidence(plain, model, names, spans)
    found = found.withColumn("score", 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("evidence") + F.lit(model.offset)))))
    return found.toDF(*carry, "evidence", *["passages"] * spans, "score")
