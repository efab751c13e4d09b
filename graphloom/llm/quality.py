"""Quality classifier by positive-unlabelled learning.

Texts are described by shares of character classes, by the lengths and
repetition of words and lines.  A small network is fitted to trusted positives
and unlabelled web text only: it minimises the non-negative unbiased risk

    prior * R(positives as good) + max(0, R(unlabelled as bad) - prior * R(positives as bad))

with the sigmoid loss.  The class prior is estimated from the same two samples:
the least ratio of unlabelled to positive rows above any threshold of a first
discriminating score, with a confidence margin (best-bin estimate).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, slices, text_or_empty
from .textbuf import NONSPACE, span_hash, word_spans, words

#: Rows of either sample; the only data that the model is fitted to.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, WEIGHT_DECAY = 24, 40, 512, 5e-3, 1e-4
_CLASSES = [
    range(65, 91), range(97, 123), range(48, 58), [10], [9, 32], [46, 44], [33, 63], [39, 34, 40, 41, 45, 58, 59], [124], [35, 36, 37, 38, 42, 64, 94, 126],
    [60, 62, 91, 93, 123, 125, 92, 47, 95, 61, 43, 96], range(128, 192), range(192, 256),
]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes)] = _k
_NOT_NEWLINE = np.array([b != 10 for b in range(256)])


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2


def _repetition(values: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the share of its items (by weight) that occur before, and that of its commonest item."""
    n = len(first) - 1
    again, top = np.zeros(n), np.zeros(n)
    for d in np.flatnonzero(np.diff(first)).tolist():
        a, b = first[d], first[d + 1]
        _, at, inverse = np.unique(values[a:b], return_index=True, return_inverse=True)
        w = np.ones(b - a) if weight is None else weight[a:b].astype(float)
        total = max(w.sum(), 1e-9)
        again[d] = 1 - w[at].sum() / total
        top[d] = np.bincount(inverse, w).max() / total
    return again, top


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(text, feature); an empty text is all zeros."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * (len(_CLASSES) + 1) + _CLASS_OF[buf], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)
    shares = counts / np.maximum(1, size)[:, None]
    w = words(buf, off, NONSPACE)
    word_doc = np.repeat(np.arange(n), w.counts)
    length = w.end - w.start
    per_word = lambda x: np.bincount(word_doc, x, minlength=n) / np.maximum(1, w.counts)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (word_doc[1:] == word_doc[:-1])
    upper = (buf >= 65) & (buf <= 90)
    uppers = np.concatenate([[0], np.cumsum(upper)])
    shouted = ((uppers[w.end] - uppers[w.start]) * 2 > length) & (length > 2)
    plain = _CLASS_OF[buf[w.start]] if len(w.start) else np.zeros(0, np.int64)
    symbolic = ~np.isin(plain, [0, 1, 2, 11, 12])
    word_again, word_top = _repetition(w.hash, w.first)
    start, end, first = word_spans(buf, off, _NOT_NEWLINE)
    line_again, line_top = _repetition(span_hash(buf, start, end), first, end - start)
    lines = np.diff(first)
    line_doc = np.repeat(np.arange(n), lines)
    closed = np.isin(buf[end - 1], [46, 33, 63, 34, 41]) if len(end) else np.zeros(0)
    more = [
        np.log1p(w.counts), per_word(length) / 8, np.sqrt(np.maximum(0, per_word(length**2) - per_word(length) ** 2)) / 8, per_word(same), per_word(shouted), per_word(symbolic),
        word_again, word_top, line_again, line_top, np.log1p(size / np.maximum(1, lines)), np.bincount(line_doc, closed, minlength=n) / np.maximum(1, lines),
    ]
    return np.hstack([shares, np.sqrt(shares), np.column_stack(more)]).astype(np.float32)


WIDTH = 2 * (len(_CLASSES) + 1) + 12


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Best-bin estimate of the positives' share of the unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    half = [x[1::2] if len(x) > 1 else x for x in (positive, unlabelled)]
    fit = [x[::2] for x in (positive, unlabelled)]
    x = np.vstack(fit)
    y = np.repeat([1.0, 0.0], [len(fit[0]), len(fit[1])])
    share = np.where(y > 0, 0.5 / len(fit[0]), 0.5 / len(fit[1])) * len(y)
    data = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(data.shape[1])
    for _ in range(15):
        p = _sigmoid(data @ beta)
        step = np.linalg.solve((data * (share * p * (1 - p))[:, None]).T @ data + np.eye(len(beta)), data.T @ (share * (y - p)) - beta)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    p, u = (np.sort(np.column_stack([h, np.ones(len(h))]) @ beta) for h in half)
    limits = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    above = [1 - np.searchsorted(s, limits) / len(s) for s in (p, u)]
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((above[1] + margin) / np.maximum(above[0], 1e-9)))
    return float(np.clip(above[1][best] / max(above[0][best], 1e-9), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 1) -> Model:
    """The network of least non-negative risk; without positives or unlabelled rows every text scores 0.5."""
    width = WIDTH
    if not len(positive) or not len(unlabelled):
        return Model(0.5, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float64) for x in (positive, unlabelled))
    prior = estimate_prior(p, u)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    steps = max(1, max(len(p), len(u)) // BATCH)
    t = 0
    for epoch in range(max(EPOCHS, 1200 // steps)):
        rate = RATE * (1 - epoch / max(EPOCHS, 1200 // steps))
        for _ in range(steps):
            x = np.vstack([p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=BATCH)]])
            h = np.tanh(x @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3][0]
            good, bad = _sigmoid(-z), _sigmoid(z)  # the losses of calling a row bad, and good, by the sigmoid loss
            slope = good * bad
            rest = bad[BATCH:].mean() - prior * bad[:BATCH].mean()
            grad = np.empty(2 * BATCH)
            if rest >= 0:
                grad[:BATCH] = (-prior * slope[:BATCH] - prior * slope[:BATCH]) / BATCH
                grad[BATCH:] = slope[BATCH:] / BATCH
            else:  # the negative part has been overfitted: go back on it
                grad[:BATCH] = prior * slope[:BATCH] / BATCH
                grad[BATCH:] = -slope[BATCH:] / BATCH
            back = grad[:, None] * weights[2] * (1 - h * h)
            gradients = [x.T @ back, back.sum(axis=0), h.T @ grad, np.array([grad.sum()])]
            t += 1
            for k, g in enumerate(gradients):
                g = g + WEIGHT_DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(prior, mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def _picked(share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs(doc_id, text)``, unlabelled, and the trusted positives in ``labels(doc_id, quality)``.

    Only rows of ``labels`` with quality above 0 are used.  Either sample has
    about ``sample_rows`` rows at most, whatever the size of the tables.
    """
    trusted = labels.filter("quality > 0").select("doc_id")
    n_trusted, n_docs = trusted.count(), docs.count()
    sample = trusted.filter(_picked(sample_rows / max(1, n_trusted), 3)).distinct().limit(2 * sample_rows).withColumn("trusted", F.lit(True))
    web = _picked(sample_rows / max(1, n_docs), 5)
    # The sample of positives is bounded, and so may be broadcast.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id", "left")
    rows = rows.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce(web, F.lit(False)).alias("web")).filter("trusted or web")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features(*bytes_of(part.column("text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("trusted"), part.column("web"), values], names=["trusted", "web", "x"])

    got = arrow_map(rows, run, "trusted boolean, web boolean, x array<float>").toPandas()
    x = np.vstack(got.x.to_list()) if len(got) else np.zeros((0, WIDTH), np.float32)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # the fit must not depend on the order of partitions
    x, trusted_, web_ = x[order], got.trusted.to_numpy(bool)[order], got.web.to_numpy(bool)[order]
    mixed = np.random.default_rng(7).permutation(len(x))
    return fit(x[mixed][trusted_[mixed]], x[mixed][web_[mixed]])


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` of each row with ``score``, from 0 to 1, of any text, null (as empty) included.

    Rows that repeat stay; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            z = sent.value.logits(features(*bytes_of(part.column("_text"))))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(_sigmoid(z).astype(np.float64))], names=[*names, "score"])

    out = arrow_map(rows, run, ", ".join([f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["score double"]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, names, strict=True)], "score")


def select_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns and in their form."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part in slices(iter([batch.rename_columns(names)]), names[at]):
                z = sent.value.logits(features(*bytes_of(part.column(at))))
                yield part.filter(pa.array(_sigmoid(z) >= least)).rename_columns(batch.schema.names)

    return arrow_map(docs, run, docs.schema)
