"""Language identification of mixed-language text.

A word's score for a language is the log probability of its hashed character
trigrams (word edges included) in that language's training texts.  Script
ranges narrow the candidates: a language in whose training words a script
hardly occurs is no candidate for words of that script.  Viterbi over the words,
with a penalty for each switch, labels spans of one language; the document's
label is the language of most bytes.

Counts are taken over all training rows and kept in tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, slices, text_or_empty
from .textbuf import LOWER, word_spans

#: Entries of the model over all languages, so its broadcast is bounded: buckets times languages at most.
MODEL_CELLS, MOST_BUCKETS = 1 << 22, 1 << 16
#: Cost of a switch between languages, in nats, and the share of a language's words that makes a script its own.
SWITCH, SCRIPT_SHARE = 12.0, 0.002
SMOOTHING = 0.5
#: Scripts as first code points of ranges, in order; every other code point is of the range before it.
SCRIPT_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0xAC00, 0xD7B0, 0x1F000])
SCRIPTS = "latin greek cyrillic armenian hebrew arabic devanagari indic thai hangul other latin greek han kana han hangul other other".split()
SCRIPT_NAMES = sorted(set(SCRIPTS))
_SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS])
#: Bytes of words: letters, and every byte of a longer character.
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Model:
    languages: list[str]
    #: log probability by trigram bucket and language
    trigrams: np.ndarray
    #: whether a language is a candidate for words of a script
    allowed: np.ndarray


def _grams(low: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the padded words, and where each word's begin: a word of n bytes has n."""
    n = end - start
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(start, n)
    middle = low[at].astype(np.uint32)
    before = np.zeros(len(at), np.uint32)
    after = np.zeros(len(at), np.uint32)
    before[1:] = middle[:-1]
    after[:-1] = middle[1:]
    before[first] = 0
    after[first + n - 1] = 0
    key = (before << np.uint32(16)) | (middle << np.uint32(8)) | after
    key *= np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64), first


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _scripts(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Script of each word by its first letter; a word of none is of no script, which is "other"."""
    padded = np.concatenate([low, np.zeros(4, np.uint8)])
    out = np.full(len(start), SCRIPT_NAMES.index("other"))
    plain = low[start] < 0x80  # the bytes of words below 128 are letters
    out[plain] = SCRIPT_NAMES.index("latin")
    rows = np.flatnonzero(~plain)
    at = start[rows]
    while len(rows):
        b = [padded[at + k].astype(np.int64) for k in range(4)]
        two, three = (b[0] & 0x1F) << 6 | (b[1] & 0x3F), (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | (b[2] & 0x3F)
        four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | (b[3] & 0x3F)
        point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))
        found = _letters()[np.minimum(point, 0x10FFFF)]
        out[rows[found]] = _SCRIPT_OF_RANGE[np.searchsorted(SCRIPT_STARTS, point[found], side="right") - 1]
        at = at + np.where(b[0] < 0x80, 1, np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4)))
        left = ~found & (at < end[rows])
        rows, at = rows[left], at[left]
    return out


def buckets_for(languages: int) -> int:
    n = min(MOST_BUCKETS, MODEL_CELLS // max(1, languages))
    return 1 << max(8, n.bit_length() - 1)


def train(rows: DataFrame) -> Model:
    """A model of ``rows(text, lang)``; rows whose lang is null teach nothing.  Without any, there are no languages.

    The model's size is bounded, and so is the number of languages, by
    ``MODEL_CELLS`` over 256: more are refused, none is left out.
    """
    rows = rows.filter("lang is not null").select(text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MODEL_CELLS // 256 + 1).collect())
    if len(languages) > MODEL_CELLS // 256:
        raise ValueError(f"more than {MODEL_CELLS // 256} languages")
    buckets, scripts = buckets_for(len(languages)), len(SCRIPT_NAMES)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets + scripts), np.int64)
        for part in slices(batches, "text"):
            buf, off = bytes_of(part.column("text"))
            low = LOWER[buf]
            start, end, first = word_spans(low, off, LETTERS)
            grams, _ = _grams(low, start, end, buckets)
            mine = np.repeat(np.array([number[x] for x in part.column("lang").to_pylist()]), np.diff(first))
            total += np.bincount(np.repeat(mine, end - start) * (buckets + scripts) + grams, minlength=total.size).reshape(total.shape)
            total += np.bincount(mine * (buckets + scripts) + buckets + _scripts(low, start, end), minlength=total.size).reshape(total.shape)
        k, c = np.nonzero(total)
        for a in range(0, len(k), 1 << 16):
            cut = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array(c[cut]), pa.array(total[k[cut], c[cut]])], names=["k", "c", "n"])

    sums = arrow_map(rows, count, "k long, c long, n long").groupBy("k", "c").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), buckets + scripts))
    total[sums["k"].to_numpy(), sums["c"].to_numpy()] = sums["n"].to_numpy()
    grams, by_script = total[:, :buckets] + SMOOTHING, total[:, buckets:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True))
    share = by_script / np.maximum(1, by_script.sum(axis=1, keepdims=True))
    return Model(languages, logs.T.astype(np.float32).copy(), (share >= SCRIPT_SHARE).T.copy())


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word of one text, from (word, language) scores, where a switch costs ``penalty``."""
    n, k = scores.shape
    if k > 16:
        return _viterbi_wide(scores, penalty)
    rows = scores.tolist()
    best, tops, stays = rows[0], [0] * n, [0] * n
    for t in range(1, n):
        high = max(best)
        low, bit, stay, new = high - penalty, 1, 0, []
        for b, r in zip(best, rows[t], strict=True):
            if b >= low:
                stay |= bit
                new.append(b + r)
            else:
                new.append(low + r)
            bit <<= 1
        tops[t], stays[t] = best.index(high), stay
        best = new
    state = best.index(max(best))
    path = [state] * n
    for t in range(n - 1, 0, -1):
        if not stays[t] >> state & 1:
            state = tops[t]
        path[t - 1] = state
    return np.array(path, np.int64)


def _viterbi_wide(scores: np.ndarray, penalty: float) -> np.ndarray:
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    best = scores[0].copy()
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[t] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - penalty) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _steady(scores: np.ndarray, first: np.ndarray, base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts of which the best path surely is ``base`` throughout, from (language, word) scores; no text may be empty.

    A stretch of other languages gains no more than the sum of each word's best
    gain over the base, and costs a switch at each end within the text.  So it
    cannot pay if no window gains two switches, none at either end of the text
    gains one, and the whole text gains nothing.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    column = np.arange(len(doc))
    others = scores.copy()
    others[base[doc], column] = -np.inf
    gain = np.maximum(others.max(axis=0) - scores[base[doc], column], -1e3)
    sums = np.cumsum(gain)
    before = sums - gain
    start = first[:-1]
    # Texts are moved so far apart that a running minimum never looks back into the one before.
    far = (np.abs(gain).sum() + 1) * 2 * doc
    window = np.maximum.reduceat(sums - (np.minimum.accumulate(before - far) + far), start)
    ahead = np.maximum.reduceat(sums, start) - before[start]
    total = sums[first[1:] - 1] - before[start]
    behind = sums[first[1:] - 1] - np.minimum.reduceat(before, start)
    return (window < 2 * SWITCH) & (ahead < SWITCH) & (behind < SWITCH) & (total < 0)


def label(model: Model, buf: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text, spans (first byte, end byte, language number) in order; none for a text without letters."""
    low = LOWER[buf]
    start, end, first = word_spans(low, off, LETTERS)
    counts = np.diff(first)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    if not len(start):
        return spans
    grams, at = _grams(low, start, end, len(model.trigrams))
    scores = np.ascontiguousarray(np.add.reduceat(model.trigrams[grams], at, axis=0).T, dtype=np.float64)
    # A word counts by its mean over a few bytes, lest one long word outweigh a sentence.
    scores *= np.minimum(1.0, 8.0 / (end - start))
    scripts = _scripts(low, start, end)
    candidates = model.allowed.T[:, scripts]
    candidates |= ~model.allowed.any(axis=1)[scripts]
    scores = np.where(candidates, scores, scores.min(axis=0) - SWITCH)
    scores -= scores.max(axis=0)
    full = np.flatnonzero(counts)
    base = np.zeros(len(counts), np.int64)
    base[full] = np.add.reduceat(scores, first[full], axis=1).argmax(axis=0)
    steady = np.ones(len(counts), bool)
    if len(model.languages) > 1:
        steady[full] = _steady(scores, np.append(first[full], len(start)), base[full], counts[full])
    for d in full.tolist():
        a, b = int(first[d]), int(first[d + 1])
        if steady[d]:
            spans[d] = [(int(start[a] - off[d]), int(end[b - 1] - off[d]), int(base[d]))]
        else:
            path = viterbi(scores[:, a:b].T)
            edge = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
            spans[d] = [(int(start[a + i] - off[d]), int(end[a + j - 1] - off[d]), int(path[i])) for i, j in zip(edge, edge[1:], strict=False)]
    return spans


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (the label's share of the labelled bytes) and ``spans`` (language, first byte, end byte).

    A null text or one without a letter is ``und`` with score 0; so is every
    text if the model knows no language.  Rows that repeat stay; an empty table
    gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct({"lang": pa.string(), "start": pa.int64(), "end": pa.int64()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.languages
        for part in slices(batches, "text"):
            column = part.column("text")
            buf, off = bytes_of(column)
            found = label(sent.value, buf, off) if names else [[] for _ in range(len(column))]
            plain = np.concatenate([[0], np.cumsum((LOWER[buf] >= 97) & (LOWER[buf] <= 122))])
            plain = np.diff(plain[off])
            labels, scores = [], []
            for d, spans in enumerate(found):
                size: dict[int, int] = {}
                for a, b, k in spans:
                    size[k] = size.get(k, 0) + b - a
                # Words of bytes above 127 alone may hold no letter.
                if not size or (not plain[d] and not _has_letter(column[d].as_py())):
                    labels.append("und")
                    scores.append(0.0)
                    found[d] = []
                else:
                    top = max(size, key=lambda k: (size[k], -k))
                    labels.append(names[top])
                    scores.append(size[top] / sum(size.values()))
            columns = [
                part.column("doc_id"),
                pa.array(labels, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array([[{"lang": names[k], "start": a, "end": b} for a, b, k in s] for s in found], kind),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"])

    return arrow_map(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")
