import hashlib
import random
from collections import Counter

import pytest

from graphloom.llm import registry, repeats


def brute_force(rows, length):
    """(doc_id, n_bytes, removed spans, bytes left) from a count of every string."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(b), sum(gone), len(spans), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(length, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(length // rng.choice([2, 3, 4]))) for _ in range(8)]
    out = [None, "", "x" * (length - 1), "x" * (length + 3), "ab " * length, "ab " * length, "y" * length, "y" * length]
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[: len(p) - a], word(), " ".join(word() for _ in range(length // 3))]))
        out.append(" ".join(parts))
    return out + [out[-1], out[-2] + "!"]


def result(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in registry.op8_repeats(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"TASK_CONTEXTS": 1}, {"TASK_BATCH": 3}])
def test_against_counting_every_string(spark, tmp_path, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(repeats, k, v)
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts(repeats.LENGTH, 3))]
    rows += [rows[20], (rows[21][0], "another text of this id")]
    assert result(spark, tmp_path, rows) == brute_force(rows, repeats.LENGTH)


@pytest.mark.parametrize("length,seed", [(40, 1), (41, 2)])
def test_other_lengths(spark, length, seed):
    rows = list(enumerate(texts(length, seed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(docs, ["doc_id"], length=length).collect()]
    assert sorted(got, key=str) == brute_force(rows, length)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert repeats.remove_repeats(docs, ["doc_id", "spans"]).count() == 0
