import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import decontaminate as D
from graphloom.llm import registry

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_force(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(10, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[j : j + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(3)
    word = lambda: rng.choice(["The", "a", "été", "x1", "zu", "of", "QUX", "ñu"]) + rng.choice(["", "s", "ing"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(9)] + [(9, None), (10, "same words"), (11, "same words"), (11, "same words")]
    docs = [(0, None), (1, ""), (2, "... !"), (3, "same"), (3, "same words"), (None, "Same, WORDS same words")]
    for k in range(60):
        parts = [rng.choice([str(rng.choice(items)[1] or "").upper().replace(" ", ", "), " ".join(word() for _ in range(rng.randrange(12)))]) for _ in range(rng.randrange(6))]
        docs.append((10 + k, " - ".join(parts)))
    docs.append((99, "filler " * 200_000 + (items[6][1] or "x")))
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = tables()
    docs = [x for x in docs if x[0] != 99]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((tuple(r) for r in registry.op7_decontaminate(spark, str(tmp_path)).collect()), key=str) == brute_force(docs, items)


@pytest.mark.parametrize("block", [1, 200])
def test_many_blocks_give_the_same(spark, block):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    get = lambda **k: sorted((str(r.doc_id), r.n_words, str(r.spans), str(r["items"]), r.longest) for r in D.contamination(d, b, ["doc_id"], **k).collect())
    assert get(block_bytes=block) == get()


def test_rows_that_stay_and_empty_tables(spark):
    docs, items = tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, _n int")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(d, b)
    dirty = {str(r[:2]) for r in docs if brute_force([r], items)[0][5]} if len(docs) < 500 else set()
    assert kept.columns == d.columns and {str((r.doc_id, r.text)) for r in kept.collect()} == {str(r) for r in docs} - dirty
    assert D.decontaminate(d.limit(0), b).count() == 0 and D.decontaminate(d, b.limit(0)).count() == len(docs)


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint64)
        order = D.suffix_array(s, 64)
        assert sorted(order.tolist()) == list(range(len(s)))
        rows = [s[o:].tolist() for o in order]
        assert rows == sorted(rows)
