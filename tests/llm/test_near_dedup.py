import random
import re

import pytest

from graphloom.llm import near_dedup

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, size, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    label = list(range(len(rows)))
    changed = True
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    low = {}
    for (d, _), c in zip(rows, label, strict=True):
        low[c] = min([x for x in (low.get(c), d) if x is not None], default=None)
    return sorted(((d, len(s), low[c] if d is not None else low[c]) for (d, _), s, c in zip(rows, sets, label, strict=True)), key=str)


def documents():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A  b\tc"), (7, "a b"), (8, "x y z w"), (9, "x y z w")]
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 18)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(words)))
    rows.append((len(rows), "long " * 50_000 + " ".join(map(str, range(20_000)))))
    rows.append((len(rows), "long " * 40_000 + " ".join(map(str, range(20_000)))))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK_SHINGLES": 300}, {"CLUSTER_BLOCKS": 0}, {"CLUSTER_BLOCKS": 0, "DIRECT_PAIRS": 0, "PARTNER_ROUNDS": 2}])
def test_against_all_pairs(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(near_dedup, k, v)
    rows = documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = near_dedup.near_groups(docs, size=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "q", 3)], "doc_id long, text string, bucket int")
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == [1, 3]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
