import random
import re

import pytest
import xxhash

from graphloom.llm import registry, simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    runs = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, bits):
    """Smallest id reachable, by comparing all pairs."""
    label = list(range(len(prints)))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return [min((d for d, x in zip(ids, label, strict=True) if x == c and d is not None), default=None) for c in label]


def documents():
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A  b\tc"), (7, "É x\x0by"), (None, "é alone"), (None, "one"), (3, "other words in a row of six")]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            rows.append((len(rows) + 10, rng.choice([" ", "\n "]).join(words)))
    return rows


@pytest.mark.parametrize("step", [1 << 18, 40, 1])
def test_prints_are_those_of_the_definition(step, monkeypatch):
    monkeypatch.setattr(simhash.pieces, "__defaults__", (step,))
    for _, text in documents():
        for size in (1, 4):
            assert simhash.fingerprint((text or "").encode(), size) == plain_print(text, size)


@pytest.mark.parametrize("block", [1 << 14, 3])
@pytest.mark.parametrize("bits", [1, 4, 9])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block, bits):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(bits)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            prints.add(x)
            for _ in range(rng.randrange(bits + 3)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.node: r.component for r in simhash.print_components(spark.createDataFrame([(p,) for p in signed], "print long"), bits).collect()}
    want = dict(zip(signed, plain_components(signed, prints, bits), strict=True))
    assert {p: c for p, c in want.items() if list(want.values()).count(c) > 1} == got


def test_query(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([(*r, 7, "x", 5) for r in rows], "doc_id long, text string, print int, component string, row_tag int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_print(t, 4) for _, t in rows]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, plain_components([d for d, _ in rows], prints, 4), strict=True)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_kept_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "q", 3)], "doc_id long, text string, tag int")
    assert sorted(tuple(r) for r in simhash.simhash_dedup(docs).collect()) == [(1, "a b c d e f", 1), (3, "q", 3)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
    assert sorted(r.component_id for r in simhash.simhash_groups(docs, bits=0).collect()) == [1, 1, 1, 3]
