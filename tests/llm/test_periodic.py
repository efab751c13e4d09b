import hashlib
import random
import re
import zlib

import pytest

from graphloom.llm import periodic, registry


def plain_runs(w, least, exponent):
    """By trying every period on every stretch."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= least and n >= exponent * q:
                out.setdefault((i, n), q)
            i = j + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        w = [rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            at, part = rng.randrange(len(w) + 1), [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            w[at:at] = part * rng.randrange(2, 7) + part[: rng.randrange(len(part))]
        if rng.random() < 0.5 and w:  # whole stretches again, so that runs are copied
            a = rng.randrange(len(w))
            w += ["x"] * rng.randrange(2) + w[a : a + rng.randrange(40)]
        yield w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3), (9, 2), (3, 6)])
def test_runs_are_those_of_brute_force(least, exponent):
    for w in texts(random.Random(least * 10 + exponent), 1200):
        assert periodic.word_runs([x.encode() for x in w], least, exponent) == plain_runs(w, least, exponent), w


def test_factors_are_the_longest_that_start_earlier():
    for w in texts(random.Random(3), 200):
        s = [ord(x) for x in w]
        at = 0
        for begin, end, shift in periodic.factors(s):
            assert begin == at < end
            starts = lambda n: [i for i in range(begin) if s[i : i + n] == s[begin : begin + n]]  # noqa: E731, B023
            if shift:
                assert starts(end - begin)[0] == begin - shift
                assert end == len(s) or not starts(end - begin + 1)
            else:
                assert s[begin] not in s[:begin] and end == begin + 1
            at = end
        assert at == len(s)


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice([" ", "\n\t"]).join(w)) for k, w in enumerate(texts(rng, 120))]
    rows += [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(400)))) for k in range(500, 580)]
    rows += [(None, None), (None, "a " * 9), (3, ""), (3, "b " * 9), (901, " \x0b "), (902, "lang " * 30_000 + "zwei wort " * 20_000)]
    spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, runs int, c0 string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, planted = [], 0
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str("" if d is None else d).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = plain_runs(w, 6, 4) if d != 902 else [(0, 30_000, 1), (30_000, 40_000, 2)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        want.append((d, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert planted > 10
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_columns_of_any_name_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b a b a b a b a b", "x"), (1, None, None)], "doc_id long, text string, n_words string")
    got = periodic.periodic_runs(docs, ["n_words", "doc_id"])
    assert got.columns == ["n_words", "doc_id", "n_words", "runs", "collapsed"]
    assert sorted((str(r[0]), r[2], [tuple(x) for x in r[3]], r[4]) for r in got.collect()) == [("None", 0, [], ""), ("x", 9, [(0, 9, 2)], "b a")]
    assert periodic.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
