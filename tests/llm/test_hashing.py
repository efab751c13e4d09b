"""Strings that collide under any polynomial modulo 2**64 (a Thue-Morse word and its complement), and under this library's own constants."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, near_dedup, repeats, textbuf
from graphloom.llm.common import bytes_of

WORD = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def test_no_link(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER), (3, f"one {WORD} x"), (4, f"one {OTHER} x")], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(docs, size=4).collect()} == {1, 2, 3, 4}


def test_no_hit(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER)], "doc_id long, text string")
    items = spark.createDataFrame([(7, OTHER)], "item_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.contamination(docs, items, ["doc_id"]).collect()}
    assert got == {1: [], 2: [(0, 1)]}


def test_words_whose_hashes_meet_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(textbuf, "span_hash", lambda buf, start, end: (end - start).astype(np.uint64) + np.uint64(9))
    own = decontaminate.shard(*bytes_of(pa.array(["aa bb cc", "aa dd cc"])), 3)
    block = decontaminate.test_block(["i"], ["aa bb cc"], 3)
    assert [r[0] for r in decontaminate.annotate(own, block)] == [[(0, 3)], []]


def test_no_removal(spark):
    docs = spark.createDataFrame([(1, WORD), (2, OTHER)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in repeats.remove_repeats(docs, ["doc_id"], length=1024).collect()}
    assert got == {1: WORD.encode(), 2: OTHER.encode()}


@pytest.mark.parametrize("width", [1, 5, 7, 8, 9, 16, 31, 200, 400])
def test_every_hash_is_of_the_bytes_alone(width):
    rng = np.random.default_rng(width)
    buf = rng.integers(97, 100, 900).astype(np.uint8)
    buf[450:450 + width] = buf[:width]
    h = textbuf.every_hash(buf, width)
    raw = buf.tobytes()
    strings = [raw[i : i + width] for i in range(len(raw) - width + 1)]
    assert len(h) == len(strings) and len(set(zip(strings, h.tolist(), strict=True))) == len(set(strings)) == len(set(h.tolist()))
    assert len(textbuf.every_hash(buf[: width - 1], width)) == 0


def test_span_hash_is_of_the_bytes_alone():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2000, 3000)
    end = start + rng.integers(0, 600, 3000) // rng.choice([1, 20, 100], 3000)
    raw, h = buf.tobytes(), textbuf.span_hash(buf, start, end).tolist()
    strings = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    assert len(set(zip(strings, h, strict=True))) == len(set(strings)) == len(set(h))


def second_block(first, second, other):
    """The eight bytes that after ``other`` give the state that ``second`` gives after ``first``, for ``span_hash`` of 16 bytes with the fixed constants."""
    size = textbuf.mix(np.array([16 + textbuf._MASK // 3], np.uint64))
    state = lambda b: textbuf.mix(textbuf.combine(np.repeat(size, len(b)), b))
    back = np.uint64(pow(int(textbuf._RIGHT), -1, 1 << 64))
    return second + (state(first) - state(other)) * textbuf._LEFT * back


def colliding_words():
    """Two words of 16 letters and digits with one hash, found by solving for the second block."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    rng, first = np.random.default_rng(4), np.frombuffer(b"collisionexample", "<u8")
    for _ in range(400):
        others = letters[rng.integers(0, 36, (1 << 18, 8))].reshape(-1).view("<u8")
        tails = second_block(first[:1], first[1], others)
        raw = tails.view(np.uint8).reshape(-1, 8)
        good = np.flatnonzero(((raw > 32) & (raw < 127)).all(axis=1))
        plain = good[textbuf.ALNUM[raw[good]].all(axis=1)] if len(good) else good
        if len(plain):
            k = plain[0]
            return "collisionexample", others[k : k + 1].tobytes().decode() + tails[k : k + 1].tobytes().decode()
    raise AssertionError("no pair found")


@pytest.fixture(scope="module")
def pair():
    a, b = colliding_words()
    buf = np.frombuffer((a + b).encode(), np.uint8)
    h = textbuf.span_hash(buf, np.array([0, 16]), np.array([16, 32]))
    assert a != b and h[0] == h[1]
    h = textbuf.span_hash(buf, np.array([0, 16]), np.array([16, 32]), textbuf.draw_key())
    assert h[0] != h[1]
    return a, b


def test_constructed_words_are_told_apart_by_the_benchmark(spark, pair):
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, f"x {pair[1]} y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in decontaminate.contamination(docs, items, ["doc_id"]).collect()}
    assert got == {1: ([(0, 1)], ["1"]), 2: ([(0, 1)], ["2"]), 3: ([(1, 2)], ["2"])}


def test_constructed_words_give_no_link(spark, pair):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, pair[0]), (2, pair[1]), (3, " ".join([*words, pair[0]] * 2)), (4, " ".join([*words, pair[1]] * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_groups(docs, size=4).collect()}
    assert got[1] == (1, 1) and got[2] == (2, 1)
    assert [x.component_id for x in near_dedup.near_groups(spark.createDataFrame([(5, pair[0]), (6, pair[1]), (7, pair[1].upper())], "doc_id long, text string")).orderBy("doc_id").collect()] == [5, 6, 6]


def test_sets_of_one_node_are_hashed_again_if_they_differ(spark, monkeypatch):
    keys = iter([3, 3, 5, 7])
    monkeypatch.setattr(near_dedup, "draw_key", lambda: next(keys))
    calls, real = [], near_dedup.profiles

    def first_wrong(rows, size, keys):
        calls.append(keys)
        found = real(rows, size, keys)
        return found.withColumn("node", F.lit(1).cast("long")) if len(calls) == 1 else found

    monkeypatch.setattr(near_dedup, "profiles", first_wrong)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(docs, size=4).collect()} == {1, 2} and calls == [(3, 3), (5, 7)]


def test_constructed_strings_are_not_removed(spark):
    rng = np.random.default_rng(1)
    common = bytes(rng.integers(97, 123, 384).astype(np.uint8)).decode()
    rows = [(1, "firstblksecondbk" + common), (2, "lvhtlydvO7oF5n&!" + common)]  # their first 16 bytes collide by construction
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.spans, bytes(r.kept).decode()) for r in got) == [(d, [], t) for d, t in rows]


@pytest.mark.parametrize("classes", [1, 2, 7])
def test_strings_of_one_hash_are_told_apart_by_bytes(classes):
    rng, length = np.random.default_rng(classes), 12
    parts = ["".join(rng.choice(list("ab"), 30)) for _ in range(6)]
    texts = [rng.choice(parts) + rng.choice(parts)[: rng.integers(0, 30)] for _ in range(30)]
    part = pa.record_batch({"bytes": pa.array([t.encode() for t in texts], pa.binary())})
    row, offset, at, buf = repeats._strings(part, length)
    strings = [texts[r][o : o + length] for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
    for h in (np.array([sum(s.encode()) % classes for s in strings], np.uint64), np.array([hash(s) & textbuf._MASK for s in strings], np.uint64)):
        of = repeats.equal_strings(buf, row, at, h, length).tolist()
        assert len(set(of)) == len(set(strings)) == len(set(zip(of, strings, strict=True)))
