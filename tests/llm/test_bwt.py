import random
from collections import Counter

from test_repeats import texts

from graphloom.llm import bwt, repeats


def test_merged_prefixes_against_sorting():
    rng = random.Random(1)
    for _ in range(40):
        shards = [[bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 4))]
        every = [t for s in shards for t in s]
        length = rng.randrange(1, 5)
        count = Counter(t[i : i + length] for t in every for i in range(len(t) - length + 1))
        want = [(k, i) for k, t in enumerate(every) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
        assert bwt.repeated_strings(shards, length) == want


def test_the_corpus_operator_removes_what_the_merged_transform_finds(spark):
    length = 40
    rows = [(k, t or "") for k, t in enumerate(texts(length, 6)) if len(t or "") < 1500]
    raw = [t.encode() for _, t in rows]
    gone = [bytearray(len(b)) for b in raw]
    for k, i in bwt.repeated_strings([raw[:20], raw[20:30], raw[30:]], length):
        gone[k][i : i + length] = b"\1" * length
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], length=length).collect()}
    assert got == {d: sum(g) for (d, _), g in zip(rows, gone, strict=True)} and sum(got.values()) > 1000
