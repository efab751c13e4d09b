import random

import public_tokenizers
import pyarrow as pa
import pytest

from graphloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the ", "don't ", "we'll", "'l", "'", "l", " ", "  ", "\n", "\n\n ", "\t", "é", "ß", "漢字", "🙂", "123", "4", "...", "$$$ ", "a" * 40, "<|endoftext|>", "<|endof", " ", " ", "x"]


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH)


def test_every_token_alone_is_itself(own):
    assert own.quick is not None


def check(own, texts):
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(pa.array(texts))
    assert [x.tolist() for x in got] == want
    assert [own.decode(x) for x in got] == own.tokenizer.decode_batch(want, skip_special_tokens=False)


@pytest.mark.parametrize("bits,least", [(11, 512), (6, 40), (3, 1), (1, 1)])
def test_equals_the_plain_tokenizer(own, monkeypatch, bits, least):
    """Chunks of a few bytes make every kind of join."""
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "LEAST_CHUNK", least)
    rng = random.Random(bits)
    own.cache.clear()
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 300))) for _ in range(150)]
    prose = "".join(rng.choices(["the ", "don't ", "we'll ", "it's", " fell", "\n", ", ", "größe ", "12 ", "  ", "'", "l", " $$ ", "été\n\n", "¿qué? ", "«½» ", "– ", "“x” ", "ª²"], k=20_000))
    check(own, [prose, "", *texts, "".join(texts), "a" * 30_000, " " * 9_000 + "b", *texts[:20]])


def test_shared_passages_are_encoded_once(own):
    passage = " ".join(f"w{i * i} and" for i in range(4000))
    own.cache.clear()
    own.encode(pa.array([passage]))
    before = own.encoded_bytes
    own.encode(pa.array(["Another start. " + passage]))
    assert own.encoded_bytes - before < 5000


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "Hello world", "c"), (None, "é" * 5, "c")], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH, ["doc_id"])
    back = {(r.doc_id, r.text) for r in bpe.decode(coded, PATH, ["doc_id"]).collect()}
    assert back == {(1, ""), (2, ""), (2, "Hello world"), (None, "é" * 5)}
    assert {r.n_tokens for r in bpe.round_trip(docs, PATH).collect()} == {0, 2, len(coded.filter("doc_id is null").first().ids)}
    assert bpe.encode(docs.limit(0), PATH, ["doc_id"]).count() == 0
