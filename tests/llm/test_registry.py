"""The contract queries whose rows no SQL gives, called as they are registered."""

import hashlib
import zlib

import public_tokenizers
import pytest
from test_language_id import texts
from test_near_dedup import brute_force, documents
from test_quality import texts as good_and_bad
from tokenizers import Tokenizer

from graphloom.llm import language_id, registry


def write(spark, tmp_path, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")


def remainder(doc_id, n):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % n


def test_op4(spark, tmp_path):
    rows = [(1, "Hello world"), (2, None), (2, ""), (None, "Hello world, it's <|endoftext|> été " * 90), (5, "Hello world, it's <|endoftext|> été " * 90 + "x")]
    write(spark, tmp_path, rows, "doc_id long, text string")
    got = registry.op4_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_op6(spark, tmp_path):
    rows = good_and_bad(500, 3)
    write(spark, tmp_path, [(d, t) for d, t, _ in rows] + [rows[0][:2], (None, None)], "doc_id long, text string")
    write(spark, tmp_path, [(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int", "labels")
    got = registry.op6_quality(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + 2
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    label = {d: q for d, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held) > 50


def test_op9(spark, tmp_path):
    rows = texts(400, 5)
    write(spark, tmp_path, [*rows, (9000, "123", "en"), (9001, None, None), rows[3]], "doc_id long, text string, lang string")
    got = registry.op9_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows) + 3 and all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    lang = {d: x for d, _, x in rows} | {9000: "und", 9001: "und"}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)


def test_op10(spark, tmp_path):
    rows = [r for r in documents() if len(r[1] or "") < 10_000]
    write(spark, tmp_path, rows, "doc_id long, text string")
    got = registry.op10_near_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_force(rows, 4)


@pytest.mark.parametrize("word,script", [("“Привет", "cyrillic"), ("¿qué", "latin"), ("–漢", "han"), ("…", "other"), ("abc", "latin"), ("été", "latin"), ("»мир", "cyrillic")])
def test_script_of_the_first_letter(word, script):
    import numpy as np

    raw = np.frombuffer(word.encode(), np.uint8)
    start, end, _ = language_id.word_spans(language_id.LOWER[raw], np.array([0, len(raw)]), language_id.LETTERS)
    assert language_id.SCRIPT_NAMES[language_id._scripts(language_id.LOWER[raw], start, end)[0]] == script
