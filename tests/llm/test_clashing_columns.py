"""Tables whose further columns are named like what the operators make, with nulls, repeated rows and no rows."""

import public_tokenizers
from test_quality import texts

from graphloom.llm import bpe, language_id, quality, secrets
from graphloom.llm.decontaminate import contamination, decontaminate
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.html_extract import extract
from graphloom.llm.near_dedup import near_dedup
from graphloom.llm.repeats import remove_repeats
from graphloom.llm.simhash import simhash_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_secrets(spark):
    rows = [(1, "password = hunter22", "b", "n", "s"), (1, "password = hunter22", "b", "n", "s"), (None, None, "b", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, novel string, spans string")
    got = secrets.scan(docs).collect()
    assert sorted(len(r.base) for r in got) == [0, 1, 1] and secrets.scan(docs.limit(0)).count() == 0


def test_quality(spark):
    rows = texts(300, 4)
    rows += [rows[0], rows[0], (None, None, 0)]
    docs = spark.createDataFrame([(k, t, y, True, 0.25, "x") for k, t, y in rows], "doc_id long, text string, web int, trusted boolean, score double, x string")
    labels = spark.createDataFrame([(k, y, 0.5) for k, _, y in rows], "doc_id long, quality int, trusted double")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id", "score", "x"])
    assert got.columns == ["doc_id", "score", "x", "score"] and got.count() == len(rows)
    assert all(tuple(r)[1:3] == (0.25, "x") for r in got.collect())
    kept = quality.select_good(docs, model)
    assert kept.schema.names == docs.schema.names and 0 < kept.count() < len(rows)
    same = [tuple(r)[3] for r in got.collect() if r.doc_id == rows[0][0]]
    assert len(same) == 3 and len(set(same)) == 1


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world", [9], 7)] * 2 + [(None, None, None, None)], "doc_id long, text string, ids array<int>, n_tokens long")
    coded = bpe.encode(docs, PATH, ["doc_id", "text", "n_tokens", "ids"])
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids", "n_tokens", "ids"]
    assert sorted((tuple(r)[2], tuple(r)[4]) for r in coded.collect() if r.doc_id) == [(7, 2), (7, 2)]
    one = bpe.encode(docs, PATH, ["doc_id"], together=False).withColumnRenamed("doc_id", "text")
    assert sorted((tuple(r) for r in bpe.decode(one, PATH, ["text", "ids"]).collect()), key=str)[0][2] == "Hello world"


def test_benchmark(spark):
    docs = spark.createDataFrame([(1, "some words here", ["a"], 3)] * 2 + [(None, None, None, None)], "doc_id long, text string, items array<string>, n_words long")
    items = spark.createDataFrame([(7, "Words here", 1)], "item_id long, text string, spans int")
    found = contamination(docs, items, ["items", "n_words", "text"])
    assert found.columns == ["items", "n_words", "text", "n_words", "spans", "items", "longest"]
    assert sorted(str(tuple(r)[3]) for r in found.collect()) == ["0", "3", "3"]
    assert [tuple(r) for r in decontaminate(docs, items).collect()] == [(None, None, None, None)]


def test_deduplicated_rows_keep_their_columns(spark):
    columns = "doc_id long, text string, _row_tag int, row_tag int, tag int, d0 string, _tag string, _id int, node string, component string"
    rows = [(1, "some words to keep", 7, 8, 9, "a", "b", 3, "c", "d"), (2, "some words to keep", 17, 18, 19, "a", "b", 13, "c", "d"), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows + rows[:1], columns)
    for f in (exact_dedup, near_dedup, simhash_dedup):
        got = f(docs)
        assert got.schema == docs.schema
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], rows[2]], key=str), f


def test_carried_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "<p>Words", "t", "c")], "page_id long, html string, text string, c0 string")
    assert [tuple(r) for r in extract(pages, ["c0", "text", "html"]).collect()] == [("c", "t", "<p>Words", "Words")]
    docs = spark.createDataFrame([(1, "x" * 500, "s", "k")] * 2, "doc_id long, text string, spans string, kept string")
    assert [(r[0], r[1], r[3]) for r in remove_repeats(docs, ["spans", "kept"]).collect()] == [("s", "k", [(0, 500)])] * 2


def test_languages(spark):
    rows = [(k, "the house and the garden" if k % 2 else "das Haus und der Garten", "en" if k % 2 else "de", "z", "w", 1) for k in range(60)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, word string, score int")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(got) == 61 and sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got if r["doc_id"] is not None) >= 58
