import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup as exact_dedup_module
from graphloom.llm.exact_dedup import exact_dedup, exact_groups

ROWS = [(1, "a b"), (2, "ab"), (None, "a  b "), (None, None), (5, ""), (7, "x"), (7, "x"), (-9, "x"), (4, "y" * 200_000), (3, "y" * 200_000 + "\n")]


@pytest.mark.parametrize("salts", [64, 1])
def test_groups_ties_nulls_and_repeats(spark, salts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, salts=salts).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (1, None, 3, False, sha("ab")) in got and (None, None, 3, True, sha("ab")) in got
    assert (7, -9, 3, False, sha("x")) in got and (-9, -9, 3, True, sha("x")) in got
    assert (4, 3, 2, False, sha("y" * 200_000)) in got and (5, 5, 2, True, sha("")) in got


def test_rows_that_stay_keep_their_form(spark):
    docs = spark.createDataFrame([(*r, "c") for r in ROWS] + [(3, "y" * 200_000 + "\n", "c")], "doc_id long, text string, content string")
    got = sorted(((r.doc_id, r.text, r.content) for r in exact_dedup(docs).collect()), key=str)
    assert got == sorted([(None, "a  b ", "c"), (-9, "x", "c"), (5, "", "c"), (3, "y" * 200_000 + "\n", "c")], key=str)


def test_contents_of_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "digest", lambda content: F.substring(content, 1, 1))
    rows = [(k, f"{'ab'[k % 2]}{k % 5 if k % 2 else 0} ") for k in range(60)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for k, text in rows:
        same = [d for d, t in rows if t == text]
        want.add((k, min(same), len(same), k == min(same)))
    assert got == want


def test_a_hot_group_among_others(spark):
    rows = [(k, "hot text" + " " * (k % 3)) for k in range(300)] + [(1000 + k, f"cold {k // 2}") for k in range(40)]
    got = {r.doc_id: r for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].keep_id == 2 and got[k].group_size == 300 for k in range(300))
    assert all(got[1000 + k].keep_id == 1000 + k // 2 * 2 and got[1000 + k].group_size == 2 for k in range(40))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(docs).count() == 0 and exact_dedup(docs).count() == 0
