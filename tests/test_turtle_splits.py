"""Turtle files that are dealt to many tasks."""

import random

import pytest

from graphloom.sources import files


def turtle(n, seed=2):
    rng = random.Random(seed)
    out = ["@prefix ex: <http://e.org/> .", "@prefix foaf: <http://f.org/> .", "# a comment . [ with marks", ""]
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(f'ex:s{k} a ex:Thing ; ex:name "name . [{k}] \\" and ; more" ; ex:size {k}.5 .')
        elif kind == 1:
            out += [f"ex:s{k}", "    ex:knows ex:s1 ,", f"        ex:s{max(0, k - 3)} ;", "    foaf:see _:z", "."]
        elif kind == 2:
            out.append(f"ex:s{k} ex:has [ ex:name \"b{k}\" ; ex:in [ ex:n {k} ] ] . ex:t{k} ex:p ex:q.")
        elif kind == 3:
            out.append(f"[ ex:name \"alone {k}\" ] ex:knows ex:s{k} .")
        elif kind == 4:
            out += ["", f"<http://x.org/{k}#frag> ex:p \"v\"^^ex:type , \"w\"@en .   # said . so"]
        else:
            out += [f"ex:s{k} ex:long", *[f"    ex:o{j} ," for j in range(rng.randrange(30))], f"    _:b{k}x", "  . ex:u ex:v ex:w ."]
    return "\n".join(out) + "\n"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in (("spark.sql.files.maxPartitionBytes", str(size)), ("spark.sql.files.openCostInBytes", "0"))]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [10**8, 900, 257, 31])
def test_parts_give_the_triples_of_the_whole(spark, tmp_path, small_splits, size):
    text = turtle(40 if size < 100 else 120)
    (tmp_path / "t.ttl").write_text(text)
    small_splits(size)
    got = files.turtle_triples(spark, str(tmp_path / "t.ttl"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(files.parse_turtle(text))
    parts = spark.read.text(str(tmp_path / "t.ttl")).rdd.getNumPartitions()
    assert parts > 8 or size > 10**6


def test_several_files_and_files_that_are_parsed_whole(spark, tmp_path, small_splits):
    one = "@prefix ex: <http://e.org/> .\nex:a ex:p [ ex:q 1 ] .\nex:a ex:p _:z .\n"
    two = "PREFIX ex: <http://e.org/>\nex:b ex:p _:z .\n@prefix ex: <http://other.org/> .\nex:b ex:p ex:c .\n"
    three = '@prefix ex: <http://e.org/> .\nex:d ex:name "two\nlines . here" .\n'
    for name, text in (("1.ttl", one), ("2.ttl", two), ("3.ttl", three), ("4.ttl", "")):
        (tmp_path / name).write_text(text)
    small_splits(20)
    got = {tuple(r) for r in files.turtle_triples(spark, str(tmp_path)).collect()}
    assert ("http://other.org/b", "http://e.org/p", "http://other.org/c", False) not in got
    assert ("http://other.org/b", "http://other.org/p", "http://other.org/c", False) in got
    assert ("http://e.org/d", "http://e.org/name", "two\nlines . here", True) in got
    blanks = {x for s, _, o, literal in got for x in (s, "" if literal else o) if x.startswith("_:")}
    assert len(blanks) == 3 and len(got) == 6
    g = files.read_turtle(spark, str(tmp_path))
    assert g.nodes.count() == len({x for s, _, o, literal in got for x in [s, *([] if literal else [o])]})
    assert files.turtle_triples(spark, str(tmp_path / "4.ttl")).count() == 0
