from graphloom.plans.query import Query
from graphloom.sources import files
from graphloom.sources.graph import Graph, relational_graph
from graphloom.streaming import maintain

TURTLE = """@prefix ex: <http://e.org/> . # comment
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:Thing ; ex:name "A \\"x\\"" , "B"@en ; ex:size "3"^^xsd:int ; ex:knows ex:b , [ ex:name "blank" ] .
ex:b ex:flag true ; ex:weight 1.5 .
_:z ex:knows ex:a .
"""
XML = """<dblp>
<article key="j/1" mdate="2001"><author>Ann</author><author>Bo</author><title>One</title><journal>J</journal><cite>j/2</cite><year>2001</year></article>
<article key="j/2" mdate="2002"><author>Bo</author><title>Two</title><crossref>j/1</crossref></article>
</dblp>"""
PATTERN = "age:Integer name:String\n0 1\n0\n2\nA 1 2 age>5 name=bo\nB 2 0\n1\nA B 3 1\n"


def test_turtle(spark, tmp_path):
    triples = files.parse_turtle(TURTLE)
    assert ("http://e.org/a", "http://e.org/name", 'A "x"', True) in triples and ("http://e.org/b", "http://e.org/weight", "1.5", True) in triples
    assert ("_:z", "http://e.org/knows", "http://e.org/a", False) in triples and ("_:b1", "http://e.org/name", "blank", True) in triples
    (tmp_path / "t.ttl").write_text(TURTLE)
    g = files.read_turtle(spark, str(tmp_path / "t.ttl"))
    nodes = {r.props["__URI__"]: r for r in g.nodes.collect()}
    assert set(nodes) == {"http://e.org/a", "http://e.org/b", "_:b1", "_:z"} and nodes["http://e.org/a"].labels == ["http://e.org/Thing"]
    assert nodes["http://e.org/a"].props["http://e.org/size"] == "3" and g.edges.count() == 3


def test_bibliography(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    records = files.read_bibliography(spark, str(tmp_path / "d.xml"), "article")
    g = files.bibliography_graph(records)
    assert {tuple(r) for r in g.edges.groupBy("type").count().collect()} == {("WRITTEN_BY", 3), ("CITE_TO", 1), ("IS_CROSSREF_WITH", 1), ("PUBLISHED_IN", 1)}
    assert g.nodes.count() == 5 and ["article", "One", "J"] in [r.labels for r in g.nodes.collect()]


def test_patterns_and_queries(spark, tmp_path):
    p = files.parse_pattern(PATTERN)
    assert p.conditions["A"] == [("age", ">", 5.0), ("name", "=", "bo")] and p.bounds == {("A", "B"): 3} and p.colours == {("A", "B"): 1}
    again = files.parse_pattern(files.format_pattern(p))
    assert (again.bounds, again.weights, again.query.edges) == (p.bounds, p.weights, p.query.edges)
    queries = [Query({"0": "x", "1": "y"}, (("0", "1"),), 4)]
    files.write_queries(spark, queries, [1], str(tmp_path / "q"))
    assert files.read_queries(spark, str(tmp_path / "q" / "stars=1")) == queries
    nodes, edges = files.query_tables(spark, queries)
    assert [tuple(r) for r in edges.collect()] == [(4, "0", "1")] and nodes.count() == 2


def test_graph_files(spark, tmp_path):
    g = Graph.from_rows(spark, [(1, ["a", "b"]), (2, [])], [(1, 2, "t", {"w": "1"})])
    g.write(str(tmp_path / "g"))
    back = Graph.read(spark, str(tmp_path / "g"))
    assert back.edges.first().props == {"w": "1"} and back.node(1).first().labels == ["a", "b"] and back.edge(1, 2).count() == 1
    files.write_graph_csv(g, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c" / "nodes")).filter("`:Label` = 'a;b'").count() == 1
    files.write_answers(g.edges.select("src", "dst"), str(tmp_path / "a"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "a")).count() == 1


def test_synthetic_graph_is_connected_and_repeats(spark):
    from graphloom.operators.structure import components

    g = files.synthetic_graph(spark, 60, 1.5, ["x", "y"], seed=5)
    assert g.edges.count() == 90 and components(g.nodes, g.edges).select("component").distinct().count() == 1
    assert sorted(g.edges.select("src", "dst").collect()) == sorted(files.synthetic_graph(spark, 60, 1.5, ["x", "y"], seed=5).edges.select("src", "dst").collect())


def test_relational_graph(spark):
    g = relational_graph(spark, "/root/testdata/sf0.001")
    assert g.nodes.select("id").distinct().count() == g.nodes.count() == 1890
    assert g.edges.join(g.nodes.selectExpr("id as src"), "src", "left_anti").count() == 0


def test_streams(spark, tmp_path):
    g = Graph.from_rows(spark, [(1, ["alpha"]), (2, ["beta"])], [(1, 2), (1, 2), (2, 2)])
    g.write(str(tmp_path / "g"))
    edges = spark.readStream.schema(g.edges.schema).parquet(str(tmp_path / "g" / "edges"))
    q = maintain.degree_stream(edges, "degrees_now")
    q.processAllAvailable()
    assert {tuple(r) for r in spark.table("degrees_now").select("id", "out_degree", "in_degree").collect()} == {(1, 2, 0), (2, 1, 3)}
    q.stop()
    nodes = spark.readStream.schema(g.nodes.schema).parquet(str(tmp_path / "g" / "nodes"))
    q = maintain.maintain_prefix_index(nodes, str(tmp_path / "idx"), 4, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.prefix, r.id) for r in spark.read.parquet(str(tmp_path / "idx")).collect()} == {("alph", 1), ("beta", 2)}
