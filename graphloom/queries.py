"""The registered graph queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import similarity as fn
from graphloom.operators import hublabels, indexes, matching, mining, stats, structure, traversal, workload
from graphloom.operators.iterate import shared_dir
from graphloom.plans import learned
from graphloom.plans.anytime import AnytimeEngine, round_robin
from graphloom.plans.query import Plan, Query, Star, format_query, make_plan, non_star, runnable
from graphloom.plans.threshold import ThresholdSearch
from graphloom.plans.topk import Matcher, candidate_counts, candidates
from graphloom.sources.files import synthetic_graph, turtle_triples
from graphloom.sources.graph import Graph, relational_graph, subgraph_of_kinds

Call = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Call] = {}
ORACLE: dict[str, str] = {}
PREFIX, THETA, K = 4, 0.3, 10

NODES = """
    SELECT 1000000000 + r_regionkey::BIGINT AS id, [r_name] AS labels, 1 AS kind FROM region
    UNION ALL SELECT 2000000000 + n_nationkey::BIGINT, [n_name], 2 FROM nation
    UNION ALL SELECT 3000000000 + c_custkey::BIGINT, [c_name, c_mktsegment], 3 FROM customer
    UNION ALL SELECT 4000000000 + s_suppkey::BIGINT, [s_name], 4 FROM supplier"""
NODES_ALL = NODES + """
    UNION ALL SELECT 5000000000 + p_partkey::BIGINT, [p_name, p_brand, p_type], 5 FROM part
    UNION ALL SELECT 6000000000 + o_orderkey::BIGINT, [o_orderpriority, o_orderstatus], 6 FROM orders"""
EDGES = """
    SELECT 10000000000000 + n_nationkey::BIGINT AS eid, 2000000000 + n_nationkey::BIGINT AS src, 1000000000 + n_regionkey::BIGINT AS dst, 'IN_REGION' AS type FROM nation
    UNION ALL SELECT 20000000000000 + c_custkey::BIGINT, 3000000000 + c_custkey::BIGINT, 2000000000 + c_nationkey::BIGINT, 'IN_NATION' FROM customer
    UNION ALL SELECT 30000000000000 + s_suppkey::BIGINT, 4000000000 + s_suppkey::BIGINT, 2000000000 + s_nationkey::BIGINT, 'IN_NATION' FROM supplier"""
EDGES_ALL = EDGES + """
    UNION ALL SELECT 40000000000000 + o_orderkey::BIGINT, 6000000000 + o_orderkey::BIGINT, 3000000000 + o_custkey::BIGINT, 'PLACED_BY' FROM orders
    UNION ALL SELECT 50000000000000 + l_orderkey::BIGINT * 10 + l_linenumber, 6000000000 + l_orderkey::BIGINT, 5000000000 + l_partkey::BIGINT, 'CONTAINS' FROM lineitem
    UNION ALL SELECT 60000000000000 + l_partkey * 100000 + l_suppkey, 5000000000 + l_partkey, 4000000000 + l_suppkey, 'SUPPLIED_BY' FROM (SELECT DISTINCT l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey FROM lineitem)"""
PROPS = """
    SELECT 3000000000 + c_custkey::BIGINT AS id, 'acctbal' AS property, floor(c_acctbal)::BIGINT::VARCHAR AS value FROM customer
    UNION ALL SELECT 4000000000 + s_suppkey::BIGINT, 'acctbal', floor(s_acctbal)::BIGINT::VARCHAR FROM supplier
    UNION ALL SELECT 5000000000 + p_partkey::BIGINT, 'size', p_size::VARCHAR FROM part
    UNION ALL SELECT 5000000000 + p_partkey::BIGINT, 'price', floor(p_retailprice)::BIGINT::VARCHAR FROM part
    UNION ALL SELECT 6000000000 + o_orderkey::BIGINT, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders"""
LARGE = f"WITH RECURSIVE nodes AS ({NODES_ALL}), edges AS ({EDGES_ALL}), "
BOTH_WAYS = "steps AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), "


def query(sql: str | None = None) -> Callable[[Call], Call]:
    def add(f: Call) -> Call:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def large(spark: SparkSession, sf_dir: str) -> Graph:
    return relational_graph(spark, sf_dir)


# Indexes and statistics


@query(LARGE + f"t AS (SELECT DISTINCT id, substr(label, 1, {PREFIX}) AS prefix FROM (SELECT id, unnest(labels) AS label FROM nodes) WHERE length(label) >= {PREFIX}) SELECT prefix, count(*) AS n_nodes, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY prefix")
def label_prefix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.prefix_index(large(spark, sf_dir).nodes, PREFIX)


@query(LARGE + "t AS (SELECT DISTINCT id, unnest(labels) AS label FROM nodes) SELECT label, count(*) AS n_nodes FROM t GROUP BY label")
def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.label_frequency(large(spark, sf_dir).nodes)


@query(LARGE + "t AS (SELECT id, unnest(labels) AS label FROM nodes), f AS (SELECT label, count(*) AS frequency FROM t WHERE length(label) >= 4 AND label NOT LIKE 'http://%' GROUP BY label) SELECT frequency, count(*) AS n_labels FROM f GROUP BY frequency")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.frequency_histogram(indexes.term_frequency(large(spark, sf_dir).nodes))


@query(LARGE + "t AS (SELECT DISTINCT id, unnest(labels) AS label FROM nodes) SELECT DISTINCT id FROM t WHERE label IN ('ASIA', 'BUILDING', '1-URGENT')")
def ids_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.ids_with_labels(large(spark, sf_dir).nodes, ["ASIA", "BUILDING", "1-URGENT"])


@query(f"WITH p AS ({PROPS}) SELECT property, count(*) AS n_nodes, count(DISTINCT value) AS n_values FROM p GROUP BY property")
def property_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.property_stats(large(spark, sf_dir).nodes)


@query(f"WITH p AS ({PROPS}) SELECT value, count(DISTINCT id) AS n_owners, min(id) AS first_owner FROM p GROUP BY value")
def property_value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.value_index(large(spark, sf_dir).nodes)


@query("SELECT l_returnflag AS value, count(DISTINCT l_orderkey::BIGINT * 10 + l_linenumber) AS n_owners, min(50000000000000 + l_orderkey::BIGINT * 10 + l_linenumber) AS first_owner FROM lineitem GROUP BY l_returnflag")
def edge_property_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.value_index(large(spark, sf_dir).edges, "eid")


@query(f"WITH p AS ({PROPS}) SELECT id FROM p WHERE property IN ('size', 'price') GROUP BY id HAVING count(DISTINCT property) = 2")
def nodes_with_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.nodes_with_all_keys(large(spark, sf_dir).nodes, ["size", "price"])


@query(LARGE + "t AS (SELECT DISTINCT src, dst FROM edges) SELECT src AS id, count(*) AS n, min(dst) AS first_neighbour FROM t GROUP BY src")
def neighbor_index_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indexes.neighbours(large(spark, sf_dir).edges, outgoing=True)
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first_neighbour"))


@query(LARGE + "t AS (SELECT DISTINCT src, dst FROM edges) SELECT dst AS id, count(*) AS n, min(src) AS first_neighbour FROM t GROUP BY dst")
def neighbor_index_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indexes.neighbours(large(spark, sf_dir).edges, outgoing=False)
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("neighbour").alias("first_neighbour"))


DEGREES = """o AS (SELECT src AS id, count(*) AS d, count(DISTINCT dst) AS n FROM edges GROUP BY src), i AS (SELECT dst AS id, count(*) AS d, count(DISTINCT src) AS n FROM edges GROUP BY dst),
    deg AS (SELECT nodes.id, coalesce(i.d, 0) AS in_degree, coalesce(o.d, 0) AS out_degree, coalesce(i.n, 0) AS in_neighbours, coalesce(o.n, 0) AS out_neighbours, coalesce(i.d, 0) + coalesce(o.d, 0) AS degree
            FROM nodes LEFT JOIN o ON o.id = nodes.id LEFT JOIN i ON i.id = nodes.id) """


@query(LARGE + DEGREES + "SELECT * FROM deg")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return indexes.degrees(g.nodes, g.edges)


@query(LARGE + DEGREES + "SELECT min(degree) AS min_degree, floor(avg(degree))::BIGINT AS avg_degree, max(degree) AS max_degree FROM deg")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degree_stats(large(spark, sf_dir))


@query(LARGE + "x AS (SELECT 1) SELECT id, row_number() OVER (ORDER BY id) - 1 AS dense_id FROM nodes")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.dense_ids(large(spark, sf_dir).nodes)


@query(LARGE + "n AS (SELECT count(*) AS n_nodes FROM nodes), e AS (SELECT count(*) AS n_edges FROM edges) SELECT n_nodes, n_edges, round(n_edges::DOUBLE / n_nodes / (n_nodes - 1), 12) AS density FROM n, e")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density(large(spark, sf_dir))


@query(LARGE + "x AS (SELECT 1) SELECT type, count(*) AS n_edges FROM edges GROUP BY type")
def rel_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_counts(large(spark, sf_dir).edges)


@query(LARGE + "t AS (SELECT eid, type, src AS id FROM edges UNION ALL SELECT eid, type, dst FROM edges WHERE src <> dst) SELECT id, count(DISTINCT type) AS n_types, count(*) AS n_edges FROM t GROUP BY id")
def rel_types_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.types_per_node(large(spark, sf_dir))


@query(LARGE + f"""p AS ({PROPS}) SELECT 'nodes' AS key, count(*) AS cnt FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges
    UNION ALL SELECT 'distinct_labels', count(DISTINCT label) FROM (SELECT unnest(labels) AS label FROM nodes) UNION ALL SELECT 'distinct_properties', count(DISTINCT property) FROM p
    UNION ALL SELECT 'distinct_types', count(DISTINCT type) FROM edges UNION ALL SELECT 'nodes_with_labels_' || len(labels), count(*) FROM nodes GROUP BY len(labels)
    UNION ALL SELECT 'property_' || property, count(*) FROM p GROUP BY property""")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_stats(large(spark, sf_dir))


MAX_LABEL = """own AS (SELECT DISTINCT id, unnest(labels) AS label FROM nodes), fr AS (SELECT label, count(*) AS frequency FROM own GROUP BY label),
    best AS (SELECT id, label, frequency FROM (SELECT id, own.label, frequency, row_number() OVER (PARTITION BY id ORDER BY frequency DESC, own.label) AS r FROM own JOIN fr ON own.label = fr.label) WHERE r = 1) """


@query(LARGE + MAX_LABEL + "SELECT id, label, frequency FROM best")
def most_frequent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_frequent_label(large(spark, sf_dir).nodes)


# Functions


def _lev(a: str, b: str) -> str:
    return f"(1 - levenshtein(lower({a}), lower({b}))::DOUBLE / greatest(length({a}), length({b})))"


@query(f"SELECT p_partkey::BIGINT AS p_partkey, round(greatest(0, {_lev("'small widget'", 'p_name')}), 9) AS sim, round(greatest(0, {_lev("'STANDARD TIN'", 'p_type')}), 9) AS type_sim FROM part")
def label_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sim = lambda q, c: F.round(F.greatest(F.lit(0.0), fn.lev_norm(F.lit(q), F.col(c))), 9)
    return part.select(F.col("p_partkey").cast("long").alias("p_partkey"), sim("small widget", "p_name").alias("sim"), sim("STANDARD TIN", "p_type").alias("type_sim"))


def sim_sql(label: str) -> str:
    return f"list_sum(list_transform(labels, lambda l: greatest(0.0, 1 - levenshtein(lower('{label}'), lower(l))::DOUBLE / greatest(length('{label}'), length(l))))) / len(labels)"


@query(LARGE + f"x AS (SELECT 1) SELECT id, round({sim_sql('Customer#000000012')}, 9) AS sim FROM nodes WHERE kind = 3")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = subgraph_of_kinds(large(spark, sf_dir), ["customer"]).nodes
    return nodes.select("id", F.round(fn.label_similarity(F.lit("Customer#000000012"), fn.node_terms()), 9).alias("sim"))


@query("""WITH w AS (SELECT p_partkey::BIGINT AS p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct(string_split(p_name, ' ')) AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM w""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.round(fn.jaccard(F.split("p_type", " "), F.split("p_name", " ")), 9).alias("jaccard"))


def _signature_sql(items: str) -> str:
    digest = "('0x' || substr(md5(x), 1, 7))::BIGINT"
    return f"list_transform(family, lambda f: list_min(list_transform({items}, lambda x: ({digest} * f.a + f.b) % {fn.MERSENNE})))"


@query(
    f"WITH f AS (SELECT [{', '.join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in fn.minhash_family(100))}] AS family), "
    "w AS (SELECT p_partkey::BIGINT AS p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part), "
    f"s AS (SELECT p_partkey, a, b, {_signature_sql('a')} AS sa, {_signature_sql('b')} AS sb FROM w, f) "
    "SELECT p_partkey, len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2]))::DOUBLE / 100 AS estimate, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM s"
)
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"))
    return part.select("p_partkey", fn.minhash_similarity(fn.minhash(F.col("a")), fn.minhash(F.col("b"))).alias("estimate"), F.round(fn.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("""SELECT page_id::BIGINT AS page_id, CASE WHEN url LIKE 'http://dbpedia.org/resource/%' THEN 'dbp_uri_' || substr(url, 29) ELSE regexp_replace(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), ''), '^www\\.', '') END AS short FROM pages""")
def uri_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), fn.short_uri(F.col("url")).alias("short"))


@query("SELECT vec_id::BIGINT AS vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS square, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 2 * x + x - 1)), 5) AS total FROM embeddings")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product, sum, difference and scaling of vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ones = F.transform(v, lambda _: F.lit(1.0))
    combined = fn.vector_difference(fn.vector_sum(fn.scaled(v, 2.0), v), ones)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.round(fn.dot(v, v), 5).alias("square"), F.round(fn.dot(combined, ones), 5).alias("total"))


@query("""WITH a AS (SELECT l_orderkey::BIGINT AS l_orderkey, list_sort(list(l_extendedprice::DOUBLE)) AS v FROM lineitem GROUP BY l_orderkey),
    k AS (SELECT *, CASE len(v) WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 4 ELSE len(v) - 5 END AS keep FROM a)
    SELECT l_orderkey, round(list_sum(v[1:keep]) / keep, 4) AS trimmed, v[2] AS second FROM k""")
def order_line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order's prices the mean of the smallest, by the rule for repeated timings, and the second smallest."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey"))
    values = lines.agg(F.collect_list(F.col("l_extendedprice").cast("double")).alias("v"))  # an order's lines are few
    return values.select("l_orderkey", F.round(fn.trimmed_mean(F.col("v")), 4).alias("trimmed"), fn.kth_smallest(F.col("v"), 2).alias("second"))


TURTLE = "http://shop.example/"


@query(f"""WITH c AS (SELECT '{TURTLE}customer/' || c_custkey::BIGINT AS s, * FROM customer)
    SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{TURTLE}Customer' AS o, false AS literal FROM c
    UNION ALL SELECT s, '{TURTLE}name', c_name, true FROM c UNION ALL SELECT s, '{TURTLE}segment', c_mktsegment, true FROM c
    UNION ALL SELECT s, '{TURTLE}nation', '{TURTLE}nation/' || c_nationkey::BIGINT, false FROM c""")
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers written as Turtle, and the triples read back from parts of those files."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    text = F.concat(
        F.lit(f"@prefix s: <{TURTLE}> .\n<{TURTLE}customer/"), F.col("c_custkey").cast("long"), F.lit("> a s:Customer ;\n  s:name "), quoted(F.col("c_name")),
        F.lit(" ;\n  s:segment "), quoted(F.col("c_mktsegment")), F.lit(f" ; s:nation <{TURTLE}nation/"), F.col("c_nationkey").cast("long"), F.lit("> ."),
    )
    path = f"{shared_dir(spark)}/turtle-{uuid.uuid4().hex}"
    c.select(text.alias("value")).write.text(path)
    return turtle_triples(spark, path)


# Top-k subgraph queries

STAR = Query({"0": "1-URGENT", "1": "Customer#000000012", "2": "small widget"}, (("0", "1"), ("0", "2")))
CHAIN = Query({"0": "1-URGENT", "1": "Customer#000000012", "2": "small widget", "3": "Supplier#000000001", "4": "NATION_7"}, (("0", "1"), ("0", "2"), ("2", "3"), ("3", "4")))
SHAPE = Query({"0": "", "1": "", "2": "", "3": ""}, (("0", "1"), ("1", "2"), ("3", "2")))


def cand_sql(q: str, label: str) -> str:
    blocked = f"len(list_filter(labels, lambda l: substr(l, 1, {PREFIX}) = '{label[:PREFIX]}')) > 0"
    return f"c{q} AS (SELECT id, sim FROM (SELECT id, {sim_sql(label)} AS sim FROM nodes WHERE {blocked}) WHERE sim > {THETA})"


def match_sql(qids: list[str], edges: list[tuple[str, str]], distinct: bool = True) -> str:
    """FROM and WHERE of all injective matches of candidates along edges."""
    source, seen = [], []
    for a, b in edges:
        if not seen:
            source.append(f"c{a}")
            seen.append(a)
        ab, new = (f"arcs a{a}_{b}", b) if a in seen else (f"arcs a{a}_{b}", a)
        on = f"a{a}_{b}.src = c{a}.id" if a in seen else f"a{a}_{b}.dst = c{b}.id"
        source.append(f"JOIN {ab} ON {on}")
        if new not in seen:
            source.append(f"JOIN c{new} ON c{new}.id = a{a}_{b}.{'dst' if new == b else 'src'}")
            seen.append(new)
    unequal = " AND ".join(f"c{a}.id <> c{b}.id" for a, b in combinations(qids, 2)) or "true"
    return f"FROM {' '.join(source) or 'c' + qids[0]} WHERE {unequal if distinct else 'true'}"


def topk_sql(query: Query, k: int) -> str:
    ids = query.ids
    score = "round(" + " + ".join(f"c{q}.sim" for q in ids) + ", 6)"
    order = "score DESC, " + ", ".join(f"q{q} DESC" for q in ids)
    cands = ", ".join(cand_sql(q, label) for q, label in query.labels.items())
    return (
        LARGE + f"arcs AS (SELECT DISTINCT src, dst FROM edges), {cands}, r AS (SELECT {', '.join(f'c{q}.id AS q{q}' for q in ids)}, {score} AS score {match_sql(ids, matching.edge_order(query))} ORDER BY {order} LIMIT {k}) "
        f"SELECT row_number() OVER (ORDER BY {order}) AS rank, {', '.join(f'q{q}' for q in ids)}, score FROM r"
    )


@query(LARGE + ", ".join(cand_sql(q, label) for q, label in CHAIN.labels.items()) + " " + " UNION ALL ".join(f"SELECT '{q}' AS qid, count(*) AS n FROM c{q} HAVING count(*) > 0" for q in CHAIN.labels))
def candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_counts(candidates(large(spark, sf_dir), CHAIN, PREFIX, THETA))


@query(topk_sql(STAR, K))
def star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Matcher(large(spark, sf_dir), STAR, PREFIX, THETA).top(K)


@query(topk_sql(CHAIN, K))
def multi_star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Matcher(large(spark, sf_dir), CHAIN, PREFIX, THETA).top(K)


def fixed_star(m: Matcher, star: Star) -> Star:
    """Uses a given decomposition, so that the oracle's need not repeat the greedy choice."""
    m.plan = make_plan(m.query, [star])
    return star


STAR_OF = Star("0", STAR.edges)


@query(topk_sql(STAR, K))
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers with candidates from a stored prefix index in place of a scan of all nodes."""
    g = large(spark, sf_dir)
    index = indexes.PrefixIndex.build(g.nodes, PREFIX, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    return Matcher(g, STAR, PREFIX, THETA, index=index).top(K)


@query(topk_sql(STAR, K))
def threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from sorted lists of candidates, read until the threshold ends the search."""
    return ThresholdSearch(Matcher(large(spark, sf_dir), STAR, PREFIX, THETA)).top(K)[0]


@query(topk_sql(STAR, K))
def pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from one star of two leaves, of which each pivot keeps its best only."""
    m = Matcher(large(spark, sf_dir), STAR, PREFIX, THETA)
    fixed_star(m, STAR_OF)
    return m.top(K)


@query(LARGE + "arcs AS (SELECT DISTINCT src, dst FROM edges), " + ", ".join(cand_sql(q, label) for q, label in STAR.labels.items()) + f""",
    r AS (SELECT c0.id AS q0, c1.id AS q1, c2.id AS q2, round(c0.sim + c1.sim + c2.sim, 6) AS score {match_sql(STAR.ids, list(STAR.edges))})
    SELECT q0, q1, q2, score FROM (SELECT *, row_number() OVER (PARTITION BY q0 ORDER BY score DESC, q0 DESC, q1 DESC, q2 DESC) AS n FROM r) WHERE n = 1""")
def star_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Matcher(large(spark, sf_dir), STAR, PREFIX, THETA)
    return m.best_per_pivot(fixed_star(m, STAR_OF))


@query(LARGE + "arcs AS (SELECT DISTINCT src, dst FROM edges), " + ", ".join(cand_sql(q, label) for q, label in STAR.labels.items()) + """,
    x AS (SELECT c0.id, count(*) AS n FROM c0 JOIN arcs ON src = c0.id JOIN c1 ON c1.id = dst WHERE c1.id <> c0.id GROUP BY c0.id),
    y AS (SELECT c0.id, count(*) AS n FROM c0 JOIN arcs ON src = c0.id JOIN c2 ON c2.id = dst WHERE c2.id <> c0.id GROUP BY c0.id)
    SELECT coalesce(sum(x.n * y.n), 0)::BIGINT AS pa_estimate, count(*) AS n_pivots, round(coalesce(avg(x.n + y.n), 0), 6) AS avg_degree FROM x JOIN y USING (id)""")
def star_pa_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Matcher(large(spark, sf_dir), STAR, PREFIX, THETA)
    return m.estimate(fixed_star(m, STAR_OF))


CHAIN_STARS = [Star("0", (("0", "1"), ("0", "2"))), Star("3", (("2", "3"), ("3", "4")))]


def anytime_sql(query: Query, plan: Plan, k: int) -> str:
    parts = []
    sets = [[s] for s in plan.stars] + [plan.stars[:m] for m in range(2, len(plan.stars) + 1)]
    for stars in sets:
        covered = list(dict.fromkeys(q for s in stars for q in s.nodes))
        edges = [e for s in stars for e in s.edges]
        score = "round(" + " + ".join(f"c{q}.sim" for q in covered) + ", 6)"
        columns = ", ".join(f"{f'c{q}.id' if q in covered else 'NULL::BIGINT'} AS q{q}" for q in query.ids)
        order = matching.edge_order(Query({q: "" for q in covered}, tuple(edges)))
        parts.append(f"SELECT {columns}, {score} AS score, round({score} + {len(covered) + len(edges)}, 6) AS anytime, {len(covered)}::BIGINT AS nodes, {len(edges)}::BIGINT AS edges {match_sql(covered, order)}")
    order = "anytime DESC, score DESC, " + ", ".join(f"q{q} DESC NULLS LAST" for q in query.ids)
    cands = ", ".join(cand_sql(q, label) for q, label in query.labels.items())
    return LARGE + f"arcs AS (SELECT DISTINCT src, dst FROM edges), {cands}, r AS ({' UNION ALL '.join(parts)}), t AS (SELECT * FROM r ORDER BY {order} LIMIT {k}) SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM t"


@query(anytime_sql(CHAIN, make_plan(CHAIN, CHAIN_STARS), 20))
def anytime_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Matcher(large(spark, sf_dir), CHAIN, PREFIX, THETA)
    m.plan = make_plan(CHAIN, CHAIN_STARS)
    return m.top_anytime(20)


@query(topk_sql(STAR, 5))
def anytime_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AnytimeEngine(Matcher(large(spark, sf_dir), STAR, PREFIX, THETA), 5).run(round_robin(200))[0]


@query(anytime_sql(CHAIN, make_plan(CHAIN, CHAIN_STARS), 20))
def anytime_partial_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and partial answers by turns, until no plan node's bound reaches the least of the best."""
    m = Matcher(large(spark, sf_dir), CHAIN, PREFIX, THETA)
    m.plan = make_plan(CHAIN, CHAIN_STARS)
    return AnytimeEngine(m, 20).run(round_robin(2000), partial=True)[0]


@query(LARGE + DEGREES + """, arcs AS (SELECT DISTINCT src, dst FROM edges),
    c0 AS (SELECT id FROM deg WHERE out_neighbours >= 1), c1 AS (SELECT id FROM deg WHERE in_neighbours >= 1 AND out_neighbours >= 1), c2 AS (SELECT id FROM deg WHERE in_neighbours >= 2), c3 AS (SELECT id FROM deg WHERE out_neighbours >= 1),
    r AS (SELECT c0.id AS q0, c1.id AS q1, c2.id AS q2, c3.id AS q3, 4.0::DOUBLE AS score FROM c0 JOIN arcs x ON x.src = c0.id JOIN c1 ON c1.id = x.dst JOIN arcs y ON y.src = c1.id JOIN c2 ON c2.id = y.dst JOIN arcs z ON z.dst = c2.id JOIN c3 ON c3.id = z.src
          WHERE c0.id <> c1.id AND c0.id <> c2.id AND c0.id <> c3.id AND c1.id <> c2.id AND c1.id <> c3.id AND c2.id <> c3.id ORDER BY score DESC, q0 DESC, q1 DESC, q2 DESC, q3 DESC LIMIT 15)
    SELECT row_number() OVER (ORDER BY score DESC, q0 DESC, q1 DESC, q2 DESC, q3 DESC) AS rank, q0, q1, q2, q3, score FROM r""")
def structural_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Matcher(large(spark, sf_dir), SHAPE, structural=True).top(15)


# Exact matching and simulation

EXACT = Query({"0": "1-URGENT", "1": "BUILDING", "2": "NATION_7", "3": "", "4": ""}, (("0", "1"), ("1", "2"), ("0", "3"), ("3", "4"), ("4", "2")))
TREE = Query({"0": "1-URGENT", "1": "BUILDING", "2": "NATION_7"}, (("0", "1"), ("1", "2")))


def exact_cands(query: Query) -> str:
    return ", ".join(f"c{q} AS (SELECT id FROM nodes{f" WHERE list_contains(labels, '{label}')" if label else ''})" for q, label in query.labels.items())


EXACT_SQL = LARGE + f"arcs AS (SELECT DISTINCT src, dst FROM edges), {exact_cands(EXACT)}, m AS (SELECT {', '.join(f'c{q}.id AS q{q}' for q in EXACT.ids)} FROM c0 JOIN arcs a ON a.src = c0.id JOIN c1 ON c1.id = a.dst JOIN arcs b ON b.src = c1.id JOIN c2 ON c2.id = b.dst JOIN arcs c ON c.src = c0.id JOIN c3 ON c3.id = c.dst JOIN arcs d ON d.src = c3.id JOIN c4 ON c4.id = d.dst JOIN arcs e ON e.src = c4.id AND e.dst = c2.id WHERE {' AND '.join(f'c{a}.id <> c{b}.id' for a, b in combinations(EXACT.ids, 2))}) "


@query(EXACT_SQL + "SELECT * FROM m")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_match(large(spark, sf_dir), EXACT)


@query(EXACT_SQL + "SELECT least(count(DISTINCT q0), count(DISTINCT q1), count(DISTINCT q2), count(DISTINCT q3), count(DISTINCT q4)) AS support FROM m")
def mni_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.support(exact_match(spark, sf_dir))


@query(EXACT_SQL + "SELECT count(*) AS coverage FROM (SELECT q0 FROM m UNION SELECT q1 FROM m UNION SELECT q2 FROM m UNION SELECT q3 FROM m UNION SELECT q4 FROM m)")
def match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.coverage(exact_match(spark, sf_dir))


@query(EXACT_SQL.rstrip() + ", f AS (SELECT row_number() OVER () AS r, unnest([q0, q1, q2, q3, q4]) AS id FROM m) SELECT id, count(DISTINCT r) AS frequency FROM f GROUP BY id")
def answer_node_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exact_match(spark, sf_dir)
    return stats.node_frequency(m, m.columns)


SIM = LARGE + f"arcs AS (SELECT DISTINCT src, dst FROM edges), {exact_cands(TREE)}, s2 AS (SELECT id FROM c2), s1 AS (SELECT id FROM c1 WHERE EXISTS (SELECT 1 FROM arcs WHERE src = c1.id AND dst IN (SELECT id FROM s2))), s0 AS (SELECT id FROM c0 WHERE EXISTS (SELECT 1 FROM arcs WHERE src = c0.id AND dst IN (SELECT id FROM s1))), sim AS (SELECT '0' AS qid, id FROM s0 UNION ALL SELECT '1', id FROM s1 UNION ALL SELECT '2', id FROM s2) "


@query(SIM + "SELECT qid, id FROM sim")
def simulation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.simulation(large(spark, sf_dir), TREE)


@query(SIM + "SELECT qid, count(*) AS n_nodes FROM sim GROUP BY qid")
def simulation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.set_sizes(matching.simulation(large(spark, sf_dir), TREE))


@query(SIM + "SELECT round(3 * count(DISTINCT id)::DOUBLE / (SELECT count(*) FROM nodes), 9) AS interestingness FROM sim")
def interestingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return matching.interestingness(matching.simulation(g, TREE), TREE, g.nodes.count())


@query(SIM + "SELECT DISTINCT src, dst FROM arcs JOIN sim a ON a.id = src JOIN sim b ON b.id = dst WHERE (a.qid = '0' AND b.qid = '1') OR (a.qid = '1' AND b.qid = '2')")
def simulation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return matching.result_edges(g, TREE, matching.simulation(g, TREE))


@query(EXACT_SQL + "SELECT * FROM m")
def exact_match_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With candidates of too few neighbours dropped first."""
    return matching.exact_match(large(spark, sf_dir), EXACT, ahead=True)


@query(SIM + ", r AS (SELECT DISTINCT src, dst FROM arcs JOIN sim a ON a.id = src JOIN sim b ON b.id = dst WHERE (a.qid = '0' AND b.qid = '1') OR (a.qid = '1' AND b.qid = '2')), "
    "steps AS (SELECT src AS u, dst AS v FROM r UNION SELECT dst, src FROM r), reach(id, c) USING KEY (id) AS (SELECT u, u FROM steps UNION SELECT v, min(p.c) FROM reach p JOIN steps ON u = p.id JOIN recurring.reach k ON k.id = v WHERE k.c > p.c GROUP BY v) "
    "SELECT c AS component, count(DISTINCT reach.id) AS n_nodes, (SELECT count(*) FROM r JOIN reach x ON x.id = r.src WHERE x.c = reach.c) AS n_edges FROM reach GROUP BY c")
def result_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return matching.result_components(matching.result_edges(g, TREE, matching.simulation(g, TREE)))


CARDINALITY = SIM.rstrip() + ", steps AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), k0 AS (SELECT qid, id FROM sim)"
for _k in range(1, 9):
    CARDINALITY += f", k{_k} AS (SELECT qid, id FROM k{_k - 1} WHERE id IN (SELECT u FROM steps WHERE v IN (SELECT id FROM k{_k - 1}) GROUP BY u HAVING count(*) BETWEEN 1 AND 5))"


@query(CARDINALITY + " SELECT qid, id FROM k8")
def simulation_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulation's nodes with one to five neighbours among themselves, until none goes."""
    g = large(spark, sf_dir)
    ways = traversal.undirected(g.edges).toDF("src", "dst")
    return matching.edge_cardinality(matching.simulation(g, TREE), ways, 1, 5)


@query(SIM + "SELECT qid, id FROM sim")
def simulation_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started from the sets of its first edge's pattern."""
    g = large(spark, sf_dir)
    parent = Query({"0": "1-URGENT", "1": "BUILDING"}, (("0", "1"),))
    start = matching.simulation(g, parent).unionByName(indexes.ids_with_labels(g.nodes, ["NATION_7"]).select(F.lit("2").alias("qid"), "id"))
    return matching.simulation(g, TREE, inherited=start)


@query(LARGE + "arcs AS (SELECT DISTINCT src, dst FROM edges), m AS (SELECT id FROM nodes WHERE kind = 5 AND id IN (SELECT 5000000000 + p_partkey FROM part WHERE p_size > 25 AND floor(p_retailprice) < 1500)) SELECT c.id AS q0, m.id AS q1 FROM arcs JOIN m ON m.id = dst JOIN (SELECT id FROM nodes WHERE list_contains(labels, '1-URGENT')) c ON c.id = src")
def attribute_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicate = matching.attribute_predicate([("size", ">", 25), ("price", "<", 1500)])
    return matching.exact_match(large(spark, sf_dir), Query({"0": "1-URGENT", "1": ""}, (("0", "1"),)), {"1": predicate})


@query("SELECT DISTINCT id FROM (SELECT 6000000000 + l_orderkey::BIGINT AS id FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 5000000000 + l_partkey::BIGINT FROM lineitem WHERE l_returnflag = 'R')")
def edge_property_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nodes_with_edge_property(large(spark, sf_dir), "flag", "R")


@query("SELECT DISTINCT 6000000000 + l_orderkey::BIGINT AS src, 5000000000 + l_partkey::BIGINT AS dst FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def edge_property_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return matching.successors_by_property(g, indexes.ids_with_labels(g.nodes, ["1-URGENT"]), "flag", "A")


# Whole-graph algorithms

# Searches keep one row per node, improved from round to round, so that recursive SQL covers the whole graph.
DIST = BOTH_WAYS + """reach(id, d) USING KEY (id) AS (SELECT 1000000000::BIGINT, 0
    UNION SELECT v, min(r.d) + 1 FROM reach r JOIN steps ON u = r.id LEFT JOIN recurring.reach k ON k.id = v WHERE k.id IS NULL GROUP BY v) """


@query(LARGE + DIST + "SELECT 1000000000::BIGINT AS src, id AS dst, d FROM reach")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.hop_distance(large(spark, sf_dir).edges, 10**9)


@query(LARGE + DIST + "SELECT id, id IN (SELECT id FROM reach) AS reachable FROM nodes")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected reachability of every node from one, by component labels."""
    comp = connected_components(spark, sf_dir)
    mine = comp.filter(F.col("id") == 10**9).select("component", F.lit(True).alias("reachable"))
    return comp.join(mine, "component", "left").select("id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@query(LARGE + BOTH_WAYS + """reach(id, c) USING KEY (id) AS (SELECT id, id FROM nodes
    UNION SELECT v, min(r.c) FROM reach r JOIN steps ON u = r.id JOIN recurring.reach k ON k.id = v WHERE k.c > r.c GROUP BY v) SELECT id, c AS component FROM reach""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.components(g.nodes, g.edges)


@query(LARGE + "k1 AS (SELECT DISTINCT src, dst FROM edges), k AS (SELECT 6000000001::BIGINT AS dst, 0 AS d UNION ALL SELECT dst, 1 FROM k1 WHERE src = 6000000001 UNION ALL SELECT b.dst, 2 FROM k1 a JOIN k1 b ON a.dst = b.src WHERE a.src = 6000000001) SELECT 6000000001::BIGINT AS src, dst, min(d) AS d FROM k GROUP BY dst")
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.khop(large(spark, sf_dir).edges, spark.createDataFrame([(6 * 10**9 + 1,)], "id long"), 2)


@query(LARGE + "k AS (SELECT DISTINCT src, dst FROM edges) SELECT 1000000000::BIGINT AS src, id AS dst, min(d) AS d FROM (SELECT 1000000000::BIGINT AS id, 0 AS d UNION ALL SELECT src, 1 FROM k WHERE dst = 1000000000 UNION ALL SELECT a.src, 2 FROM k a JOIN k b ON a.dst = b.src WHERE b.dst = 1000000000) GROUP BY id")
def reverse_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.khop(large(spark, sf_dir).edges, spark.createDataFrame([(10**9,)], "id long"), 2, reverse=True)


@query(LARGE + "r(id) AS (SELECT 6000000001::BIGINT UNION SELECT dst FROM r JOIN edges ON src = id) SELECT id FROM r")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.closure(large(spark, sf_dir).edges, 6 * 10**9 + 1)


@query(LARGE + "r(id, depth) AS (SELECT 6000000001::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = id WHERE type = 'CONTAINS') SELECT id, min(depth) AS depth FROM r GROUP BY id")
def typed_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.typed_bfs(large(spark, sf_dir).edges, 6 * 10**9 + 1, "CONTAINS")


@query(LARGE + "x AS (SELECT 1) SELECT DISTINCT a.src, c.dst FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.type = 'CONTAINS' AND b.type = 'SUPPLIED_BY' AND c.type = 'IN_NATION' AND a.src IN (SELECT id FROM nodes WHERE list_contains(labels, '1-URGENT'))")
def regular_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return traversal.coloured_reach(g.edges, indexes.ids_with_labels(g.nodes, ["1-URGENT"]), [("CONTAINS", 1), ("SUPPLIED_BY", 1), ("IN_NATION", 1)])


@query(LARGE + """arcs AS (SELECT DISTINCT src, dst FROM edges), o AS (SELECT id FROM nodes WHERE list_contains(labels, '1-URGENT')),
    w AS (SELECT o.id AS src, c.dst AS dst, 3 AS d FROM o JOIN arcs a ON a.src = o.id JOIN arcs b ON b.src = a.dst JOIN arcs c ON c.src = b.dst WHERE c.dst BETWEEN 1000000000 AND 1000000001
          UNION SELECT o.id, b.dst, 2 FROM o JOIN arcs a ON a.src = o.id JOIN arcs b ON b.src = a.dst WHERE b.dst BETWEEN 1000000000 AND 1000000001) SELECT src, dst, min(d) AS d FROM w GROUP BY src, dst""")
def bounded_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which urgent orders come within three hops of two regions, meeting in the middle."""
    g = large(spark, sf_dir)
    orders = indexes.ids_with_labels(g.nodes, ["1-URGENT"]).select(F.col("id").alias("src"))
    pairs = orders.withColumn("dst", F.explode(F.array(F.lit(10**9), F.lit(10**9 + 1))))
    return traversal.within_bound(g.edges, pairs, 3)


# All distances from a stated set of nodes, the regions and nations, to all nodes: pairs of all nodes grow with the square of the graph.
APSP = LARGE + BOTH_WAYS + """dist(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0 FROM nodes WHERE kind <= 2
    UNION SELECT r.s, v, min(r.d) + 1 FROM dist r JOIN steps ON u = r.id LEFT JOIN recurring.dist k ON k.s = r.s AND k.id = v WHERE k.id IS NULL GROUP BY r.s, v) """


@query(APSP + "SELECT s AS src, id AS dst, d FROM dist")
def all_pairs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of any length from every region and nation to every node."""
    g = large(spark, sf_dir)
    return traversal.distances(traversal.both_ways(g.edges), subgraph_of_kinds(g, ["region", "nation"]).nodes.select("id"), symmetric=True)


@query(APSP.replace(LARGE, f"WITH RECURSIVE nodes AS ({NODES}), edges AS ({EDGES}), ") + "SELECT s AS src, id AS dst, d FROM dist WHERE s >= 2000000000 AND id BETWEEN 3000000000 AND 3999999999")
def label_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all customers from all nations, by hub labels of the graph of places, customers and suppliers, which answer any pair."""
    g = relational_graph(spark, sf_dir, small=True)
    ends = [subgraph_of_kinds(g, [k]).nodes for k in ("nation", "customer")]
    return hublabels.label_distances(hublabels.hub_labels(g.edges), *ends)


COLOURED = """dist(s, id, d) USING KEY (s, id) AS (SELECT id, id, 0 FROM nodes WHERE kind = 2
    UNION SELECT r.s, v, min(r.d) + 1 FROM dist r JOIN own ON u = r.id LEFT JOIN recurring.dist k ON k.s = r.s AND k.id = v WHERE k.id IS NULL GROUP BY r.s, v) """


@query(LARGE + "own AS (SELECT DISTINCT dst AS u, src AS v FROM edges WHERE type = 'IN_NATION' OR type = 'SUPPLIED_BY' OR type = 'CONTAINS'), " + COLOURED.strip() + ", one AS (SELECT 'IN_NATION' AS colour, dst AS src, src AS dst, 1 AS d FROM edges WHERE type = 'IN_NATION') SELECT colour, src, dst, min(d) AS d FROM (SELECT colour, src, dst, d FROM one UNION ALL SELECT 'any', s, id, d FROM dist WHERE d > 0) GROUP BY colour, src, dst")
def coloured_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from every nation against the edges of one colour, and against those of any of three."""
    g = large(spark, sf_dir)
    nations = subgraph_of_kinds(g, ["nation"]).nodes.select("id")
    back = structure.reverse(g.edges)
    return traversal.coloured_distances(back, nations, [["IN_NATION"], ["IN_NATION", "SUPPLIED_BY", "CONTAINS"]]).filter("d > 0").withColumn("colour", F.when(F.col("colour") == "IN_NATION", F.col("colour")).otherwise("any"))


@query(APSP + "SELECT s AS id, max(d) AS value FROM dist GROUP BY s")
def eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every region and nation, over all nodes that it reaches."""
    g = large(spark, sf_dir)
    return traversal.eccentricity(g.edges, subgraph_of_kinds(g, ["region", "nation"]).nodes.select("id"))


@query()
def diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole graph, by bounds; tests hold it against all pairs."""
    g = large(spark, sf_dir)
    return traversal.diameter(g.edges, g.nodes)


@query(LARGE + """arcs AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
    r(k, id, v) AS (SELECT 0, id, 1 / n FROM nodes, n UNION ALL SELECT k + 1, id, w / sum(w) OVER () FROM
        (SELECT max(max(r.k)) OVER () AS k, nodes.id AS id, 0.15 / any_value(n) + 0.85 * coalesce(avg(r.v), 0) AS w FROM nodes CROSS JOIN n LEFT JOIN arcs ON arcs.dst = nodes.id LEFT JOIN r ON r.id = arcs.src GROUP BY nodes.id) WHERE k < 100)
    SELECT id, round(v, 9) AS value FROM r WHERE k = 100""")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 rounds."""
    g = large(spark, sf_dir)
    return structure.mean_rank(g.nodes, g.edges).select("id", F.round("value", 9).alias("value"))


def supply_triangles(g: Graph) -> DataFrame:
    """Edges of the relational graph, and part-nation ones two steps long, so that triangles close."""
    supplied = g.edges.filter("type = 'SUPPLIED_BY'").select("src", F.col("dst").alias("m"))
    located = g.edges.filter("type = 'IN_NATION'").select(F.col("src").alias("m"), "dst")
    return g.edges.select("src", "dst").unionByName(supplied.join(located, "m").select("src", "dst"))


@query(LARGE + """e AS (SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'SUPPLIED_BY' AND b.type = 'IN_NATION'),
    t AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst) SELECT count(*) AS n_triangles FROM t a JOIN t b ON a.v = b.u JOIN t c ON c.u = a.u AND c.v = b.v""")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.triangle_count(supply_triangles(large(spark, sf_dir)))


CYCLES = f"WITH RECURSIVE nodes AS ({NODES_ALL}), e0 AS ({EDGES_ALL}), arcs AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0 WHERE type = 'IN_REGION'), "


def with_region_cycles(g: Graph) -> DataFrame:
    back = structure.reverse(g.edges.filter("type = 'IN_REGION'")).select("src", "dst")
    return g.edges.select("src", "dst").unionByName(back)


@query(CYCLES + "r(s, id) AS (SELECT id, id FROM nodes UNION SELECT s, dst FROM r JOIN arcs ON src = id) SELECT a.s AS id, min(a.id) AS component FROM r a JOIN r b ON a.s = b.id AND a.id = b.s GROUP BY a.s")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.strong_components(g.nodes, with_region_cycles(g))


@query(CYCLES + "r(s, id) AS (SELECT id, id FROM nodes UNION SELECT s, dst FROM r JOIN arcs ON src = id), c AS (SELECT a.s AS id, min(a.id) AS component FROM r a JOIN r b ON a.s = b.id AND a.id = b.s GROUP BY a.s) SELECT DISTINCT x.component AS src, y.component AS dst FROM arcs JOIN c x ON x.id = arcs.src JOIN c y ON y.id = arcs.dst WHERE x.component <> y.component")
def scc_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    arcs = with_region_cycles(g)
    return structure.condensation(arcs, structure.strong_components(g.nodes, arcs))


@query(LARGE + "r(id, level) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT dst, level + 1 FROM r JOIN edges ON src = id) SELECT id, max(level) AS level FROM r GROUP BY id")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.topological_levels(g.nodes, g.edges)


@query(LARGE + "r(id, level) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT src FROM edges) UNION SELECT src, level + 1 FROM r JOIN edges ON dst = id) SELECT id, max(level) AS rank FROM r GROUP BY id")
def bisimulation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.bisimulation_ranks(g.nodes, g.edges, g.nodes.select("id", F.col("id").alias("component")))


@query(LARGE + BOTH_WAYS + """w(v, path) AS (SELECT 3000000001::BIGINT, [3000000001::BIGINT] UNION ALL SELECT s.v, list_append(path, s.v) FROM w JOIN steps s ON s.u = w.v WHERE len(path) <= 4 AND w.v <> 2000000000 AND NOT list_contains(path, s.v)),
    f AS (SELECT path, len(path) - 1 AS d FROM w WHERE v = 2000000000) SELECT path, d::INTEGER AS d FROM f ORDER BY d, path LIMIT 1""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first customer to the first nation, up to four hops; of equal ones that of least ids."""
    return traversal.shortest_path(large(spark, sf_dir).edges, 3 * 10**9 + 1, 2 * 10**9, 4)


# Graphs from graphs


@query(LARGE + "x AS (SELECT 1) SELECT eid, src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE list_contains(labels, 'BUILDING') OR list_contains(labels, '1-URGENT')) AND dst IN (SELECT id FROM nodes WHERE list_contains(labels, 'BUILDING') OR list_contains(labels, '1-URGENT'))")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.induced(g, indexes.ids_with_labels(g.nodes, ["BUILDING", "1-URGENT"])).edges.select("eid", "src", "dst")


@query(LARGE + "x AS (SELECT 1) SELECT DISTINCT id FROM (SELECT src AS id FROM edges WHERE type = 'PLACED_BY' UNION ALL SELECT dst FROM edges WHERE type = 'PLACED_BY')")
def edge_induced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return structure.edge_induced(g, g.edges.filter("type = 'PLACED_BY'")).nodes.select("id")


@query(LARGE + "x AS (SELECT 1) SELECT eid, dst AS src, src AS dst, type FROM edges")
def reverse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reverse(large(spark, sf_dir).edges).select("eid", "src", "dst", "type")


@query("SELECT user_id::BIGINT AS src, event_id::BIGINT % 100 AS dst, count(*) AS n FROM events WHERE user_id <> event_id % 100 GROUP BY ALL")
def drop_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("src"), (F.col("event_id") % 100).cast("long").alias("dst"))
    return structure.without_loops(events).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(LARGE + "x AS (SELECT 1) SELECT src, dst, type, min(eid) AS eid FROM edges WHERE type <> 'SUPPLIED_BY' GROUP BY src, dst, type")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    kinds = [subgraph_of_kinds(g, k) for k in (["region", "nation", "customer", "order"], ["supplier", "nation"], ["order", "part"])]
    return structure.merge(structure.merge(kinds[0], kinds[1]), kinds[2]).edges.select("src", "dst", "type", "eid")


@query(LARGE + "x AS (SELECT 1) SELECT eid, src, dst FROM edges WHERE src NOT IN (2000000003, 2000000007) AND dst NOT IN (2000000003, 2000000007)")
def remove_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([(2 * 10**9 + 3,), (2 * 10**9 + 7,)], "id long")
    return structure.remove_nodes(large(spark, sf_dir), gone).edges.select("eid", "src", "dst")


@query(LARGE + "x AS (SELECT eid, (eid * 7919 + 761) % 100 AS slot FROM edges), s AS (SELECT unnest([1, 2, 3, 4, 5]) AS snapshot) SELECT snapshot, count(*) AS n_edges, min(eid) AS first_edge FROM x, s WHERE slot >= snapshot * 10 GROUP BY snapshot")
def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.edge_snapshots(large(spark, sf_dir).edges, 10).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_edges"), F.min("eid").alias("first_edge"))


@query()
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synthetic_graph(spark, 1000, 2.5, ["alpha", "beta", "gamma", "delta"], seed=3)
    return stats.dataset_stats(g)


@query(LARGE + "x AS (SELECT 1) SELECT DISTINCT id FROM (SELECT id, unnest(labels) AS label FROM nodes) WHERE contains(label, 'Customer#00000001')")
def label_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.ids_with_label_part(large(spark, sf_dir).nodes, "Customer#00000001")


@query(LARGE + "x AS (SELECT 1) SELECT eid, src, dst FROM edges UNION ALL SELECT (SELECT max(eid) FROM edges) + row_number() OVER (ORDER BY eid), (SELECT max(id) FROM nodes) + 1, dst FROM edges WHERE src = 3000000001 UNION ALL SELECT (SELECT max(eid) FROM edges) + (SELECT count(*) FROM edges WHERE src = 3000000001) + row_number() OVER (ORDER BY eid), src, (SELECT max(id) FROM nodes) + 1 FROM edges WHERE dst = 3000000001")
def clone_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges with those of a copy of the first customer, whose one out-edge comes before its in-edges by id."""
    g = large(spark, sf_dir)
    return structure.clone_nodes(g, spark.createDataFrame([(3 * 10**9 + 1,)], "id long")).edges.select("eid", "src", "dst")


# Workloads and learned schedules: walks and models draw by hashes and seeds, so rows repeat but no SQL gives them


@query(LARGE + "l AS (SELECT id, unnest(labels) AS label FROM nodes), m AS (SELECT DISTINCT o.id AS q0, c.id AS q1, n.id AS q2 FROM nodes o JOIN edges a ON a.src = o.id JOIN nodes c ON c.id = a.dst JOIN edges b ON b.src = c.id JOIN nodes n ON n.id = b.dst WHERE list_contains(o.labels, '1-URGENT') AND list_contains(c.labels, 'BUILDING') AND list_contains(n.labels, 'NATION_7')) SELECT DISTINCT x.label AS label_q0, y.label AS label_q1, z.label AS label_q2 FROM m JOIN l x ON x.id = q0 JOIN l y ON y.id = q1 JOIN l z ON z.id = q2 WHERE x.label <> y.label AND x.label <> z.label AND y.label <> z.label")
def workload_label_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = large(spark, sf_dir)
    return workload.label_combinations(g, matching.exact_match(g, TREE))


@query()
def workload_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty connected queries of four nodes, their shape and whether a workload keeps them."""
    found = workload.sample_queries(large(spark, sf_dir), 4, 20, seed=2)
    rows = [(q.index, format_query(q), len(q.edges), non_star(q), runnable(q, PREFIX)) for q in found]
    return spark.createDataFrame(rows, "query int, text string, n_edges int, non_star boolean, runnable boolean")


@query()
def workload_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for a template of three nodes from all its structural matches."""
    q = workload.label_templates(large(spark, sf_dir), Query({"0": "", "1": "", "2": ""}, (("0", "1"), ("1", "2"))))
    return spark.createDataFrame(list(q.labels.items()), "qid string, label string")


def chain_engine(spark: SparkSession, sf_dir: str, k: int = 5) -> AnytimeEngine:
    m = Matcher(large(spark, sf_dir), CHAIN, PREFIX, THETA)
    m.plan = make_plan(CHAIN, CHAIN_STARS)
    return AnytimeEngine(m, k)


@query()
def oracle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle's fetches for a query of two stars, by beam search over depths as rows."""
    tasks = learned.task_table(spark, {0: chain_engine(spark, sf_dir)})
    return learned.beam_search_all(tasks).select("step", "star", "amount")


@query()
def schedule_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the oracle's run gives to learning: 108 features of each choice of a star, and its label."""
    engine = chain_engine(spark, sf_dir)
    static, needed = learned.static_features(engine.m), engine.needed_depths()
    rows = learned.examples(0, engine.known(needed), static, needed)
    return learned.example_table(spark, rows)


@query()
def schedule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs in rows and quality of the oracle, of taking turns, of a random choice and of an imitating policy on one query."""
    engine = chain_engine(spark, sf_dir)
    static, needed = learned.static_features(engine.m), engine.needed_depths()
    engine = engine.known(needed)
    path = learned.beam_search(engine.start.depth, engine.start.sizes, needed)
    policy = learned.fit_policy(learned.examples(0, engine, static, needed), spark, static)
    return learned.compare(engine, {"oracle": learned.replay(path), "turns": round_robin(200), "random": learned.random_schedule(1), "policy": policy.scheduler()})


# Pattern mining

MINE_LOW, MINE_HIGH = 5, 100_000


@query(LARGE + MAX_LABEL + f", e AS (SELECT DISTINCT src, dst FROM edges) SELECT a.label AS src_label, b.label AS dst_label, count(*) AS n_edges FROM e JOIN best a ON a.id = src JOIN best b ON b.id = dst WHERE a.frequency BETWEEN {MINE_LOW} AND {MINE_HIGH} AND b.frequency BETWEEN {MINE_LOW} AND {MINE_HIGH} GROUP BY ALL")
def edge_patterns_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.edge_patterns(large(spark, sf_dir), MINE_LOW, MINE_HIGH)


#: Least interestingness of a pattern.  Merges cover as much as their parts, so far fewer edge patterns may pass than a level could merge.
MINE_THETA = 0.305


@query()
def diversified_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns that reach theta, to the last level, and of them the three chosen."""
    g = large(spark, sf_dir)
    found = mining.mine(g, 50, MINE_HIGH, MINE_THETA)
    chosen = mining.diversify_by_swaps([p.interest for p in found], mining.distances(found), min(3, len(found)))
    return mining.pattern_table(g, found, chosen)
