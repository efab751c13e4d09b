"""Readers and writers: query and pattern texts, bibliography XML, Turtle, graph CSV, answers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.iterate import cut
from graphloom.plans.query import Query, format_query, parse_queries
from graphloom.sources.graph import EDGE_SCHEMA, Graph

# Fields of a bibliography record.
LIST_FIELDS = ("author", "editor", "cite")
SCALAR_FIELDS = tuple("title pages year volume journal number url ee note cdRom crossref isbn booktitle series publisher month school chapter address".split())
ENTITY_LABELS = ("title", "journal", "note", "booktitle", "publisher")


def read_queries(spark: SparkSession, path: str) -> list[Query]:
    """All queries of some text files: a workload is planned by the driver, which takes one file at a time."""
    return [q for r in spark.read.text(path, wholetext=True).toLocalIterator() for q in parse_queries(r.value)]


def query_tables(spark: SparkSession, queries: list[Query]) -> tuple[DataFrame, DataFrame]:
    """``qnodes(query_id, qid, label)`` and ``qedges(query_id, qsrc, qdst)``."""
    index = lambda k, q: q.index if q.index is not None else k
    nodes = [(index(k, q), a, label) for k, q in enumerate(queries) for a, label in q.labels.items()]
    edges = [(index(k, q), a, b) for k, q in enumerate(queries) for a, b in q.edges]
    return spark.createDataFrame(nodes, "query_id int, qid string, label string"), spark.createDataFrame(edges, "query_id int, qsrc string, qdst string")


def write_queries(spark: SparkSession, queries: list[Query], stars: list[int], path: str) -> None:
    """Query texts, in a folder for each number of stars."""
    rows = [(format_query(q), n) for q, n in zip(queries, stars, strict=True)]
    spark.createDataFrame(rows, "value string, stars int").write.mode("overwrite").partitionBy("stars").text(path)


@dataclass(frozen=True)
class PatternGraph:
    """A pattern with attribute conditions and weights by node, and hop bounds and colours by edge."""

    query: Query
    conditions: dict[str, list[tuple[str, str, str | float]]]
    weights: dict[str, float]
    bounds: dict[tuple[str, str], int]
    colours: dict[tuple[str, str], int]
    is_data: bool = False


def parse_pattern(text: str) -> PatternGraph:
    """A pattern text: attribute types, colours, graph type, then counted nodes ``tag weight n attr<op>value..`` and edges ``from to bound colour``."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    types = dict(x.split(":") for x in lines[0] if ":" in x)
    kind, at = lines[2][0] == "1", 4
    n = int(lines[3][0])
    conditions, weights, labels = {}, {}, {}
    for row in lines[at : at + n]:
        tag, parsed = row[0], []
        for c in row[3 : 3 + int(row[2])]:
            name, op, value = re.fullmatch(r"(.+?)([=<>])(.*)", c).groups()
            parsed.append((name, op, value if types.get(name, "String") == "String" else float(value)))
        conditions[tag], weights[tag], labels[tag] = parsed, float(row[1]), ""
    at += n
    rows = lines[at + 1 : at + 1 + int(lines[at][0])]
    edges = [(r[0], r[1]) for r in rows]
    return PatternGraph(Query(labels, tuple(edges)), conditions, weights, {e: int(r[2]) for e, r in zip(edges, rows, strict=True)}, {e: int(r[3]) for e, r in zip(edges, rows, strict=True)}, kind)


def format_pattern(p: PatternGraph) -> str:
    names = sorted({c[0] for cs in p.conditions.values() for c in cs})
    kind = {c[0]: "String" if isinstance(c[2], str) else "Double" for cs in p.conditions.values() for c in cs}
    lines = [" ".join(f"{x}:{kind[x]}" for x in names) or "-", " ".join(str(c) for c in sorted(set(p.colours.values()))) or "0", str(int(p.is_data)), str(len(p.query.labels))]
    lines += [" ".join([q, f"{p.weights[q]:g}", str(len(p.conditions[q])), *(f"{a}{op}{v}" for a, op, v in p.conditions[q])]) for q in p.query.ids]
    lines += [str(len(p.query.edges))] + [f"{a} {b} {p.bounds[a, b]} {p.colours[a, b]}" for a, b in p.query.edges]
    return "\n".join(lines) + "\n"


def pattern_of(nodes: list[tuple[str, list[tuple[str, str, str | float]], float]], edges: list[tuple[str, str, int, int]]) -> PatternGraph:
    """A pattern from nodes (tag, conditions, weight) and edges (from, to, bound, colour)."""
    ends = [(a, b) for a, b, *_ in edges]
    return PatternGraph(
        Query({t: "" for t, *_ in nodes}, tuple(ends)), {t: list(c) for t, c, _ in nodes}, {t: w for t, _, w in nodes},
        {e: x[2] for e, x in zip(ends, edges, strict=True)}, {e: x[3] for e, x in zip(ends, edges, strict=True)},
    )


def copy_pattern(p: PatternGraph) -> PatternGraph:
    """An equal pattern that shares nothing with ``p``."""
    return replace(p, query=replace(p.query, labels=dict(p.query.labels)), conditions={q: list(c) for q, c in p.conditions.items()}, weights=dict(p.weights), bounds=dict(p.bounds), colours=dict(p.colours))


def stored_pattern(g: Graph) -> PatternGraph:
    """A stored graph as a pattern: a node's last label counts, every bound is 1 and every colour 0.  A pattern is small, so its graph is read by the driver."""
    nodes = {str(r.id): (r.labels or [""])[-1] for r in g.nodes.orderBy("id").collect()}
    edges = [(str(r.src), str(r.dst)) for r in g.edges.orderBy("eid").collect()]
    query = Query(nodes, tuple(edges))
    return PatternGraph(query, {q: [] for q in nodes}, dict.fromkeys(nodes, 0.0), dict.fromkeys(query.edges, 1), dict.fromkeys(query.edges, 0))


def convert_patterns(text: str) -> list[Query]:
    """Queries of a dump of frequent patterns: per pattern ``id<tab>label`` rows, a line with the number of edges, ``src<tab>dst`` rows."""
    lines, out, at = [x.rstrip() for x in text.splitlines() if x.strip()], [], 0
    while at < len(lines):
        labels: dict[str, str] = {}
        while "\t" in lines[at]:
            q, label = lines[at].split("\t", 1)
            labels[q], at = label, at + 1
        n = int(lines[at])
        rows = [x.split("\t") for x in lines[at + 1 : at + 1 + n]]
        if len(rows) < n:
            raise ValueError("the text ends within a pattern")
        out.append(Query(labels, tuple((r[0], r[1]) for r in rows), len(out)))
        at += 1 + n
    return out


def relabel(queries: list[Query], prefix: str) -> list[Query]:
    """Queries with a prefix before every label, as the data's own labels have."""
    return [Query({q: prefix + label for q, label in x.labels.items()}, x.edges, x.index) for x in queries]


def write_index(entries: DataFrame, path: str, by: str) -> None:
    """Any index's entries, ordered within files by their key, so that a lookup skips row groups."""
    entries.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_distances(distances: DataFrame, path: str) -> None:
    """A table of (src, dst, d), one folder for each distance."""
    distances.write.mode("overwrite").partitionBy("d").parquet(path)


def read_distances(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Written distances, up to ``most`` if given, which prunes folders."""
    found = spark.read.schema("src long, dst long, d int").parquet(path)
    return found if most is None else found.filter(F.col("d") <= most)


def write_simulation(sim: DataFrame, path: str) -> None:
    """The nodes of each pattern node, one folder for each."""
    sim.write.mode("overwrite").partitionBy("qid").option("header", True).csv(path)


def read_bibliography(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a bibliography XML: ``key``, ``kind``, list fields and scalar fields, absent ones null."""
    fields = [T.StructField("_key", T.StringType()), *[T.StructField(f, T.ArrayType(T.StringType())) for f in LIST_FIELDS], *[T.StructField(f, T.StringType()) for f in SCALAR_FIELDS]]
    rows = spark.read.format("xml").option("rowTag", record).schema(T.StructType(fields)).load(path)
    return rows.withColumnRenamed("_key", "key").withColumn("kind", F.lit(record))


def bibliography_graph(records: DataFrame) -> Graph:
    """Persons and records as nodes; WRITTEN_BY, EDITED_BY, CITE_TO, IS_CROSSREF_WITH and PUBLISHED_IN edges.

    Node ids are hashes of what names them, so no counter is shared.
    """
    node_id = lambda kind, c: F.xxhash64(F.lit(kind), c)
    labels = F.array_compact(F.array("kind", *ENTITY_LABELS))
    keep = [c for c in SCALAR_FIELDS if c not in ENTITY_LABELS]
    own = F.map_filter(F.create_map(*[x for c in ["key", *keep] for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    entity = records.select(node_id("record", F.col("key")).alias("id"), labels.alias("labels"), own.alias("props"))
    nodes, edges = [entity], []
    source = node_id("record", F.col("key")).alias("src")
    for column, kind in (("author", "WRITTEN_BY"), ("editor", "EDITED_BY")):
        person = records.select(source, F.explode(column).alias("name"))
        nodes.append(person.select(node_id("person", F.col("name")).alias("id"), F.array("name").alias("labels"), F.create_map().cast("map<string,string>").alias("props")))
        edges.append(person.select("src", node_id("person", F.col("name")).alias("dst"), F.lit(kind).alias("type")))
    keys = records.select(F.col("key").alias("to"))
    for column, kind in ((F.explode("cite"), "CITE_TO"), (F.col("crossref"), "IS_CROSSREF_WITH")):
        linked = records.select(source, column.alias("to")).filter("to is not null").join(keys, "to", "left_semi")
        edges.append(linked.select("src", node_id("record", F.col("to")).alias("dst"), F.lit(kind).alias("type")))
    venue = records.select(source, F.coalesce("journal", "booktitle").alias("venue")).filter("venue is not null")
    nodes.append(venue.select(node_id("venue", F.col("venue")).alias("id"), F.array("venue").alias("labels"), F.create_map().cast("map<string,string>").alias("props")))
    edges.append(venue.select("src", node_id("venue", F.col("venue")).alias("dst"), F.lit("PUBLISHED_IN").alias("type")))
    all_nodes, all_edges = nodes[0], edges[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    all_edges = all_edges.distinct().select(F.xxhash64("src", "dst", "type").alias("eid"), "src", "dst", "type", F.create_map().cast("map<string,string>").alias("props"))
    return Graph(all_nodes.dropDuplicates(["id"]), all_edges)


_TERM = r"""(?:<[^>]*>|"(?:[^"\\]|\\.)*"(?:\^\^\S+|@[\w-]+)?|[^\s;,."<]+(?:\.[^\s;,."<]+)*)"""


_TOKEN = re.compile(_TERM + r"|[;,.\[\]]")
_COMMENT = re.compile(r"(?m)(^|\s)#[^\n]*")
_QUOTE = re.compile(r'(?<!\\)"')


def parse_turtle(text: str, known: Mapping[str, str] | None = None, blanks: int = 0) -> list[tuple[str, str, str, bool]]:
    """(subject, predicate, object, is literal) of a Turtle text: prefixes, ``a``, ``;`` and ``,`` lists, blank nodes ``_:x`` and ``[..]``, literals.

    A part of a text takes the prefixes ``known`` before it, and the number of
    blank nodes ``[..]`` that came before.
    """
    prefixes: dict[str, str] = dict(known or {})
    text = _COMMENT.sub(r"\1", text)
    tokens = _TOKEN.findall(text)
    out: list[tuple[str, str, str, bool]] = []
    blank = [blanks]

    def term(t: str) -> tuple[str, bool]:
        if t.startswith("<"):
            return t[1:-1], False
        if t.startswith('"'):
            return re.sub(r'\\(.)', r"\1", t[1 : t.rindex('"')]), True
        if re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?|true|false", t):
            return t, True
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", False
        name, _, rest = t.partition(":")
        return (prefixes[name] + rest if name in prefixes else t), False

    def properties(subject: str, at: int, stop: str) -> int:
        while at < len(tokens) and tokens[at] != stop:
            if tokens[at] == ";":
                at += 1
                continue
            predicate = term(tokens[at])[0]
            at += 1
            while True:
                if tokens[at] == "[":
                    blank[0] += 1
                    inner = f"_:b{blank[0]}"
                    at = properties(inner, at + 1, "]")
                    out.append((subject, predicate, inner, False))
                else:
                    value, literal = term(tokens[at])
                    out.append((subject, predicate, value, literal))
                at += 1
                if at < len(tokens) and tokens[at] == ",":
                    at += 1
                    continue
                break
        return at

    at = 0
    while at < len(tokens):
        if tokens[at].lower() in ("@prefix", "prefix"):
            prefixes[tokens[at + 1].rstrip(":")] = tokens[at + 2][1:-1]
            at += 3 + (at + 3 < len(tokens) and tokens[at + 3] == ".")
        elif tokens[at].lower() in ("@base", "base"):
            at += 2 + (at + 2 < len(tokens) and tokens[at + 2] == ".")
        elif tokens[at] == ".":
            at += 1
        elif tokens[at] == "[":
            blank[0] += 1
            subject = f"_:b{blank[0]}"
            at = properties(subject, properties(subject, at + 1, "]") + 1, ".")
        else:
            at = properties(term(tokens[at])[0], at + 1, ".")
    return out


def triples_graph(triples: DataFrame) -> Graph:
    """Nodes by URI: types become labels, literals properties (the least of several), resources distinct edges."""
    node_id = lambda c: F.xxhash64(F.lit("uri"), F.col(c))
    is_type = F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    names = triples.select(F.col("s").alias("uri")).unionByName(triples.filter(~F.col("literal") & ~is_type).select(F.col("o").alias("uri"))).distinct()
    labels = triples.filter(is_type).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("labels"))
    single = triples.filter("literal").groupBy("s", "p").agg(F.min("o").alias("o"))
    props = single.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "o"))).alias("props"))
    joined = names.join(labels.withColumnRenamed("s", "uri"), "uri", "left").join(props.withColumnRenamed("s", "uri"), "uri", "left")
    uri = F.create_map(F.lit("__URI__"), F.col("uri"))
    nodes = joined.select(node_id("uri").alias("id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.when(F.col("props").isNull(), uri).otherwise(F.map_concat(uri, "props")).alias("props"))
    links = triples.filter(~F.col("literal") & ~is_type).select("s", "p", "o").distinct()
    edges = links.select(F.xxhash64("s", "p", "o").alias("eid"), node_id("s").alias("src"), node_id("o").alias("dst"), F.col("p").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(nodes, edges)


def turtle_statements(lines: DataFrame) -> DataFrame:
    """(file, text, before) of every statement of Turtle files, from ``lines(file, block, value)`` as Spark deals them.

    A full stop outside of terms ends a statement wherever it stands, and terms
    end with their line, so a part of a file tells by itself where its
    statements end.  What two parts or more share is put together again:
    every part gives two pieces of statements at most.  ``before`` counts the
    blank nodes ``[..]`` in the statements before, in the file's order.  A file
    in which a quoted text goes on over lines has a row without text as well.
    """

    def cut_up(batches):
        import pandas as pd

        where, seq, before, held, n, ended = None, 0, 0, [], 0, False

        def rest():
            # A piece that does not end: of a part without any end, the whole of it.
            return [(*where, seq, "tail" if ended or where[1] == 0 else "middle", "\n".join(held), before, n)] if held or not ended else []

        for batch in batches:
            out = []
            for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
                if (file, block) != where:
                    if where:
                        out += rest()
                    where, seq, before, held, n, ended = (file, block), 0, 0, [], 0, False
                line, at = _COMMENT.sub(r"\1", value), 0
                if len(_QUOTE.findall(line)) % 2:
                    out.append((file, block, -1, "open", None, 0, 0))
                for m in _TOKEN.finditer(line):
                    if m[0] == "[":
                        n += 1
                    elif m[0] == ".":
                        held.append(line[at : m.end()])
                        whole = ended or block == 0
                        out.append((file, block, seq, "whole" if whole else "head", "\n".join(held), before, n))
                        # The blank nodes of a head belong to the part in which its statement starts.
                        seq, before, held, n, at, ended = seq + 1, before + (n if whole else 0), [], 0, m.end(), True
                if line[at:].strip():
                    held.append(line[at:])
            yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "text", "before", "n"])
        if where:
            yield pd.DataFrame(rest(), columns=["file", "block", "seq", "kind", "text", "before", "n"])

    parts = cut(lines.mapInPandas(cut_up, "file string, block long, seq long, kind string, text string, before long, n long"))
    own = Window.partitionBy("file").orderBy("block", "seq")
    # Pieces in the file's order: a head ends what the tail before it began.
    pieces = parts.filter("kind not in ('whole', 'open')").withColumn("number", F.coalesce(F.sum((F.col("kind") == "head").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text", "before", "kind"))).alias("p"), F.sum("n").alias("n"))
    joined = cut(joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["before"].alias("before"), (F.col("p")[0]["kind"] == "head").alias("first"), "n", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    every = parts.filter("kind = 'whole'").select("file", "block", "before", F.lit(False).alias("first"), "n", "text").unionByName(joined)
    # A statement that starts with its part comes before the others there.
    leading = joined.filter("first").select("file", "block", F.col("n").alias("leading"))
    every = every.join(leading, ["file", "block"], "left").withColumn("before", F.when(F.col("first"), F.lit(0)).otherwise(F.col("before") + F.coalesce("leading", F.lit(0))))
    sums = every.groupBy("file", "block").agg(F.sum("n").alias("n"))
    earlier = sums.withColumn("earlier", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).select("file", "block", "earlier")  # a row for each part
    out = every.filter(F.trim("text") != "").join(earlier, ["file", "block"]).select("file", "text", (F.col("before") + F.col("earlier")).alias("before"))
    return out.unionByName(parts.filter("kind = 'open'").select("file", "text", "before").distinct())


def turtle_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal) of Turtle files, of which large ones are dealt to many tasks.

    Prefixes are collected first, by file; a file that gives a prefix two
    meanings, or holds a quoted text of several lines, is parsed whole.  Blank nodes belong to their file: of several
    files, their names begin with a hash of the file's.
    """
    schema = "s string, p string, o string, literal boolean"
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    statements = cut(turtle_statements(lines))
    names = F.regexp_extract_all("text", F.lit(r"(?i)(?:^|\s)@?prefix\s+([^\s:]*):\s*<([^>]*)>"), F.lit(1))
    values = F.regexp_extract_all("text", F.lit(r"(?i)(?:^|\s)@?prefix\s+([^\s:]*):\s*<([^>]*)>"), F.lit(2))
    given = statements.filter(F.lower(F.ltrim("text")).rlike("^@?prefix")).select("file", F.explode(F.arrays_zip(names.alias("k"), values.alias("v"))).alias("x")).select("file", "x.k", "x.v").distinct()
    twice = given.groupBy("file", "k").count().filter("count > 1").select("file").unionByName(statements.filter("text is null").select("file")).distinct()
    maps = given.join(twice, "file", "left_anti").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))
    several = statements.select("file").distinct().limit(2).count() > 1
    scope = F.concat(F.hex(F.xxhash64("file")), F.lit("_")) if several else F.lit("")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for text, known, before, scope in zip(batch["text"], batch["known"], batch["before"], batch["scope"], strict=True):
                own = lambda x, scope=scope: f"_:{scope}{x[2:]}" if x.startswith("_:") else x
                rows += [(own(s), p, o if literal else own(o), literal) for s, p, o, literal in parse_turtle(text, dict(known or {}), before)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "literal"])

    once = statements.join(twice, "file", "left_anti").join(maps, "file", "left")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).join(twice, "file", "left_semi")
    whole = whole.select("file", "text", F.lit(0).cast("long").alias("before"), F.create_map().cast("map<string,string>").alias("known"))
    rows = once.select("file", "text", "before", "known").unionByName(whole).withColumn("scope", scope)
    return rows.select("text", "known", "before", "scope").mapInPandas(parse, schema)


def read_turtle(spark: SparkSession, path: str) -> Graph:
    """A graph of Turtle files, whose node ids are hashes that were found to be distinct."""
    g = triples_graph(cut(turtle_triples(spark, path)))
    if not g.nodes.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("two names have one hash, so they cannot both be a node's")
    return g


def write_graph_csv(g: Graph, path: str) -> None:
    """``unique:ID,:Label`` and ``:START_ID,:END_ID,:TYPE`` files."""
    nodes = g.nodes.select(F.col("id").alias("unique:ID"), F.array_join("labels", ";").alias(":Label"))
    nodes.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    g.edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE")).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_answers(answers: DataFrame, path: str, milliseconds: float | None = None) -> None:
    """Rows of answers, with the time that they took if given."""
    if milliseconds is not None:
        answers = answers.withColumn("milliseconds", F.lit(float(milliseconds)))
    answers.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def synthetic_graph(spark: SparkSession, n_nodes: int, edges_per_node: float, words: list[str], seed: int = 1) -> Graph:
    """A connected random digraph: each node hangs on an earlier one, in a random direction, plus random extra edges; labels by hash."""
    pick = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40))
    label = F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(pick("id", F.lit(0)), F.lit(len(words))) + 1).cast("int"))
    nodes = spark.range(n_nodes).select("id", F.array(label).alias("labels"), F.create_map().cast("map<string,string>").alias("props"))
    tree = spark.range(1, max(1, n_nodes)).select(F.col("id").alias("eid"), F.col("id").alias("a"), F.pmod(pick("id", F.lit(1)), F.col("id")).alias("b"), pick("id", F.lit(2)).alias("way"))
    extra = max(0, int(n_nodes * edges_per_node) - max(0, n_nodes - 1)) if n_nodes else 0
    more = spark.range(n_nodes, n_nodes + extra).select(F.col("id").alias("eid"), F.pmod(pick("id", F.lit(3)), F.lit(max(1, n_nodes))).alias("a"), F.pmod(pick("id", F.lit(4)), F.lit(max(1, n_nodes))).alias("b"), pick("id", F.lit(5)).alias("way"))
    all_ = tree.unionByName(more)
    ahead = F.col("way") % 2 == 0
    edges = all_.select("eid", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("dst"), F.lit("RELATED").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(nodes, edges.select(*[f.name for f in EDGE_SCHEMA]))
