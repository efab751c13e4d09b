"""Components, triangles, ranks, and graphs made from graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import bucketed, cut, written
from graphloom.operators.traversal import directed, one_way, undirected
from graphloom.sources.graph import Graph


def ranked_rows(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with numbers from 0 in the order of a column without ties, by ranges and their counts."""
    dealt = cut(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    local = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1)
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_before", "_row")


#: Pairs of a node from which contraction takes it for a hub.
HUB_PAIRS = 100_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weak components, named by their least id, by large-star and small-star contraction."""

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")))
        # Hubs, at most the pairs by HUB_PAIRS, meet their minima where their pairs lie; no task gets all pairs of one.
        hubs = F.broadcast(least.filter(F.col("n") > HUB_PAIRS).select("u", "m"))
        rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= HUB_PAIRS).select("u", "m"), "u")
        moved = rest.unionByName(pairs.join(hubs, "u"))
        if larger:
            out = moved.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    current, before = written(undirected(edges).filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))), None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        current = written(star(star(both, True).select(F.col("b").alias("u"), F.col("a").alias("v")), False))
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return nodes.select("id").join(current.select(F.col("b").alias("id"), F.col("a").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): strong components, named by their least id.

    Forward-backward colouring: every open node takes the least id that reaches
    it; within a colour, what reaches back to the colour's node is its component.
    Nodes that no arc enters or none leaves go first, again and again: they are alone.
    """
    arcs, before = bucketed(one_way(edges), "u", distinct=True), None
    while (size := arcs.count()) != before:
        before = size
        inner = written(arcs.select(F.col("v").alias("id")).distinct().join(arcs.select(F.col("u").alias("id")), "id", "left_semi"))
        kept = arcs.join(inner.withColumnRenamed("id", "u"), "u", "left_semi").join(inner.withColumnRenamed("id", "v"), "v", "left_semi")
        arcs = written(kept)
    all_ = nodes.select("id").distinct()
    found = written(all_.join(inner, "id", "left_anti").withColumn("component", F.col("id")))
    open_ = written(all_.join(inner, "id", "left_semi"))
    while not open_.isEmpty():
        colour = written(open_.withColumn("colour", F.col("id")))
        while True:
            best = colour.join(arcs, colour["id"] == arcs["u"]).groupBy("v").agg(F.min("colour").alias("m"))
            moved = written(colour.join(best, colour["id"] == best["v"], "left").select("id", F.least("colour", "m").alias("colour"), (F.col("m") < F.col("colour")).alias("moved")))
            colour = moved.select("id", "colour")
            if moved.filter("moved").isEmpty():
                break
        same = arcs.join(colour.select(F.col("id").alias("u"), F.col("colour").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("colour").alias("cv")), "v")
        back = written(same.filter("cu = cv").select("u", "v", F.col("cu").alias("colour")))
        reach = written(colour.filter("id = colour"))
        frontier = reach
        while True:
            up = frontier.select(F.col("id").alias("v"), "colour").join(back, ["v", "colour"]).select(F.col("u").alias("id"), "colour").distinct()
            frontier = written(up.join(reach, "id", "left_anti"))
            if frontier.isEmpty():
                break
            reach = written(reach.unionByName(frontier))
        part = reach.select("id", F.col("colour").alias("component"))
        found = written(found.unionByName(part))
        open_ = written(open_.join(part, "id", "left_anti"))
        arcs = written(arcs.join(open_.select(F.col("id").alias("u")), "u", "left_semi").join(open_.select(F.col("id").alias("v")), "v", "left_semi"))
    return found


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between different strong components."""
    a, b = (scc.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").filter("csrc <> cdst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct()


def bisimulation_ranks(nodes: DataFrame, edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(id, rank): bisimilar nodes have equal ranks.

    0 for a node without out-edges; null, below every number, for one that only
    cycles without another way out; else the most over its component's targets of
    their rank, plus 1 where the target reaches no cycle.
    """
    arcs = bucketed(condensation(edges, scc), "dst")
    inner = edges.join(scc.select(F.col("id").alias("src"), F.col("component").alias("c")), "src").join(scc.select(F.col("id").alias("dst"), F.col("component").alias("d")), "dst")
    cyclic = inner.filter("c = d").select("c").distinct()
    comps = scc.select(F.col("component").alias("c")).distinct().join(cyclic.withColumn("cyclic", F.lit(True)), "c", "left").fillna(False)
    open_, done = written(comps), None
    while not open_.isEmpty():
        # A condensation has no cycles, so each round some component has only ranked targets.
        waits = arcs.join(open_.select(F.col("c").alias("dst")), "dst", "left_semi").select(F.col("src").alias("c"))
        ready = written(open_.join(waits, "c", "left_anti"))
        if done is None:
            part = ready.select("c", (~F.col("cyclic")).alias("well"), F.when(~F.col("cyclic"), 0).alias("rank"))
        else:
            rank = F.when(F.col("w"), F.col("r") + 1).otherwise(F.col("r"))
            told = arcs.join(done.select(F.col("c").alias("dst"), F.col("well").alias("w"), F.col("rank").alias("r")), "dst").groupBy(F.col("src").alias("c")).agg(F.max(rank).alias("rank"), F.min("w").alias("w"))
            part = ready.join(told, "c").select("c", (~F.col("cyclic") & F.col("w")).alias("well"), "rank")
        done = written(part if done is None else done.unionByName(part))
        open_ = written(open_.join(ready.select("c"), "c", "left_anti"))
    if done is None:
        return scc.select("id", F.lit(None).cast("int").alias("rank"))
    return scc.join(done.select(F.col("c").alias("component"), "rank"), "component").select("id", "rank")


def edges_by_level(edges: DataFrame, levels: DataFrame, bound: str | None = None) -> DataFrame:
    """(eid, position): edges ordered by their target's level, then by a bound among their properties, then by id."""
    own = edges.join(levels.select(F.col("id").alias("dst"), "level"), "dst")
    key = F.struct("level", (F.try_element_at("props", F.lit(bound)).try_cast("double") if bound else F.lit(None).cast("double")).alias("b"), "eid")
    return ranked_rows(own.select("eid", key.alias("_key")), "_key", "position").select("eid", "position")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest path from a source of an acyclic graph; nodes on or after a cycle have no row."""
    arcs = cut(directed(edges))
    open_, level, found = cut(nodes.select("id").distinct()), 0, None
    while True:
        ready = cut(open_.join(arcs.select(F.col("v").alias("id")), "id", "left_anti"))
        if ready.isEmpty():
            return found if found is not None else ready.withColumn("level", F.lit(0))
        part = ready.withColumn("level", F.lit(level))
        found = part if found is None else cut(found.unionByName(part))
        open_ = cut(open_.join(ready, "id", "left_anti"))
        arcs = cut(arcs.join(ready.select(F.col("id").alias("u")), "u", "left_anti"))
        level += 1


#: Pieces of the range of ids, the bits of a long.
PIECES = 64


def triangle_count(edges: DataFrame) -> DataFrame:
    """Triangles of the simple undirected graph.

    Edges point from lower to higher degree, so the pairs joined at a node stay
    few however many edges a hub has.
    """
    simple = edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    simple = written(simple)
    low, high = simple.agg(F.min("u"), F.max("v")).first()
    if low is None:
        return edges.sparkSession.createDataFrame([(0,)], "n_triangles long")
    # Ids fall into pieces of their range.  A wedge of which no edge joins the ends' pieces cannot close, and edges between pieces that no wedge has close none.
    width = (high - low) // PIECES + 1
    piece = lambda c: F.least(F.lit(PIECES - 1), F.floor((F.col(c).cast("double") - F.lit(float(low))) / F.lit(float(width))).cast("int"))
    degree = simple.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    ends = simple.join(degree.select("u", F.col("d").alias("du")), "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    arcs = bucketed(ends.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("c"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("x")), "c")
    met = arcs.groupBy("c").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), piece("x"))).alias("mask")).select("mask").distinct()
    places = lambda: F.explode(F.filter(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.getbit("mask", k) == 1))
    wanted = met.select("mask", places().alias("px")).select("px", places().alias("py")).filter("px <= py").distinct()
    joined = simple.select(piece("u").alias("px"), piece("v").alias("py")).distinct()
    open_ = F.broadcast(written(joined.join(wanted, ["px", "py"], "left_semi")))  # PIECES squared rows at most
    closing = written(simple.select(F.col("u").alias("x"), F.col("v").alias("y"), piece("u").alias("px"), piece("v").alias("py")).join(open_, ["px", "py"], "left_semi").select("x", "y"))
    wedges = arcs.join(arcs.select("c", F.col("x").alias("y")), "c").filter("x < y")
    wedges = wedges.select("x", "y", piece("x").alias("px"), piece("y").alias("py")).join(open_, ["px", "py"], "left_semi")
    closed = wedges.join(closing, ["x", "y"])  # both have the lesser id first
    return closed.agg(F.count(F.lit(1)).alias("n_triangles"))


def mean_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, q: float = 0.15) -> DataFrame:
    """(id, value): rank by the mean of the in-neighbours' ranks, normalised to 1 each round.

    The start is 1 / n; a round gives q / n + (1 - q) * mean, where a node
    without in-neighbours has mean 0.

    A round is linear but for its norm, which is a number, and starts from equal
    ranks, as its constant part is.  So all that is made of tables are the means of
    means e_j = (1 - q) * mean(e_(j-1)) of e_0 = q / n.  The ranks after k rounds are
    e_0 + e_1 / T_(k-1) + e_2 / (T_(k-1) T_(k-2)) + .. + e_k / (q T_(k-1) .. T_1), over
    the norm T_k; the norms come from the sums of e_j alone.  Where no path of j
    edges ends, e_j is 0 and has no row, so a graph without cycles is done
    after its longest path.
    """
    n = nodes.count()
    if not n or not rounds:
        return nodes.select("id", F.lit(1.0 / max(1, n)).alias("value"))
    arcs = bucketed(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u", distinct=True)
    share = arcs.groupBy("v").agg((F.lit(1.0 - q) / F.count(F.lit(1))).alias("w"))
    share = bucketed(share.join(nodes.select(F.col("id").alias("v")), "v", "left_semi"), "v")
    means, sums = [nodes.select("id", F.lit(q / n).alias("value"))], [q]
    while len(sums) <= rounds:
        # Built on the ranks, which are few beside the edges.
        moved = arcs.join(means[-1].hint("shuffle_hash"), F.col("u") == F.col("id")).groupBy("v").agg(F.sum("value").alias("value"))
        seen = Observation()
        found = moved.join(share, "v").select(F.col("v").alias("id"), (F.col("value") * F.col("w")).alias("value"))
        found = written(found.observe(seen, F.sum("value").alias("total")))
        if not seen.get["total"]:
            break
        means.append(found)
        sums.append(seen.get["total"])
    norms: list[float] = []
    for k in range(1, rounds + 1):
        weights = [1.0]  # of e_0, e_1 .. in round k, before its own norm
        for norm in reversed(norms[max(0, k - len(sums)) :]):
            weights.append(weights[-1] / norm)
        if k < len(sums):
            weights.append(weights[-1] / q)
        norms.append(sum(w * s for w, s in zip(weights, sums, strict=False)))
    parts = [m.select("id", (F.col("value") * F.lit(w / norms[-1])).alias("value")) for w, m in zip(weights, means, strict=False)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("value").alias("value"))


def induced(g: Graph, ids: DataFrame) -> Graph:
    """The subgraph on some nodes ``ids(id)``."""
    keep = lambda c: ids.select(F.col("id").alias(c)).distinct()
    return Graph(g.nodes.join(keep("id"), "id", "left_semi"), g.edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi"))


def edge_induced(g: Graph, edges: DataFrame) -> Graph:
    """The subgraph on some edges (eid) and their ends."""
    kept = g.edges.join(edges.select("eid"), "eid", "left_semi")
    ends = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(g.nodes.join(ends, "id", "left_semi"), kept)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[c for c in edges.columns if c not in ("src", "dst")], F.col("dst").alias("src"), F.col("src").alias("dst"))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def insert_edges(g: Graph, edges: DataFrame) -> Graph:
    """Adds edges (of the edge schema) between nodes that exist."""
    return Graph(g.nodes, g.edges.unionByName(induced(Graph(g.nodes, edges), g.nodes).edges))


def insert_nodes(g: Graph, nodes: DataFrame) -> Graph:
    return Graph(g.nodes.unionByName(nodes.join(g.nodes, "id", "left_anti")), g.edges)


def remove_edges(g: Graph, eids: DataFrame) -> Graph:
    return Graph(g.nodes, g.edges.join(eids.select("eid"), "eid", "left_anti"))


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    gone = lambda c: ids.select(F.col("id").alias(c))
    return Graph(g.nodes.join(gone("id"), "id", "left_anti"), g.edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"))


def without_isolated(g: Graph, least_degree: int = 1) -> Graph:
    """Drops nodes of a total degree below ``least_degree``, with their edges."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= least_degree)
    return induced(g, ends.select("id"))


def merge(a: Graph, b: Graph) -> Graph:
    """Union of two graphs by node id: nodes of both once (the first graph's), equal edges (ends and type) once."""
    edges = a.edges.unionByName(b.edges)
    first = edges.groupBy("src", "dst", "type").agg(F.min(F.struct("eid", F.map_entries("props").alias("p"))).alias("e"))
    props = F.map_from_entries("e.p")
    return Graph(a.nodes.unionByName(b.nodes.join(a.nodes, "id", "left_anti")), first.select(F.col("e.eid").alias("eid"), "src", "dst", "type", props.alias("props")))


def _draw(*columns: str, seed: int) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.xxhash64(*columns, F.lit(seed))


def insert_random_edges(g: Graph, count: int, kind: str = "RELATED", seed: int = 1) -> Graph:
    """Adds ``count`` edges between nodes drawn by hash, no loops; fewer if a graph of one node allows none."""
    first = g.edges.agg(F.coalesce(F.max("eid"), F.lit(-1)).alias("m")).first()["m"] + 1
    draws = g.spark.range(count).select((F.col("id") + first).alias("eid"))
    # Ends are neighbours in the order of a hash, so no node is drawn twice before all have been.
    ids = [r.id for r in g.nodes.orderBy(_draw("id", seed=seed), "id").limit(2 * count + 2).select("id").collect()]
    rows = [(r.eid, ids[(2 * k) % len(ids)], ids[(2 * k + 1) % len(ids)]) for k, r in enumerate(draws.collect())] if len(ids) > 1 else []
    new = g.spark.createDataFrame(rows, "eid long, src long, dst long").filter("src <> dst")
    return Graph(g.nodes, g.edges.unionByName(new.withColumn("type", F.lit(kind)).withColumn("props", F.create_map().cast("map<string,string>"))))


def remove_random_edges(g: Graph, count: int, seed: int = 1) -> Graph:
    return remove_edges(g, g.edges.orderBy(_draw("eid", seed=seed), "eid").limit(count).select("eid"))


def remove_random_nodes(g: Graph, count: int, seed: int = 1) -> Graph:
    return remove_nodes(g, g.nodes.orderBy(_draw("id", seed=seed), "id").limit(count).select("id"))


def extend_edges(g: Graph, eids: DataFrame, hops: int) -> Graph:
    """Replaces some edges by paths of ``hops`` edges over new nodes without labels."""
    if hops < 2:
        return g
    one = g.nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first()["m"] + 1
    first = g.edges.agg(F.coalesce(F.max("eid"), F.lit(-1)).alias("m")).first()["m"] + 1
    old = ranked_rows(g.edges.join(eids.select("eid"), "eid", "left_semi"), "eid", "_k")
    at = lambda j: F.when(F.lit(0) == j, F.col("src")).when(j == hops, F.col("dst")).otherwise(F.lit(one) + F.col("_k") * (hops - 1) + j - 1)
    steps = old.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(hops - 1))))
    edges = steps.select((F.lit(first) + F.col("_k") * hops + F.col("_j")).cast("long").alias("eid"), at(F.col("_j")).cast("long").alias("src"), at(F.col("_j") + 1).cast("long").alias("dst"), "type", "props")
    inner = old.select(F.explode(F.sequence(F.lit(one) + F.col("_k") * (hops - 1), F.lit(one) + (F.col("_k") + 1) * (hops - 1) - 1)).alias("id"))
    nodes = inner.select(F.col("id").cast("long").alias("id"), F.array().cast("array<string>").alias("labels"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(g.nodes.unionByName(nodes), remove_edges(g, eids).edges.unionByName(edges))


def clone_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Adds a copy of each given node, with its labels, properties and edges; copies of two joined nodes are joined to the originals."""
    one = g.nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first()["m"] + 1
    first = g.edges.agg(F.coalesce(F.max("eid"), F.lit(-1)).alias("m")).first()["m"] + 1
    own = cut(ranked_rows(g.nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id"), "id", "_k").select("id", (F.col("_k") + one).cast("long").alias("new")))
    nodes = g.nodes.join(own, "id").select(F.col("new").alias("id"), "labels", "props")
    out = g.edges.join(own.withColumnRenamed("id", "src"), "src").select("eid", F.col("new").alias("src"), "dst", "type", "props", F.lit(0).alias("_way"))
    into = g.edges.join(own.withColumnRenamed("id", "dst"), "dst").select("eid", "src", F.col("new").alias("dst"), "type", "props", F.lit(1).alias("_way"))
    more = ranked_rows(out.unionByName(into).withColumn("_key", F.struct("eid", "_way")), "_key", "_k").withColumn("eid", (F.col("_k") + first).cast("long"))
    return Graph(g.nodes.unionByName(nodes), g.edges.unionByName(more.select("eid", "src", "dst", "type", "props")))


def clear_attributes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Nodes without some of their properties."""
    return nodes.withColumn("props", F.map_filter("props", lambda k, _: ~k.isin(names)))


def grow_by_walks(g: Graph, ids: DataFrame, size: int, most_degree: int = 1000, seed: int = 1) -> Graph:
    """The subgraph on ``ids(id)`` grown to ``size`` nodes, or until nothing is near: each round every node takes a random neighbour of a degree below ``most_degree``."""
    steps = cut(undirected(g.edges))
    small = steps.groupBy("u").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") < most_degree).select(F.col("u").alias("v"))
    steps, have, turn = cut(steps.join(small, "v", "left_semi")), cut(ids.select("id").distinct()), 0
    n = have.count()
    while n < size:
        turn += 1
        near = steps.join(have.withColumnRenamed("id", "u"), "u").join(have.withColumnRenamed("id", "v"), "v", "left_anti")
        taken = near.groupBy("u").agg(F.min_by("v", F.xxhash64("u", "v", F.lit(seed + turn))).alias("id")).select("id").distinct()
        taken = cut(taken.orderBy(_draw("id", seed=seed), "id").limit(size - n))
        if taken.isEmpty():
            break
        have = cut(have.unionByName(taken))
        n = have.count()
    return induced(g, have)


def sample_nodes(g: Graph, fraction: float, seed: int = 1) -> Graph:
    """A Bernoulli sample of the nodes and the edges between them; equal seeds give equal samples."""
    keep = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    both = F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    there = F.pmod(F.xxhash64("dst", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return Graph(g.nodes.filter(keep), g.edges.filter(both & there))


def edge_snapshots(edges: DataFrame, percent: int, snapshots: int = 5, multiplier: int = 2_654_435_761) -> DataFrame:
    """Edges with ``snapshot`` 1 to ``snapshots``: each drops a further ``percent`` of the original edges, by an arithmetic hash of their id."""
    slot = F.pmod(F.col("eid") * F.lit(7919) + F.lit(multiplier % 1000), F.lit(100))
    numbers = F.sequence(F.lit(1), F.lit(snapshots))
    return edges.withColumn("snapshot", F.explode(numbers)).filter(slot >= F.col("snapshot") * percent)
