"""Paths, distances and reachability by frontier joins.

Each round joins the last frontier with the edges and drops what is known by an
anti join; rounds end with an empty frontier or at the depth asked for.  Where
steps go both ways, what is known and near is in the last two frontiers, so that
no round reads the rest.  Frontiers are checkpointed, so plans stay short and a
lost executor repeats one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.iterate import bucketed, cut, written

#: Sources of one search, the bits of a long.
SHARED_SOURCES = 64
#: Rows of a frontier up to which steps are read where they come from, not stored before.
DIRECT_ROWS = 10_000
#: Sources searched from at once for eccentricities, and an upper bound before any search.
ECCENTRICITY_BATCH, UNBOUNDED = SHARED_SOURCES, 2**31 - 1
#: Nodes of the middle have at least this part of the greatest degree.
HUB_SHARE = 8


def one_way(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(u, v): steps along the edges, or against them, of parallel edges repeated."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")


def directed(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(u, v): distinct steps along the edges, or against them."""
    return one_way(edges, reverse).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v): steps along and against the edges, of parallel edges repeated."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).filter("u <> v")


def undirected(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct()


def stored(steps: DataFrame) -> DataFrame:
    """``steps(u, v)`` in buckets of ``u``, as searches read them in every round; repeated ones stay, since a search takes a node once however many steps lead to it."""
    return bucketed(steps, "u")


class Steps:
    """``steps(u, v)`` of a search: small frontiers, and the last one of a search of limited depth, meet them where they come from.

    Only steps between the least and the greatest node of the frontier are read
    then, a filter that reaches the scans.  For a larger frontier that others may follow,
    steps are ``stored``, once, and read from there on.
    """

    def __init__(self, steps: DataFrame, table: DataFrame | None = None) -> None:
        self.plain, self.table = steps, table

    def of(self, frontier: DataFrame, rows: int, first: int, last: int, end: bool) -> DataFrame:
        """Steps joined with ``frontier(u, ..)`` of so many rows from ``first`` to ``last``; ``end`` says that no other frontier comes."""
        small = rows <= DIRECT_ROWS
        if self.table is None and (small or end):
            near = self.plain.filter(F.col("u").between(first, last))
            return near.join(F.broadcast(frontier) if small else frontier.hint("shuffle_hash"), "u")
        if self.table is None:
            self.table = stored(self.plain)
        # Built on the frontier; the steps stay in their buckets.
        return self.table.join(frontier.hint("shuffle_hash"), "u")


def few(rows: DataFrame, column: str) -> list[int] | None:
    """The distinct ids of a column, if one search can share them."""
    found = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().limit(SHARED_SOURCES + 1).collect()]
    return sorted(found) if len(found) <= SHARED_SOURCES else None


def distances(steps: DataFrame, sources: DataFrame, depth: int | None = None, symmetric: bool = False) -> DataFrame:
    """(src, dst, d): hop distances from each source along ``steps(u, v)``, the source itself at 0.

    ``sources(id)``; up to 64 share one search, of more every one grows its own
    frontier.  No row means unreachable.  ``symmetric`` says that every step has its
    reverse: neighbours of one frontier are at most one hop nearer, so only the last
    two are dropped from the next.
    """
    ids = few(sources, "id")
    if ids is not None:
        # A search without a limit of depth reads the steps to the end, so they are stored at once.
        levels, _ = shared_search(Steps(steps) if depth is not None else stored(steps), ids, depth, symmetric)
        return reduce(DataFrame.unionByName, [level.select(_met(mask_bits(ids)).alias("src"), F.col("id").alias("dst"), F.lit(d).alias("d")) for d, level in enumerate(levels)])
    steps = stored(steps)
    frontier = written(sources.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct())
    levels, d = [frontier.withColumn("d", F.lit(0))], 0
    seen = frontier
    while depth is None or d < depth:
        d += 1
        moved = steps.join(frontier.hint("shuffle_hash"), F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst")).distinct()
        frontier = written(moved.join(seen, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            break
        before = levels[-1].drop("d") if symmetric else seen
        levels.append(frontier.withColumn("d", F.lit(d)))
        seen = before.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels)


def hop_distance(edges: DataFrame, source: int, depth: int | None = None) -> DataFrame:
    spark = edges.sparkSession
    return distances(both_ways(edges), spark.createDataFrame([(source,)], "id long"), depth, symmetric=True)


def coloured_distances(edges: DataFrame, sources: DataFrame, colours: list[list[str]], depth: int | None = None) -> DataFrame:
    """(colour, src, dst, d): directed distances along the edges of each set of types, named by its types joined with ``|``."""
    parts = [distances(one_way(edges.filter(F.col("type").isin(own))), sources, depth).select(F.lit("|".join(own)).alias("colour"), "src", "dst", "d") for own in colours]
    return reduce(DataFrame.unionByName, parts)


def shortest_path(edges: DataFrame, source: int, target: int, depth: int = 4) -> DataFrame:
    """(path, d): the undirected shortest path of least ids, by position, up to ``depth``; no row if there is none."""
    steps = Steps(both_ways(edges))
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, [source])], "v long, path array<long>")
    seen = frontier.select("v")
    for d in range(depth + 1):
        found = frontier.filter(F.col("v") == target)
        size = frontier.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last")).first()
        if d == depth or not size.n or not found.isEmpty():
            return found.select("path", F.lit(d).alias("d"))
        moved = steps.of(frontier.select(F.col("v").alias("u"), "path"), *size, d + 1 == depth).join(seen, "v", "left_anti")
        # A shortest path of least ids to a node goes on from one to its predecessor: one path for each node is enough.
        frontier = written(moved.groupBy("v").agg(F.min("path").alias("path")).select("v", F.concat("path", F.array("v")).alias("path")))
        seen = seen.unionByName(frontier.select("v"))
    raise AssertionError


def khop(edges: DataFrame, sources: DataFrame, k: int, reverse: bool = False) -> DataFrame:
    """(src, dst, d) within k directed hops, forward or backward."""
    return distances(one_way(edges, reverse), sources, k)


def closure(edges: DataFrame, source: int, reverse: bool = False) -> DataFrame:
    """Nodes that the source reaches (or that reach it), itself included."""
    return distances(one_way(edges, reverse), edges.sparkSession.createDataFrame([(source,)], "id long")).select(F.col("dst").alias("id"))


def within_bound(edges: DataFrame, pairs: DataFrame, bound: int) -> DataFrame:
    """Of ``pairs(src, dst)``, those joined by a directed path of ``bound`` hops or fewer, with its length.

    Few targets share one backward search, few sources a forward one.  Of many on
    both sides, searches meet in the middle: forward frontiers of half the bound
    from the sources, backward ones from the targets.
    """
    for end, far in (("dst", "src"), ("src", "dst")):
        if few(pairs, end) is not None:
            found = distances(one_way(edges, reverse=end == "dst"), pairs.select(F.col(end).alias("id")).distinct(), bound)
            return pairs.select("src", "dst").distinct().join(found.select(F.col("src").alias(end), F.col("dst").alias(far), "d"), ["src", "dst"])
    ahead = distances(one_way(edges), pairs.select(F.col("src").alias("id")).distinct(), (bound + 1) // 2)
    back = distances(one_way(edges, reverse=True), pairs.select(F.col("dst").alias("id")).distinct(), bound // 2)
    forward = pairs.join(ahead.select("src", F.col("dst").alias("m"), F.col("d").alias("d1")), "src")
    backward = back.select(F.col("src").alias("dst"), F.col("dst").alias("m"), F.col("d").alias("d2"))
    return forward.join(backward, ["dst", "m"]).groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("d")).filter(F.col("d") <= bound)


def coloured_reach(edges: DataFrame, sources: DataFrame, steps: list[tuple[str, int]]) -> DataFrame:
    """(src, dst) joined by a directed path of edge types that follows ``steps``: one to ``bound`` edges of each type in turn.

    Few targets, as bits of one number for each node, come back along the steps to
    the sources, so that no step makes a row for each pair; of many, pairs go forward.
    """
    ends = few(edges.filter(F.col("type") == steps[-1][0]), "dst") if steps else None
    if ends is not None:
        bits = mask_bits(ends)
        current = edges.sparkSession.createDataFrame(bits, "id long, mask long")
        for kind, bound in reversed(steps):
            own = edges.filter(F.col("type") == kind).select(F.col("src").alias("u"), F.col("dst").alias("v"))
            level, reached = current, None
            for k in range(bound):
                level = level.join(own, level["id"] == own["v"]).groupBy(F.col("u").alias("id")).agg(F.bit_or("mask").alias("mask"))
                if reached is not None:
                    level = level.join(reached.select("id", F.col("mask").alias("known")), "id", "left")
                    level = level.select("id", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))).alias("mask")).filter("mask <> 0")
                level = written(level)
                reached = level if reached is None else reached.unionByName(level).groupBy("id").agg(F.bit_or("mask").alias("mask"))
                if k + 1 < bound and level.isEmpty():
                    break
            current = reached
        return current.join(sources.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("src"), _met(bits).alias("dst"))
    current = sources.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct()
    for kind, bound in steps:
        own = directed_with_loops(edges.filter(F.col("type") == kind))
        level, reached = current, None
        for _ in range(bound):
            level = level.join(own, level["dst"] == own["u"]).select("src", F.col("v").alias("dst")).distinct()
            if reached is not None:
                level = level.join(reached, ["src", "dst"], "left_anti")
            level = written(level)
            reached = level if reached is None else reached.unionByName(level)
            if level.isEmpty():
                break
        current = written(reached.distinct())
    return current


def _met(bits: list[tuple[int, int]]) -> Column:
    """A row for each source (or target) whose bit is in ``mask``."""
    if not bits:
        return F.explode(F.array().cast("array<long>"))
    places = F.filter(F.sequence(F.lit(0), F.lit(len(bits) - 1)), lambda k: F.getbit("mask", k) == 1)
    return F.explode(F.transform(places, lambda k: F.get(F.array(*[F.lit(s).cast("long") for s, _ in bits]), k)))


def directed_with_loops(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()


def typed_bfs(edges: DataFrame, source: int, kind: str, depth: int | None = None) -> DataFrame:
    """(id, depth) along outgoing edges of one type."""
    one = edges.sparkSession.createDataFrame([(source,)], "id long")
    return distances(one_way(edges.filter(F.col("type") == kind)), one, depth).select(F.col("dst").alias("id"), F.col("d").alias("depth"))


def eccentricity(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, value): greatest undirected distance from each source to what it reaches; sources, few of the nodes, search by 64 at once."""
    ids = sorted(r.id for r in sources.select("id").distinct().collect())
    steps = stored(both_ways(edges))
    rows = [row for k in range(0, len(ids), SHARED_SOURCES) for part in [ids[k : k + SHARED_SOURCES]] for row in zip(part, shared_search(steps, part)[1], strict=True)]
    return edges.sparkSession.createDataFrame(rows, "id long, value int")


def mask_bits(sources: list[int]) -> list[tuple[int, int]]:
    """(source, its bit in a long) of up to 64 sources."""
    return [(s, (1 << k) - (1 << 64 if k == 63 else 0)) for k, s in enumerate(sources)]


def shared_search(steps: DataFrame | Steps, sources: list[int], depth: int | None = None, symmetric: bool = True) -> tuple[list[DataFrame], list[int]]:
    """Distances from up to 64 sources in one search along steps, ``stored`` ones if they are a table: per hop the nodes (id, mask) with the sources first met there as bits, and each source's eccentricity."""
    steps = steps if isinstance(steps, Steps) else Steps(steps, steps)
    levels, ecc = [written(steps.plain.sparkSession.createDataFrame(mask_bits(sources), "id long, mask long"))], [0] * len(sources)
    extent = (len(sources), min(sources, default=0), max(sources, default=0))
    while depth is None or len(levels) <= depth:
        near = reduce(DataFrame.unionByName, levels[-2:] if symmetric else levels)
        moved = steps.of(levels[-1].withColumnRenamed("id", "u"), *extent, len(levels) == depth).select(F.col("v").alias("id"), "mask", F.lit(0).cast("long").alias("known"))
        # What is known meets what is new in one shuffle.
        new = moved.unionByName(near.select("id", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("known")))
        new = new.groupBy("id").agg(F.bit_or("mask").alias("mask"), F.bit_or("known").alias("known"))
        new = new.select("id", F.col("mask").bitwiseAND(F.bitwise_not(F.col("known"))).alias("mask"))
        seen = Observation()
        counts = [F.bit_or("mask").alias("met"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")]
        new = written(new.filter("mask <> 0").observe(seen, *counts))
        met, extent = seen.get["met"], (seen.get["n"], seen.get["first"], seen.get["last"])
        if not met:
            break
        ecc = [len(levels) if met >> k & 1 else e for k, e in enumerate(ecc)]
        levels.append(new)
    return levels, ecc


def eccentricities(edges: DataFrame, nodes: DataFrame, batch: int = ECCENTRICITY_BATCH, only_greatest: bool = False) -> DataFrame:
    """(id, value): as ``eccentricity`` from every node, without a row for each pair.

    A search from w bounds the value of each v that it reaches: at least d(v, w)
    and ecc(w) - d(v, w), at most ecc(w) + d(v, w).  Rounds search from ``batch``
    nodes, half of them neighbours of most open nodes, half open nodes of the
    greatest lower bound, which are the middle and the rim of the graph, until all
    bounds meet; a node searched from is settled, so rounds end.
    With ``only_greatest`` they end once no open node can exceed the greatest
    lower bound, and ``value`` is the lower bound.  The first round then searches
    from the nodes of the greatest degrees, the second from the one furthest from them.
    """
    steps = stored(both_ways(edges))
    ends = steps.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    bounds = nodes.select("id").distinct().join(ends, "id", "left")
    # Until a search tells more, nodes of the least degree count as the furthest out.
    bounds = bounds.select("id", (-F.coalesce("degree", F.lit(0))).alias("out"), F.lit(0).alias("low"), F.when(F.col("degree") > 0, F.lit(UNBOUNDED)).otherwise(0).alias("high"))
    bounds = written(bounds)
    first, searched, rounds = None, [], 0
    while True:
        open_ = bounds.filter("low < high")
        noise = F.xxhash64("id"), F.col("id")
        if only_greatest and first is None:
            hubs = open_.orderBy("out", *noise).limit(max(1, batch // 2)).collect()
            picked = [r.id for r in hubs if r.out * HUB_SHARE <= hubs[0].out]
        elif only_greatest:
            least = bounds.agg(F.max("low")).first()[0]
            open_ = open_.filter(F.col("high") > least)
            # The furthest node of all may reach what the bounds allow.
            rim = 1 if rounds == 1 else max(1, batch // 2)
            picked = [r.id for r in open_.orderBy(F.desc("high"), F.desc("out"), *noise).limit(rim).collect()]
            if picked and rounds > 1:
                # A node w settles those within the greatest value less its own of it.
                middle = _near_most(steps, open_, 2 if least > min(first[1]) + 1 else 1).filter(~F.col("id").isin(searched + picked))
                picked += [r.id for r in middle.orderBy(F.desc("n"), *noise).limit(batch // 2).collect()]
        else:
            picked = [r.id for r in open_.orderBy(F.desc("low"), F.desc("out"), *noise).limit(max(1, batch // 2)).collect()]
            middle = _near_most(steps, open_, 1).join(open_.select("id"), "id", "left_semi").orderBy(F.desc("n"), *noise)
            picked += [r.id for r in middle.limit(batch // 2).collect() if r.id not in picked]
        if not picked:
            return bounds.select("id", F.col("low").alias("value"))
        searched, rounds = searched + picked, rounds + 1
        found = shared_search(steps, picked)
        if only_greatest and first and bounds.agg(F.max("high")).first()[0] <= max(found[1]):
            # No node can exceed what the search met.
            met = edges.sparkSession.createDataFrame(list(zip(picked, found[1], strict=True)), "id long, e int")
            return bounds.join(F.broadcast(met), "id", "left").select("id", F.greatest("low", "e").alias("value"))
        bounds = written(_bounded(bounds, *found, out=only_greatest and first is None))
        if only_greatest and first:
            bounds = _far_pairs_only(bounds, *first)
        first = first or found


def _near_most(steps: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(id, n): the number of walks of so many steps from ``nodes(id)`` to each node."""
    counts = nodes.select("id", F.lit(1.0).alias("n"))
    for _ in range(hops):
        counts = steps.join(counts.select(F.col("id").alias("u"), "n").hint("shuffle_hash"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("n").alias("n"))
    return counts


def _bounded(bounds: DataFrame, levels: list[DataFrame], ecc: list[int], both: bool = True, out: bool = False) -> DataFrame:
    """``bounds`` with what a search tells of every node that it met; without ``both`` of the upper ones only, with ``out`` of the sum of its distances from all sources too."""
    # A node's sources at one distance all tell by their own eccentricity, of which there are few values.
    masks = {e: sum(1 << k for k, x in enumerate(ecc) if x == e) for e in set(ecc)}
    masks = {e: m - (1 << 64) if m >> 63 else m for e, m in masks.items()}
    told = []
    for d, level in enumerate(levels):
        has = {e: F.col("mask").bitwiseAND(F.lit(m)) != 0 for e, m in masks.items()}
        low = F.greatest(F.lit(-1), *[F.when(x, max(d, e - d)) for e, x in has.items()])
        high = F.least(F.lit(UNBOUNDED), *[F.when(x, e + d) for e, x in has.items()])
        told.append(level.select("id", (low if both else F.lit(-1)).alias("l"), high.alias("h"), (F.bit_count("mask") * d).cast("long").alias("o")))
    told = reduce(DataFrame.unionByName, told).groupBy("id").agg(F.max("l").alias("l"), F.min("h").alias("h"), F.sum("o").alias("o"))
    sums = F.coalesce("o", "out").alias("out") if out else F.col("out")
    return bounds.join(told, "id", "left").select("id", sums, F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high"))


def _far_pairs_only(bounds: DataFrame, levels: list[DataFrame], ecc: list[int]) -> DataFrame:
    """Upper bounds of the distance to open nodes alone, until no more nodes are settled.

    A pair further apart than the greatest lower bound has two open ends.  So a
    node is at most d(v, w) and w's distance to the furthest open node from any open one.
    ``levels`` and ``ecc`` are those of the search from the middle.
    """
    met = reduce(DataFrame.unionByName, [x.select("id", F.lit(d).alias("d"), "mask") for d, x in enumerate(levels)])
    before = None
    while True:
        least = bounds.agg(F.max("low")).first()[0]
        open_ = bounds.filter((F.col("low") < F.col("high")) & (F.col("high") > F.lit(least)))
        if (now := open_.count()) in (0, before):
            return bounds
        told = {r.d: r.m for r in met.join(open_.select("id"), "id", "left_semi").groupBy("d").agg(F.bit_or("mask").alias("m")).collect()}
        # Of an eccentricity counts what an open node is away; nothing, if the search met none.
        far = [max((d for d, m in told.items() if m >> k & 1), default=-1) for k in range(len(ecc))]
        if far == ecc:
            return bounds
        before, ecc = now, far
        bounds = written(_bounded(bounds, levels, far, both=False))


def diameter(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Greatest finite undirected distance, over all pairs, without a row for each."""
    return eccentricities(edges, nodes, only_greatest=True).agg(F.max("value").alias("diameter"))


class DistanceCache:
    """Bounded directed distances of node pairs, kept in a checkpointed table: a pair is searched for once, and misses are kept as well."""

    def __init__(self, edges: DataFrame, bound: int) -> None:
        self.edges, self.bound, self.known = edges, bound, None
        self.hits = self.searched = 0

    def get(self, pairs: DataFrame) -> DataFrame:
        """``pairs(src, dst)`` with ``d``, null if they are further apart than the bound."""
        pairs = pairs.select("src", "dst").distinct()
        new = pairs if self.known is None else pairs.join(self.known, ["src", "dst"], "left_anti")
        new = cut(new)
        n = new.count()
        self.hits, self.searched = self.hits + pairs.count() - n, self.searched + n
        if n:
            found = cut(new.join(within_bound(self.edges, new, self.bound), ["src", "dst"], "left"))
            self.known = found if self.known is None else cut(self.known.unionByName(found))
        return pairs.join(self.known, ["src", "dst"]) if self.known is not None else pairs.withColumn("d", F.lit(None).cast("int"))
