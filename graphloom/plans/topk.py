"""Top-k approximate subgraph matching.

Candidates come from an equi-join on label prefixes and a similarity filter.  A
star is its pivot's candidates joined with edges and each leaf's candidates; of a
leaf that no other star shares only the best ``k + n - 1`` per pivot can be part
of an answer, so no more are kept.  Stars are joined on the query nodes that they
share; of very many candidates, only rows that can reach the k-th score of the
answers that the best rows alone give.  If all answers tie, those of the first
query node's greatest candidates are made alone.  Answers map distinct query nodes to distinct data nodes; they are ranked
by the sum of similarities, then by node ids in query order, both descending.
"""

from __future__ import annotations

from collections.abc import Mapping
from copy import copy
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions.similarity import label_similarity, lev_norm, node_terms
from graphloom.operators.indexes import PrefixIndex, degrees, neighbours_to_two
from graphloom.operators.iterate import bucketed, cut, written
from graphloom.plans.query import Plan, Query, Star, decompose, make_plan
from graphloom.sources.graph import Graph

#: Candidate rows up to which a query node's candidates count as small enough to be broadcast.
BROADCAST_ROWS = 50_000
#: Candidates of a query from which star rows are pruned by score before they are joined, and best rows of each star that bound it.
BOUNDED_ROWS, LEADING_ROWS = 1_000_000, 10_000
#: Where all answers tie, the first query node's candidates of the greatest ids that are answered first, and how many times as many come next.
FIRST_HEADS, MORE_HEADS = 100, 10


class SimilarityMemo:
    """Similarities of query labels to data labels, kept from query to query.

    The key is a pair of labels, not of nodes: nodes of one label share an entry.
    Entries of a query label are joined before any edit distance is taken; only
    what is missing is computed, and written.  ``computed`` counts it.
    """

    def __init__(self) -> None:
        self.known: dict[str, list[DataFrame]] = {}
        self.computed = 0

    def of(self, label: str, terms: DataFrame) -> DataFrame:
        """(term, value) of the distinct ``terms(term)``."""
        pieces = self.known.setdefault(label, [])
        new = terms.select("term").distinct()
        if pieces:
            new = new.join(reduce(DataFrame.unionByName, pieces), "term", "left_anti")
        new = written(new.withColumn("value", F.greatest(F.lit(0.0), lev_norm(F.lit(label), F.col("term")))))
        if n := new.count():
            self.computed += n
            pieces.append(new)
        if len(pieces) > 8:
            pieces[:] = [written(reduce(DataFrame.unionByName, pieces))]
        return reduce(DataFrame.unionByName, pieces) if pieces else new

    def similarity(self, label: str, rows: DataFrame) -> DataFrame:
        """(id, sim) of ``rows(id, terms)``, as ``label_similarity`` gives it."""
        each = cut(rows.select("id", F.posexplode("terms").alias("at", "term")))
        found = each.join(self.of(label, each), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
        return found.select("id", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x["value"]) / F.size("v")).alias("sim"))

    def close(self) -> None:
        """Forgets all entries."""
        self.known.clear()


def candidates(
    g: Graph, query: Query, p: int, theta: float, structural: bool = False, index: PrefixIndex | None = None, memo: SimilarityMemo | None = None
) -> DataFrame:
    """(qid, id, sim) of all data nodes that may stand for a query node.

    A candidate shares the first ``p`` characters of a label (of a property
    value, if it has no label) and is more similar than ``theta``.  A query label
    shorter than ``p`` has none.  In structural mode labels do not count: every
    node of enough in- and out-neighbours is a candidate of similarity 1.  An
    ``index`` of the graph's nodes is read instead of the nodes; a ``memo`` gives
    the similarities that earlier queries took.
    """
    if index is not None and index.p != p:
        raise ValueError(f"the index has prefixes of {index.p} characters, not {p}")
    if structural:
        need = {q: (len({a for a, b in query.edges if b == q}), len({b for a, b in query.edges if a == q})) for q in query.ids}
        count = neighbours_to_two if max(n for both in need.values() for n in both) <= 2 else degrees
        fits = [F.when((F.col("in_neighbours") >= i) & (F.col("out_neighbours") >= o), F.lit(q)) for q, (i, o) in need.items()]
        return count(g.nodes, g.edges).select(F.explode(F.array(*fits)).alias("qid"), "id", F.lit(1.0).alias("sim")).filter(F.col("qid").isNotNull())
    terms = g.nodes.select("id", node_terms().alias("terms"))
    parts = []
    for q, label in query.labels.items():
        if len(label) < p:
            blocked = terms.filter(F.lit(False))
        elif index is not None:
            blocked = index.lookup(label[:p])
        else:  # one literal for each query node: the filter runs in the scan of the nodes, no join is needed
            blocked = terms.filter(F.exists("terms", _starts(label[:p])))
        own = memo.similarity(label, blocked) if memo else blocked.select("id", label_similarity(F.lit(label), F.col("terms")).alias("sim"))
        parts.append(own.filter(F.col("sim") > theta).select(F.lit(q).alias("qid"), "id", "sim"))
    return reduce(DataFrame.unionByName, parts)


def _starts(prefix: str):
    return lambda t: F.substring(t, 1, len(prefix)) == prefix


def candidate_counts(cands: DataFrame) -> DataFrame:
    return cands.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def _col(q: str) -> str:
    return f"q{q}"


def _distinct(qids: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(_col(a)) != F.col(_col(b)) for a, b in combinations(qids, 2)], F.lit(True))


def rank_order(qids: list[str]) -> list[Column]:
    return [F.desc("score"), *[F.desc_nulls_last(_col(q)) for q in qids]]


def total(qids: list[str]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s{q}"), F.lit(0.0)) for q in qids]), 6)


class Matcher:
    """One query against one graph: its candidates, plan and star tables."""

    def __init__(
        self, g: Graph, query: Query, p: int = 12, theta: float = 0.3, structural: bool = False, index: PrefixIndex | None = None, memo: SimilarityMemo | None = None
    ) -> None:
        if not query.connected():
            raise ValueError("the query graph is not connected, so its answers are products")
        self.graph, self.query = g, query
        self.cands = candidates(g, query, p, theta, structural, index, memo).persist()
        extent = self.cands.groupBy("qid").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), (F.min("sim") == F.max("sim")).alias("ties")
        ).collect()
        self.counts: Mapping[str, int] = {q: 0 for q in query.ids} | {r.qid: r.n for r in extent}
        self.extent = {r.qid: (r.first, r.last) for r in extent}
        self.ties = all(r.ties for r in extent)
        self._near: dict[str, DataFrame] = {}
        self._met: dict[tuple[str, str, str], DataFrame] = {}
        self.plan: Plan = make_plan(query, decompose(query, self.counts))

    def _of(self, q: str) -> DataFrame:
        own = self._near[q] if q in self._near else self.cands.filter(F.col("qid") == q).select(F.col("id").alias(_col(q)), F.col("sim").alias(f"s{q}"))
        return F.broadcast(own) if self.counts[q] <= BROADCAST_ROWS else own

    def close(self) -> None:
        """Gives back what is kept of the candidates."""
        self.cands.unpersist()

    def distinct(self, qids: list[str]) -> Column:
        return _distinct(qids)

    def steps(self, a: str, b: str) -> DataFrame:
        """(qa, qb), of parallel edges repeated: the edges whose ends lie between the least and the greatest candidate of a query edge's nodes, a filter that reaches the scans."""
        ends = self.graph.edges.select(F.col("src").alias(_col(a)), F.col("dst").alias(_col(b)))
        for q in (a, b):
            ends = ends.filter(F.col(_col(q)).between(*self.extent[q]) if q in self.extent else F.lit(False))
            if q in self._near:  # broadcast, if small: so it is asked in the scans too
                ends = ends.join(self._of(q).select(_col(q)), _col(q), "left_semi")
        return ends

    def met(self, a: str, b: str, by: str) -> DataFrame:
        """(qa, qb) with both similarities: all distinct pairs of candidates that an edge of the graph joins as a query edge does.

        The graph is read for it once; all else that a query asks of the edge reads the pairs, in buckets of ``by``.
        """
        if (a, b, by) not in self._met:
            known = self._met.get((a, b, b if by == a else a))
            if known is None:
                ends = self.steps(a, b).filter(F.col(_col(a)) != F.col(_col(b)))
                for q in sorted((a, b), key=lambda q: self.counts[q]):
                    ends = ends.join(self._of(q), _col(q))
            self._met[a, b, by] = bucketed(ends, _col(by), distinct=True) if known is None else bucketed(known, _col(by))
        return self._met[a, b, by]

    def leaf_matches(self, star: Star) -> list[tuple[str, DataFrame]]:
        """Per leaf, (pivot, leaf, leaf's similarity) of every pair that the star's edge allows."""
        pairs = [(leaf, self.met(a, b, star.pivot)) for (a, b), leaf in zip(star.edges, star.leaves, strict=True)]
        return [(leaf, found.select(_col(star.pivot), _col(leaf), f"s{leaf}")) for leaf, found in pairs]

    def star(self, star: Star, k: int | None = None) -> DataFrame:
        """All matches of a star, or what is enough for the best ``k`` answers."""
        rows = self._of(star.pivot)
        n = len(self.query.ids)
        for leaf, found in self.leaf_matches(star):
            if k is not None and self.plan.stars_of(leaf) == 1:
                best = Window.partitionBy(_col(star.pivot)).orderBy(F.desc(f"s{leaf}"), F.desc(_col(leaf)))
                found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + n - 1).drop("_n")
            rows = rows.join(found, _col(star.pivot))
        return rows.filter(_distinct(star.nodes))

    def joined(self, levels: int, k: int | None = None) -> DataFrame:
        """The first ``levels`` stars of the plan, joined."""
        rows = self.star(self.plan.stars[0], k)
        covered = list(self.plan.stars[0].nodes)
        for star, shared in zip(self.plan.stars[1:levels], self.plan.shared[1:levels], strict=True):
            right = self.star(star, k).drop(*[f"s{q}" for q in shared])
            rows = rows.join(right, [_col(q) for q in shared])
            covered += [q for q in star.nodes if q not in covered]
            rows = rows.filter(_distinct(covered))
        return rows

    def share(self, star: Star) -> Column:
        """A star's part of an answer's score: a node's similarity counts in equal parts for the stars that contain it."""
        return reduce(lambda a, b: a + b, [F.col(f"s{q}") / self.plan.stars_of(q) for q in star.nodes])

    def _combined(self, tables: list[DataFrame]) -> DataFrame:
        """Whole answers, with their score, from rows of every star."""
        rows, covered = None, []
        for star, shared, table in zip(self.plan.stars, self.plan.shared, tables, strict=True):
            part = table.drop("share", *[f"s{q}" for q in shared])
            rows = part if rows is None else rows.join(part, [_col(q) for q in shared])
            covered += [q for q in star.nodes if q not in covered]
            rows = rows.filter(_distinct(covered))
        ids = self.query.ids
        return rows.select(*[_col(q) for q in ids], total(ids).alias("score"))

    def bounded(self, k: int) -> DataFrame:
        """Answers among which the best ``k`` are: of star rows only those that, with the best of every other star, reach the k-th score found among leading rows."""
        tables, first = [], []
        for star in self.plan.stars:
            seen = Observation()
            tables.append(cut(self.star(star, k).withColumn("share", self.share(star)).observe(seen, F.max("share").alias("best"))))
            first.append(seen.get["best"] or 0.0)
        leading = [t.orderBy(F.desc("share"), *[F.desc(_col(q)) for q in s.nodes]).limit(max(LEADING_ROWS, k)) for s, t in zip(self.plan.stars, tables, strict=True)]
        found = self._combined(leading).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()
        if found.n == k:
            # Scores are rounded to six digits.
            tables = [t.filter(F.col("share") + F.lit(sum(first) - f) >= F.lit(found.s - 1e-6)) for t, f in zip(tables, first, strict=True)]
        return self._combined(tables)

    def near(self, heads: DataFrame) -> Matcher:
        """The matcher of the answers whose first node is one of ``heads(q, s)``.

        Steps from the heads along the query's edges leave each query node only the candidates that they meet.  A node of
        one edge keeps all: what its edge's other end meets is found where the pairs are made.
        """
        out = copy(self)
        out._near, out._met, out.counts, out.extent = {}, {}, dict(self.counts), dict(self.extent)

        def leave(q: str, rows: DataFrame) -> None:
            out._near[q] = cut(rows)
            out.counts[q], *ends = out._near[q].agg(F.count(F.lit(1)), F.min(_col(q)), F.max(_col(q))).first()
            out.extent[q] = tuple(ends)  # of none, nulls: no edge lies between them

        seen = self.query.ids[:1]
        leave(seen[0], heads)
        for q in seen:
            for a, b in self.query.incident(q):
                other = b if a == q else a
                if other not in seen:
                    seen.append(other)
                    if len(self.query.incident(other)) > 1:
                        leave(other, out.steps(a, b).select(_col(other)).distinct().join(self._of(other), _col(other)))
        out.plan = make_plan(self.query, decompose(self.query, out.counts))
        return out

    def tied(self, k: int) -> DataFrame:
        """Answers among which the best ``k`` are, if all answers have one score: of the first query node's candidates those of greatest ids decide.

        They are taken by blocks that grow; once ``k`` answers are found, no smaller candidate has a better one.
        """
        ids = self.query.ids
        head, left, size = _col(ids[0]), self.counts[ids[0]], FIRST_HEADS
        heads, found, n = self._of(ids[0]), [], 0
        while left and n < k:
            if size <= LEADING_ROWS:
                least = heads.orderBy(F.desc(head)).limit(size).agg(F.min(head)).first()[0]
            else:
                least = heads.agg(F.percentile_approx(head, max(0.0, 1 - size / left))).first()[0]
            m = self.near(heads.filter(F.col(head) >= least))
            rows = m.joined(len(m.plan.stars), k).select(*[_col(q) for q in ids], total(ids).alias("score"))
            found.append(cut(rows.orderBy(*rank_order(ids)).limit(k)))
            n += found[-1].count()
            heads, left, size = heads.filter(F.col(head) < least), left - m.counts[ids[0]], size * MORE_HEADS
        return reduce(DataFrame.unionByName, found)

    def top(self, k: int) -> DataFrame:
        """The best ``k`` answers: ``rank``, a column for each query node, ``score``."""
        ids = self.query.ids
        if len(self.plan.stars) > 1 and self.ties and all(self.counts.values()) and self.counts[ids[0]] > FIRST_HEADS:
            rows = self.tied(k)
        elif len(self.plan.stars) > 1 and sum(self.counts.values()) > BOUNDED_ROWS:
            rows = self.bounded(k)
        else:
            rows = self.joined(len(self.plan.stars), k).select(*[_col(q) for q in ids], total(ids).alias("score"))
        best = rows.orderBy(*rank_order(ids)).limit(k)
        return best.select(F.row_number().over(Window.orderBy(*rank_order(ids))).cast("long").alias("rank"), *[_col(q) for q in ids], "score")

    def top_anytime(self, k: int) -> DataFrame:
        """The best ``k`` of whole and partial answers: single stars and every join level.

        ``anytime`` is the score plus the numbers of query nodes and edges covered.
        """
        ids, parts = self.query.ids, []
        sets = [([s], [q for q in s.nodes], self.star(s)) for s in self.plan.stars]
        sets += [(self.plan.stars[:m], list(dict.fromkeys(q for s in self.plan.stars[:m] for q in s.nodes)), self.joined(m)) for m in range(2, len(self.plan.stars) + 1)]
        for stars, covered, rows in sets:
            n_edges = sum(len(s.edges) for s in stars)
            columns = [F.col(_col(q)) if q in covered else F.lit(None).cast("long").alias(_col(q)) for q in ids]
            score = total(covered)
            parts.append(rows.select(*columns, score.alias("score"), F.round(score + len(covered) + n_edges, 6).alias("anytime"), F.lit(len(covered)).cast("long").alias("nodes"), F.lit(n_edges).cast("long").alias("edges")))
        order = [F.desc("anytime"), *rank_order(ids)]
        return reduce(DataFrame.unionByName, parts).orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))

    def star_statistics(self, star: Star) -> DataFrame:
        """Per pivot: its number of matches per leaf multiplied up, and its degree over the star's leaves."""
        rows = self._of(star.pivot)
        for leaf, found in self.leaf_matches(star):
            rows = rows.join(found.groupBy(_col(star.pivot)).agg(F.count(F.lit(1)).alias(f"n{leaf}")), _col(star.pivot))
        product = reduce(lambda x, y: x * y, [F.col(f"n{leaf}") for leaf in star.leaves], F.lit(1).cast("long"))
        degree = reduce(lambda x, y: x + y, [F.col(f"n{leaf}") for leaf in star.leaves], F.lit(0).cast("long"))
        return rows.select(F.col(_col(star.pivot)).alias("pivot"), product.alias("matches"), degree.alias("degree"))

    def estimate(self, star: Star) -> DataFrame:
        """Upper estimate of a star's answers, its number of pivots and their mean degree."""
        own = self.star_statistics(star)
        return own.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("pa_estimate"), F.count(F.lit(1)).alias("n_pivots"), F.round(F.coalesce(F.avg("degree"), F.lit(0.0)), 6).alias("avg_degree"))

    def best_per_pivot(self, star: Star) -> DataFrame:
        """The best match of each pivot."""
        ids = star.nodes
        rows = self.star(star, 1).select(*[_col(q) for q in ids], total(ids).alias("score"))
        window = Window.partitionBy(_col(star.pivot)).orderBy(*rank_order(ids))
        return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
