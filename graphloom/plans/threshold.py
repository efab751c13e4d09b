"""Top-k by a threshold algorithm: sorted lists of candidates, read block by block until no unseen answer can count.

Each query node's candidates are a list sorted by similarity and id, stored in
blocks of doubling size.  A round reads the next block of every list (sorted
access) and finds the answers of which a node of that block is the first one
met: along the query's edges, other nodes are looked up by id in the parts of
their lists that were not read before (random access).  An answer of which no node was
met has at most the sum of the similarities at the cursors; once the k-th score
is above it, or a list is read to its end, the best k are known.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import written
from graphloom.plans.enumeration import ranked
from graphloom.plans.topk import Matcher, rank_order, total

#: Candidates in the first block of a list; each next block has twice as many.
FIRST_BLOCK = 256


@dataclass
class Accesses:
    """What a search has read: per query node the list's length and the candidates read in order; rounds, and answers formed."""

    sizes: dict[str, int]
    read: dict[str, int] = field(default_factory=dict)
    rounds: int = 0
    answers: int = 0


class ThresholdSearch:
    def __init__(self, matcher: Matcher) -> None:
        self.m = matcher
        self.lists = {q: self._list(q) for q in matcher.query.ids}
        self.ends = {q: {r.block: (r.n, r.low, r.high) for r in t.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"), F.max("sim").alias("high")).collect()} for q, t in self.lists.items()}

    def _list(self, q: str) -> DataFrame:
        own = self.m.cands.filter(F.col("qid") == q).select("id", "sim")
        rows = ranked(own, [F.desc("sim"), F.desc("id")])
        block = F.floor(F.log2((F.col("rank") - 1) / FIRST_BLOCK + 1)).cast("int")
        return written(rows.withColumn("block", block), "block", order=("rank",))

    def _steps(self, start: str) -> list[tuple[str, str, str | None]]:
        """The query's edges from a node outwards, with the end that each adds (None: both ends are there)."""
        seen, left, out = [start], list(self.m.query.edges), []
        while left:
            a, b = next((e for e in left if e[0] in seen or e[1] in seen))
            left.remove((a, b))
            new = None if a in seen and b in seen else (b if a in seen else a)
            out.append((a, b, new))
            seen += [new] if new else []
        return out

    def seeded(self, q: str, block: int, least: float | None) -> DataFrame:
        """The answers whose first node met is one of this block of q's list, of a score of ``least`` or more."""
        ids = self.m.query.ids
        rows = self.lists[q].filter(F.col("block") == block).select(F.col("id").alias(f"q{q}"), F.col("sim").alias(f"s{q}"))
        covered = [q]
        for a, b, new in self._steps(q):
            step = self.m.met(a, b, a if a in covered else b).select(f"q{a}", f"q{b}")
            rows = rows.join(step, [f"q{x}" for x in (a, b) if x in covered])
            if new is None:
                continue
            after = block + (ids.index(new) < ids.index(q))  # earlier blocks, and in this round earlier lists, gave their answers
            own = self.lists[new].filter(F.col("block") >= after).select(F.col("id").alias(f"q{new}"), F.col("sim").alias(f"s{new}"))
            covered.append(new)
            rows = rows.join(own, f"q{new}").filter(self.m.distinct(covered))
            if least is not None:
                best = sum(self.best(x) for x in ids if x not in covered)
                rows = rows.filter(total(covered) + F.lit(best) >= F.lit(least - 1e-6))
        return rows.select(*[f"q{x}" for x in ids], total(ids).alias("score"))

    def best(self, q: str) -> float:
        return max((high for _, _, high in self.ends[q].values()), default=0.0)

    def top(self, k: int) -> tuple[DataFrame, Accesses]:
        """The best ``k`` answers as ``Matcher.top`` gives them, and what was read for them."""
        ids, spark = self.m.query.ids, self.m.graph.spark
        seen = Accesses({q: sum(n for n, _, _ in e.values()) for q, e in self.ends.items()}, {q: 0 for q in ids})
        schema = ", ".join([f"q{q} long" for q in ids] + ["score double"])
        held, least, block = [], None, 0
        while all(block in self.ends[q] for q in ids):
            for q in ids:
                found = [self.seeded(q, block, least)] + ([spark.createDataFrame(held, schema)] if held else [])
                rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
                held = [tuple(r) for r in rows.orderBy(*rank_order(ids)).limit(k).collect()]  # k rows
                least = held[-1][-1] if len(held) == k else None
                seen.read[q] += self.ends[q][block][0]
            seen.rounds, seen.answers = seen.rounds + 1, len(held)
            if least is not None and sum(self.ends[q][block][1] for q in ids) < least - 1e-6:
                break
            block += 1
        out = spark.createDataFrame(held, schema)
        return out.select(F.row_number().over(Window.orderBy(*rank_order(ids))).cast("long").alias("rank"), *out.columns), seen
