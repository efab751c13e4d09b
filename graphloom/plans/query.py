"""Query graphs: small labelled digraphs, their text form, and their decomposition into stars."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Query:
    """A query graph: a label for each node (in order) and directed edges; at most one edge joins two nodes."""

    labels: Mapping[str, str]
    edges: tuple[tuple[str, str], ...]
    index: int | None = None

    def __post_init__(self) -> None:
        seen: set[frozenset[str]] = set()
        kept = []
        for a, b in self.edges:
            if a not in self.labels or b not in self.labels:
                raise ValueError(f"edge {a}->{b} names no node")
            if a != b and frozenset((a, b)) not in seen:
                seen.add(frozenset((a, b)))
                kept.append((a, b))
        object.__setattr__(self, "edges", tuple(kept))

    @property
    def ids(self) -> list[str]:
        return list(self.labels)

    def incident(self, q: str) -> list[tuple[str, str]]:
        return [e for e in self.edges if q in e]

    def connected(self) -> bool:
        if not self.labels:
            return True
        seen, open_ = set(), [self.ids[0]]
        while open_:
            q = open_.pop()
            if q not in seen:
                seen.add(q)
                open_ += [x for e in self.incident(q) for x in e if x not in seen]
        return len(seen) == len(self.labels)


@dataclass(frozen=True)
class Star:
    """A pivot and some of its edges."""

    pivot: str
    edges: tuple[tuple[str, str], ...]

    @property
    def leaves(self) -> list[str]:
        return [b if a == self.pivot else a for a, b in self.edges]

    @property
    def nodes(self) -> list[str]:
        return [self.pivot, *self.leaves]


@dataclass
class Plan:
    """Stars in join order; each is joined to those before it on the nodes that they share."""

    query: Query
    stars: list[Star]
    shared: list[list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.shared, seen = [], set()
        for s in self.stars:
            self.shared.append([q for q in s.nodes if q in seen])
            seen |= set(s.nodes)

    def stars_of(self, q: str) -> int:
        return sum(q in s.nodes for s in self.stars)


def decompose(query: Query, weights: Mapping[str, int]) -> list[Star]:
    """Greedy weighted vertex cover (Clarkson): the node of the least weight per open edge becomes a pivot with its open edges.

    A chosen node's ratio is charged to its neighbours' weights.  Ties go to the
    first node of the query.  A query of one node is one star without leaves.
    """
    if not query.edges:
        return [Star(q, ()) for q in query.ids]
    open_, weight, stars = list(query.edges), {q: float(weights.get(q, 0)) for q in query.ids}, []
    while open_:
        degree = {q: sum(q in e for e in open_) for q in query.ids}
        pivot = min((q for q in query.ids if degree[q]), key=lambda q: weight[q] / degree[q])
        ratio = weight[pivot] / degree[pivot]
        own = [e for e in open_ if pivot in e]
        for a, b in own:
            other = b if a == pivot else a
            weight[other] = max(0.0, weight[other] - ratio)
        stars.append(Star(pivot, tuple(own)))
        open_ = [e for e in open_ if pivot not in e]
    alone = set(query.ids) - {q for s in stars for q in s.nodes}
    return stars + [Star(q, ()) for q in query.ids if q in alone]


def make_plan(query: Query, stars: Iterable[Star]) -> Plan:
    """Left-deep order from the last star found back, each star after one that it shares a node with (of a connected query)."""
    rest = list(stars)[::-1]
    order = [rest.pop(0)]
    while rest:
        covered = {q for s in order for q in s.nodes}
        k = next((i for i, s in enumerate(rest) if covered & set(s.nodes)), 0)
        order.append(rest.pop(k))
    return Plan(query, order)


def spanning_weight(query: Query, weights: Mapping[tuple[str, str], float]) -> float:
    """Total weight of a minimum spanning forest of the query graph (Kruskal)."""
    up = {q: q for q in query.ids}

    def root(q: str) -> str:
        while up[q] != q:
            q = up[q]
        return q

    total = 0.0
    for e in sorted(query.edges, key=lambda e: (weights.get(e, 1.0), e)):
        a, b = root(e[0]), root(e[1])
        if a != b:
            up[a] = b
            total += weights.get(e, 1.0)
    return total


def isomorphic(a: Query, b: Query) -> bool:
    """Whether two query graphs are equal up to the names of nodes, by backtracking over equal labels and degrees."""
    if sorted(a.labels.values()) != sorted(b.labels.values()) or len(a.edges) != len(b.edges):
        return False
    sign = lambda g, q: (g.labels[q], sum(e[0] == q for e in g.edges), sum(e[1] == q for e in g.edges))
    there, order = set(b.edges), a.ids

    def extend(k: int, image: dict[str, str]) -> bool:
        if k == len(order):
            return True
        for x in b.ids:
            if x not in image.values() and sign(a, order[k]) == sign(b, x):
                new = image | {order[k]: x}
                if all((new[s], new[t]) in there for s, t in a.edges if s in new and t in new) and extend(k + 1, new):
                    return True
        return False

    return extend(0, {})


def parse_queries(text: str) -> list[Query]:
    """Queries of a text: node count, optional ``queryIndex:n``, ``id;label;..`` for each node, then ``src;dst;..`` for each node."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    out, at = [], 0
    while at < len(lines):
        n, at, index = int(lines[at].rstrip(";")), at + 1, None
        if at < len(lines) and lines[at].startswith("queryIndex:"):
            index, at = int(lines[at].split(":")[1].rstrip(";")), at + 1
        rows = [[x for x in line.split(";") if x] for line in lines[at : at + 2 * n]]
        if len(rows) < 2 * n:
            raise ValueError("the text ends within a query")
        labels = {r[0]: (r[1] if len(r) > 1 else "") for r in rows[:n]}
        out.append(Query(labels, tuple((r[0], x) for r in rows[n:] for x in r[1:]), index))
        at += 2 * n
    return out


def format_query(query: Query) -> str:
    head = [str(len(query.labels))] + ([f"queryIndex:{query.index}"] if query.index is not None else [])
    nodes = [f"{q};{label};" for q, label in query.labels.items()]
    edges = [";".join([q, *(b for a, b in query.edges if a == q)]) + ";" for q in query.ids]
    return "\n".join(head + nodes + edges) + "\n"


def runnable(query: Query, p: int) -> bool:
    """Whether a workload keeps a query: every label has ``p`` characters, and no two are alike."""
    values = list(query.labels.values())
    return all(len(v) >= p for v in values) and len(set(values)) == len(values)


def non_star(query: Query) -> bool:
    """Whether two nodes or more have more than one edge."""
    return sum(len(query.incident(q)) > 1 for q in query.ids) >= 2
