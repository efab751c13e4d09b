"""Runs of words that repeat with a period, by the algorithm of Kolpakov and Kucherov.

Within a text, where all of this is linear in its words but for a map's look-up:

1. the suffix automaton, with the first end of each state, gives the factors of
   Lempel and Ziv: each the longest string from its start that starts earlier;
2. Main's algorithm finds the runs that touch the border before each factor, by
   longest extensions to both sides of the border;
3. every other run lies inside a factor and is copied from the factor's earlier
   occurrence, from left to right.

A run of ``exponent`` periods and ``length`` words has each of its three-word
strings several times (``repeats_of``), so words outside such strings are cut
away first; what is cut away cannot extend a run either.  Texts are whole within
a task, so nothing is shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, slices, text_or_empty

LENGTH, EXPONENT = 6, 4
_GRAM = 3


class Automaton:
    """The suffix automaton of a list of numbers from 0; ``first`` is where a state's strings end for the first time."""

    def __init__(self, s: list[int]) -> None:
        self.first, link, length = array("q", [-1]), array("q", [-1]), array("q", [0])
        # Most states have one way out, which needs no map.
        self.by, self.to, self.more = array("q", [-1]), array("q", [0]), {}
        first, by, to, more, last = self.first, self.by, self.to, self.more, 0
        for i, c in enumerate(s):
            new = len(length)
            for column, value in ((first, i), (link, 0), (length, length[last] + 1), (by, -1), (to, 0)):
                column.append(value)
            p, q = last, -1
            while p >= 0:
                if by[p] == c:
                    q = to[p]
                    break
                if by[p] < 0:
                    by[p], to[p] = c, new
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: new}
                    elif c in ways:
                        q = ways[c]
                        break
                    else:
                        ways[c] = new
                p = link[p]
            last = new
            if q < 0:
                continue
            if length[p] + 1 == length[q]:
                link[new] = q
                continue
            copy = len(length)
            for column, value in ((first, first[q]), (link, link[q]), (length, length[p] + 1), (by, by[q]), (to, to[q])):
                column.append(value)
            if q in more:
                more[copy] = dict(more[q])
            while p >= 0:
                if by[p] == c:
                    if to[p] != q:
                        break
                    to[p] = copy
                else:
                    ways = more.get(p)
                    if ways is None or ways.get(c) != q:
                        break
                    ways[c] = copy
                p = link[p]
            link[q] = link[new] = copy


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Start, end and distance to the first occurrence (0 for a new symbol) of each factor."""
    own = Automaton(s)
    first, by, to, more, out, at = own.first, own.by, own.to, own.more, [], 0
    while at < len(s):
        state, k = 0, at
        while k < len(s):
            ahead = to[state] if by[state] == s[k] else more[state][s[k]]
            if first[ahead] >= k:
                break
            state, k = ahead, k + 1
        out.append((at, k, k - 1 - first[state]) if k > at else (at, at + 1, 0))
        at = max(k, at + 1)
    return out


def extensions(s: list[int], upto: int) -> list[int]:
    """For the positions below ``upto``, how far the string from there agrees with the whole (0 at the start)."""
    z, low, high = [0] * upto, 0, 0
    n = len(s)
    for i in range(1, upto):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def border_runs(s: list[int], begin: int, at: int, end: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and a period of runs that touch the border ``at`` between the factors from ``begin`` and to ``end``, which they do not leave to the right."""
    # A run that goes on past the border starts less than a period before ``begin``.
    most = (end - begin) // (exponent - 1)
    if most < 1 or end - begin + most < least:
        return
    back = max(0, at - (at - begin) - most - 1)
    left, right = s[back:at], s[at:end]
    x, y = len(left), len(right)
    ahead = extensions([*right, -1, *left, *right], x + y + 1)
    left.reverse()
    behind = extensions([*left, -1, *right[::-1], *left], x + y + 2)
    for q in range(1, most + 1):
        spans = []
        if q <= y:  # a whole period after the border
            spans.append((at - behind[x + 1 + y - q], at + q + (ahead[q] if q < y else 0)))
        if q <= x:  # one before it
            spans.append((at - q - (behind[q] if q < x else 0), at + ahead[y + 1 + x - q]))
        for a, b in spans:
            cut = (a == back and back) or (b == end and b < len(s) and s[b] == s[b - q])
            if b - a >= least and b - a >= exponent * q and not cut:
                yield a, b, q


def runs(symbols: list[int], least: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of at least ``least`` symbols and ``exponent`` periods, 2 at least, by start, then period."""
    s = [*symbols, max(symbols, default=0) + 1]  # a last symbol of its own ends every run
    parts = factors(s)
    found: dict[int, dict[int, int]] = {}
    for (begin, at, _), (_, end, _) in zip(parts, parts[1:], strict=False):
        for a, b, q in border_runs(s, begin, at, end, least, exponent):
            ends = found.setdefault(a, {})
            ends[b] = min(q, ends.get(b, q))
    if found:
        for begin, end, shift in parts:
            if shift:
                for a in range(begin + 1, end - least):
                    for b, q in found.get(a - shift, {}).items():
                        if b + shift < end:
                            found.setdefault(a, {})[b + shift] = q
    return sorted(((a, b - a, q) for a, ends in found.items() for b, q in ends.items()), key=lambda r: (r[0], r[2]))


def repeats_of(least: int, exponent: int) -> int:
    """How often any string of ``_GRAM`` symbols within a run occurs in it at least."""
    return min(exponent - 1, max(least, exponent) - _GRAM + 1)


def live_parts(symbols: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Parts of a text that hold all its runs."""
    n, often = len(symbols), repeats_of(least, exponent)
    if n < least or n < _GRAM or often < 2:
        return [(0, n)] if n >= max(1, least) else []
    many = int(symbols.max()) + 1
    pair = symbols[:-2] * many + symbols[1:-1]  # symbols are below 2**31
    if many >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair * many + symbols[2:], return_inverse=True, return_counts=True)
    live = np.concatenate([[False], count[inverse] >= often, [False]])
    edge = np.flatnonzero(live[1:] != live[:-1])
    return [(a, b + _GRAM - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a + _GRAM - 1 >= least]


def word_runs(words: list[bytes], least: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``runs`` of words."""
    if len(words) < least:
        return []
    ids: dict[bytes, int] = {}
    symbols = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    out = []
    for a, b in live_parts(symbols, least, exponent):
        own: dict[int, int] = {}
        out += [(a + s, n, q) for s, n, q in runs([own.setdefault(x, len(own)) for x in symbols[a:b].tolist()], least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    step = [0] * (len(words) + 1)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, depth in zip(words, accumulate(step), strict=False) if not depth]


def periodic_runs(docs: DataFrame, carry: list[str], text_col: str = "text", least: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """The columns ``carry`` of each row with ``n_words``, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``.

    Words are the maximal strings without white space (space, tab to carriage
    return), and differ by case.  ``collapsed`` joins, by one space, the words
    that no run contains after its first period.  Null texts and texts without
    words have no runs and collapse to the empty string; an empty table gives an
    empty result; ids are not read, so null and repeated ones do not matter.  A
    text is held whole, with some 100 bytes for each word and some 200 more for
    each that lies in a repeated part.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = bytes_of(part.column("text"))
            sizes, listed, left = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                words = buf[a:b].tobytes().split()
                found = word_runs(words, least, exponent)
                sizes.append(len(words))
                listed.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(b" ".join(collapse(words, found)))
            columns = [pa.array(sizes, pa.int64()), pa.array(listed, kind), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, "n_words", "runs", "collapsed"])

    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)]
    out = arrow_map(rows, find, ", ".join([*fields, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]))
    return out.toDF(*carry, "n_words", "runs", "collapsed")


def planted_period(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a text as the contract query reads them: by a hash of its id, every tenth text repeats a part of itself to its end."""
    import zlib

    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ``planted_period``; other texts as they are."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, own = part.column("doc_id").to_pylist(), part.column("chosen").to_pylist()
            texts = [x.as_buffer().to_pybytes() for x in part.column("text")]
            texts = [b" ".join(planted_period(d, t.split())) if c else t for d, c, t in zip(ids, own, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return arrow_map(rows.withColumn("chosen", chosen), change, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")
