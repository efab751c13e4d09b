"""Benchmark decontamination with suffix arrays over the training shards.

A shard is a slice of an input partition.  Its words become 64-bit symbols with
a separator after each document, and its suffixes are sorted once by prefix
doubling, to ``DEPTH`` words or the window length, whichever is more.  Every test
suffix that starts a window is then binary-searched in that array; the equal
range gives its locations, whose words are compared byte by byte with the
window's, and comparing on from there its longest match.  Documents are whole
within a shard, so nothing is shuffled.

Benchmark items are read in blocks of ``BLOCK_BYTES``, and a worker holds one at
a time.  One pass over the documents takes ``PASS_BLOCKS`` blocks, which bounds
what is broadcast; a larger benchmark takes more passes, each on what the one
before wrote to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, materialise, slices, text_or_empty
from .textbuf import ALNUM, LOWER, Words, same_bytes, words

WINDOW = 10
#: Suffixes are sorted by so many words at least.
DEPTH = 16
#: Text of benchmark items in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Blocks that one pass over the documents takes.
PASS_BLOCKS = 32
SHARD_BYTES = 2 << 20
_END_OF_DOC, _END_OF_ITEM = np.uint64(0), np.uint64(1)


@dataclass
class TestBlock:
    """The distinct windows of some items: ``symbols`` of all items, where each window starts, its length, its items; and the items' bytes, with every word's place among them and first symbol."""

    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    items: list[list[str]]
    text: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray


@dataclass
class Shard:
    """Some documents with the order of their suffixes: ``at`` is where each document starts among the symbols."""

    text: np.ndarray
    words: Words
    symbols: np.ndarray
    at: np.ndarray
    order: np.ndarray


def shard(buf: np.ndarray, off: np.ndarray, window: int = WINDOW) -> Shard:
    w = words(buf, off, ALNUM)
    symbols, at = with_separators(w.hash, w.first, _END_OF_DOC)
    return Shard(LOWER[buf], w, symbols, at, suffix_array(symbols, max(DEPTH, window)))


def test_block(ids: list[str], texts: list[str], window: int = WINDOW) -> TestBlock:
    """Every window of the items, equal ones once; an item of fewer words than a window, but not none, is one window."""
    buf, off = bytes_of(pa.array(texts, pa.large_string()))
    w = words(buf, off, ALNUM)
    symbols, at = with_separators(w.hash, w.first, _END_OF_ITEM)
    low = LOWER[buf]
    spelled = [low[s:e].tobytes() for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    found: dict[tuple[bytes, ...], tuple[int, int, set[str]]] = {}  # windows are told apart by their words' bytes
    for i, (n, a) in enumerate(zip(w.counts.tolist(), at.tolist(), strict=True)):
        size = min(n, window)
        first = int(w.first[i])
        for j in range(n - size + 1 if n else 0):
            found.setdefault(tuple(spelled[first + j : first + j + size]), (a + j, size, set()))[2].add(ids[i])
    rows = list(found.values())
    place = np.zeros((2, len(symbols)), np.int64)
    place[:, np.arange(len(w.hash)) + np.repeat(np.arange(len(texts)), w.counts)] = w.start, w.end
    return TestBlock(symbols, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [sorted(r[2]) for r in rows], low, *place)


def with_separators(hashes: np.ndarray, first: np.ndarray, separator: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with one separator after each text, and where each text starts among them."""
    n = len(first) - 1
    out = np.full(len(hashes) + n, separator, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))] = np.maximum(hashes, np.uint64(2))
    return out, first[:-1] + np.arange(n)


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` symbols or more (ties in any order)."""
    n = len(symbols)
    order = np.argsort(symbols)
    rank = np.empty(n, np.int64)
    key, size = symbols, 1
    while True:
        ordered = key[order]
        steps = np.empty(n, np.int64)
        steps[:1] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
        if size >= depth or (n and steps[-1] == n - 1):
            return order
        rank[order] = steps + 1
        key = rank * np.int64(n + 2)
        key[: n - size] += rank[size:]
        order = np.argsort(key)
        size *= 2


def bounds(symbols: np.ndarray, order: np.ndarray, queries: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each query row (its first ``length`` symbols): the first suffix not below it, or above it if ``after``."""
    n, width = len(order), queries.shape[1]
    padded = np.concatenate([symbols, np.zeros(width, np.uint64)])
    outside = np.arange(width) >= length[:, None]
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
    rows = np.arange(len(queries))
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, n - 1)
        seen = padded[order[mid][:, None] + np.arange(width)]
        differ = (seen != queries) & ~outside
        k = differ.argmax(axis=1)
        below = differ[rows, k] & (seen[rows, k] < queries[rows, k])
        if after:
            below |= ~differ.any(axis=1)
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def match_shard(own: Shard, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All window occurrences in a shard: document, first word in it, length in words, window number, longest match from there."""
    empty = np.zeros(0, np.int64)
    if not len(own.words.hash) or not len(block.start):
        return empty, empty, empty, empty, empty
    symbols, at, order = own.symbols, own.at, own.order
    width = int(block.length.max())
    tests = np.concatenate([block.symbols, np.full(width, _END_OF_ITEM)])
    queries = tests[block.start[:, None] + np.arange(width)]
    low = bounds(symbols, order, queries, block.length, after=False)
    first = np.concatenate([symbols, np.zeros(width, np.uint64)])[order[np.minimum(low, len(order) - 1)][:, None] + np.arange(width)]
    there = np.flatnonzero((low < len(order)) & ((first == queries) | (np.arange(width) >= block.length[:, None])).all(axis=1))
    high = bounds(symbols, order, queries[there], block.length[there], after=True)
    count = high - low[there]
    window = np.repeat(there, count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = order[np.repeat(low[there], count) + inside]
    real = same_words(own, place, block, block.start[window], block.length[window])
    window, place = window[real], place[real]
    longest, grow = block.length[window].copy(), np.arange(len(window))
    while len(grow):
        here, test = place[grow] + longest[grow], block.start[window[grow]] + longest[grow]
        same = (here < len(symbols)) & (symbols[np.minimum(here, len(symbols) - 1)] == tests[np.minimum(test, len(tests) - 1)])
        grow = grow[same]
        longest[grow] += 1
    doc = np.searchsorted(at, place, side="right") - 1
    return doc, place - at[doc], block.length[window], window, longest


def same_words(own: Shard, place: np.ndarray, block: TestBlock, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words from each ``place`` of the shard are, byte by byte, the ``length`` ones from ``start`` of the block."""
    if not len(place):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(first, length)
    mine, theirs = np.repeat(place, length) + step, np.repeat(start, length) + step
    pairs, back = np.unique(np.column_stack([mine, theirs]), axis=0, return_inverse=True)
    mine = pairs[:, 0] - (np.searchsorted(own.at, pairs[:, 0], side="right") - 1)  # a separator follows each document
    begin, size = own.words.start[mine], own.words.end[mine] - own.words.start[mine]
    same = size == block.word_end[pairs[:, 1]] - block.word_start[pairs[:, 1]]
    same[same] = same_bytes(own.text, begin[same], block.text, block.word_start[pairs[same, 1]], size[same])
    return np.logical_and.reduceat(same[back.reshape(-1)], first)


def hit_runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the given spans."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def annotate(own: Shard, block: TestBlock) -> list[tuple[list[tuple[int, int]], set[str], int]]:
    """Per document of a shard: hit runs, items with occurring windows, longest match."""
    doc, start, length, window, longest = match_shard(own, block)
    rows = [([], set(), 0)] * len(own.at)
    by = np.argsort(doc, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(doc[by])) + 1) if len(by) else []:
        items = {i for k in set(window[part].tolist()) for i in block.items[k]}
        rows[int(doc[part[0]])] = (hit_runs(start[part], start[part] + length[part]), items, int(longest[part].max()))
    return rows


def test_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[Iterator[TestBlock]]:
    """The blocks of each pass; every block is read when its turn comes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))

    def block(k: int) -> TestBlock:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        return test_block([r.item_id for r in rows], [r.text for r in rows], window)

    return [map(block, range(k, min(n, k + PASS_BLOCKS))) for k in range(0, n, PASS_BLOCKS)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns ``carry`` of each row with ``n_words``, ``spans`` (maximal hit runs of words, end exclusive), ``items`` and ``longest``.

    A null text has no words.  A null item id is listed as the empty string;
    repeated items count once by id.  Empty tables give no rows or no hits.
    ``carry`` may include the text column; other columns are not read.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], docs[text_col].alias("text"))
    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)]
    passes, sent = test_blocks(benchmark, window, block_bytes), []
    for k, blocks in enumerate(passes):
        if k:
            rows = materialise(rows)
            for b in sent:
                b.destroy()
        sent = [spark.sparkContext.broadcast(block) for block in blocks]
        on = k + 1 < len(passes)  # the text goes on to the next pass
        rows = _scan(rows, sent, [*names, *["text"] * on], [*fields, *["text string"] * on], window, k > 0)
    return rows.toDF(*carry, "n_words", "spans", "items", "longest")


def _scan(rows: DataFrame, sent: list, names: list[str], fields: list[str], window: int, again: bool) -> DataFrame:
    """One pass over the documents: what the blocks ``sent`` bring, added to what an earlier pass found."""
    span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))

    def blocks() -> Iterator[TestBlock]:
        for b in sent:
            yield b.value
            if len(sent) > 1:
                b.__dict__.pop("_value", None)  # it is read from the executor's disk again when needed

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SHARD_BYTES):
            own = shard(*bytes_of(part.column("text")), window)
            found = [([], set(), 0)] * part.num_rows
            if again:
                old = zip(*(part.column(c).to_pylist() for c in ("spans", "items", "longest")), strict=True)
                found = [([(s["start"], s["end"]) for s in spans], set(items), longest) for spans, items, longest in old]
            for block in blocks():
                found = [_both(r, n) for r, n in zip(found, annotate(own, block), strict=True)]
            columns = [
                pa.array(own.words.counts, pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in r[0]] for r in found], span),
                pa.array([sorted(r[1]) for r in found], pa.list_(pa.string())),
                pa.array([r[2] for r in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, "n_words", "spans", "items", "longest"])

    out = [*fields, "n_words long", "spans array<struct<start:long,end:long>>", "items array<string>", "longest long"]
    return arrow_map(rows, scan, ", ".join(out))


def _both(x: tuple, y: tuple) -> tuple:
    """A row's findings in two blocks as one."""
    if not x[0] or not y[0]:
        return x if x[0] else y
    spans = np.array(x[0] + y[0], np.int64)
    return hit_runs(spans[:, 0], spans[:, 1]), x[1] | y[1], max(x[2], y[2])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    plain = docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])
    text = f"d{docs.columns.index(text_col)}"
    found = contamination(plain, benchmark, plain.columns, text, window).filter(F.size("spans") == 0)
    return found.select(*[F.col(f"d{k}").alias(c) for k, c in enumerate(docs.columns)])
