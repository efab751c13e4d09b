"""Removal of long byte strings that occur more than once, anywhere in the corpus.

The suffixes that matter are sampled: of each run of ``LENGTH - SEED + 1``
neighbouring seeds (substrings of ``SEED`` bytes) the one of least hash is an
anchor, so equal strings of ``LENGTH`` bytes have the same anchor at the same
place.  Neighbouring strings with one anchor form a run, with a context that
covers them all.  What repeats is then found from coarse to fine, each step on
what the one before left open:

1. runs whose anchor occurs once repeat nothing;
2. runs whose whole context occurs again repeat throughout;
3. the other runs of an anchor, one of each distinct context, are compared
   string by string: within a task for an anchor of few contexts, by counting
   string hashes over the cluster for an anchor of many.

Counts combine before every shuffle, and joins by anchor deal with its hot
anchors apart, so a passage in a third of all documents is no hot key.  Hashes of
64 bits only propose.  Whole contexts, and strings that are counted over the
cluster, are told apart by cryptographic digests of 128 bits; strings within a
task by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, keyed_join, materialise, slices, text_or_empty
from .textbuf import every_hash, same_bytes

LENGTH = 400
#: Contexts of one anchor up to which they are compared within a task, and contexts compared at once there.
TASK_CONTEXTS, TASK_BATCH = 2048, 4096
#: Bits that hold any position in a buffer: no text of Spark's is longer.
_PLACE = np.uint64(31)
_RUN = "doc_id long, tag long, a int, b int, anchor long, context binary, n int"
#: Bytes of a digest that stands for a string.
DIGEST = 16


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    pad = -n % width
    grid = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each run: its text, first and last string start (in the buffer), anchor hash, context digest (as two numbers)."""
    seed = length // 2
    width = length - seed + 1
    size = np.diff(off)
    empty = np.zeros(0, np.int64)
    if len(buf) < length or not (size >= length).any():
        return empty, empty, empty, empty.astype(np.uint64), np.zeros((0, 2), np.uint64)
    seeds = every_hash(buf, seed)
    packed = (seeds >> _PLACE << _PLACE) | np.arange(len(seeds), dtype=np.uint64)
    anchor = (window_minima(packed, width) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), np.maximum(0, size - length + 1))
    first = np.cumsum(np.maximum(0, size - length + 1)) - np.maximum(0, size - length + 1)
    start = np.arange(len(doc)) - first[doc] + off[doc]
    mine = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(start)) - 1
    a, b = start[begin], start[last]
    raw = memoryview(np.ascontiguousarray(buf))
    digests = b"".join([blake2b(raw[x : y + length], digest_size=DIGEST).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return doc[begin], a, b, seeds[mine[begin]], np.frombuffer(digests, np.uint64).reshape(-1, 2)


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal covered runs of (start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]])


def _find_runs(rows: DataFrame, length: int) -> DataFrame:
    """Runs of all texts, equal ones of a text once with their number; and, without an anchor, spans that repeat within their text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = bytes_of(part.column("text"))
            doc, a, b, anchor, context = runs(buf, off, length)
            # Equal contexts of one text: one row stands for them, and their strings are covered already.
            order = np.lexsort((a, context[:, 0], context[:, 1], doc))
            new = np.ones(len(order), bool)
            new[1:] = (context[order][1:] != context[order][:-1]).any(axis=1) | (doc[order][1:] != doc[order][:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(order)))
            first = order[at]
            again = order[np.repeat(count, count) > 1]
            covered, cover_doc = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            if len(again):
                covered = _merge(np.column_stack([a[again], b[again] + length]))  # texts do not touch: a span ends within its own
                cover_doc = np.searchsorted(off, covered[:, 0], side="right") - 1
                # Neighbouring texts may meet at their border.
                cut = np.flatnonzero(covered[:, 1] > off[cover_doc + 1])
                if len(cut):
                    pieces = [(d, max(s, off[d]), min(e, off[d + 1])) for s, e in covered[cut] for d in range(int(np.searchsorted(off, s, side="right")) - 1, len(off) - 1) if off[d] < e and max(s, off[d]) < min(e, off[d + 1])]
                    keep = np.setdiff1d(np.arange(len(covered)), cut)
                    cover_doc = np.concatenate([cover_doc[keep], np.array([x[0] for x in pieces], np.int64)])
                    covered = np.vstack([covered[keep], np.array([x[1:] for x in pieces], np.int64).reshape(-1, 2)])
            whose = np.concatenate([doc[first], cover_doc])
            begin = np.concatenate([a[first], covered[:, 0]]) - off[whose]
            end = np.concatenate([b[first], covered[:, 1]]) - off[whose]
            none = np.arange(len(whose)) >= len(first)
            fill = np.zeros(len(covered), np.uint64)
            columns = [
                part.column("doc_id").take(pa.array(whose)),
                part.column("tag").take(pa.array(whose)),
                pa.array(begin.astype(np.int32)),
                pa.array(end.astype(np.int32)),
                pa.array(np.concatenate([anchor[first], fill]).view(np.int64), mask=none),
                pa.array([None if n else c for n, c in zip(none.tolist(), _digests(np.vstack([context[first], np.zeros((len(covered), 2), np.uint64)])), strict=True)], pa.binary()),
                pa.array(np.concatenate([count, fill.astype(np.int64)]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "a", "b", "anchor", "context", "n"])

    return arrow_map(rows, find, _RUN)


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs."""
    listed = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("a", "b", "anchor", "single", "many")).alias("wanted"))
    joined = _with(rows, listed, "inner").select("doc_id", "tag", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = [x.as_buffer() for x in part.column("text").cast(pa.binary())]
            out = [(d, t, w, raw[k][w["a"] : w["b"] + length].to_pybytes()) for k, (d, t, ws) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "tag", "wanted")), strict=True)) for w in ws]
            columns = [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2]["a"] for x in out], pa.int32()),
                pa.array([x[2]["anchor"] for x in out], pa.int64()),
                pa.array([x[2]["single"] for x in out], pa.bool_()),
                pa.array([x[2]["many"] for x in out], pa.bool_()),
                pa.array([x[3] for x in out], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "a", "anchor", "single", "many", "bytes"])

    return arrow_map(joined, cut, "doc_id long, tag long, a int, anchor long, single boolean, many boolean, bytes binary")


def _digests(pairs: np.ndarray) -> list[bytes]:
    raw = pairs.tobytes()
    return [raw[k : k + DIGEST] for k in range(0, len(raw), DIGEST)]


def _strings(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every string in some contexts: the context's row, offset in it and in the bytes of all; and those bytes."""
    buf, off = bytes_of(part.column("bytes"))
    many = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(many)), many)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, offset, offset + off[row], buf


def equal_strings(buf: np.ndarray, row: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """A number for each string that strings of equal bytes share, and no others; ``h`` are hashes of them.

    Strings of a hash are compared with the first of it.  Neighbours whose first
    ones are neighbours as well make one stretch, which is compared at once.
    """
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    first = first[of]
    later = np.flatnonzero(first != np.arange(len(h)))
    if not len(later):
        return of
    x, y = later[1:], later[:-1]
    joined = (x == y + 1) & (row[x] == row[y]) & (first[x] == first[y] + 1) & (row[first[x]] == row[first[y]])
    begin = np.flatnonzero(np.append(True, ~joined))
    count = np.diff(np.append(begin, len(later)))
    same = same_bytes(buf, at[later[begin]], buf, at[first[later[begin]]], count + length - 1)
    if not same.all():
        unequal = np.isin(of, of[later[np.repeat(~same, count)]])
        numbers: dict[bytes, int] = {}
        for k in np.flatnonzero(unequal).tolist():
            of[k] = len(h) + numbers.setdefault(buf[at[k] : at[k] + length].tobytes(), len(numbers))
    return of


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, tag, a, b) of the single contexts whose strings occur in another context of their anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            part = table.combine_chunks().to_batches()[0]
            row, offset, at, buf = _strings(part, length)
            _, inverse, count = np.unique(equal_strings(buf, row, at, every_hash(buf, length)[at], length), return_inverse=True, return_counts=True)
            single = part.column("single").to_numpy(zero_copy_only=False)
            hit = (count[inverse] > 1) & single[row]
            row, offset = row[hit], offset[hit]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1 if len(row) else first
            begin = part.column("a").to_numpy()[row[first]]
            take = pa.array(row[first])
            columns = [part.column("doc_id").take(take), part.column("tag").take(take), pa.array((begin + offset[first]).astype(np.int32)), pa.array((begin + offset[last] + length).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= TASK_BATCH:
                # Rows come in the order of anchors; the last anchor's may go on in the next batch.
                table = pa.Table.from_batches(held)
                anchors = table.column("anchor").to_numpy()
                stop = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if (anchors != anchors[-1]).any() else 0
                if stop:
                    yield flush(table.slice(0, stop))
                held, rows = table.slice(stop).to_batches(), table.num_rows - stop
        if held:
            yield flush(pa.Table.from_batches(held))

    return arrow_map(contexts.repartition("anchor").sortWithinPartitions("anchor"), compare, "doc_id long, tag long, a int, b int")


def _count(contexts: DataFrame, length: int) -> DataFrame:
    """What ``_compare`` gives, by counting every string's digest: for anchors of any number of contexts."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "bytes", 1 << 16):
            row, offset, at, buf = _strings(part, length)
            raw, take = memoryview(np.ascontiguousarray(buf)), pa.array(row)
            digest = pa.array([blake2b(raw[k : k + length], digest_size=DIGEST).digest() for k in at.tolist()], pa.binary())
            columns = [part.column("doc_id").take(take), part.column("tag").take(take), pa.array((part.column("a").to_numpy()[row] + offset).astype(np.int32)), part.column("single").take(take), digest]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "a", "single", "h"])

    strings = materialise(arrow_map(contexts, spell, "doc_id long, tag long, a int, single boolean, h binary"))
    again = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return strings.filter("single").join(again, "h").select("doc_id", "tag", "a", (F.col("a") + length).cast("int").alias("b"))


def _with(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    right = listed.withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag")
    return rows.join(right, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, a, b): spans of bytes that together cover all repeated strings of ``rows(doc_id, tag, text)``."""
    found = materialise(_find_runs(rows, length))
    every = found.filter("anchor is not null")
    twice = every.groupBy("anchor").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("runs")).filter("times > 1").select("anchor", "runs")
    open_ = materialise(keyed_join(every, materialise(twice), "anchor", "runs").drop("runs"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag", "a")).alias("first")
    context = materialise(open_.groupBy("anchor", "context").agg(F.sum("n").alias("times"), first, F.max(F.col("b") - F.col("a")).alias("more")))
    per = context.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("times").alias("least")).filter("contexts > 1 and least = 1")
    # One run of each distinct context of the anchors that still have a context of one occurrence.
    left = keyed_join(context, materialise(per), "anchor", "contexts")
    end = (F.col("first.a") + F.col("more")).cast("int").alias("b")
    many = (F.col("contexts") > TASK_CONTEXTS).alias("many")
    wanted = left.select("first.doc_id", "first.tag", "first.a", end, "anchor", (F.col("times") == 1).alias("single"), many)
    contexts = materialise(_contexts(rows, wanted, length))
    parts = [
        found.filter("anchor is null").select("doc_id", "tag", "a", "b"),
        open_.join(context.filter("times > 1").select("anchor", "context"), ["anchor", "context"]).select("doc_id", "tag", "a", (F.col("b") + length).cast("int").alias("b")),
        _compare(contexts.filter("not many").drop("many"), length),
    ]
    many = contexts.filter("many").drop("many")
    if not many.isEmpty():
        parts.append(_count(many, length))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove_repeats(docs: DataFrame, carry: list[str], text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The columns ``carry`` of each row with ``n_bytes``, removed ``spans`` (bytes, end exclusive) and ``kept``, the bytes left.

    A byte goes if a string of ``length`` bytes around it also starts anywhere
    else, in the same text included, before anything is removed.  Rows that
    repeat repeat each other's bytes.  Null texts are empty; texts shorter than
    ``length`` stay whole; an empty table gives an empty result.  What is left
    need not be valid UTF-8.
    """
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *[docs[c].alias(k) for c, k in zip(carry, names, strict=True)])
    rows = rows.withColumn("tag", F.xxhash64("text"))
    listed = repeated_spans(rows.select("doc_id", "tag", "text"), length).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = _with(rows, listed, "left").select(*names, "text", "spans")
    kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            kept, spans, sizes = [], [], []
            for text, listed in zip(part.column("text"), part.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                merged = _merge(np.array([(s["a"], s["b"]) for s in listed or []], np.int64).reshape(-1, 2)).tolist()
                at, pieces = 0, []
                for a, b in merged:
                    pieces.append(raw[at:a])
                    at = b
                kept.append(b"".join([*pieces, raw[at:]]))
                spans.append([{"start": a, "end": b} for a, b in merged])
                sizes.append(len(raw))
            columns = [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, "n_bytes", "spans", "kept"])

    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["n_bytes long", "spans array<struct<start:long,end:long>>", "kept binary"]
    return arrow_map(joined, cut, ", ".join(fields)).toDF(*carry, "n_bytes", "spans", "kept")
