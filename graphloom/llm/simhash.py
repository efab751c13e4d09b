"""Near-duplicate classes by SimHash fingerprints and pigeonhole blocks.

A fingerprint has 64 bits; a bit is set if over half of the text's shingles,
repeats included, have it in their XXH64.  Texts link if their fingerprints
differ in ``bits`` bits at most.  Fingerprints are cut into ``bits + SPARE``
blocks: of two that link, ``SPARE`` blocks at least are equal, so every choice of
``SPARE`` blocks is a join key and no link is missed.  What shares a key is
verified by Hamming distance.

Work on links stays near linear in the documents:

* equal fingerprints are one node from the start, so copies never meet;
* what shares a key is a bucket, in which only links that join its members are
  kept: a node that was reached is not tried again;
* a bucket of over ``BLOCK`` nodes is cut into blocks, first each by itself; only
  of buckets that still hold several components are pairs of blocks tried then,
  and only across components.

Nothing is capped: every pair in a bucket is of one component, or was compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, keyed_join, materialise, rows_of, slices, text_or_empty
from .components import connected_components

SEED = 42
#: Blocks that two linked fingerprints have in common at least.
SPARE = 3
#: Nodes of a bucket, or of a part of it, that are compared in one task.
BLOCK = 1 << 14
#: Bytes of a text whose words are held at once.
PIECE = 1 << 18
_KEY_BITS = 50
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes, step: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of some ``step`` bytes of text."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + step) if at + step < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by one space."""
    body = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return np.array([xxhash.xxh64_intdigest(body[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64)


def fingerprint(raw: bytes, size: int) -> int:
    """The fingerprint of a text; a text of fewer words is one shingle, one of none has fingerprint zero."""
    count, n, held = np.zeros(64, np.int64), 0, []
    for words in pieces(raw.lower()):
        held += words
        if len(held) >= size:
            h = shingle_hashes(held, size)
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
            held = held[len(held) - size + 1 :]
    if not n and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_tag, print) of (doc_id, row_tag, text)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            buf, off = bytes_of(part.column("text"))
            raw = [buf[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            found = np.array([fingerprint(x, size) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_tag"), pa.array(found)], names=["doc_id", "row_tag", "print"])

    return arrow_map(rows, prints, "doc_id long, row_tag long, print long")


def block_keys(prints: Column, bits: int) -> Column:
    """One key for each choice of ``SPARE`` of the ``bits + SPARE`` blocks: the choice's number above those blocks' bits."""
    n = bits + SPARE
    border = [64 * k // n for k in range(n + 1)]
    block = [F.shiftrightunsigned(prints, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(border[:-1], border[1:], strict=True)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), SPARE)):
        key, at = F.lit(number << _KEY_BITS).cast("long"), 0
        for k in chosen:
            key = key.bitwiseOR(F.shiftleft(block[k], at))
            at += border[k + 1] - border[k]
        keys.append(key)
    return F.array(*keys)


def bucket_links(prints: np.ndarray, known: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (rows) that join all rows linked through rows given here; rows of one component ``known`` count as joined."""
    _, of = np.unique(known, return_inverse=True)
    order = np.argsort(of, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    left, links = np.arange(len(prints)), []
    while len(left):
        reached = of[left[0]]
        open_ = members[reached].tolist()
        left = left[of[left] != reached]
        while open_ and len(left):
            x = open_.pop()
            near = left[np.bitwise_count(prints[left] ^ prints[x]) <= bits]
            if len(near):
                _, first = np.unique(of[near], return_index=True)
                links += [(x, y) for y in near[first].tolist()]
                open_ += np.concatenate([members[k] for k in of[near[first]]]).tolist()
                left = left[~np.isin(of[left], of[near])]
    return links


def _link(tasks: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) within the groups of ``tasks(bucket, i, j, component, print)``, each of which one task can hold."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            prints = rows[4].view(np.uint64)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
            at = np.append(np.flatnonzero(new), rows.shape[1])
            size = np.diff(at)
            # Most groups are of two.
            two = at[:-1][size == 2]
            two = two[(np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits) & (rows[3, two] != rows[3, two + 1])]
            a, b = [rows[4, two]], [rows[4, two + 1]]
            for k in np.flatnonzero(size > 2).tolist():
                own = slice(at[k], at[k + 1])
                found = np.array(bucket_links(prints[own], rows[3, own], bits), np.int64).reshape(-1, 2) + at[k]
                a.append(rows[4, found[:, 0]])
                b.append(rows[4, found[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            held = np.hstack([held, np.vstack([batch.column(c).to_numpy() for c in ("bucket", "i", "j", "component", "print")])])
            if held.shape[1] > BLOCK:
                # Rows come in the order of groups; the last one may go on in the next batch.
                other = np.flatnonzero((held[:3] != held[:3, -1:]).any(axis=0))
                if len(other):
                    yield flush(np.ascontiguousarray(held[:, : other[-1] + 1]))
                    held = held[:, other[-1] + 1 :]
        if held.shape[1]:
            yield flush(np.ascontiguousarray(held))

    group = ["bucket", "i", "j"]
    rows = tasks.select(F.col("bucket"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "component", "print")
    return arrow_map(rows.repartition(*group).sortWithinPartitions(*group), link, "a long, b long")


def print_components(nodes: DataFrame, bits: int) -> DataFrame:
    """(node, component) of the fingerprints of ``nodes(print)``, each there once, that link with another."""
    keys = nodes.select("print", F.explode(block_keys(F.col("print"), bits)).alias("bucket"))
    shared = materialise(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = keyed_join(keys, shared, "bucket", "n").withColumn("component", F.col("print"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    links = materialise(_link(rows.withColumn("j", F.col("i")), bits))
    parts = connected_components(links)
    large = rows.filter(F.col("blocks") > 1).drop("component")
    if large.isEmpty():
        return parts
    named = large.join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = materialise(named)
    open_ = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    rest = named.join(open_, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> i")
    rest = rest.select("bucket", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), "component", "print")
    return connected_components(links.unionByName(_link(rest, bits)))


def simhash_groups(docs: DataFrame, size: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``print`` (as a signed number), ``component_id``, ``kept`` and ``row_tag``, a hash of the text.

    Texts whose fingerprints are equal or differ in ``bits`` bits at most,
    directly or through others, share the smallest id among them.  Null and
    empty texts and those of white space alone have fingerprint zero, which
    links like any other; a text of fewer than ``size`` words is one shingle.
    A null id never names a component unless it stands alone, with which ids
    are null; rows that repeat an id are kept alike.  An empty table gives an
    empty result; further columns are not read.
    """
    if not 0 <= bits <= 16:
        raise ValueError("bits must be from 0 to 16")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = materialise(fingerprints(rows.select("doc_id", F.xxhash64("text").alias("row_tag"), "text"), size))
    nodes = materialise(found.groupBy("print").agg(F.min("doc_id").alias("low")))
    named = nodes.select("print", F.col("low").alias("component_id"))
    if bits:
        parts = print_components(nodes.select("print"), bits).withColumnRenamed("node", "print")
        labelled = materialise(nodes.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print")))
        lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
        named = materialise(labelled.join(lowest, "component").select("print", "component_id"))
    out = found.join(named, "print")
    return out.select("doc_id", "print", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_tag")


def simhash_dedup(docs: DataFrame, size: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component: one of each group, with all its columns in their form."""
    stays = simhash_groups(docs, size, bits, id_col, text_col).filter("kept").groupBy("doc_id").agg(F.min("row_tag").alias("row_tag"))
    return rows_of(docs, stays, id_col, text_col)
