"""Near-duplicate classes by min-max hashing.

Each of ``PERMUTATIONS`` affine permutations of 64-bit shingle hashes gives two
signature values, its minimum and its maximum over a document's shingle set, so
a signature costs half the hash evaluations that as many minima would.  Both
agree between two sets with probability equal to their Jaccard similarity.
``BANDS`` bands of ``ROWS`` values, each value of a band from another
permutation, are compared; a pair at similarity 0.8 shares none with
probability (1 - 0.8**4)**32 = 5e-8.

Work on links stays near linear in the documents:

* equal shingle sets are one node from the start, so copies never meet;
* nodes that share band buckets, directly or through others, form a cluster;
  each node's set is sent once to its cluster, and there a node is tried against
  others of its buckets only while they are in different components;
* a cluster is cut into blocks of bounded size, and each pair of blocks is one
  task;
* a cluster of too many blocks is linked by proposals instead: each bucket
  proposes one node to all its members, confirmed by joins on the full sets,
  with new proposals until few untested pairs between components are left or
  ``PARTNER_ROUNDS`` are over; then each bucket that still holds several
  components is cut into blocks as a small cluster is.

No link within a bucket that could still join two components goes untested.

Sets are those of 64-bit shingle hashes under a key drawn for each run, which
nobody who writes texts can know: two given sets are taken for more alike than
they are with a probability of their shingles' product over 2**64.  Equal sets
are told by two such hashes under independent keys; should they disagree
anywhere, new keys are drawn and all is hashed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, arrow_map, bytes_of, materialise, rows_of, slices, text_or_empty
from .components import connected_components
from .textbuf import LOWER, NONSPACE, Words, draw_key, mix, shingles, span_hash, stream, words

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Untested pairs per node from which another round of partners is tried, and rounds at most, before buckets are cut into blocks.
DIRECT_PAIRS, PARTNER_ROUNDS = 4, 6
#: Shingles in a block of a cluster, and blocks up to which its block pairs are tried.
BLOCK_SHINGLES, CLUSTER_BLOCKS = 1 << 20, 16
#: Rows of a block that a row is compared with one by one before the rest is compared at once.
FIRST_TRIES = 8


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """(document, 2 * permutations): the minima, then the maxima; zeros for an empty set."""
    a, b = stream(31, permutations) | np.uint64(1), stream(37, permutations)
    out = np.zeros((len(sets), 2 * permutations), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            for at in range(0, len(s), 4096):  # a cache's worth at a time
                x = s[at : at + 4096]
                y = x[None, :] * a[:, None]
                y += b[:, None]
                low, high = y.min(axis=1), y.max(axis=1)
                if at:
                    low, high = np.minimum(low, out[i, :permutations]), np.maximum(high, out[i, permutations:])
                out[i, :permutations], out[i, permutations:] = low, high
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(document, band): one 64-bit key per band, of values from ``rows`` different permutations."""
    half = signature.shape[1] // 2
    out = np.empty((len(signature), bands), np.uint64)
    for k in range(bands):
        first = (k * rows) % half
        columns = [(first + r) % half + half * (k * rows // half % 2) for r in range(rows)]
        key = np.full(len(signature), k + 1, np.uint64)
        for c in columns:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, c])
        out[:, k] = key
    return out


def _sets(part: pa.RecordBatch, size: int, key: int, *more: int) -> list[list[np.ndarray]]:
    """For each key, every text's set."""
    buf, off = bytes_of(part.column("text"))
    w = words(buf, off, NONSPACE, key)
    out = [shingles(w, size, key)]
    for k in more:
        out.append(shingles(Words(span_hash(LOWER[buf], w.start, w.end, k), w.start, w.end, w.first), size, k))
    return out


def set_hash(s: np.ndarray) -> int:
    """One 64-bit value for a whole set; equal sets agree."""
    mixed = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(s)))
    total = mixed.sum(dtype=np.uint64, keepdims=True) ^ np.bitwise_xor.reduce(mix(mixed), keepdims=True)
    return int(mix(total).view(np.int64)[0])


def profiles(docs: DataFrame, size: int, keys: tuple[int, int]) -> DataFrame:
    """Per row: id, ``n_shingles``, ``node`` (a hash of the whole set, null if empty), ``check`` (one under the second key) and its ``bands``."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets, others = _sets(part, size, *keys)
            found = band_keys(signatures(sets)).view(np.int64)
            nodes, check = ([set_hash(s) if len(s) else None for s in x] for x in (sets, others))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(check, pa.int64()), bands],
                names=["doc_id", "row_tag", "n_shingles", "node", "check", "bands"],
            )

    return arrow_map(docs, profile, "doc_id long, row_tag long, n_shingles long, node long, check long, bands array<long>")


def settled_profiles(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """``profiles`` and the distinct nodes among them, each of one set, with the key of their hashes."""
    while True:
        keys = draw_key(), draw_key()
        found = materialise(profiles(rows, size, keys))
        nodes = found.filter("node is not null").groupBy("node")
        nodes = materialise(nodes.agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.min("check").alias("x"), F.max("check").alias("y")))
        if nodes.filter("x <> y").isEmpty():
            return found, nodes.drop("x", "y"), keys[0]


def shingle_sets(nodes_text: DataFrame, size: int, key: int) -> DataFrame:
    """(node, shingles, hash) of (node, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = _sets(part, size, key)[0]
            at = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)), pa.array([set_hash(s) if len(s) else None for s in found], pa.int64())], names=["node", "shingles", "hash"])

    return arrow_map(nodes_text, sets, "node long, shingles array<long>, hash long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    # The partner column a may name one node very often; b's set is fetched first, as b recurs least.
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    y = x.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    y = y.filter(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
    y = y.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return y.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``row_tag``, a hash of the text.

    Texts with equal shingle sets, or linked through similar ones, share the
    smallest id among them.  An empty or null text has no shingles and is its
    own component.  A null id never names a component unless it stands alone;
    rows that repeat an id are kept alike.  Empty tables give empty results;
    further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("row_tag", F.xxhash64("text"))
    found, nodes, key = settled_profiles(rows, size)
    bands = nodes.select("node", F.explode("bands").alias("bucket"))
    bucket = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("bucket", "least")
    cluster = connected_components(bands.join(bucket, "bucket").select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "cluster")
    blocks = cluster.join(nodes, "node").groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = materialise(cluster.join(nodes, "node").join(blocks, "cluster"))
    # Nodes of null ids alone are found by the text's tag as well, so that their rows do not all meet.
    tags = found.filter("doc_id is null").groupBy(F.col("node").alias("_node")).agg(F.min("row_tag").alias("tag"))
    named = members.join(tags, (F.col("node") == F.col("_node")) & F.col("low").isNull(), "left").select("node", "low", "tag")
    by_tag = F.when(F.col("doc_id").isNull(), F.col("row_tag"))
    texts = rows.withColumn("by_tag", by_tag).join(named, F.col("doc_id").eqNullSafe(F.col("low")) & F.col("by_tag").eqNullSafe(F.col("tag"))).select("node", "text")
    # Rows that repeat an id may bring another text; the set's own hash tells.
    sets = materialise(shingle_sets(texts, size, key).filter("node = hash").select("node", "shingles").dropDuplicates(["node"]))
    members = members.withColumn("component", F.col("node"))
    links = materialise(_link_blocks(members.filter(F.col("blocks") <= CLUSTER_BLOCKS), sets, percent))
    large = members.filter(F.col("blocks") > CLUSTER_BLOCKS)
    if not large.isEmpty():
        links = links.unionByName(_link_by_proposals(large.select("node", "n_shingles", F.explode("bands").alias("bucket")), sets, percent))
    components = connected_components(links)
    lowest = components.join(nodes, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    named = components.join(lowest, "component").select("node", "component_id")
    alone = nodes.join(components.select("node"), "node", "left_anti").select("node", F.col("low").alias("component_id"))
    out = found.select("doc_id", "row_tag", "n_shingles", "node").join(named.unionByName(alone), "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row_tag", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


class Labels:
    """Components of the rows of one task, as one label for each row; the smaller of two components is labelled anew."""

    def __init__(self, known: np.ndarray) -> None:
        _, self.of = np.unique(known, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        self.rows = dict(enumerate(np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1)))

    def union(self, x: int, y: int) -> None:
        a, b = int(self.of[x]), int(self.of[y])
        if len(self.rows[a]) < len(self.rows[b]):
            a, b = b, a
        moved = self.rows.pop(b)
        self.of[moved] = a
        self.rows[a] = np.concatenate([self.rows[a], moved])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) * 100 < len(large) * percent:
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def block_links(nodes: np.ndarray, known: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all rows of a task which are linked through shared buckets; pairs already joined, as rows of one component of ``known`` are, are not tried.

    Each row is tried against the rows before it: one by one against ``FIRST_TRIES`` that share
    most buckets with it, and then against what is left at once.
    """
    n, labels, links = len(nodes), Labels(known), []
    size = np.array([len(s) for s in sets], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(item.max()) + 1, bool)
    _, bucket = np.unique(bands.reshape(-1), return_inverse=True)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    start = np.searchsorted(bucket[order], bucket).reshape(n, -1).tolist()
    place, row = place.reshape(n, -1).tolist(), order // bands.shape[1]

    def link(x: int, y: int) -> None:
        labels.union(x, y)
        links.append((int(nodes[x]), int(nodes[y])))

    for x in range(n):
        before = [row[a:b] for a, b in zip(start[x], place[x], strict=True) if a < b]
        if not before:
            continue
        shared = np.bincount(np.concatenate(before), minlength=x)[:x]
        left = np.flatnonzero((shared > 0) & (labels.of[:x] != labels.of[x]))
        left = left[np.argsort(-shared[left], kind="stable")]
        for _ in range(FIRST_TRIES):
            if not len(left):
                break
            y, left = int(left[0]), left[1:]
            if similar(sets[x], sets[y], percent):
                link(x, y)
                left = left[labels.of[left] != labels.of[x]]
        if len(left):
            mark[item[off[x] : off[x + 1]]] = True
            first = np.cumsum(size[left]) - size[left]
            at = np.arange(int(size[left].sum())) + np.repeat(off[left] - first, size[left])
            common = np.add.reduceat(mark[item[at]], first, dtype=np.int64)
            mark[item[off[x] : off[x + 1]]] = False
            for y in left[100 * common >= percent * (size[x] + size[left] - common)].tolist():
                if labels.of[x] != labels.of[y]:
                    link(x, y)
    return links


def _link_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the clusters of ``members(cluster, blocks, node, component, bands)``, one task for each pair of blocks of a cluster."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "bands").join(sets, "node")

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes = group.column("node").to_numpy()
        column = group.column("bands").combine_chunks()
        bands = column.flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
        column = group.column("shingles").combine_chunks()
        values, off = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        found = block_links(nodes, group.column("component").to_numpy(), bands, [values[a:b] for a, b in zip(off[:-1], off[1:], strict=True)], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    arrow_limits(members.sparkSession)
    return rows.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")


def _link_by_proposals(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes linked through shared buckets, from ``shared(bucket, node, n_shingles)`` of any size."""
    shared = materialise(shared)
    links = tested = None
    labelled = shared.withColumn("component", F.col("node"))
    for turn in range(PARTNER_ROUNDS + 1):
        if turn:
            # What is left to test crosses components within a bucket: m**2 - sum of squares, in closed form.
            per = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
            left = per.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q")).filter("m * m > q")
            stats = left.agg(F.sum(((F.col("m") * F.col("m") - F.col("q")) / 2)).alias("pairs"), F.sum("m").alias("members")).first()
            if not stats.pairs:
                break
            labelled = labelled.join(left.select("bucket"), "bucket")
            if turn == PARTNER_ROUNDS or stats.pairs <= DIRECT_PAIRS * stats.members:
                blocks = labelled.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
                rows = labelled.join(blocks, "bucket").withColumn("cluster", F.col("bucket")).withColumn("bands", F.array("bucket"))
                return links.unionByName(_link_blocks(rows, sets, percent))
        mine = labelled.select("bucket", "node", "component")
        pick = F.min_by("node", F.xxhash64("node", F.lit(turn))) if turn else F.min("node")
        other = labelled.groupBy("bucket").agg(pick.alias("a"))
        if turn:
            other = other.join(labelled.select("bucket", F.col("node").alias("a"), F.col("component").alias("with")), ["bucket", "a"])
            pairs = mine.join(other, "bucket").filter("component <> with")
        else:
            pairs = mine.join(other, "bucket").filter("node <> a")
        pairs = pairs.select(F.least("a", "node").alias("b"), F.greatest("a", "node").alias("a")).distinct()
        if turn:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = materialise(confirm(pairs, sets, percent))
        links = new if links is None else links.unionByName(new)
        parts = connected_components(links)
        labelled = shared.join(parts, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    return links


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component: one of each group, the one with the smallest id."""
    stays = near_groups(docs, size, percent, id_col, text_col).filter("kept").select("doc_id", "row_tag").distinct()
    return rows_of(docs, stays, id_col, text_col)
