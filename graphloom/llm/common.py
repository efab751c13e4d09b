"""Shared plumbing of the operators: reading, scratch tables, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text handed to a vectorised kernel at once; its temporaries take some 40 times as much.
SLICE_BYTES = 1 << 19


def give_memory_back() -> None:
    """Let freed arrays of a worker go back to the system at once: an executor may keep several idle workers."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


def trim_memory() -> None:
    """What a worker does after a task: it may stay idle while others work."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


give_memory_back()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    session may do without, as in tests: a temporary folder is used there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_join(rows: DataFrame, listed: DataFrame, key: str, per_key: str, most: int = 10_000) -> DataFrame:
    """``rows`` joined to ``listed``, which has each ``key`` once with its number of rows in ``per_key``.

    A key with more than one row in ``most`` is hot; there are fewer than
    ``most`` such keys, so theirs is a broadcast join, and no task gets more than
    that share of the rows by one key.
    """
    total = listed.agg(F.sum(per_key)).first()[0] or 0
    hot = listed.filter(F.col(per_key) * most > total)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    cold = marked.filter("_hot is null").drop("_hot").join(listed.filter(F.col(per_key) * most <= total), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def rows_of(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs``, with all its columns, for each row of ``stays(doc_id, row_tag)``, whose pairs are distinct; ``row_tag`` is the text's hash."""
    plain = docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])  # columns may have any names
    own, text = F.col(f"d{docs.columns.index(id_col)}"), f"d{docs.columns.index(text_col)}"
    joined = plain.withColumn("tag", F.xxhash64(text_or_empty(text))).join(stays, own.eqNullSafe(F.col("doc_id")) & (F.col("tag") == F.col("row_tag")))
    return joined.dropDuplicates(["doc_id", "row_tag"]).select(*[F.col(f"d{k}").alias(c) for k, c in enumerate(docs.columns)])


def arrow_limits(spark: SparkSession) -> None:
    """Keep each Arrow batch small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` has about ``limit`` bytes in each; one longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the offsets of its rows in it; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    off = offsets_of(column)
    raw = column.buffers()[2]
    if raw is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]], off - off[0]


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim_memory()

    return df.mapInArrow(run, schema)
