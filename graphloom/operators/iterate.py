"""Cutting the lineage of iterative plans, and tables that a run writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without, as in tests: a temporary folder is used there.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="graphloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the folder that the cluster names in ``spark.checkpoint.dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, *keys: str, distinct: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in as many buckets by ``keys`` as a shuffle has partitions.

    A join on the keys reads the buckets where they are: only its other side is
    shuffled, in every round anew.  ``distinct`` drops repeated rows on the way,
    in the same shuffle.
    """
    spark = df.sparkSession
    name, count = f"graphloom_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(count, *keys)
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    (rows.distinct() if distinct else rows).write.bucketBy(count, *keys).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def written(df: DataFrame, *partitions: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in directories by ``partitions``, which a filter on them prunes.

    Rows of one directory go to few files, however many tasks made them; a
    directory that would be large for one task is split.  Files are sorted by
    ``order``, so that filters on it skip row groups.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if partitions:
        df = df.hint("rebalance", *partitions)
    if partitions or order:
        df = df.sortWithinPartitions(*partitions, *order)
    out = df.write
    if partitions:
        out = out.partitionBy(*partitions)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
