"""Indexes kept up to date from a stream of edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def degree_stream(edges: DataFrame, name: str) -> StreamingQuery:
    """Running in- and out-degrees of a stream of ``edges(src, dst)``, in a memory table (for tests and small graphs)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    running = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"))
    return running.writeStream.outputMode("complete").format("memory").queryName(name).start()


def typed_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Edges per type and event-time window of a stream ``(ts, type)``; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("n_edges")).select("window.start", "window.end", "type", "n_edges")


def maintain_prefix_index(nodes: DataFrame, path: str, p: int, checkpoint: str) -> StreamingQuery:
    """Appends the prefix entries of each micro-batch of ``nodes`` to a table; a repeated batch rewrites its own part."""
    from graphloom.operators.indexes import prefix_entries

    def put(batch: DataFrame, number: int) -> None:
        prefix_entries(batch, p).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
