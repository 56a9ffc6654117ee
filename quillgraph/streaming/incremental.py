"""Incremental counterparts on Structured Streaming: degree deltas of an edge stream, and online sub-clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """Running degree and strength of each source of a streaming edge table (complete or update mode)."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def windowed_edges(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Edge weights in tumbling windows of event time, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "src", "dst").agg(F.count(F.lit(1)).alias("w"))


def merge_sums(path: str, d: int):
    """``foreachBatch`` function that keeps (g, n, ls) sums of each micro-batch under ``path``.

    A batch that is run again after a failure replaces its own rows, so no
    vector counts twice; :func:`read_sums` adds the batches up.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("vec")[i]) for i in range(d))).alias("ls"))
        sums.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return merge


def read_sums(spark: SparkSession, path: str, d: int) -> DataFrame:
    """``g, n, ls`` over all batches so far."""
    parts = spark.read.parquet(path)
    return parts.groupBy("g").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("ls")[i]) for i in range(d))).alias("ls"))
