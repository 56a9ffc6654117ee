"""Cutting the lineage of iterative plans in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local master, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def checkpoint(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as Parquet, in folders by the values of ``by``, and read back; survives the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
