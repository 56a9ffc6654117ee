"""Shared helpers: written intermediates in the cluster's shared folder, and
column guards used by every operator of the subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediates that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting
    is absent another one is chosen: the temporary folder for a local master
    (tests), otherwise the warehouse, which executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (an executor lost later costs nothing that was finished
    before) and makes rows stable where several branches read them.
    """
    path = f"{shared_folder(df.sparkSession)}/quillgraph-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(batch, columns: tuple[int, ...], max_rows: int, max_bytes: int):
    """Slices of a record batch with at most so many rows and, beyond one row, bytes of text in the columns."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = sum(np.asarray(pc.binary_length(batch.column(c)).fill_null(0)).astype(np.int64) for c in columns)
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(total, total[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + max_rows, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def sample_by_hash(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``rows``: those with the smallest hashes of ``key``.

    The rows are counted and a threshold leaves few more than ``limit`` of
    them before they are sorted, so no partition sends ``limit`` rows.
    """
    n = rows.count()
    if n <= limit:
        return rows
    bits = 1 << 40
    share = (limit + 8 * limit**0.5 + 64) / n
    position = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    few = rows.filter(position < F.lit(min(bits, int(share * bits))))
    return few.orderBy(position, key).limit(limit)


def text_or_empty(column: str | Column) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
