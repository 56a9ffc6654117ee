"""Training on pairs with both tables of vectors kept in blocks: no table is sent whole, collected or averaged.

Nodes are hashed into P blocks for each table.  In turn t of an epoch block i
of the first table meets block i + t (mod P) of the second and the pairs that
belong to both, so P tasks train at a time on rows that no other task holds,
and after P turns every pair has been seen.  The tables are written after each
turn.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint

#: A block holds about so many rows of a table, a cell of two blocks about so many different pairs.
BLOCK_ROWS, CELL_PAIRS = 50_000, 2_000_000

_STATE = "side int, block int, node_id long, p double, sq double, vec array<double>"

#: ``step(u, v, a, b, k, base, nodes, weight)`` gives (table, rows, values), as the gradients of one batch.
Step = Callable[..., list[tuple[int, np.ndarray, np.ndarray]]]


def descend(table: np.ndarray, squares: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], rate: float) -> None:
    """One adaptive step: a row's gradient over the root of the mean squares it has seen, so no loss needs a rate of its own."""
    rows, at = np.unique(np.concatenate([r for r, _ in steps]), return_inverse=True)
    dim = table.shape[1]
    cell = at[:, None] * dim + np.arange(dim)
    g = np.bincount(cell.ravel(), np.concatenate([s for _, s in steps]).ravel(), len(rows) * dim).reshape(-1, dim)
    squares[rows] += (g * g).mean(axis=1)
    table[rows] -= rate * g / np.sqrt(squares[rows] + 1e-12)[:, None]


def _cell(rows: pd.DataFrame, pairs: pd.DataFrame, step: Step, nodes: int, negative: int, rate: float, repeats: int, batch: int, key: list[int]) -> pd.DataFrame:
    """The two blocks of one cell after its pairs; the same from the same rows, in whatever order they come."""
    rows = rows.sort_values(["side", "node_id"], ignore_index=True)
    sides = [rows[rows["side"] == side] for side in (0, 1)]
    if not len(pairs) or not all(map(len, sides)):
        return rows
    pairs = pairs.sort_values(["center", "context"])
    ids = [s["node_id"].to_numpy() for s in sides]
    tables = [np.stack(s["vec"].to_numpy()) for s in sides]
    squares = [s["sq"].to_numpy().copy() for s in sides]
    law = np.maximum(sides[1]["p"].to_numpy(), 0.0)
    law = np.cumsum(law if law.sum() > 0 else np.ones(len(law)))
    a, b = np.searchsorted(ids[0], pairs["center"].to_numpy()), np.searchsorted(ids[1], pairs["context"].to_numpy())
    count = pairs["n"].to_numpy().astype(float)
    visits = np.minimum(count, repeats)
    until, weight = np.cumsum(visits), count / visits
    r = np.random.default_rng(key)
    todo = int(until[-1])
    while todo > 0:
        size = min(batch, todo)
        at = np.minimum(np.searchsorted(until, r.random(size) * until[-1], side="right"), len(until) - 1)
        k = np.minimum(np.searchsorted(law, r.random((size, negative)) * law[-1], side="right"), len(law) - 1)
        base = (r.integers(0, len(ids[0]), size), r.integers(0, len(ids[1]), size))
        steps = step(*tables, a[at], b[at], k, base, nodes, weight[at])
        for t in (0, 1):
            descend(tables[t], squares[t], [s[1:] for s in steps if s[0] == t], rate)
        todo -= size
    rows["sq"] = np.concatenate(squares)
    rows["vec"] = [*tables[0], *tables[1]]
    return rows


def _kept(df: DataFrame, folder: str | None, name: str, *by: str) -> DataFrame:
    """A checkpoint, or the table ``name`` of ``folder``, written unless an earlier run has finished it."""
    if folder is None:
        return checkpoint(df, *by)
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    if not finished(spark, path):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a written table was committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def train(
    pairs: DataFrame,
    noise: DataFrame,
    dim: int,
    step: Step,
    epochs: int = 1,
    negative: int = 5,
    rate: float = 0.1,
    blocks: int | None = None,
    repeats: int = 64,
    batch: int = 256,
    seed: int = 1,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``node_id, vec`` of the first and the second table after training on ``pairs(center, context)``.

    ``noise(node_id, p)`` holds every node once; noise contexts follow ``p``
    within the block at hand.  Equal pairs are counted before they are moved; a
    pair that occurs n times is drawn min(n, ``repeats``) times on average, with
    a gradient that counts for all n, so a hub costs no more than its different
    partners.  ``blocks``: by default as many as keep :data:`BLOCK_ROWS` and
    :data:`CELL_PAIRS`.  Pairs with a null or an unknown node are left out.

    With a ``folder`` in shared storage the pairs and the tables after each turn
    stay there, and a later call with the same options goes on behind the last
    turn that was finished, to the same result; more ``epochs`` train on.
    """
    known = _kept(noise.filter("node_id IS NOT NULL").groupBy(F.col("node_id").cast("long").alias("node_id")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).cast("double").alias("p")), folder, "nodes")
    counted = _kept(pairs.groupBy(F.col("center").cast("long").alias("center"), F.col("context").cast("long").alias("context")).agg(F.count(F.lit(1)).alias("n")), folder, "counts")
    nodes = known.count()
    p = blocks or max(1, math.ceil(nodes / BLOCK_ROWS), math.ceil(math.sqrt(counted.count() / CELL_PAIRS)))
    block = lambda c, side: F.pmod(F.xxhash64(F.lit(side), c), F.lit(p)).cast("int")
    for column in ("center", "context"):
        counted = counted.join(known.select(F.col("node_id").alias(column)), column, "left_semi")
    lane = block(F.col("center"), 0)
    cells = counted.select("center", "context", "n", lane.alias("lane"), F.pmod(block(F.col("context"), 1) - lane, F.lit(p)).alias("turn"))
    cells = _kept(cells.repartition(max(p, 1), "turn", "lane"), folder, f"cells-{p}", "turn")
    start = lambda side: F.array(*((prng.uniform(seed, F.lit(side), F.col("node_id"), F.lit(j)) - 0.5) / dim for j in range(dim)))
    sides = [known.select(F.lit(s).alias("side"), block(F.col("node_id"), s).alias("block"), "node_id", "p", F.lit(0.0).alias("sq"), start(s).alias("vec")) for s in (0, 1)]
    state = _kept(sides[0].unionByName(sides[1]), folder, f"state-{p}-0")

    def at_turn(epoch: int, turn: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            out = _cell(rows.drop(columns="lane"), some, step, nodes, negative, rate, repeats, batch, [seed, epoch, turn, int(key[0])])
            return out[["side", "block", "node_id", "p", "sq", "vec"]]

        return run

    order, done = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for turn in map(int, order.permutation(p)):
            done += 1
            meet = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(p))).alias("lane")
            here = cells.filter(F.col("turn") == turn).select("lane", "center", "context", "n")
            state = _kept(state.select("*", meet).groupBy("lane").cogroup(here.groupBy("lane")).applyInPandas(at_turn(epoch, turn), _STATE), folder, f"state-{p}-{done}")
    first, second = (state.filter(F.col("side") == s).select("node_id", "vec") for s in (0, 1))
    return first, second
