"""Huffman codes of a table of frequencies, the tree of a hierarchical softmax.

All pairs that the two smallest weights admit are merged in one round: a node
that weighs no more than their sum s comes before every node yet to be made,
which weighs s or more, so the light nodes pair off in order.  The least weight
doubles from round to round (a single one left over apart), hence the rounds
are as many as the digits of the total, and each ranks the light nodes by
ranges.  Two rows and a count reach the driver in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint
from .graph import running_sum

_ORDER = ["w", "inner", "id"]


def merges(weights: DataFrame) -> tuple[list[DataFrame], list[int], int]:
    """Rounds of ``inner, id, w, parent, bit``, the number of the first node that each round makes, and how many are made."""
    leaves = weights.filter("node_id IS NOT NULL").groupBy(F.col("node_id").cast("long").alias("id"))
    heavy = leaves.agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("w"))
    active = checkpoint(heavy.select(F.coalesce("w", F.lit(0.0)).alias("w"), F.lit(0).alias("inner"), "id"))
    rounds, firsts, made = [], [], 0
    while len(two := active.orderBy(*_ORDER).limit(2).collect()) == 2:
        light = F.col("w") <= two[0]["w"] + two[1]["w"]
        ranked = running_sum(active.filter(light), _ORDER, F.lit(1), "rank")
        pairs = ranked.count() // 2
        at = F.col("rank") - 1
        taken = ranked.filter(F.col("rank") <= 2 * pairs)
        merged = checkpoint(taken.select("inner", "id", "w", (F.floor(at / 2) + made).cast("long").alias("parent"), (at % 2).cast("int").alias("bit")))
        new = merged.groupBy("parent").agg(F.sum("w").alias("w")).select("w", F.lit(1).alias("inner"), F.col("parent").alias("id"))
        active = checkpoint(active.join(merged.select("inner", "id"), ["inner", "id"], "left_anti").select(*_ORDER).unionByName(new))
        rounds.append(merged)
        firsts.append(made)
        made += pairs
    return rounds, firsts, made


def huffman_codes(weights: DataFrame) -> DataFrame:
    """``node_id, code array<int>, points array<long>`` of ``weights(node_id, weight)``, from the root down.

    ``points`` are the inner nodes on the way, numbered from 0 in the order in
    which they are made (the root last); ``code`` tells the side taken at each.
    Equal weights go leaves first, then by number, so the tree is that of a
    queue ordered so.  Rows of one node add up, null nodes are left out, null
    and negative weights count as 0.  One node has an empty code, an empty
    table gives none.
    """
    rounds, firsts, made = merges(weights)
    empty_code, empty_points = F.array().cast("array<int>"), F.array().cast("array<long>")
    if not made:
        alone = weights.filter("node_id IS NOT NULL").select(F.col("node_id").cast("long").alias("node_id")).distinct()
        return alone.select("node_id", empty_code.alias("code"), empty_points.alias("points"))
    spark = weights.sparkSession
    state = spark.range(made - 1, made).select("id", empty_code.alias("code"), empty_points.alias("points"))
    out = None
    for merged, first in zip(reversed(rounds), reversed(firsts), strict=True):
        up = state.select(F.col("id").alias("parent"), "code", "points").filter(F.col("parent") >= first)
        below = merged.join(up, "parent").select("inner", "id", F.concat("code", F.array("bit")).alias("code"), F.concat("points", F.array("parent")).alias("points"))
        written = checkpoint(below.unionByName(state.filter(F.col("id") < first).select(F.lit(1).alias("inner"), "id", "code", "points")))
        state = written.filter("inner = 1").drop("inner")
        found = written.filter("inner = 0").select(F.col("id").alias("node_id"), "code", "points")
        out = found if out is None else out.unionByName(found)
    return out
