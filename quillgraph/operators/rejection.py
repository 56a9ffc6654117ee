"""Second-order walks by rejection: proposals from numbered links, no line graph and no list of neighbours.

Links are numbered over the whole table in order of (source, target), so a
node's links are a stretch of numbers, and a proposal is one number in it.  A
walker meets the row of that number, whatever the node's degree: a hub costs
its walkers one row each and never stands in one task as a list.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint, shared_folder
from .graph import running_sum

_STATE = "start long, round long, pos int, prev long, cur long, attempt int, live boolean"


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``number, dst, share`` and stretches ``cur, first, degree``.

    Equal links add up; null ends and weights that aren't above 0 are left out.
    ``share`` is the weight over the largest of its source.
    """
    links = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND w > 0").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.sum(F.col("w").cast("double")).alias("w"))
    placed = checkpoint(running_sum(links, ["src", "dst"], F.lit(1), "number"))
    stretches = checkpoint(placed.groupBy(F.col("src").alias("cur")).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("degree"), F.max("w").alias("most")))
    shares = placed.join(stretches.select(F.col("cur").alias("src"), "most"), "src").select("number", "src", "dst", (F.col("w") / F.col("most")).alias("share"))
    return checkpoint(shares), stretches.drop("most")


def walk_steps(edges: DataFrame, length: int, p: float = 1.0, q: float = 1.0, walks: int = 1, seed: int = 1, tries: int = 4) -> DataFrame:
    """``start, round, pos, node`` of ``walks`` walks of ``length`` nodes from every source.

    A proposal, uniform over the links of the current node, is taken with
    probability weight / largest weight times bias / largest bias, where the
    bias is 1/p for a return, 1 for a node that the previous one leads to, else
    1/q.  A node with one link is left by it at once.  Walkers make several
    attempts in one pass, at least ``tries``, more the longer they were
    rejected, and the first that holds counts; numbers are keyed by walk, step
    and attempt, so ``tries`` and the partitions change nothing.  A walk ends
    early at a node without links.  Passes go on until no walker is left; each
    is written.
    """
    spark = edges.sparkSession
    links, stretches = numbered(edges)
    steps = links.select(F.col("number"), F.col("dst").alias("cand"), "share")
    direct = links.select(F.col("src").alias("prev"), F.col("dst").alias("cand"), F.lit(True).alias("direct"))
    most = max(1.0 / p, 1.0, 1.0 / q)
    rounds = spark.range(walks).select(F.col("id").alias("round"))
    at = stretches.select(F.col("cur").alias("start")).crossJoin(F.broadcast(rounds))  # `walks` rows are broadcast
    at = at.select("start", "round", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("prev"), F.col("start").alias("cur"), F.lit(0).alias("attempt"), F.lit(length > 1).alias("live"))
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    walker = ["start", "round", "pos", "prev", "cur"]
    step = 0
    while True:
        path = f"{root}/pass={step}"
        at.write.parquet(path)
        here = spark.read.schema(_STATE).parquet(path).filter("live")
        if not here.take(1):
            break
        key = ("start", "round", F.col("pos") + 1)
        more = F.greatest(F.lit(tries), F.least(F.col("attempt"), F.lit(64)))
        asked = here.join(stretches, "cur", "left")
        asked = asked.withColumn("attempt", F.explode(F.when(F.col("degree") > 1, F.sequence(F.col("attempt"), F.col("attempt") + more - 1)).otherwise(F.array("attempt"))))
        asked = asked.withColumn("number", F.col("first") + F.pmod(prng.bits(seed, *key, "attempt"), F.col("degree")))
        met = asked.join(steps, "number", "left")
        if p != 1.0 or q != 1.0:
            met = met.join(direct, ["prev", "cand"], "left")
            bias = F.when(F.col("prev").isNull(), most).when(F.col("cand") == F.col("prev"), 1.0 / p).when(F.col("direct"), 1.0).otherwise(1.0 / q)
        else:
            bias = F.lit(1.0)
        taken = (F.col("degree") == 1) | (prng.uniform(seed + 1, *key, "attempt") < F.col("share") * (bias / F.lit(most)))
        best = met.groupBy(*walker).agg(
            F.min(F.when(taken, F.struct("attempt", "cand"))).alias("took"),
            F.max("attempt").alias("last"),
            F.first("degree").isNotNull().alias("open"),
        )
        took = F.col("took").isNotNull()
        at = best.filter("open").select(
            "start",
            "round",
            F.when(took, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"),
            F.when(took, F.col("cur")).otherwise(F.col("prev")).alias("prev"),
            F.when(took, F.col("took.cand")).otherwise(F.col("cur")).alias("cur"),
            F.when(took, 0).otherwise(F.col("last") + 1).alias("attempt"),
            (~took | (F.col("pos") + 1 < length - 1)).alias("live"),
        )
        step += 1
    made = spark.read.schema(f"{_STATE}, pass int").parquet(root)
    return made.filter("attempt = 0").select("start", "round", "pos", F.col("cur").alias("node"))  # a step taken starts at attempt 0


def rejection_walks(edges: DataFrame, length: int, p: float = 1.0, q: float = 1.0, walks: int = 1, seed: int = 1, tries: int = 4) -> DataFrame:
    """The same as ``start, round, path``."""
    steps = walk_steps(edges, length, p, q, walks, seed, tries)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node")))  # `length` rows a walk
    return steps.groupBy("start", "round").agg(F.transform(ordered, lambda x: x["node"]).alias("path"))
