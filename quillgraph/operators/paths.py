"""Shortest paths: distances by relaxed frontiers, a predecessor table, and paths read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint

#: Links of predecessors that are sent to every task at most, some 32 MB.
SENT = 1_000_000


def shortest_paths(edges: DataFrame, sources: DataFrame, weighted: bool = False) -> DataFrame:
    """``source, node_id, dist, pred`` for every node that a source of ``sources(node_id)`` reaches.

    Distances are numbers of links or, with ``weighted``, sums of ``w``.  Each
    round is one join of what became nearer in the last round with the links,
    and one minimum by (source, node); it ends when nothing becomes nearer.
    ``pred`` is the smallest node before ``node_id`` on a shortest path, null
    at the source itself.  Links whose weight is null, zero or negative don't
    exist; repeated sources count once; a source without links reaches itself.
    """
    length = F.col("w").cast("double") if weighted else F.lit(1.0)
    links = checkpoint(edges.filter("w > 0").groupBy(F.col("src").alias("from"), F.col("dst").alias("to")).agg(F.min(length).alias("w")))
    start = sources.select(F.col("node_id").alias("source")).dropna().distinct()
    none = F.lit(None).cast("double")
    known = checkpoint(start.select("source", F.col("source").alias("node_id"), F.lit(0.0).alias("dist"), none.alias("old")))
    while not (nearer := known.filter("old IS NULL OR dist < old")).isEmpty():
        reached = nearer.join(links, nearer["node_id"] == links["from"]).select("source", F.col("to").alias("node_id"), (F.col("dist") + F.col("w")).alias("dist"), none.alias("old"))
        both = known.withColumn("old", F.col("dist")).unionByName(reached)
        known = checkpoint(both.groupBy("source", "node_id").agg(F.min("dist").alias("dist"), F.min("old").alias("old")))
    before = known.select("source", F.col("node_id").alias("from"), F.col("dist").alias("start")).join(links, "from")
    before = before.select("source", F.col("to").alias("node_id"), (F.col("start") + F.col("w")).alias("dist"), "from")
    pred = before.groupBy("source", "node_id", "dist").agg(F.min("from").alias("pred"))  # a sum equals the distance exactly where it was chosen
    return known.drop("old").join(pred, ["source", "node_id", "dist"], "left")


def _meet(pairs: DataFrame, few: DataFrame, by: list[str], how: str, most: int) -> DataFrame:
    """Join of many pairs with a written table, which is sent whole if it has at most ``most`` rows, else kept by its key: the pairs are never sorted."""
    return pairs.join(F.broadcast(few) if few.count() <= most else few.hint("shuffle_hash"), by, how)


def trace_paths(tree: DataFrame, pairs: DataFrame, most: int = 100, cut_every: int = 8) -> DataFrame:
    """``source, target, path`` for ``pairs(source, target)`` from a table of predecessors, source first.

    At most ``most`` links are followed back, so a longer path keeps its last
    ``most + 1`` nodes.  A target that can't be reached has itself alone as
    path, and so has a source.  Only pairs with a link to follow are walked
    back; the others pass by once, in whatever number.
    """
    steps = checkpoint(tree.filter("pred IS NOT NULL").select("source", F.col("node_id").alias("_at"), "pred"))
    linked = _meet(pairs, steps.select("source", F.col("_at").alias("target")), ["source", "target"], "left_semi", SENT)
    out = checkpoint(linked.select("source", "target").distinct()).select("source", "target", F.array("target").alias("path"), F.col("target").alias("_at"))
    for k in range(1, most + 1):
        joined = out.join(steps, ["source", "_at"], "left")
        more = F.when(F.col("pred").isNotNull(), F.concat(F.array("pred"), F.col("path"))).otherwise(F.col("path"))
        out = joined.select("source", "target", more.alias("path"), F.col("pred").alias("_at"))
        if k % cut_every == 0:
            out = checkpoint(out)
            if out.filter("_at IS NOT NULL").isEmpty():
                break
    found = checkpoint(out.select("source", "target", F.col("path").alias("_path")))
    return _meet(pairs, found, ["source", "target"], "left", SENT // most).select("source", "target", F.coalesce("_path", F.array("target")).alias("path"))
