"""Noise distributions and pair samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prng
from .algebra import powers, weighted_sum
from .graph import block_matrix, running_sum

#: Items of a label that meet as many others in one tile of :func:`positive_pairs`; Spark keeps so many in memory.
LOT = 2048


def noise_distribution(edges: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Configuration model: ``node_id, p`` proportional to in-degree^exponent."""
    d = edges.groupBy(F.col("dst").alias("node_id")).agg(F.pow(F.sum("w"), F.lit(float(exponent))).alias("v"))
    return d.crossJoin(F.broadcast(d.agg(F.sum("v").alias("t")))).select("node_id", (F.col("v") / F.col("t")).alias("p"))


def uniform_distribution(edges: DataFrame) -> DataFrame:
    n = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return n.crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("t")))).select("node_id", (1.0 / F.col("t")).alias("p"))


def group_distribution(edges: DataFrame, nodes: DataFrame, exponent: float = 1.0) -> DataFrame:
    """Within each group, ``node_id, membership, p`` proportional to in-degree^exponent (0 counts as 0)."""
    d = edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("w").alias("d"))
    v = nodes.join(d, "node_id").select("node_id", "membership", F.pow(F.col("d").cast("double"), F.lit(float(exponent))).alias("v"))
    return v.select("node_id", "membership", (F.col("v") / F.sum("v").over(Window.partitionBy("membership"))).alias("p"))


def with_cdf(distribution: DataFrame, by: str, digits: int = 12) -> DataFrame:
    w = Window.partitionBy(by)
    run = F.sum("p").over(w.orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(w)
    last = F.row_number().over(w.orderBy("node_id")) == F.count(F.lit(1)).over(w)
    return distribution.withColumn("cdf", F.when(last, 1.0).otherwise(F.round(run, digits)))


def block_transition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row-normalised group-to-group weights: ``src, dst, w`` over groups."""
    b = block_matrix(edges, nodes)
    return b.select(F.col("g_src").alias("src"), F.col("g_dst").alias("dst"), (F.col("w") / F.sum("w").over(Window.partitionBy("g_src"))).alias("w"))


def whole_cdf(distribution: DataFrame, digits: int = 12) -> DataFrame:
    """``node_id, cdf`` of one distribution ``node_id, p`` over all nodes, added up by ranges; the last value is 1."""
    run = running_sum(distribution.select("node_id", "p"), ["node_id"], F.col("p"), "cdf")
    last = distribution.agg(F.max("node_id").alias("_last"))
    return run.crossJoin(F.broadcast(last)).select("node_id", F.when(F.col("node_id") == F.col("_last"), 1.0).otherwise(F.round("cdf", digits)).alias("cdf"))  # one row is broadcast


def draw(requests: DataFrame, cdf: DataFrame, by: str | None, seed: int, *keys: str, cells: int = 1024, name: str = "drawn") -> DataFrame:
    """``requests`` with ``name``: the first node whose CDF (in its group ``by``) reaches the number keyed by ``keys``.

    [0, 1] is cut into cells.  A node belongs to the cells that its step of the
    CDF touches and a request to the cell of its number, so they meet by an
    equality join and a request never sees all nodes.  Equal requests stay apart.
    """
    group = [by] if by else []
    steps = Window.partitionBy(*group).orderBy("cdf", "node_id") if by else None
    table = cdf.select(*group, "node_id", "cdf")
    if by:
        table = table.withColumn("_low", F.coalesce(F.lag("cdf").over(steps), F.lit(-1.0)))
    else:
        table = _previous(table)
    place = lambda c: F.least(F.floor(F.greatest(c, F.lit(0.0)) * cells), F.lit(cells)).cast("int")
    table = table.withColumn("_cell", F.explode(F.sequence(place(F.col("_low")), place(F.col("cdf"))))).withColumnsRenamed({"node_id": name, "cdf": "_high"})
    asked = requests.withColumn("_u", prng.uniform(seed, *keys)).withColumn("_cell", place(F.col("_u")))
    met = asked.join(table, [*group, "_cell"]).filter((F.col("_low") < F.col("_u")) & (F.col("_u") <= F.col("_high")))
    return met.select(*requests.columns, name)


def _previous(table: DataFrame) -> DataFrame:
    """``_low``, the CDF of the node before, without a window over all nodes."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..plans.lineage import checkpoint

    dealt = checkpoint(table.repartitionByRange(n, "cdf", "node_id").withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range").agg(F.max("cdf").alias("_end"))
    ends = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_before"))  # one row a range
    low = F.coalesce(F.lag("cdf").over(Window.partitionBy("_range").orderBy("cdf", "node_id")), "_before", F.lit(-1.0))
    return dealt.join(F.broadcast(ends), "_range").withColumn("_low", low).drop("_range", "_before")


def with_replacement(draws: DataFrame, size: int, seed: int, *keys: str) -> DataFrame:
    """``draws`` with ``index``, a uniform number below ``size`` keyed by ``keys``."""
    return draws.withColumn("index", F.floor(prng.uniform(seed, *keys) * size).cast("long"))


def block_noise(requests: DataFrame, edges: DataFrame, nodes: DataFrame, seed: int, *keys: str, window: int = 10, exponent: float = 1.0) -> DataFrame:
    """Context nodes of a block model: ``requests(center, ...)`` with ``block`` and ``drawn``.

    The block of the context follows the mean of the first ``window`` powers of
    the block transition matrix, its node the in-degree in the block to the
    given exponent (0: uniform).  Two keyed draws.
    """
    b = block_transition(edges, nodes)
    mean = weighted_sum([(p, 1.0 / window) for p in powers(b, window)])
    rows = with_cdf(mean.select(F.col("src").alias("membership"), F.col("dst").alias("node_id"), F.col("w").alias("p")), "membership")
    started = requests.join(nodes.select(F.col("node_id").alias("center"), "membership"), "center")
    blocks = draw(started, rows, "membership", seed, *keys, cells=16, name="block").drop("membership").withColumnRenamed("block", "membership")
    inside = with_cdf(group_distribution(edges, nodes, exponent), "membership")
    return draw(blocks, inside, "membership", seed + 1, *keys, cells=256).withColumnRenamed("membership", "block")


def partial_propagation(edges: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """Block-factored propagation: ``g, node_id, p``, where a walk from block ``g`` is after ``steps`` steps.

    Powers are taken of the group-by-group table and spread over nodes by
    their share of the block's in-degree, so nothing N x N is built.
    """
    last = powers(block_transition(edges, nodes), steps)[-1]
    share = group_distribution(edges, nodes).select(F.col("membership").alias("dst"), "node_id", "p")
    return last.join(share, "dst").select(F.col("src").alias("g"), "node_id", (F.col("w") * F.col("p")).alias("p"))


# ------------------------------------------------------------ training samples


def triplets(pairs: DataFrame, noise: DataFrame, negative: int, seed: int, *keys: str) -> DataFrame:
    """``pairs`` (``center, context`` and keys) with ``k`` and ``negative``: so many noise nodes for each context."""
    asked = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(negative - 1))))
    return draw(asked, whole_cdf(noise), None, seed, *keys, "k", name="negative")


def with_base_pairs(rows: DataFrame, nodes: int, seed: int, *keys: str) -> DataFrame:
    """Triplets of the modularity objective: ``base_center, base_context`` are uniform over 0..nodes-1."""
    pick = lambda kind: F.floor(prng.uniform(seed, F.lit(kind), *keys) * nodes).cast("long")
    return rows.withColumn("base_center", pick("center")).withColumn("base_context", pick("context"))


def signed_pairs(pairs: DataFrame, noise: DataFrame, negative: int, seed: int, *keys: str) -> DataFrame:
    """``keys, center, context, y``: every pair with 1, and ``negative`` noise contexts for it with -1."""
    drawn = triplets(pairs, noise, negative, seed, *keys)
    plus = pairs.select(*keys, "center", "context", F.lit(1.0).alias("y"))
    return plus.unionByName(drawn.select(*keys, "center", F.col("negative").alias("context"), F.lit(-1.0).alias("y")))


def modularity_pairs(pairs: DataFrame, noise: DataFrame, nodes: int, negative: int, seed: int, *keys: str) -> DataFrame:
    """Signed pairs with ``power`` 1, and one uniform base pair for each pair with y -0.5 and power 2."""
    signed = signed_pairs(pairs, noise, negative, seed, *keys).withColumn("power", F.lit(1))
    base = with_base_pairs(pairs, nodes, seed, *keys)
    return signed.unionByName(base.select(*keys, F.col("base_center").alias("center"), F.col("base_context").alias("context"), F.lit(-0.5).alias("y"), F.lit(2).alias("power")))


def positive_pairs(items: DataFrame, lot: int = LOT) -> DataFrame:
    """All ``a < b`` with one label.

    A label's items are dealt to lots by their id, and each two lots meet in
    one tile, so a large label is the work of many tasks and no tile is large.
    Quadratic in rows; an item is copied once for each lot.
    """
    most, labels = items.groupBy("label").count().agg(F.max("count"), F.count(F.lit(1))).first()
    lots = -(-(most or 0) // lot) or 1
    tiles = labels * lots * (lots + 1) // 2
    n = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles // 8)
    dealt = items.select("node_id", "label", F.pmod(F.xxhash64("node_id"), F.lit(lots)).cast("int").alias("_own"))
    own, last = F.col("_own"), F.lit(lots - 1)
    a = dealt.select("label", F.col("node_id").alias("_a"), own.alias("_i"), F.explode(F.sequence(own, last)).alias("_j"))
    b = dealt.select("label", F.col("node_id").alias("_b"), F.explode(F.sequence(F.lit(0), own)).alias("_i"), own.alias("_j"))
    tile = ["label", "_i", "_j"]
    met = a.repartition(n, *tile).join(b.repartition(n, *tile), tile)
    met = met.filter((F.col("_a") < F.col("_b")) | ((F.col("_i") < F.col("_j")) & (F.col("_a") > F.col("_b"))))
    return met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def negative_groups(items: DataFrame) -> DataFrame:
    """(label, block) groups with the other labels of the block: ``block, label, other``."""
    g = items.select("block", "label").distinct()
    return g.join(g.withColumnRenamed("label", "other"), "block").filter("label <> other")


def negative_pairs(items: DataFrame) -> DataFrame:
    """All pairs of a block with different labels, a < b."""
    a = items.select(F.col("node_id").alias("a"), "block", F.col("label").alias("la"))
    b = items.select(F.col("node_id").alias("b"), "block", F.col("label").alias("lb"))
    return a.join(b, "block").filter("la <> lb AND a < b").select("a", "b")


def shuffled(nodes: DataFrame, seed: int) -> DataFrame:
    """A reproducible random order, as a sort key rather than a global sort."""
    return nodes.withColumn("position_key", prng.bits(seed, "node_id"))
