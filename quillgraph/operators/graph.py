"""Graph reshaping over edge tables ``(src, dst, w)`` with one row for each stored entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, weight 1."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back).distinct().withColumn("w", F.lit(1.0))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def upper_triangle(edges: DataFrame) -> DataFrame:
    return edges.filter("src <= dst")


def nonzero(edges: DataFrame) -> DataFrame:
    return edges.filter("w <> 0")


def coalesce_edges(edges: DataFrame, at_least: float | None = None) -> DataFrame:
    """Sum of the weights of repeated entries, dropping sums below ``at_least``."""
    out = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return out if at_least is None else out.filter(F.col("w") >= at_least)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degree, strength of each source."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node_id)``."""
    a, b = nodes.select(F.col("node_id").alias("src")), nodes.select(F.col("node_id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)


def row_probability(edges: DataFrame, guard: float = 1e-32) -> DataFrame:
    """Rows scaled to sum 1; rows of weight 0 stay 0."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.col("w") / F.greatest(total, F.lit(guard)))


def row_unit(edges: DataFrame, guard: float = 1e-32) -> DataFrame:
    total = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("src")))
    return edges.withColumn("w", F.col("w") / F.greatest(total, F.lit(guard)))


def symmetric_normalized(edges: DataFrame, guard: float = 1e-12) -> DataFrame:
    """w / sqrt(d_src d_dst) with both roots at least ``guard``."""
    d = edges.groupBy("src").agg(F.greatest(F.sqrt(F.sum("w")), F.lit(guard)).alias("d"))
    e = d.select(F.col("src").alias("dst"), F.col("d").alias("e"))
    return edges.join(d, "src").join(e, "dst").select("src", "dst", (F.col("w") / (F.col("d") * F.col("e"))).alias("w"))


def row_cdf(edges: DataFrame) -> DataFrame:
    """Running probability along each row in order of ``dst``; the last one is exactly 1."""
    by = Window.partitionBy("src")
    run = F.sum("w").over(by.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(by)
    last = F.row_number().over(by.orderBy("dst")) == F.count(F.lit(1)).over(by)
    return edges.select("src", "dst", F.when(last, 1.0).otherwise(run).alias("cdf"))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` from the first row to this one in the given order.

    Rows are dealt out by ranges of the order; a window adds up inside each
    range, and the totals of the ranges, one row each, are added up before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumn("_value", value)
    dealt = checkpoint(valued.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)  # one row a range


def reindex_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the dense rank of ``column`` from 0: the distinct values are numbered by ranges."""
    values = df.select(column).distinct()
    ranks = running_sum(values, [column], F.lit(1), name).withColumn(name, (F.col(name) - 1).cast("long"))
    return df.join(ranks, column)


def pair_number(a: Column, b: Column) -> Column:
    """Cantor number of an ordered pair, exact in BIGINT."""
    s = a + b
    return F.floor(s * (s + 1) / 2).cast("long") + b


def block_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weight between groups: ``g_src, g_dst, w``."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("membership").alias("g_src"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("membership").alias("g_dst"))
    return edges.join(a, "src").join(b, "dst").groupBy("g_src", "g_dst").agg(F.sum("w").alias("w"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node_id, component`` (smallest node of the component).

    Each round every node follows the smallest of its neighbours and itself,
    and only links between the nodes so chosen go on to the next round, of
    which there are fewer and fewer.  The smallest node of a component always
    stays.  Rounds are cut from their lineage in the shared folder.
    """
    links = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = None
    while True:
        chosen = links.groupBy(F.col("src").alias("node_id")).agg(F.least(F.min("dst"), F.col("src")).alias("component"))
        chosen = checkpoint(chosen)
        if labels is None:
            labels = chosen
        else:
            further = chosen.select(F.col("node_id").alias("component"), F.col("component").alias("further"))
            labels = checkpoint(labels.join(further, "component", "left").select("node_id", F.coalesce("further", "component").alias("component")))
        end = lambda name: chosen.select(F.col("node_id").alias(name), F.col("component").alias(f"{name}_to"))  # noqa: B023, E731
        moved = links.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"))
        links = checkpoint(moved.filter("src <> dst").distinct())
        if links.isEmpty():
            return labels


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; the lowest label wins ties."""
    labels = connected_components(edges)
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(best), "component", "left_semi").select("node_id")  # one row is broadcast


def project_to_component(edges: DataFrame) -> DataFrame:
    """The largest component with nodes renumbered from 0: ``src, dst, w``."""
    nodes = reindex_column(largest_component(edges), "node_id", "new_id")
    inner = induced(edges, nodes)
    a, b = nodes.select(F.col("node_id").alias("src"), F.col("new_id").alias("s")), nodes.select(F.col("node_id").alias("dst"), F.col("new_id").alias("d"))
    return inner.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def reexpand(nodes: DataFrame, result: DataFrame) -> DataFrame:
    """All nodes with their result; null outside the component."""
    return nodes.join(result, "node_id", "left")


def line_graph(edges: DataFrame, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """Second-order graph: (prev, cur) -> (cur, nxt) with the walk's bias.

    1/p for a return, 1 if prev also leads to nxt, else 1/q, times the weight
    of the second edge.
    """
    e1 = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    e2 = edges.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
    e3 = edges.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(1).alias("direct"))
    bias = F.when(F.col("nxt") == F.col("prev"), 1.0 / p).when(F.col("direct").isNotNull(), 1.0).otherwise(1.0 / q)
    return e1.join(e2, "cur").join(e3, ["prev", "nxt"], "left").select("prev", "cur", "nxt", (F.col("w") * bias).alias("w"))


def nonbacktracking_matrix(edges: DataFrame, n: int) -> DataFrame:
    """[[0, D - I], [-I, A]] as entries, the second half offset by ``n``."""
    d = edges.groupBy("src").agg(F.sum("w").alias("d"))
    top = d.select("src", (F.col("src") + n).alias("dst"), (F.col("d") - 1.0).alias("w"))
    left = d.select((F.col("src") + n).alias("src"), F.col("src").alias("dst"), F.lit(-1.0).alias("w"))
    right = edges.select((F.col("src") + n).alias("src"), (F.col("dst") + n).alias("dst"), "w")
    return top.unionByName(left).unionByName(right).filter("w <> 0")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
