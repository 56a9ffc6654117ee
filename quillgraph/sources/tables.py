"""Readers, writers, and the graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint

#: Line items a task of the graph of parts, so a task's memory does not grow with the table.
ROWS_A_TASK = 500_000
EDGE_SCHEMA = "src long, dst long, w double"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE_SCHEMA).parquet(path)


def read_edge_text(spark: SparkSession, path: str, one_based: bool = True, sep: str = "\t") -> DataFrame:
    """Header-less pairs of ids."""
    off = 1 if one_based else 0
    return spark.read.schema("a long, b long").option("sep", sep).csv(path).select((F.col("a") - off).alias("src"), (F.col("b") - off).alias("dst"), F.lit(1.0).alias("w"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_id long, membership int").option("header", True).csv(path)


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """Any table of links as ``src long, dst long, w double``: no weight counts as 1, true as 1, repeated entries add up, zeros go."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    out = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("w"))
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0")


def read_partitions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``node_id, membership`` of each variant of a partition bundle by its name."""
    bundle = spark.read.parquet(path)
    names = sorted(r[0] for r in bundle.select("variant").distinct().collect())  # one row for each variant
    return {v: bundle.filter(F.col("variant") == v).drop("variant") for v in names}


def write_edge_text(edges: DataFrame, path: str, one_based: bool = True) -> None:
    off = 1 if one_based else 0
    edges.select((F.col("src") + off).alias("a"), (F.col("dst") + off).alias("b")).write.mode("overwrite").option("sep", "\t").csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def write_embedding(vectors: DataFrame, path: str, **fields: object) -> None:
    for k, v in fields.items():
        vectors = vectors.withColumn(k, F.lit(v))
    vectors.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitions(partitions: DataFrame, path: str) -> None:
    partitions.write.mode("overwrite").partitionBy("variant").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def write_network(edges: DataFrame, nodes: DataFrame, params: dict[str, object], path: str) -> None:
    """Parquet edges, tab-separated communities and the parameters as JSON."""
    write_edges(edges, f"{path}/network")
    nodes.select("node_id", "membership").write.mode("overwrite").option("sep", "\t").csv(f"{path}/community")
    row = edges.sparkSession.createDataFrame([tuple(params.values())], list(params))
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/params")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation -> supplier nation, weight = number of line items; written once, one row for each pair of nations."""
    l, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    # both sides get their nations before they meet on the one large key, so what they are grouped by is small
    ordered = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    supplied = l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    joined = supplied.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    return checkpoint(joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("membership"))


def trade_top(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top partners of each nation, symmetrised, weight 1."""
    from ..operators.graph import symmetrize

    t = trade(spark, sf_dir).filter("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return symmetrize(t.withColumn("_r", rank).filter(F.col("_r") <= k))


def parts(spark: SparkSession, sf_dir: str, at_least: int = 2) -> DataFrame:
    """Parts that occur together in several orders, both directions, weight 1."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-l.count() // ROWS_A_TASK))  # the count comes from the files' footers
    l = l.repartition(n, "l_orderkey")
    pairs = l.withColumnRenamed("l_partkey", "src").join(l.withColumnRenamed("l_partkey", "dst"), "l_orderkey").filter("src < dst").select("src", "dst")
    often = pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= at_least)
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))  # src < dst, so none comes twice
    return often.select(F.explode(both).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("w"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the ordered event types as small numbers: ``user_id, path``."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr("cast(array_position(array('click','error','purchase','signup','view'), event_type) - 1 as long)").alias("k"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "k"))), lambda x: x["k"]).alias("path"))  # the events of one user
