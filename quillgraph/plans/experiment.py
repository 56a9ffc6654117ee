"""The whole experiment as one plan: generate, embed, cluster, score, collect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import kmeans, voronoi
from ..operators.embeddings import PRESETS
from ..operators.graph import induced, largest_component
from ..operators.metrics import contingency, element_similarity, mutual_information
from ..sources.generators import mixing_degrees, planted_partition


def score_network(edges: DataFrame, nodes: DataFrame, model: str, dim: int, clustering: str = "voronoi", metric: str = "cosine") -> DataFrame:
    """``score_type, score`` of one model on one network, embedded on its largest component."""
    inner = induced(edges, largest_component(edges))
    vectors = PRESETS[model]().fit(inner).transform(dim).join(nodes, "node_id")
    if clustering == "voronoi":
        labels = voronoi(vectors, "membership", dim, metric).select("membership", "p")
    else:
        k = nodes.select("membership").distinct().count()
        labels = kmeans(vectors, k).join(nodes, "node_id").select("membership", "p")
    cells = contingency(labels, "membership", "p")
    nmi = mutual_information(cells).select(F.lit("nmi").alias("score_type"), F.col("nmi").alias("score"))
    return nmi.unionByName(element_similarity(cells).select(F.lit("esim").alias("score_type"), F.col("esim").alias("score")))


def run_grid(spark: SparkSession, n: int, q: int, cave: float, mus: Sequence[float], models: Sequence[str], dim: int, samples: int = 1, extra: Mapping[str, object] | None = None) -> DataFrame:
    """Result table over a grid; each network is one independent plan."""
    out = None
    for mu in mus:
        for sample in range(samples):
            edges, nodes = planted_partition(spark, n, q, *mixing_degrees(cave, mu, q), seed=sample + 1)
            for model in models:
                row = score_network(edges, nodes, model, dim)
                params = {"n": n, "q": q, "cave": cave, "mu": mu, "sample": sample, "name": model, "dim": dim} | dict(extra or {})
                row = row.select("*", *(F.lit(v).alias(k) for k, v in params.items()))
                out = row if out is None else out.unionByName(row)
    return out
