"""Training objectives of the sampled embeddings, over long tables of scored pairs.

Positives are ``(center, context, score)`` and negatives ``(center, context,
negative, score)``; each function returns one row ``loss``.  An average over
centers weighs every center alike, whatever its number of contexts.  An empty
table gives a null loss; rows with a null score are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def log_sigmoid(x: Column) -> Column:
    """ln(1 / (1 + exp(-x))) without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def scored(pairs: DataFrame, inner: DataFrame, outer: DataFrame, target: str) -> DataFrame:
    """``score`` = inner vector of ``center`` times outer vector of ``target``; two equi-joins."""
    u = inner.select(F.col("node_id").alias("center"), F.col("vec").alias("_u"))
    v = outer.select(F.col("node_id").alias(target), F.col("vec").alias("_v"))
    return pairs.join(u, "center").join(v, target).select(*pairs.columns, V.dot("_u", "_v").alias("score"))


def _by_center(positives: DataFrame, negatives: DataFrame, near: Column, far: Column) -> DataFrame:
    """``center, o, n``: mean of ``near`` over contexts, and mean over contexts of the sum of ``far``."""
    o = positives.groupBy("center").agg(F.avg(near).alias("o"))
    n = negatives.groupBy("center", "context").agg(F.sum(far).alias("n")).groupBy("center").agg(F.avg("n").alias("n"))
    return o.join(n, "center")


def negative_sampling(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    score = F.col("score")
    return _by_center(positives, negatives, log_sigmoid(score), log_sigmoid(-score)).agg((-F.avg(F.col("o") + F.col("n"))).alias("loss"))


def modularity_triplet(positives: DataFrame, negatives: DataFrame, base: DataFrame, n_nodes: int) -> DataFrame:
    """Linear attraction and repulsion, and half the number of nodes times the mean squared score of ``base`` pairs."""
    score = F.col("score")
    linear = _by_center(positives, negatives, score, score).agg((F.avg("n") - F.avg("o")).alias("linear"))
    penalty = base.agg((0.5 * n_nodes * F.avg(score * score)).alias("penalty"))  # one row each
    return linear.crossJoin(penalty).select((F.col("linear") + F.col("penalty")).alias("loss"))


def laplacian_triplet(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    score = F.col("score")
    return _by_center(positives, negatives, score, -score).agg((-F.avg(F.col("o") - 0.5 * F.col("n") * F.col("n"))).alias("loss"))


def distance(metric: str, a: str, b: str) -> Column:
    """``euclidean``, ``cosine`` (1 - cosine), ``angular`` or ``dotsim`` (less the inner product)."""
    known = {"euclidean": V.euclidean, "cosine": lambda x, y: 1.0 - V.cosine(x, y), "angular": V.angular, "dotsim": lambda x, y: -V.dot(x, y)}
    return known[metric](a, b)


def pair_loss(pairs: DataFrame, metric: str = "dotsim", logistic: bool = True) -> DataFrame:
    """``pairs(u, v, y)`` with y = 1 for neighbours and -1 for noise."""
    part = -distance(metric, "u", "v") * F.col("y")
    return pairs.agg((-F.avg(log_sigmoid(part) if logistic else part)).alias("loss"))


def modularity_pair_loss(pairs: DataFrame, metric: str = "dotsim") -> DataFrame:
    """``pairs(u, v, y, pow)``: less the mean of y times a power of the closeness."""
    return pairs.agg((-F.avg(F.col("y") * F.pow(-distance(metric, "u", "v"), F.col("pow").cast("double")))).alias("loss"))
