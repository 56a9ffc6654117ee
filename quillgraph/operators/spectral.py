"""Theory operators: transition matrices in the log domain, moments, densities, loss landscapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..plans.lineage import checkpoint
from .algebra import window_transition
from .graph import block_matrix


def node2vec_matrix(edges: DataFrame, length: int) -> DataFrame:
    """ln(mean of P^t) - ln pi for reachable pairs (unreachable ones would be -inf and count as 0)."""
    p = window_transition(edges, length)
    d = edges.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("d"))
    m = edges.agg(F.sum("w").alias("m"))
    joined = p.join(d, "dst").crossJoin(F.broadcast(m))
    return joined.select("src", "dst", (F.ln("w") - F.ln(F.col("d") / F.col("m"))).alias("w"))


def floored_matrix(edges: DataFrame, length: int, floor: float = 1e-12) -> DataFrame:
    """ln of the mean of P^t, at least ``floor``, less ln pi, on reachable pairs; on others it is ln floor - ln pi(dst)."""
    p = window_transition(edges, length)
    d = edges.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("d"))
    m = edges.agg(F.sum("w").alias("m"))
    return p.join(d, "dst").crossJoin(F.broadcast(m)).select("src", "dst", (F.ln(F.greatest("w", F.lit(floor))) - F.ln(F.col("d") / F.col("m"))).alias("w"))


def pair_moments(spark: SparkSession, cin: float, cout: float, size: int, steps: int) -> DataFrame:
    """Two planted groups of ``size`` nodes: expected mean-of-powers entry within and between them and variance bounds, one row.

    The group transition matrix has eigenvalues 1 and (cin - cout) / (cin + cout), so its powers have a closed form.
    """
    n, degree = 2 * size, (cin + cout) / 2
    t = spark.range(1, steps + 1).select(F.pow(F.lit((cin - cout) / (cin + cout)), F.col("id").cast("double")).alias("lam"), F.pow(F.lit(degree), F.col("id").cast("double")).alias("scale"))
    within, between = 1.0 + F.col("lam"), 1.0 - F.col("lam")
    spread = lambda x: F.sum(x / F.col("scale")) / (n * steps * steps)
    return t.agg((F.avg(within) / n).alias("p_within"), (F.avg(between) / n).alias("p_between"), spread(within).alias("var_within"), spread(between).alias("var_between"))


def cut_condition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normalised-cut condition: smallest share ``within`` a group, largest ``between_`` (over the target's strength), ``holds``."""
    b = block_matrix(edges, nodes)
    strength = b.groupBy(F.col("g_src").alias("g_dst")).agg(F.sum("w").alias("s"))
    share = F.col("w") / F.col("s")
    inside = F.col("g_src") == F.col("g_dst")
    out = b.join(strength, "g_dst").agg(F.min(F.when(inside, share)).alias("within"), F.max(F.when(~inside, share)).alias("between_"))
    return out.withColumn("holds", F.col("within") > F.col("between_"))


def limit_matrix(edges: DataFrame, length: int) -> DataFrame:
    """2m (mean of P^t) D^-1 - 1 on reachable pairs."""
    p = window_transition(edges, length)
    d = edges.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("d"))
    m = edges.agg(F.sum("w").alias("m"))
    return p.join(d, "dst").crossJoin(F.broadcast(m)).select("src", "dst", (F.col("w") * F.col("m") / F.col("d") - 1.0).alias("w"))


def block_averages(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean entry within and between groups: ``same, mean, n``."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("membership").alias("g"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("membership").alias("h"))
    return matrix.join(a, "src").join(b, "dst").groupBy((F.col("g") == F.col("h")).cast("long").alias("same")).agg(F.avg("w").alias("mean"), F.count(F.lit(1)).alias("n"))


def semicircle(spark: SparkSession, c: float, points: int = 100) -> DataFrame:
    """Density 2 sqrt(r^2 - x^2) / (pi r^2) on a grid over [-r, r], r = 2 / sqrt(c): ``k, x, density``."""
    r = 2.0 / c**0.5
    grid = spark.range(points).select(F.col("id").alias("k"), (-r + 2 * r * F.col("id") / (points - 1)).alias("x"))
    return grid.select("k", "x", (2.0 * F.sqrt(F.greatest(F.lit(r * r) - F.col("x") * F.col("x"), F.lit(0.0))) / (F.pi() * r * r)).alias("density"))


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """Area below sorted points; for small tables such as a grid."""
    w = Window.orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    return df.select(part.alias("part")).agg(F.sum("part").alias("area"))


def _edge_dots(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    a = vectors.select(F.col("node_id").alias("src"), F.col("vec").alias("u"))
    b = vectors.select(F.col("node_id").alias("dst"), F.col("vec").alias("v"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "w", dot("u", "v").alias("uv"))


def _gram_square(vectors: DataFrame, d: int) -> DataFrame:
    """tr((X^T X)^2) as one row ``g``: the sum of squares of the d x d Gram sums."""
    long = vectors.select("vec", F.posexplode("vec").alias("i", "x"))
    rows = long.groupBy("i").agg(F.array(*(F.sum(F.col("x") * F.col("vec")[j]) for j in range(d))).alias("row"))
    return rows.agg(F.sum(dot("row", "row")).alias("g"))


def modularity_loss(edges: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """(-2 tr(X'AX - X'dd'X/2m) + tr((X'X)^2) + |B|^2) / (2m)^2 with B = A - dd'/2m: one row ``q``."""
    m = edges.agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("w")).alias("a2"))
    xax = _edge_dots(edges, vectors).agg(F.sum(F.col("w") * F.col("uv")).alias("xax"))
    deg = edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d"))
    dx = deg.join(vectors, "node_id").agg(*(F.sum(F.col("d") * F.col("vec")[i]).alias(f"x{i}") for i in range(d)))
    dx = dx.select(sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(1, d)), F.col("x0") * F.col("x0")).alias("xddx"))
    dd = deg.agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    a = edges.join(deg.select(F.col("node_id").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("node_id").alias("dst"), F.col("d").alias("dt")), "dst")
    cross = a.agg(F.sum(F.col("w") * F.col("ds") * F.col("dt")).alias("ad"))
    row = m.crossJoin(xax).crossJoin(dx).crossJoin(dd).crossJoin(cross).crossJoin(_gram_square(vectors, d))
    const = F.col("a2") - 2 * F.col("ad") / F.col("m") + F.col("d2") * F.col("d2") / (F.col("m") * F.col("m"))
    return row.select(((-2 * (F.col("xax") - F.col("xddx") / F.col("m")) + F.col("g") + const) / (F.col("m") * F.col("m"))).alias("q"))


def laplacian_loss(edges: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """sum(D^-1 A D^-1) - 2 tr(X' D^-1/2 A D^-1/2 X) + tr((X'X)^2): one row ``q``."""
    deg = edges.groupBy("src").agg(F.sum("w").alias("ds"))
    other = deg.select(F.col("src").alias("dst"), F.col("ds").alias("dt"))
    e = _edge_dots(edges, vectors).join(deg, "src").join(other, "dst")
    row = e.agg(F.sum(F.col("w") / (F.col("ds") * F.col("dt"))).alias("c"), F.sum(F.col("w") * F.col("uv") / F.sqrt(F.col("ds") * F.col("dt"))).alias("x"))
    return row.crossJoin(_gram_square(vectors, d)).select((F.col("c") - 2 * F.col("x") + F.col("g")).alias("q"))


def interpolate(start: DataFrame, end: DataFrame, x: float) -> DataFrame:
    """start + x (end - start)."""
    return start.join(end.select("node_id", F.col("vec").alias("_to")), "node_id").select("node_id", F.zip_with("vec", "_to", lambda a, b: a + x * (b - a)).alias("vec"))


# ------------------------------------------------------------ losses of mini-batches


def loss_samples(edges: DataFrame, batches: int, seed: int, nodes: int | None = None) -> DataFrame:
    """``batch, kind, a, b``: every edge (``edge``), for each a pair drawn by degree (``random``) and, with ``nodes``, a uniform one (``base``).

    Batches and draws are keyed by the edge.
    """
    from ..functions import prng
    from .sampling import draw, noise_distribution, whole_cdf

    edges = checkpoint(edges.select("src", "dst", "w"))  # every kind of samples reads it
    keyed = edges.select("src", "dst", (prng.bits(seed, F.lit("batch"), "src", "dst") % batches).alias("batch"))
    own = keyed.select("batch", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    cdf = checkpoint(whole_cdf(noise_distribution(edges)))
    drawn = draw(keyed, cdf, None, seed + 1, "src", "dst", name="a")
    drawn = draw(drawn, cdf, None, seed + 2, "src", "dst", name="b")
    out = own.unionByName(drawn.select("batch", F.lit("random").alias("kind"), "a", "b"))
    if nodes:
        pick = lambda k: F.floor(prng.uniform(seed + k, "src", "dst") * nodes).cast("long")
        out = out.unionByName(keyed.select("batch", F.lit("base").alias("kind"), pick(3).alias("a"), pick(4).alias("b")))
    return out


def batch_losses(samples: DataFrame, vectors: DataFrame, factors: dict[str, tuple[float, int]], d: int, constant: float = 0.0) -> DataFrame:
    """``batch, loss, gradient2``: the sum over kinds of factor * mean((x_a . x_b)^power), and the squared norm of its gradient."""
    x, y = (vectors.select(F.col("node_id").alias(n), F.col("vec").alias(v)) for n, v in (("a", "u"), ("b", "v")))
    samples = checkpoint(samples)
    sizes = samples.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("n"))
    factor, power = F.lit(0.0), F.lit(1)
    for kind, (f, p) in factors.items():
        factor, power = F.when(F.col("kind") == kind, float(f)).otherwise(factor), F.when(F.col("kind") == kind, p).otherwise(power)
    rows = samples.join(x, "a").join(y, "b").join(sizes, ["batch", "kind"]).withColumn("s", dot("u", "v"))
    rows = rows.select("batch", "a", "b", "u", "v", (factor / F.col("n") * F.pow("s", power.cast("double"))).alias("part"), (factor * power / F.col("n") * F.pow("s", (power - 1).cast("double"))).alias("c"))
    rows = checkpoint(rows)  # vectors are met once for the loss and both sides of the gradient
    loss = rows.groupBy("batch").agg((F.sum("part") + constant).alias("loss"))
    side = lambda node, other: rows.select("batch", F.col(node).alias("node_id"), "c", F.col(other).alias("x"))
    step = side("a", "v").unionByName(side("b", "u")).groupBy("batch", "node_id").agg(F.array(*(F.sum(F.col("c") * F.col("x")[i]) for i in range(d))).alias("g"))
    return loss.join(step.groupBy("batch").agg(F.sum(dot("g", "g")).alias("gradient2")), "batch")


def implicit_loss(loss: float, batches: DataFrame, epsilon: float) -> DataFrame:
    """One row ``q``: the loss plus epsilon / 4 times the mean squared gradient of the batches, what small steps add to it."""
    return batches.agg((F.lit(float(loss)) + epsilon / 4 * F.avg("gradient2")).alias("q"))


def degree_scaled(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Vectors times sqrt(2m / degree)."""
    deg = edges.groupBy(F.col("src").alias("node_id")).agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("d"))
    m = edges.agg(F.sum("w").alias("m"))
    joined = vectors.join(deg, "node_id").crossJoin(F.broadcast(m))  # one row is broadcast
    return joined.select("node_id", F.transform("vec", lambda x: x * F.sqrt(F.col("m") / F.col("d"))).alias("vec"))


def ensemble_moments(members: list[DataFrame]) -> DataFrame:
    """``src, dst, mean, var`` (population) of each entry over the tables; entries that are missing in some count as 0 there."""
    n = float(len(members))
    whole = members[0]
    for m in members[1:]:
        whole = whole.unionByName(m)
    out = whole.groupBy("src", "dst").agg((F.sum("w") / n).alias("mean"), (F.sum(F.col("w") * F.col("w")) / n).alias("square"))
    return out.select("src", "dst", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"))
