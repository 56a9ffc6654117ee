"""Sparse linear algebra on entry tables: every product is one join and one sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint
from .graph import row_probability


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B for two entry tables."""
    right = b.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("w").alias("v"))
    return a.select("src", F.col("dst").alias("mid"), "w").join(right, "mid").groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))


def multiply_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x for ``x(node_id, val)``; rows without entries are absent."""
    return a.join(x.select(F.col("node_id").alias("dst"), "val"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def multiply_block(a: DataFrame, x: DataFrame, d: int) -> DataFrame:
    """A X for ``x(node_id, vec)`` with vectors of length ``d``: the vector stays one array column."""
    joined = a.join(x.select(F.col("node_id").alias("dst"), "vec"), "dst")
    return joined.groupBy(F.col("src").alias("node_id")).agg(F.array(*(F.sum(F.col("w") * F.col("vec")[i]) for i in range(d))).alias("vec"))


def weighted_sum(tables: list[tuple[DataFrame, float]]) -> DataFrame:
    out = None
    for t, c in tables:
        part = t.select("src", "dst", (F.col("w") * c).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def powers(a: DataFrame, t: int, cut_every: int = 4) -> list[DataFrame]:
    out = [a]
    for k in range(1, t):
        nxt = multiply(out[-1], a)
        out.append(checkpoint(nxt) if k % cut_every == 0 else nxt)
    return out


def window_transition(edges: DataFrame, length: int) -> DataFrame:
    """(1/L) sum of P^t for t = 1..L, in Horner form: one product a step."""
    p = row_probability(edges).select("src", "dst", "w")
    total = p
    for _ in range(length - 1):
        total = weighted_sum([(multiply(total, p), 1.0), (p, 1.0)])
    return total.withColumn("w", F.col("w") / float(length))


def restart_walk(edges: DataFrame, restart: float, steps: int, offset: int = 0) -> DataFrame:
    """sum over i >= offset of w_i P^(i+1), w_i proportional to (1 - r)^i over all steps."""
    raw = [(1.0 - restart) ** i for i in range(steps)]
    weights = [v / sum(raw) for v in raw]
    ps = powers(row_probability(edges).select("src", "dst", "w"), steps)
    return weighted_sum([(ps[i], weights[i]) for i in range(offset, steps)])


def power_sum(a: DataFrame, t: int) -> DataFrame:
    return weighted_sum([(p, 1.0) for p in powers(a.select("src", "dst", "w"), t)])


def stationary(edges: DataFrame, steps: int) -> DataFrame:
    """Cesaro average of ``steps`` steps from the uniform distribution, normalised."""
    p = row_probability(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    x = nodes.crossJoin(F.broadcast(n)).select("node_id", (1.0 / F.col("n")).alias("val"))  # one row is broadcast
    total = None
    for _ in range(steps):
        x = multiply_vector(p, x)
        total = x if total is None else total.unionByName(x)
    summed = total.groupBy("node_id").agg(F.sum("val").alias("val"))
    whole = summed.agg(F.sum("val").alias("s"))
    return summed.crossJoin(F.broadcast(whole)).select("node_id", (F.col("val") / F.col("s")).alias("val"))


def modularity_power(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """Power iteration on A/2m - d d^T/(2m)^2 with unit vectors; two sums reach the driver in a step."""
    edges = checkpoint(edges)  # read in every step
    d = checkpoint(edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d")))
    m = float(d.agg(F.sum("d")).first()[0] or 1.0)
    x = start
    for _ in range(steps):
        dx = d.join(x, "node_id").agg(F.sum(F.col("d") * F.col("val"))).first()[0] or 0.0
        ax = multiply_vector(edges, x).withColumnRenamed("val", "ax")
        y = checkpoint(d.join(ax, "node_id").select("node_id", (F.col("ax") / m - F.col("d") * (dx / (m * m))).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        x = y.select("node_id", (F.col("y") / norm).alias("val"))
    return x


def gram(x: DataFrame, d: int, y: DataFrame | None = None) -> np.ndarray:
    """X^T Y (d x d) from ``(node_id, vec)``: d sums for each of d dimensions, the only data that reaches the driver."""
    pair = x.withColumn("other", F.col("vec")) if y is None else x.join(y.select("node_id", F.col("vec").alias("other")), "node_id")
    long = pair.select("other", F.posexplode("vec").alias("i", "x"))
    rows = long.groupBy("i").agg(F.array(*(F.sum(F.col("x") * F.col("other")[j]) for j in range(d))).alias("g")).collect()  # d rows
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"]] = r["g"]
    return out


def orthonormal(v: DataFrame, d: int) -> tuple[DataFrame, np.ndarray]:
    """(V M, eigenvalues of V^T V): M makes the columns orthonormal; directions that are missing become 0."""
    values, vectors = np.linalg.eigh(gram(v, d))
    scale = np.where(values > max(values[-1], 0.0) * 1e-14, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return rotate(v, vectors * scale), values


def rotate(x: DataFrame, matrix: np.ndarray) -> DataFrame:
    """X M for a small matrix on the driver."""
    cols = [sum((F.col("vec")[i] * float(matrix[i, j]) for i in range(1, matrix.shape[0])), F.col("vec")[0] * float(matrix[0, j])) for j in range(matrix.shape[1])]
    return x.select("node_id", F.array(*cols).alias("vec"))


def leading_eigenpairs(a: DataFrame, nodes: DataFrame, d: int, steps: int = 20, shift: float = 1.0, seed: int = 1, tolerance: float = 1e-10) -> tuple[np.ndarray, DataFrame]:
    """Largest eigenvalues of a symmetric matrix by block subspace iteration on A + shift I.

    Each step is one block product, then a d x d Gram matrix on the driver
    orthonormalises the block (eigendecomposition, so a rank-deficient block
    is harmless).  It stops when the Ritz values stay within the tolerance, or
    after ``steps``.  Rayleigh-Ritz gives values and vectors, largest first.
    """
    from ..functions import prng

    a = checkpoint(a)  # read in every step
    x = checkpoint(nodes.select("node_id", F.array(*(prng.uniform(seed, F.col("node_id"), F.lit(k)) - 0.5 for k in range(d))).alias("vec")))
    zero = F.array(*(F.lit(0.0) for _ in range(d)))

    def apply(v: DataFrame) -> DataFrame:
        out = v.join(multiply_block(a, v, d).withColumnRenamed("vec", "av"), "node_id", "left")
        return out.select("node_id", F.zip_with("vec", F.coalesce("av", zero), lambda s, t: s * shift + t).alias("vec"))

    last = None
    for _ in range(steps):
        x, values = orthonormal(checkpoint(apply(x)), d)  # a projection of a written table
        if last is not None and np.abs(values - last).max() <= tolerance * max(values[-1], 1e-300):
            break
        last = values
    x = checkpoint(x)
    g = gram(x, d, apply(x))
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-values)
    return values[order] - shift, rotate(x, vectors[:, order])


def randomized_svd(a: DataFrame, dim: int, oversampling: int = 10, power: int = 5, seed: int = 42) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Leading singular values and vectors of an entry table: (s, left ``node_id, vec``, right).

    A keyed random block is sent through A and A^T ``power`` times and
    orthonormalised; the small problem is a Gram matrix of the projection.
    """
    return factored_svd([[a]], dim, oversampling, power, seed)


def factored_svd(terms: list[list[DataFrame]], dim: int, oversampling: int = 10, power: int = 5, seed: int = 42) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The same for a sum of products of entry tables, of which only products with blocks are computed."""
    from ..functions import prng

    k = dim + oversampling
    terms = [[checkpoint(f.select("src", "dst", "w")) for f in t] for t in terms]
    back = [[f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") for f in reversed(t)] for t in terms]
    names = terms[0][-1].select(F.col("dst").alias("node_id")).distinct()
    for t in terms[1:]:
        names = names.union(t[-1].select("dst")).distinct()
    gauss = lambda j: F.sqrt(-2 * F.ln(1 - prng.uniform(seed, "node_id", F.lit(2 * j)))) * F.cos(2 * F.pi() * prng.uniform(seed, "node_id", F.lit(2 * j + 1)))
    x = checkpoint(names.select("node_id", F.array(*(gauss(j) for j in range(k))).alias("vec")))
    y = checkpoint(multiply_factors(terms, x, k))
    for _ in range(power):
        y, _ = orthonormal(y, k)
        z, _ = orthonormal(checkpoint(multiply_factors(back, y, k)), k)
        y = checkpoint(multiply_factors(terms, z, k))
    q, _ = orthonormal(y, k)
    q = checkpoint(q)
    z = checkpoint(multiply_factors(back, q, k))
    values, vectors = np.linalg.eigh(gram(z, k))
    order = np.argsort(-values)[:dim]
    s = np.sqrt(np.maximum(values[order], 0.0))
    inverse = np.where(s > max(s[0], 1e-300) * 1e-12, 1 / np.maximum(s, 1e-300), 0.0)
    return s, rotate(q, vectors[:, order]), rotate(z, vectors[:, order] * inverse)


def multiply_factors(terms: list[list[DataFrame]], x: DataFrame, d: int) -> DataFrame:
    """(sum of products) X: every product is applied to the block from its right end."""
    total = None
    for factors in terms:
        y = x
        for f in reversed(factors):
            y = multiply_block(f, y, d)
        total = y if total is None else total.unionByName(y)
    if len(terms) == 1:
        return total
    return total.groupBy("node_id").agg(F.array(*(F.sum(F.col("vec")[i]) for i in range(d))).alias("vec"))


def transposed(terms: list[list[DataFrame]]) -> list[list[DataFrame]]:
    """The transpose of a sum of products: every product reversed, every factor transposed."""
    return [[f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") for f in reversed(t)] for t in terms]


def assembled(terms: list[list[DataFrame]]) -> DataFrame:
    """The entry table of a sum of products."""
    out = []
    for factors in terms:
        product = factors[0]
        for f in factors[1:]:
            product = multiply(product, f)
        out.append((product, 1.0))
    return weighted_sum(out)


def spectrum_moments(a: DataFrame, most: int) -> DataFrame:
    """``k, moment``: tr(A^k) for k = 1..most, which is the sum of the k-th powers of the eigenvalues."""
    out = None
    for k, p in enumerate(powers(a.select("src", "dst", "w"), most), 1):
        part = p.filter("src = dst").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("moment")).select(F.lit(k).alias("k"), "moment")
        out = part if out is None else out.unionByName(part)
    return out


#: A matrix with more nodes is not taken apart as a whole.
DENSE_NODES = 4096


def dense_spectrum(a: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, eigenvalues, eigenvectors) of a symmetric matrix of at most :data:`DENSE_NODES` nodes, on the driver."""
    ids = [r[0] for r in a.select("src").union(a.select("dst")).distinct().orderBy("src").limit(DENSE_NODES + 1).collect()]
    if len(ids) > DENSE_NODES:
        raise ValueError(f"more than {DENSE_NODES} nodes: use leading_eigenpairs or spectrum_moments")
    at = {v: k for k, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in a.groupBy("src", "dst").agg(F.sum("w").alias("w")).collect():  # bounded by the check above
        m[at[r["src"]], at[r["dst"]]] = r["w"]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return np.array(ids), values, vectors


def matrix_function(a: DataFrame, f) -> DataFrame:
    """``src, dst, w`` of f(A) for a symmetric matrix of at most :data:`DENSE_NODES` nodes: f acts on the eigenvalues."""
    ids, values, vectors = dense_spectrum(a)
    m = (vectors * f(values)) @ vectors.T
    rows = a.sparkSession.createDataFrame([(int(i), m[k].tolist()) for k, i in enumerate(ids)], "src long, row array<double>")
    names = F.array(*(F.lit(int(i)) for i in ids))
    return rows.select("src", F.posexplode("row").alias("_j", "w")).select("src", names[F.col("_j")].alias("dst"), "w")


def raw_modularity_power(edges: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """Power iteration on A - d d^T / 2m, ``node_id, val``: unit vectors whose first node is not negative.

    It stops when no entry changes by 1 / 2m or more, or after ``most`` steps.
    """
    edges = checkpoint(edges.select("src", "dst", "w"))  # read in every step
    d = checkpoint(edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d")))
    m = float(d.agg(F.sum("d")).first()[0])
    x = checkpoint(start.select("node_id", "val"))
    for _ in range(most):
        dx = d.join(x, "node_id").agg(F.sum(F.col("d") * F.col("val"))).first()[0]
        ax = multiply_vector(edges, x).withColumnRenamed("val", "ax")
        y = checkpoint(d.join(ax, "node_id", "left").join(x, "node_id").select("node_id", F.col("val").alias("old"), (F.coalesce("ax", F.lit(0.0)) - F.col("d") * (dx / m)).alias("y")))
        row = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.min_by("y", "node_id").alias("first")).first()
        scale = (-1.0 if row["first"] < 0 else 1.0) / row["norm"]
        new = y.select("node_id", "old", (F.col("y") * scale).alias("val"))
        change = new.agg(F.max(F.abs(F.col("val") - F.col("old")))).first()[0]
        x = new.select("node_id", "val")
        if change < 1 / m:
            break
    return x


def ranked_values(values: DataFrame, order: str, k: int | None = None) -> DataFrame:
    """``values`` with ``rank`` from 1: ``descending``, ``magnitude`` or ``ascending`` value, ties by ``id``; the first ``k``."""
    key = {"descending": F.desc("value"), "magnitude": F.desc(F.abs("value")), "ascending": F.asc("value")}[order]
    out = values.withColumn("rank", F.row_number().over(Window.orderBy(key, "id")))  # as many rows as eigenvalues
    return out if k is None else out.filter(F.col("rank") <= k)


def top_k(df: DataFrame, by: str, score: str, k: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")
