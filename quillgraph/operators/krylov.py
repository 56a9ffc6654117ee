"""Leading eigenpairs of matrices that aren't symmetric: block Arnoldi steps with restarts, and plain powers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint
from .algebra import multiply_block


def _cross(t: DataFrame, left: str, right: str, m: int, k: int) -> np.ndarray:
    """L^T R (m x k) of two array columns: one sum for each entry reaches the driver."""
    long = t.select(F.posexplode(left).alias("i", "x"), F.col(right).alias("y"))
    out = np.zeros((m, k))
    for r in long.groupBy("i").agg(F.array(*(F.sum(F.col("x") * F.col("y")[j]) for j in range(k))).alias("g")).collect():  # m rows
        out[r["i"]] = r["g"]
    return out


def _times(column: str, matrix: np.ndarray) -> Column:
    """The row vector in ``column`` times a small matrix, which is one array literal: generated code doesn't grow with it."""
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in matrix.T))
    return F.transform(rows, lambda c: F.aggregate(F.zip_with(F.col(column), c, lambda p, q: p * q), F.lit(0.0), lambda total, v: total + v))


def _normal(gram: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(M, R) from X^T X: X M has orthonormal columns and X = (X M) R, without directions whose length is at most ``floor``."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > max(floor * floor, values[-1] * 1e-13)
    root = np.sqrt(values[good])
    return vectors[:, good] / root, root[:, None] * vectors[:, good].T


def _leading(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs by falling magnitude; of a complex pair the one above the real axis is first."""
    values, y = np.linalg.eig(h)
    values = np.where(np.abs(values.imag) <= 1e-12 * max(np.abs(values).max(), 1e-300), values.real, values)
    order = sorted(range(len(values)), key=lambda i: (-round(abs(values[i]), 10), -round(values[i].real, 10), -values[i].imag))
    return values[order], y[:, order]


def nonsymmetric_eigenpairs(
    a: DataFrame, nodes: DataFrame, d: int, block: int = 4, tolerance: float = 1e-4, restarts: int = 40, seed: int = 3
) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(values, ``node_id, re, im``, residuals) of the ``d`` eigenvalues of A largest in magnitude.

    The Krylov basis is a table with one array for each node.  A step
    multiplies the newest block by A, takes the basis out of it twice and
    appends it: one written product and three sums, whose results, as wide as
    the basis, are all that the driver holds.  The search ends when
    |A v - s v| <= tolerance |s| for each of the ``d`` pairs.  A basis of
    2 d columns and 12 blocks shrinks to the invariant space of the leading
    Ritz values (of a complex pair both) and grows again.  Vectors have
    length 1 and a phase that makes their real and imaginary parts
    orthogonal, the real one at least as long; the second of a complex pair
    is the conjugate of the first.  A basis that spans an invariant space
    ends the search, so there may be fewer than ``d`` pairs;
    an empty matrix has none.  After ``restarts`` without
    convergence it raises ``ArithmeticError``.
    """
    a = checkpoint(a.select("src", "dst", "w"))  # read in every step
    gauss = [F.sqrt(-2 * F.ln(1 - prng.uniform(seed, F.col("node_id"), F.lit(2 * j)))) * F.cos(2 * F.pi() * prng.uniform(seed, F.col("node_id"), F.lit(2 * j + 1))) for j in range(block)]
    t = checkpoint(nodes.select("node_id", F.array().cast("array<double>").alias("vec"), F.array(*gauss).alias("x")))
    if t.isEmpty():
        return np.zeros(0, complex), t.select("node_id", F.col("vec").alias("re"), F.col("vec").alias("im")), np.zeros(0)
    first, _ = _normal(_cross(t, "x", "x", block, block))
    t = t.withColumn("x", _times("x", first))
    m, k = 0, first.shape[1]  # columns of the basis and of the newest block
    h, r = np.zeros((0, 0)), np.zeros((k, 0))
    widest = 2 * d + 12 * block
    while k:
        product = multiply_block(a, t.select("node_id", F.col("x").alias("vec")), k).withColumnRenamed("vec", "ax")
        zero = F.array(*(F.lit(0.0) for _ in range(k)))
        m += k
        t = checkpoint(t.join(product, "node_id", "left").select("node_id", F.concat("vec", "x").alias("vec"), F.concat("vec", "x", F.coalesce("ax", zero)).alias("all")))
        t = t.withColumn("x", F.slice("all", m + 1, k))
        sums = _cross(t, "all", "x", m + k, k)
        c, size = sums[:m], np.sqrt(np.trace(sums[m:]))
        outside = np.vstack([-c, np.eye(k)])
        t = t.withColumn("x", _times("all", outside))
        scale, once = _normal(_cross(t, "x", "x", k, k), 1e-12 * size)
        whole, k = np.vstack([h, r]), scale.shape[1]
        last = np.zeros((0, c.shape[1]))
        if k:
            t = t.withColumn("x", _times("all", outside @ scale))
            sums = _cross(t.withColumn("both", F.concat("vec", "x")), "both", "x", m + k, k)
            again = sums[:m]  # as small as rounding
            scale2, twice = _normal(sums[m:] - again.T @ again)
            t = t.withColumn("x", _times("all", (outside @ scale - np.vstack([again, np.zeros((outside.shape[0] - m, k))])) @ scale2))
            c, last, k = c + again @ once, twice @ once, scale2.shape[1]
        h = np.hstack([whole, c])
        r = np.hstack([np.zeros((k, whole.shape[1])), last])
        values, y = _leading(h)
        wanted = min(d, m)
        residuals = np.linalg.norm(r @ y, axis=0)
        if not k or m >= d and (residuals[:wanted] <= tolerance * np.maximum(np.abs(values[:wanted]), 1e-12)).all():
            break
        if m < widest:
            continue
        if not restarts:
            raise ArithmeticError(f"residuals {residuals[:wanted]} are above the tolerance")
        restarts -= 1
        p = d + block
        if values[p - 1].imag > 0:  # the other one of the pair
            p += 1
        u, size, _ = np.linalg.svd(np.hstack([y[:, :p].real, y[:, :p].imag]), full_matrices=False)
        q = u[:, : int((size > 1e-10 * size[0]).sum())]
        t = t.withColumn("vec", _times("vec", q))
        h, r, m = q.T @ h @ q, r @ q, q.shape[1]
    return _vectors(t, values[:wanted], y[:, :wanted], residuals[:wanted])


def power_steps(a: DataFrame, start: DataFrame, steps: int, largest: Column | None = None, cut_every: int = 3) -> tuple[float, DataFrame]:
    """(growth, ``node_id, x``) of A^steps x for ``start(node_id, x)``, scaled to a largest entry of 1.

    Exactly so many steps, converged or not; ``growth`` is the factor of the
    last one.  ``largest`` says which rows are looked at for the largest entry
    (all by default).  A row that A doesn't give is 0.  The vector is written,
    and scaled by one number from the driver, every ``cut_every`` steps, and
    the matrix once, dealt out by its columns.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = checkpoint(a.select("src", "dst", "w").repartition(n, "dst"))
    seen = F.lit(True) if largest is None else largest
    top = lambda x: x.filter(seen).agg(F.max(F.abs("x"))).first()[0] or 0.0
    scaled = lambda x, by: x.select("node_id", (F.col("x") / (by or 1.0)).alias("x"))
    x, growth = checkpoint(start.select("node_id", F.col("x").cast("double").alias("x"))), 0.0
    for step in range(1, steps + 1):
        by = a.join(x.select(F.col("node_id").alias("dst"), "x"), "dst")
        x = by.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        if step % cut_every == 0 or step >= steps - 1:
            x = checkpoint(x)
            growth = top(x)
            x = scaled(x, growth)
    whole = start.select("node_id").join(x, "node_id", "left").select("node_id", F.coalesce("x", F.lit(0.0)).alias("x"))
    return growth, checkpoint(whole)


def _vectors(t: DataFrame, values: np.ndarray, y: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    y = y.astype(complex)
    for j in range(len(values)):
        if values[j].imag < 0 and j and np.isclose(values[j], np.conj(values[j - 1])):
            y[:, j] = np.conj(y[:, j - 1])
            continue
        y[:, j] *= np.exp(-0.5j * np.angle((y[:, j] ** 2).sum()))
        y[:, j] /= np.linalg.norm(y[:, j])
    return values, checkpoint(t.select("node_id", _times("vec", y.real).alias("re"), _times("vec", y.imag).alias("im"))), residuals
