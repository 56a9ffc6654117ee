"""Node embeddings: ``model.fit(edges).transform(dim)`` gives ``node_id, vec``.

The result for a dimension is kept until another dimension is asked for.
Spectral models iterate block products on executors; only d x d matrices reach
the driver.  Learned models train on walks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint
from . import strata
from .algebra import gram, leading_eigenpairs, multiply_block, orthonormal, rotate
from .graph import nodes_of, row_probability, symmetric_normalized
from .huffman import huffman_codes
from .sampling import noise_distribution
from .walks import context_pairs, simulate, uniform_walks


class NodeEmbedding:
    """Base: subclasses set ``in_vec`` and ``out_vec`` in :meth:`update`."""

    def __init__(self) -> None:
        self.edges: DataFrame | None = None
        self.in_vec: DataFrame | None = None
        self.out_vec: DataFrame | None = None
        self.dim: int | None = None

    def fit(self, edges: DataFrame) -> NodeEmbedding:
        self.edges, self.dim = edges.select("src", "dst", "w"), None
        return self

    def transform(self, dim: int, return_out_vector: bool = False) -> DataFrame:
        if self.dim != dim:
            self.update(dim)
            self.dim = dim
        return self.out_vec if return_out_vector else self.in_vec

    def update(self, dim: int) -> None:
        raise NotImplementedError


def _scaled(vectors: DataFrame, factors: np.ndarray) -> DataFrame:
    return rotate(vectors, np.diag(factors))


def _chosen(vectors: DataFrame, values: np.ndarray, take: list[int]) -> tuple[np.ndarray, DataFrame]:
    return values[take], vectors.select("node_id", F.array(*(F.col("vec")[int(k)] for k in take)).alias("vec"))


class LaplacianEigenMap(NodeEmbedding):
    """Leading eigenvectors of D^-1/2 A D^-1/2 without the first; in = D^-1/2 u sqrt|s|, out = u."""

    def update(self, dim: int) -> None:
        values, u = leading_eigenpairs(symmetric_normalized(self.edges), nodes_of(self.edges), dim + 1)
        s, u = _chosen(u, values, list(range(1, dim + 1)))
        self.out_vec = checkpoint(u)
        d = self.edges.groupBy(F.col("src").alias("node_id")).agg(F.greatest(F.sqrt(F.sum("w")), F.lit(1e-12)).alias("root"))
        scaled = _scaled(self.out_vec, np.sqrt(np.abs(s)))
        self.in_vec = checkpoint(scaled.join(d, "node_id").select("node_id", F.transform("vec", lambda x: x / F.col("root")).alias("vec")))


class AdjacencySpectral(NodeEmbedding):
    """Truncated decomposition of A by magnitude; in = (U S) S, as the reference scales twice."""

    def update(self, dim: int) -> None:
        nodes = nodes_of(self.edges)
        values, u = leading_eigenpairs(self.edges, nodes, min(2 * dim, dim + 8), shift=0.0)
        take = list(np.argsort(-np.abs(values), kind="stable")[:dim])
        s, u = _chosen(u, values, take)
        self.out_vec = checkpoint(u)
        self.in_vec = checkpoint(_scaled(u, np.abs(s) ** 2))


class ModularitySpectral(NodeEmbedding):
    """Eigenvectors of A without the leading one, scaled by sqrt|s|."""

    def update(self, dim: int) -> None:
        shift = float(self.edges.groupBy("src").agg(F.sum("w").alias("d")).agg(F.max("d")).first()[0])
        values, u = leading_eigenpairs(self.edges, nodes_of(self.edges), dim + 1, shift=shift)
        s, u = _chosen(u, values, list(range(1, dim + 1)))
        self.out_vec = checkpoint(u)
        self.in_vec = checkpoint(_scaled(u, np.sqrt(np.abs(s))))


class LinearizedNode2Vec(NodeEmbedding):
    """Eigenpairs of D^-1/2 A D^-1/2 through the kernel s (1 - s^T) / (T (1 - s))."""

    def __init__(self, window_length: int = 10) -> None:
        super().__init__()
        self.window_length = window_length

    def update(self, dim: int) -> None:
        values, u = leading_eigenpairs(symmetric_normalized(self.edges, guard=1.0), nodes_of(self.edges), dim + 1)
        take = [k for k in range(dim + 1) if abs(values[k]) < np.abs(values).max() - 1e-9][:dim]
        s, u = _chosen(u, values, take)
        t = self.window_length
        if t > 1:
            s = s * (1 - s**t) / (t * (1 - s))
        self.out_vec = checkpoint(u)
        self.in_vec = checkpoint(_scaled(u, np.sqrt(np.abs(s))))


class MatrixFactorization(NodeEmbedding):
    """Factors the dense node2vec matrix ln(mean P^t / pi); for graphs whose square fits the cluster."""

    def __init__(self, window_length: int = 10) -> None:
        super().__init__()
        self.window_length = window_length

    def update(self, dim: int) -> None:
        from .spectral import node2vec_matrix

        r = checkpoint(node2vec_matrix(self.edges, self.window_length))
        back = r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        sym = checkpoint(r.unionByName(back).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")))  # symmetric up to rounding for undirected graphs
        values, u = leading_eigenpairs(sym, nodes_of(self.edges), dim + 1, shift=0.0)
        take = list(np.argsort(-np.abs(values), kind="stable")[: dim + 1])
        s, u = _chosen(u, values, take)
        self.out_vec = checkpoint(u)
        self.in_vec = checkpoint(_scaled(u, np.abs(s) ** 1.5))


class HighOrderModularity(NodeEmbedding):
    """Eigenpairs of sum over t < T of diag(pi / T) P P^t - pi pi^T as composed products; nothing N x N is built."""

    def __init__(self, window_length: int = 5) -> None:
        super().__init__()
        self.window_length = window_length

    def update(self, dim: int) -> None:
        t = self.window_length
        p = checkpoint(row_probability(self.edges).select("src", "dst", "w"))
        m = float(self.edges.agg(F.sum("w")).first()[0])
        pi = checkpoint(self.edges.groupBy(F.col("src").alias("node_id")).agg((F.sum("w") / m).alias("pi")))
        d = dim

        def apply(x: DataFrame) -> DataFrame:
            total, y = None, x
            for _ in range(t):
                y = checkpoint(multiply_block(p, y, d))
                total = y if total is None else total.unionByName(y)
            mean = total.groupBy("node_id").agg(F.array(*(F.sum(F.col("vec")[i]) / t for i in range(d))).alias("vec"))
            dots = x.join(pi, "node_id").agg(*(F.sum(F.col("pi") * F.col("vec")[i]).alias(f"c{i}") for i in range(d)))
            return mean.join(pi, "node_id").crossJoin(F.broadcast(dots)).select("node_id", F.array(*(F.col("pi") * (F.col("vec")[i] - F.col(f"c{i}")) for i in range(d))).alias("vec"))

        x = checkpoint(nodes_of(self.edges).select("node_id", F.array(*(prng.uniform(7, F.col("node_id"), F.lit(k)) - 0.5 for k in range(d))).alias("vec")))
        for _ in range(8):
            x, _ = orthonormal(checkpoint(apply(x)), d)
        s, v = np.linalg.eigh((g := gram(x, d, apply(x)))[:] / 2 + g.T / 2)
        order = np.argsort(-np.abs(s))
        self.out_vec = checkpoint(rotate(x, v[:, order]))
        self.in_vec = checkpoint(_scaled(self.out_vec, s[order]))


class DeflatedModularity(NodeEmbedding):
    """Eigenpairs of A/2m - d d^T/(2m)^2, largest by magnitude first; in = u sqrt|s|, out = u.

    One block of ``dim`` and a few more vectors is iterated together; the
    rank-one part is a sum over nodes, so nothing N x N is built.
    """

    def __init__(self, steps: int = 20, more: int = 4) -> None:
        super().__init__()
        self.steps, self.more = steps, more

    def update(self, dim: int) -> None:
        k = dim + self.more
        edges = checkpoint(self.edges)  # read in every step
        m = float(edges.agg(F.sum("w")).first()[0] or 1.0)
        share = checkpoint(edges.groupBy(F.col("src").alias("node_id")).agg((F.sum("w") / m).alias("share")))

        def apply(x: DataFrame) -> DataFrame:
            dots = x.join(share, "node_id").agg(*(F.sum(F.col("share") * F.col("vec")[i]).alias(f"c{i}") for i in range(k)))
            ax = multiply_block(edges, x, k).join(share, "node_id").crossJoin(F.broadcast(dots))  # one row of sums
            return ax.select("node_id", F.array(*(F.col("vec")[i] / m - F.col("share") * F.col(f"c{i}") for i in range(k))).alias("vec"))

        x = checkpoint(nodes_of(edges).select("node_id", F.array(*(prng.uniform(11, F.col("node_id"), F.lit(i)) - 0.5 for i in range(k))).alias("vec")))
        last = None
        for _ in range(self.steps):
            x, values = orthonormal(checkpoint(apply(x)), k)
            if last is not None and np.abs(values - last).max() <= 1e-10 * values[-1]:
                break
            last = values
        x = checkpoint(x)
        g = gram(x, k, apply(x))
        s, v = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(-np.abs(s))[:dim]
        self.values = s[order]
        self.out_vec = checkpoint(rotate(x, v[:, order]))
        self.in_vec = checkpoint(_scaled(self.out_vec, np.sqrt(np.abs(self.values))))


class NonBacktracking(NodeEmbedding):
    """Eigenvectors of the companion matrix of non-backtracking walks, lower half, columns of length 1.

    The ``dim`` eigenvalues s largest in magnitude, by falling |Re s|, columns
    times sqrt|Re s|.  A complex pair gives the real and the imaginary part of
    its first vector, so the columns span what the pair spans.  With
    ``auto_dim`` the dimension asked for is left aside: of the first
    min(10 sqrt(n), n - 1) + 1 eigenvalues those above the whole part of the
    mean degree in magnitude stay, ascending, without the first and without
    the factor; pairs are computed until one falls below, never all of them.
    """

    def __init__(self, auto_dim: bool = False, tolerance: float = 1e-4) -> None:
        super().__init__()
        self.auto_dim, self.tolerance = auto_dim, tolerance

    def update(self, dim: int) -> None:
        from .graph import nonbacktracking_matrix
        from .krylov import nonsymmetric_eigenpairs

        n = int(self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]) + 1
        b = checkpoint(nonbacktracking_matrix(self.edges, n))
        half = self.edges.sparkSession.range(n).select(F.col("id").alias("node_id"))
        nodes = half.unionByName(half.select((F.col("node_id") + n).alias("node_id")))
        if not self.auto_dim:
            s, v, _ = nonsymmetric_eigenpairs(b, nodes, dim, tolerance=self.tolerance)
            order = sorted(range(len(s)), key=lambda i: -round(abs(s[i].real), 10))
        else:
            mean = int(float(self.edges.agg(F.sum("w")).first()[0]) / n)
            most = min(int(10 * np.sqrt(n)), n - 1) + 1
            ask = min(8, most)
            s, v, _ = nonsymmetric_eigenpairs(b, nodes, ask, tolerance=self.tolerance)
            while len(s) == ask < most and abs(s[-1]) > mean:
                ask = min(2 * ask, most)
                s, v, _ = nonsymmetric_eigenpairs(b, nodes, ask, tolerance=self.tolerance)
            order = sorted(np.flatnonzero(np.abs(s) > mean), key=lambda i: (s[i].real, s[i].imag))[1:]
        part = [F.col("im" if s[i].imag < 0 else "re")[int(i)] for i in order]
        low = v.filter(F.col("node_id") >= n).select((F.col("node_id") - n).alias("node_id"), F.array(*part).cast("array<double>").alias("vec"))
        if not order:
            self.in_vec = self.out_vec = low
            return
        norms = np.sqrt(np.maximum(np.diag(gram(low, len(order))), 1e-300))
        self.values = s[order]
        self.out_vec = checkpoint(_scaled(low, 1 / norms))
        self.in_vec = self.out_vec if self.auto_dim else checkpoint(_scaled(self.out_vec, np.sqrt(np.abs(self.values.real))))


class FastRP(NodeEmbedding):
    """Sparse random projection with ``window`` propagation steps; signs come from keyed numbers."""

    def __init__(self, window_length: int = 3, beta: float = -0.5, sparsity: int = 3, seed: int = 5) -> None:
        super().__init__()
        self.window_length, self.beta, self.sparsity, self.seed = window_length, beta, sparsity, seed

    def update(self, dim: int) -> None:
        p = row_probability(self.edges).select("src", "dst", "w")
        d = self.edges.groupBy(F.col("dst").alias("node_id")).agg(F.sum("w").alias("d"))
        h = [prng.bits(self.seed, F.col("node_id"), F.lit(k)) % (2 * self.sparsity) for k in range(dim)]
        root = float(np.sqrt(self.sparsity))
        signs = F.array(*(F.when(x == 0, root).when(x == 1, -root).otherwise(0.0) for x in h))
        start = nodes_of(self.edges).join(d, "node_id", "left").withColumn("f", F.pow(F.coalesce("d", F.lit(1.0)).cast("double"), F.lit(self.beta)))
        start = start.select("node_id", F.transform(signs, lambda x: x * F.col("f")).alias("vec"))
        x0 = checkpoint(multiply_block(p, start, dim))
        x = x0
        for _ in range(self.window_length):
            nxt = multiply_block(p, x, dim).withColumnRenamed("vec", "px")
            x = checkpoint(x0.join(nxt, "node_id", "left").select("node_id", F.zip_with("vec", F.coalesce("px", F.array_repeat(F.lit(0.0), dim)), lambda a, b: a + b).alias("vec")))
        self.in_vec = checkpoint(x.select("node_id", F.transform("vec", lambda v: v / float(self.window_length + 1)).alias("vec")))
        self.out_vec = self.in_vec


class Word2VecEmbedding(NodeEmbedding):
    """Walks and skip-gram with hierarchical softmax, the built-in Word2Vec; it has no second table, so out = in."""

    def __init__(self, walk_length: int = 80, num_walks: int = 10, window_length: int = 10, epochs: int = 1, seed: int = 1) -> None:
        super().__init__()
        self.walk_length, self.num_walks, self.window_length, self.epochs, self.seed = walk_length, num_walks, window_length, epochs, seed

    def update(self, dim: int) -> None:
        from pyspark.ml.feature import Word2Vec
        from pyspark.ml.functions import vector_to_array

        walks = uniform_walks(self.edges, self.walk_length, self.num_walks, self.seed)
        data = checkpoint(walks.select(F.col("path").cast("array<string>").alias("sentence")))
        parts = self.edges.sparkSession.sparkContext.defaultParallelism
        model = Word2Vec(vectorSize=dim, windowSize=self.window_length, minCount=0, maxIter=self.epochs, seed=self.seed, inputCol="sentence", outputCol="v", numPartitions=parts).fit(data)
        self.in_vec = model.getVectors().select(F.col("word").cast("long").alias("node_id"), vector_to_array("vector").alias("vec"))
        self.out_vec = self.in_vec


#: Tables of a bag of words with more nodes are not sent to tasks.
MAX_TABLE_NODES = 2_000_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pair_steps(loss: str, u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, base: tuple[np.ndarray, np.ndarray], nodes: int, weight: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Gradients of one batch as (table, rows, values): centres ``a``, contexts ``b``, noise ``k``, each pair counted ``weight`` times."""
    pos, neg = np.einsum("id,id->i", u[a], v[b]), np.einsum("id,ikd->ik", u[a], v[k])
    if loss == "node2vec":
        gp, gn = _sigmoid(pos) - 1, _sigmoid(neg)
    elif loss == "modularity":  # linear in both; the squared term is that of the base pairs
        gp, gn = -np.ones_like(pos), np.ones_like(neg)
    else:  # laplacian: half the square of the summed noise products
        gp, gn = -np.ones_like(pos), np.repeat(neg.sum(axis=1, keepdims=True), neg.shape[1], axis=1)
    gp, gn = gp * weight, gn * weight[:, None]
    out = [(0, a, gp[:, None] * v[b] + np.einsum("ik,ikd->id", gn, v[k])), (1, b, gp[:, None] * u[a]), (1, k.ravel(), (gn[:, :, None] * u[a][:, None, :]).reshape(-1, u.shape[1]))]
    if loss == "modularity":
        c, d = base
        g = nodes * (weight * np.einsum("id,id->i", u[c], v[d]))[:, None]
        out += [(0, c, g * v[d]), (1, d, g * u[c])]
    return out


def _bag_steps(u: np.ndarray, v: np.ndarray, inner: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray, points: np.ndarray, code: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The mean of the contexts ``b`` (-1: none), from the first table, against the centre ``a`` and noise ``k`` in the second and,
    in the third, against the inner nodes ``points[a]`` (-1: none) with the sides ``code[a]``."""
    dim = u.shape[1]
    there = (b >= 0)[:, :, None]
    count = np.maximum(there.sum(axis=1), 1)
    h = (u[b] * there).sum(axis=1) / count
    gp = _sigmoid(np.einsum("id,id->i", h, v[a])) - 1
    gn = _sigmoid(np.einsum("id,ikd->ik", h, v[k]))
    gh = gp[:, None] * v[a] + np.einsum("ik,ikd->id", gn, v[k])
    out = [(1, a, gp[:, None] * h), (1, k.ravel(), (gn[:, :, None] * h[:, None, :]).reshape(-1, dim))]
    way = points[a]
    on = way >= 0
    if on.any():
        gi = (_sigmoid(np.einsum("id,ild->il", h, inner[way])) - (1 - code[a])) * on
        gh = gh + np.einsum("il,ild->id", gi, inner[way])
        out.append((2, way[on], (gi[:, :, None] * h[:, None, :])[on]))
    return [(0, b[b >= 0], np.repeat(gh / count, (b >= 0).sum(axis=1), axis=0)), *out]


class SampledEmbedding(NodeEmbedding):
    """Gradient training on (center, context, noise) samples of walks.

    ``loss``: ``node2vec`` (skip-gram with negative sampling), ``cbow`` (mean of
    the contexts, negative sampling and, with ``hierarchical``, a softmax over
    the Huffman tree of the visits as well), ``modularity`` (linear terms, and
    half the number of nodes times the mean square of uniform base pairs) or
    ``laplacian``.  The first table gives in-vectors, the second out-vectors.

    Losses of pairs train on tables kept in ``parts`` blocks (:mod:`strata`),
    whatever the number of nodes.  A bag of words needs all its contexts at
    once: there every partition updates its own copy of the tables, which are
    averaged by the number of samples, and beyond :data:`MAX_TABLE_NODES` nodes
    a ValueError names the other models.  ``noise_sampler`` gives
    ``node_id, p`` from the edges, by default the in-degrees.  With a
    ``folder``, training of pairs resumes there (:func:`strata.train`).
    """

    def __init__(
        self,
        loss: str = "node2vec",
        walk_length: int = 40,
        num_walks: int = 5,
        window_length: int = 5,
        negative: int = 5,
        epochs: int = 3,
        rate: float = 0.1,
        parts: int | None = None,
        seed: int = 1,
        p: float = 1.0,
        q: float = 1.0,
        backtrack: bool = True,
        hierarchical: bool = False,
        noise_sampler: Callable[[DataFrame], DataFrame] = noise_distribution,
        folder: str | None = None,
    ) -> None:
        super().__init__()
        if loss not in ("node2vec", "cbow", "modularity", "laplacian"):
            raise ValueError(loss)
        if hierarchical and loss != "cbow":
            raise ValueError("a hierarchical softmax goes with the bag of words")
        self.loss, self.walk_length, self.num_walks, self.window_length = loss, walk_length, num_walks, window_length
        self.negative, self.epochs, self.rate, self.parts, self.seed = negative, epochs, rate, parts, seed
        self.p, self.q, self.backtrack, self.hierarchical, self.noise_sampler, self.folder = p, q, backtrack, hierarchical, noise_sampler, folder

    def fit(self, edges: DataFrame) -> NodeEmbedding:
        return super().fit(checkpoint(edges.select("src", "dst", "w")))  # walks, noise and weights read it

    def walks(self) -> DataFrame:
        if not self.backtrack:
            return uniform_walks(self.edges, self.walk_length, self.num_walks, self.seed, backtrack=False)
        return simulate(self.edges, self.walk_length, self.num_walks, self.p, self.q, self.seed)

    def samples(self) -> DataFrame:
        """``center, context``: one context, or for ``cbow`` all of a position as one string of ids."""
        pairs = context_pairs(self.walks(), ["start", "round"], self.window_length)
        if self.loss != "cbow":
            return pairs.select("center", "context")
        together = pairs.groupBy("start", "round", "pos", "center").agg(F.array_join(F.array_sort(F.collect_list(F.col("context").cast("string"))), ",").alias("context"))  # twice the window
        return together.select("start", "round", "pos", "center", "context")

    def noise(self) -> DataFrame:
        """``node_id, p`` of all nodes."""
        law = self.noise_sampler(self.edges).select("node_id", "p")
        return nodes_of(self.edges).join(law, "node_id", "left").select("node_id", F.coalesce("p", F.lit(0.0)).alias("p"))

    def update(self, dim: int) -> None:
        if self.loss == "cbow":
            self._update_bags(dim)
        else:
            step = partial(_pair_steps, self.loss)
            self.in_vec, self.out_vec = strata.train(self.samples(), self.noise(), dim, step, self.epochs, self.negative, self.rate, self.parts, seed=self.seed, folder=self.folder and f"{self.folder}/{dim}")

    def _update_bags(self, dim: int) -> None:
        law = checkpoint(self.noise())
        if (n := law.count()) > MAX_TABLE_NODES:
            raise ValueError(f"{n} nodes: the tables of a bag of words are sent to tasks; use a loss of pairs or a spectral model")
        parts = self.parts or 8
        # Written in a random order: the steps of a batch add up, so one walk must not fill it.
        mixed = F.xxhash64(F.lit(self.seed), "start", "round", "pos")
        samples = checkpoint(self.samples().withColumn("key", mixed).repartition(parts, "center").sortWithinPartitions("key", "start", "round", "pos").select("key", "center", "context"))
        rows = law.orderBy("node_id").toPandas()  # bounded by the check above
        ids, share = rows["node_id"].to_numpy(), rows["p"].to_numpy()
        points, code = self._tree(samples, ids)
        rng = np.random.default_rng(self.seed)
        tables = [(rng.random((n, dim)) - 0.5) / dim, (rng.random((n, dim)) - 0.5) / dim, np.zeros((n, dim))]
        negative, rate, seed = self.negative, self.rate, self.seed

        for epoch in range(self.epochs):
            sent = self.edges.sparkSession.sparkContext.broadcast((ids, share, points, code, *tables))

            def train(frames: Iterator[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
                ids, share, points, code, *own = sent.value
                own = [t.copy() for t in own]
                squares = [np.zeros(len(ids)) for _ in own]
                seen, total = np.zeros(len(ids)), 0
                cdf = np.cumsum(share)
                for frame in frames:
                    if not len(frame):
                        continue
                    r = np.random.default_rng([seed, epoch, int(frame["key"].iloc[0]) & 0x7FFFFFFFFFFFFFFF])
                    c = np.searchsorted(ids, frame["center"].to_numpy())
                    lists = [np.searchsorted(ids, np.array(x.split(","), dtype=np.int64)) for x in frame["context"]]
                    o = np.full((len(c), max(map(len, lists), default=1)), -1)
                    for i, x in enumerate(lists):
                        o[i, : len(x)] = x
                    for at in range(0, len(c), 256):
                        a, b = c[at : at + 256], o[at : at + 256]
                        k = np.minimum(np.searchsorted(cdf, r.random((len(a), negative)) * cdf[-1], side="right"), len(ids) - 1)
                        steps = _bag_steps(*own, a, b, k, points, code)
                        for table in range(3):
                            if mine := [s[1:] for s in steps if s[0] == table]:
                                strata.descend(own[table], squares[table], mine, rate)
                    total += len(c)
                    np.add.at(seen, c, 1)
                if total:
                    yield pd.DataFrame({"i": np.arange(len(ids)), "n": seen, "t": float(total), "u": list(own[0]), "v": list(own[1]), "s": list(own[2])})

            out = samples.mapInPandas(train, "i long, n double, t double, u array<double>, v array<double>, s array<double>")
            mean = lambda name, w: [(F.sum(F.col(w) * F.col(name)[j]) / F.sum(w)).alias(f"{name}{j}") for j in range(dim)]
            rows = out.withColumn("own", F.col("n") + 1e-9).groupBy("i").agg(*mean("u", "own"), *mean("v", "t"), *mean("s", "t")).orderBy("i").toPandas()  # one row a node
            if len(rows):
                tables = [rows[[f"{name}{j}" for j in range(dim)]].to_numpy() for name in "uvs"]
            sent.unpersist()
        spark = self.edges.sparkSession
        as_frame = lambda t: spark.createDataFrame(pd.DataFrame({"node_id": ids.astype("int64"), "vec": [row.tolist() for row in t]}), "node_id long, vec array<double>")
        self.in_vec, self.out_vec = as_frame(tables[0]), as_frame(tables[1])

    def _tree(self, samples: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner nodes and sides of every node, -1 and 0 beyond its depth; without a tree nothing but -1."""
        if not self.hierarchical:
            return np.full((len(ids), 1), -1), np.zeros((len(ids), 1))
        visits = samples.groupBy(F.col("center").alias("node_id")).agg(F.count(F.lit(1)).alias("weight"))
        rows = huffman_codes(visits).toPandas()  # one row a node, bounded by the check above
        deepest = max((len(x) for x in rows["code"]), default=0) or 1
        points, code = np.full((len(ids), deepest), -1), np.zeros((len(ids), deepest))
        for i, way, bits in zip(np.searchsorted(ids, rows["node_id"].to_numpy()), rows["points"], rows["code"], strict=True):
            points[i, : len(way)], code[i, : len(bits)] = way, bits
        return points, code


class Node2Vec(SampledEmbedding):
    """Biased or non-backtracking walks and skip-gram with negative sampling."""

    def __init__(self, walk_length: int = 80, num_walks: int = 10, window_length: int = 10, p: float = 1.0, q: float = 1.0, backtrack: bool = True, epochs: int = 1, seed: int = 1) -> None:
        super().__init__("node2vec", walk_length, num_walks, window_length, epochs=epochs, seed=seed, p=p, q=q, backtrack=backtrack)


class DeepWalk(SampledEmbedding):
    """Uniform walks and continuous bag of words with the softmax over the Huffman tree of the visits, and noise for the second table."""

    def __init__(self, walk_length: int = 80, num_walks: int = 30, window_length: int = 10, backtrack: bool = True, epochs: int = 1, seed: int = 1) -> None:
        super().__init__("cbow", walk_length, num_walks, window_length, epochs=epochs, seed=seed, backtrack=backtrack, hierarchical=True)


def save(model: NodeEmbedding, path: str) -> None:
    """Both tables of a fitted model as Parquet with its class and dimension."""
    for name, table in (("in", model.in_vec), ("out", model.out_vec)):
        table.select("node_id", "vec", F.lit(type(model).__name__).alias("model"), F.lit(model.dim).alias("dim")).write.mode("overwrite").parquet(f"{path}/{name}")


def load(edges: DataFrame, path: str) -> NodeEmbedding:
    """The saved tables as a model: it answers for its dimension and isn't trained again."""
    model = NodeEmbedding()
    model.edges = edges
    model.in_vec, model.out_vec = (edges.sparkSession.read.parquet(f"{path}/{name}").select("node_id", "vec") for name in ("in", "out"))
    model.dim = edges.sparkSession.read.parquet(f"{path}/in").first()["dim"]
    return model


#: Hyper-parameter presets by model name.
PRESETS = {
    "node2vec": lambda: Node2Vec(num_walks=40),
    "deepwalk": lambda: DeepWalk(num_walks=120),
    "word2vec": lambda: Word2VecEmbedding(num_walks=40),
    "line": lambda: Node2Vec(num_walks=400, window_length=1),
    "depthfirst-node2vec": lambda: Node2Vec(num_walks=40, p=100.0),
    "non-backtracking-node2vec": lambda: Node2Vec(num_walks=40, backtrack=False),
    "non-backtracking-deepwalk": lambda: DeepWalk(num_walks=120, backtrack=False),
    "leigenmap": LaplacianEigenMap,
    "adjspec": AdjacencySpectral,
    "modspec": ModularitySpectral,
    "modspec2": DeflatedModularity,
    "highorder-modspec": HighOrderModularity,
    "linearized-node2vec": LinearizedNode2Vec,
    "nonbacktracking": NonBacktracking,
    "node2vec-matrixfact": MatrixFactorization,
    "fastrp": FastRP,
    "torch-node2vec": lambda: SampledEmbedding("node2vec"),
    "torch-modularity": lambda: SampledEmbedding("modularity"),
    "torch-laplacian-eigenmap": lambda: SampledEmbedding("laplacian"),
}
