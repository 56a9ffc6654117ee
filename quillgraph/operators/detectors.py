"""Community detection on the graph itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint
from .graph import block_matrix, nodes_of


def label_switching(edges: DataFrame, start: DataFrame | None = None, rounds: int = 8, resolution: float = 1.0) -> DataFrame:
    """Synchronous modularity moves in alternating halves: ``node_id, g``.

    A node takes the neighbouring group with the largest weight to it less the
    expected weight; one join with the labels, one grouped sum a round.
    """
    edges = checkpoint(edges.select("src", "dst", "w"))  # read in every round
    deg = checkpoint(edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d")))
    total = float(deg.agg(F.sum("d")).first()[0] or 1.0)
    labels = start or deg.select("node_id", F.col("node_id").alias("g"))
    for r in range(rounds):
        strength = labels.join(deg, "node_id").groupBy("g").agg(F.sum("d").alias("s"))
        pulled = edges.filter("src <> dst").join(labels.select(F.col("node_id").alias("dst"), F.col("g").alias("to")), "dst").groupBy(F.col("src").alias("node_id"), "to").agg(F.sum("w").alias("k"))
        own = labels.select("node_id", "g").join(deg, "node_id").filter(prng.bits(r, "node_id") % 2 == 0)
        options = pulled.join(own, "node_id").join(strength.select(F.col("g").alias("to"), "s"), "to")
        gain = F.col("k") - resolution * F.col("d") * (F.col("s") - F.when(F.col("to") == F.col("g"), F.col("d")).otherwise(0.0)) / total
        best = options.groupBy("node_id").agg(F.max_by("to", F.struct(F.round(gain, 9), -F.col("to"))).alias("new"), F.max(gain).alias("gain"))
        labels = checkpoint(labels.join(best, "node_id", "left").select("node_id", F.when(F.col("gain") > 0, F.col("new")).otherwise(F.col("g")).alias("g")))
    return labels


def block_model(edges: DataFrame, q: int, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Degree-corrected block model with q groups by label sweeps on the q x q weight table."""
    edges = checkpoint(edges.select("src", "dst", "w"))  # read in every round
    labels = checkpoint(nodes_of(edges).select("node_id", (prng.bits(seed, "node_id") % q).alias("membership")))
    for r in range(rounds):
        rows = block_matrix(edges, labels).collect()  # at most q^2 rows
        w = np.full((q, q), 1e-6)
        for x in rows:
            w[x["g_src"], x["g_dst"]] += x["w"]
        k = w.sum(axis=1)
        score = np.log(w / np.outer(k, k))
        table = edges.sparkSession.createDataFrame([(a, b, float(score[a, b])) for a in range(q) for b in range(q)], "to long, h long, v double")
        pulled = edges.join(labels.select(F.col("node_id").alias("dst"), F.col("membership").alias("h")), "dst").groupBy(F.col("src").alias("node_id"), "h").agg(F.sum("w").alias("k"))
        best = pulled.join(F.broadcast(table), "h").groupBy("node_id", "to").agg(F.sum(F.col("k") * F.col("v")).alias("s")).groupBy("node_id").agg(F.max_by("to", F.struct(F.round("s", 9), -F.col("to"))).alias("new"))
        move = prng.bits(seed + r + 1, "node_id") % 2 == 0
        labels = checkpoint(labels.join(best, "node_id", "left").select("node_id", F.when(move, F.coalesce("new", "membership")).otherwise(F.col("membership")).alias("membership")))
    return labels


def belief_propagation(edges: DataFrame, truth: DataFrame, q: int, cin: float, cout: float, rounds: int = 10) -> DataFrame:
    """Belief propagation for the planted partition, messages started from ``truth`` (``init="truth"``).

    Messages live on directed edges as one array column; a round is a sum over
    the incoming messages of each node and a division by the reverse one.
    """
    n = truth.count()
    pairs = edges.filter("src <> dst").select("src", "dst")
    start = F.transform(F.sequence(F.lit(0), F.lit(q - 1)), lambda g: F.when(g == F.col("membership"), 0.9).otherwise(0.1 / max(1, q - 1)))
    beliefs = checkpoint(truth.select("node_id", start.alias("b")))
    messages = checkpoint(pairs.join(beliefs.select(F.col("node_id").alias("src"), F.col("b").alias("m")), "src"))
    pin, pout = cin / n, cout / n
    for _ in range(rounds):
        field = beliefs.agg(F.array(*(F.sum(F.col("b")[g]) for g in range(q))).alias("f")).first()["f"]
        h = [sum(field) * pout + (pin - pout) * f for f in field]
        logs = [F.ln(pout * n + (pin - pout) * n * F.col("m")[g]) for g in range(q)]
        incoming = messages.groupBy("dst").agg(F.array(*(F.sum(x) for x in logs)).alias("l"))
        lift = lambda a: F.transform(a, lambda x, i: x - F.get(F.array(*(F.lit(v) for v in h)), i))
        norm = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)) / F.aggregate(a, F.lit(0.0), lambda s, y: s + F.exp(y - F.array_max(a))))
        beliefs = checkpoint(truth.select("node_id").join(incoming.withColumnRenamed("dst", "node_id"), "node_id", "left").select("node_id", norm(lift(F.coalesce("l", F.array_repeat(F.lit(0.0), q)))).alias("b")))
        back = messages.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.array(*logs).alias("out"))
        nxt = back.join(incoming.select(F.col("dst").alias("src"), "l"), "src").select("src", "dst", norm(lift(F.zip_with("l", "out", lambda a, b: a - b))).alias("m"))
        messages = checkpoint(nxt)
    best = F.array_position("b", F.array_max("b")) - 1
    return beliefs.select("node_id", best.cast("long").alias("g"))


def in_largest_component(edges: DataFrame, detector) -> DataFrame:
    """``detector(edges)`` on the largest component alone; all other nodes keep a null group."""
    from .graph import induced, largest_component, reexpand

    inside = checkpoint(induced(edges, checkpoint(largest_component(edges))))
    return reexpand(nodes_of(edges), detector(inside))


def _discriminant(vectors: DataFrame, d: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Labels, weights and biases of linear discriminants: sums by label and dimension, a d x d solve on the driver."""
    products = F.array(*(F.sum(F.col("vec")[j] * F.col("x")) for j in range(d)))
    long = vectors.select("label", "vec", F.posexplode(F.slice("vec", 1, d)).alias("i", "x"))
    rows = long.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), products.alias("p")).orderBy("label", "i").collect()  # d for each class
    classes = [rows[k : k + d] for k in range(0, len(rows), d)]
    n = np.array([c[0]["n"] for c in classes], float)
    means = np.array([[r["s"] for r in c] for c in classes]) / n[:, None]
    scatter = sum(np.array([r["p"] for r in c]) - c[0]["n"] * np.outer(m, m) for c, m in zip(classes, means, strict=True))
    weights = means @ np.linalg.pinv(scatter / max(1.0, n.sum() - len(classes)))
    return [c[0]["label"] for c in classes], weights, -0.5 * np.einsum("kd,kd->k", weights, means) + np.log(n / n.sum())


def linear_discriminant(vectors: DataFrame, d: int) -> DataFrame:
    """LDA fitted and applied to ``(node_id, vec, label)`` with pooled covariance: ``node_id, label, p``."""
    known, weights, bias = _discriminant(vectors, d)
    scores = [sum((F.col("vec")[i] * float(weights[k, i]) for i in range(d)), F.lit(float(bias[k]))) for k in range(len(known))]
    labels = F.array(*(F.lit(v) for v in known))
    values = F.array(*scores)
    return vectors.select("node_id", "label", F.element_at(labels, F.array_position(values, F.array_max(values)).cast("int")).alias("p"))


def discriminant_auc(vectors: DataFrame, d: int) -> DataFrame:
    """One row ``auc`` (0.5 or more): how well the discriminant of two classes orders ``(vec, label)``."""
    from .metrics import folded_auc

    known, weights, _ = _discriminant(vectors, d)
    if len(known) != 2:
        raise ValueError("two classes are needed")
    w = weights[1] - weights[0]
    score = sum((F.col("vec")[i] * float(w[i]) for i in range(1, d)), F.col("vec")[0] * float(w[0]))
    return folded_auc(vectors.select(F.round(score, 9).alias("score"), (F.col("label") == known[1]).cast("long").alias("same")))


class _CFTree:
    """Sub-clusters (n, linear sum) of unit vectors whose mean inner product with what joins them is ``rho`` or more.

    A node holds at most ``branching`` entries.  An entry is found from the
    root by the largest <ls, x> - rho n m; a full node splits on the pair that
    is farthest apart in -ls ls' + rho n n'.
    """

    def __init__(self, rho: float, branching: int, d: int) -> None:
        self.rho, self.branching = rho, branching
        self.root = self._node(d, leaf=True)

    def _node(self, d: int, leaf: bool) -> dict:
        return {"n": np.zeros(self.branching + 1), "ls": np.zeros((self.branching + 1, d)), "child": None if leaf else [], "size": 0}

    def _add(self, node: dict, n: float, ls: np.ndarray, child: dict | None) -> None:
        k = node["size"]
        node["n"][k], node["ls"][k], node["size"] = n, ls, k + 1
        if node["child"] is not None:
            node["child"].append(child)

    def insert(self, n: float, ls: np.ndarray) -> None:
        halves = self._insert(self.root, n, ls)
        if halves:
            self.root = self._node(len(ls), leaf=False)
            for h in halves:
                self._add(self.root, h["n"][: h["size"]].sum(), h["ls"][: h["size"]].sum(axis=0), h)

    def _insert(self, node: dict, n: float, ls: np.ndarray) -> tuple[dict, dict] | None:
        k, size = -1, node["size"]
        if size:
            gain = node["ls"][:size] @ ls - self.rho * n * node["n"][:size]
            k = int(gain.argmax())
        if node["child"] is not None:
            halves = self._insert(node["child"][k], n, ls)
            node["n"][k] += n
            node["ls"][k] += ls
            if halves:
                one, two = halves
                node["child"][k] = one
                node["n"][k], node["ls"][k] = one["n"][: one["size"]].sum(), one["ls"][: one["size"]].sum(axis=0)
                self._add(node, two["n"][: two["size"]].sum(), two["ls"][: two["size"]].sum(axis=0), two)
        elif k >= 0 and gain[k] >= 0:
            node["n"][k] += n
            node["ls"][k] += ls
        else:
            self._add(node, n, ls, None)
        return self._split(node) if node["size"] > self.branching else None

    def _split(self, node: dict) -> tuple[dict, dict]:
        n, ls = node["n"][: node["size"]], node["ls"][: node["size"]]
        apart = -ls @ ls.T + self.rho * np.outer(n, n)
        np.fill_diagonal(apart, -np.inf)
        i, j = divmod(int(apart.argmax()), len(n))
        halves = tuple(self._node(ls.shape[1], node["child"] is None) for _ in range(2))
        for k in range(len(n)):
            near = 0 if k == i or (k != j and apart[k, i] <= apart[k, j]) else 1
            self._add(halves[near], n[k], ls[k], node["child"][k] if node["child"] is not None else None)
        return halves

    def leaves(self):
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node["child"] is not None:
                todo += reversed(node["child"])
            else:
                yield from zip(node["n"][: node["size"]].tolist(), node["ls"][: node["size"]].tolist(), strict=True)


#: The last merge, on the driver, has at most so many sub-clusters.
MAX_SUBCLUSTERS = 2_000


def subclusters(rows: DataFrame, rho: float, branching: int, parts: int) -> DataFrame:
    """``n, ls`` of CF trees over ``(key, n, ls)``, one tree in each of ``parts`` lots; rows come in order of their key."""
    import pandas as pd

    def build(frames):
        tree = None
        for frame in frames:
            for n, ls in zip(frame["n"], frame["ls"], strict=True):
                x = np.asarray(ls, float)
                tree = tree or _CFTree(rho, branching, len(x))
                tree.insert(float(n), x)
        if tree:
            found = list(tree.leaves())
            yield pd.DataFrame({"n": [n for n, _ in found], "ls": [x for _, x in found]})

    lots = prng.bits("lot", F.col("key")) % parts
    dealt = rows.withColumn("_lot", lots).repartition(parts, "_lot").sortWithinPartitions("_lot", "key")
    return dealt.select("n", "ls").mapInPandas(build, "n double, ls array<double>")


def cosine_birch(vectors: DataFrame, threshold: float = 0.5, clusters: int | None = None, branching: int = 50, parts: int = 8) -> DataFrame:
    """Cosine BIRCH: CF trees over lots of vectors, their sub-clusters merged by average linkage: ``node_id, p``.

    As long as there are more than :data:`MAX_SUBCLUSTERS`, trees over the
    sub-clusters are built again in half as many lots and with a lower
    threshold.  Those sums, not the vectors, are merged on the driver to
    ``clusters`` groups (or while the linkage reaches the threshold).  Vectors
    go to the sub-cluster with the largest inner product.
    """
    from ..functions.vectors import dot, unit

    rho = threshold
    rows = vectors.select(F.col("node_id").alias("key"), F.lit(1.0).alias("n"), unit("vec").alias("ls"))
    while True:
        found = checkpoint(subclusters(rows, rho, branching, parts))
        if found.count() <= MAX_SUBCLUSTERS:
            break
        rows = checkpoint(found.withColumn("key", F.xxhash64("n", "ls")))
        parts, rho = max(1, parts // 2), rho - 0.05
    table = found.orderBy(F.desc("n"), "ls").toPandas()  # bounded above
    ls, n = np.array(table["ls"].tolist()), table["n"].to_numpy(float)
    label = average_linkage(ls, n, threshold, clusters)
    centers = vectors.sparkSession.createDataFrame([(i, int(label[i]), (ls[i] / n[i]).tolist()) for i in range(len(n))], "sub long, g long, c array<double>")
    scored = vectors.select("node_id", unit("vec").alias("vec")).crossJoin(F.broadcast(centers)).withColumn("s", F.round(dot("vec", "c"), 9))  # bounded above
    return scored.groupBy("node_id").agg(F.max_by("g", F.struct("s", -F.col("sub"))).alias("p"))


def average_linkage(ls: np.ndarray, n: np.ndarray, threshold: float, clusters: int | None) -> np.ndarray:
    """Group of each (n, linear sum) pair: the two with the largest mean inner product are joined, again and again."""
    total, size, label = ls.astype(float).copy(), n.astype(float).copy(), np.arange(len(n))
    live = np.ones(len(n), dtype=bool)
    link = (total @ total.T) / np.outer(size, size)
    np.fill_diagonal(link, -np.inf)
    while live.sum() > max(1, clusters or 1):
        i, j = sorted(divmod(int(link.argmax()), len(n)))
        if clusters is None and link[i, j] < threshold:
            break
        total[i] += total[j]
        size[i] += size[j]
        label[label == j] = i
        live[j] = False
        row = np.where(live, (total @ total[i]) / (size * size[i]), -np.inf)
        row[i] = -np.inf
        link[i], link[:, i], link[j], link[:, j] = row, row, -np.inf, -np.inf
    return np.unique(label, return_inverse=True)[1]


def density_clusters(neighbours: DataFrame, min_samples: int = 5, cut: float = 0.5) -> DataFrame:
    """Density clustering on a neighbour table ``src, dst, distance``: mutual reachability, then components below ``cut``.

    The flat cut of the single-linkage tree of mutual reachability; nodes left
    alone are noise (-1).
    """
    from pyspark.sql import Window

    from .graph import connected_components

    neighbours = checkpoint(neighbours)  # read for the cores, the links and the nodes
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    core = neighbours.withColumn("r", rank).groupBy("src").agg(F.max(F.when(F.col("r") <= min_samples, F.col("distance"))).alias("core"))
    e = neighbours.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("core2")), "dst")
    close = e.filter(F.greatest("distance", "core", "core2") <= cut).select("src", "dst")
    labels = connected_components(close)
    nodes = neighbours.select(F.col("src").alias("node_id")).distinct()
    return nodes.join(labels, "node_id", "left").select("node_id", F.coalesce("component", F.lit(-1)).alias("p"))
