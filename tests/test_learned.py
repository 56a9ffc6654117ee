"""Huffman codes and models on partitioned tables against brute force."""

import heapq
import os
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import clustering, metrics, strata
from quillgraph.operators.embeddings import SampledEmbedding, _bag_steps, _pair_steps
from quillgraph.operators.graph import line_graph
from quillgraph.operators.huffman import huffman_codes
from quillgraph.operators.rejection import rejection_walks, walk_steps
from quillgraph.operators.sampling import noise_distribution, uniform_distribution
from quillgraph.sources import generators
from tests.verify_oracles import compare, connect


def by_heap(weights):
    heap = [(w, 0, i) for i, w in weights.items()]
    heapq.heapify(heap)
    below, made = {}, 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        below[made] = (a, b)
        heapq.heappush(heap, (a[0] + b[0], 1, made))
        made += 1
    out, open_ = {}, [(x, [], []) for x in heap]
    while open_:
        (_, inner, i), code, points = open_.pop()
        if inner:
            open_ += [(x, [*code, bit], [*points, i]) for bit, x in enumerate(below[i])]
        else:
            out[i] = (code, points)
    return out


def codes_of(frame):
    return {x.node_id: (x.code, x.points) for x in huffman_codes(frame).collect()}


@pytest.mark.parametrize("kind", ["ties", "deep"])
def test_codes_equal_a_heap(spark, kind):
    r = random.Random(1)
    weights = {i: float(r.choice([0, 1, 1, 2, 3, 5, 8, 100])) for i in range(90)} if kind == "ties" else {i: float(1.7**i // 1) for i in range(14)}
    got = codes_of(spark.createDataFrame(list(weights.items()), "node_id long, weight double"))
    assert got == by_heap(weights)
    words = sorted("".join(map(str, c)) for c, _ in got.values())
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))  # no code begins another


def test_codes_of_odd_tables(spark):
    schema = "node_id long, weight double, code string"
    rows = [(4, 1.0, "x"), (4, 2.0, "y"), (None, 9.0, ""), (5, None, None), (6, -3.0, ""), (7, 3.0, "")]
    assert codes_of(spark.createDataFrame(rows, schema)) == by_heap({4: 3.0, 5: 0.0, 6: 0.0, 7: 3.0})
    assert codes_of(spark.createDataFrame([(3, 1.0, ""), (3, 2.0, "")], schema)) == {3: ([], [])}
    assert codes_of(spark.createDataFrame([], schema)) == {}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("name", ["e2_huffman_codes", "r1_rejection_parts", "r2_rejection_weighted"])
def test_equal_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert compare(spark, connect(larger), name, larger) == ""


# ------------------------------------------------------------ gradients


def slopes(tables, loss, eps=1e-6):
    out = []
    for t in tables:
        g = np.zeros_like(t)
        for i in np.ndindex(*t.shape):
            kept = t[i]
            t[i] = kept + eps
            high = loss()
            t[i] = kept - eps
            g[i] = (high - loss()) / (2 * eps)
            t[i] = kept
        out.append(g)
    return out


def added(tables, steps):
    out = [np.zeros_like(t) for t in tables]
    for t, rows, values in steps:
        np.add.at(out[t], rows, values)
    return out


def softplus(z):
    return np.log1p(np.exp(z))


@pytest.mark.parametrize("name", ["node2vec", "modularity", "laplacian"])
def test_gradients_of_pairs_are_slopes(name):
    r = np.random.default_rng(3)
    tables = [r.normal(size=(6, 3)), r.normal(size=(6, 3))]
    u, v = tables
    a, b, k, c, d = r.integers(0, 6, 5), r.integers(0, 6, 5), r.integers(0, 6, (5, 2)), r.integers(0, 6, 5), r.integers(0, 6, 5)
    w = np.array([1.0, 2.0, 3.0, 1.0, 5.0])

    def loss():
        pos, neg = (u[a] * v[b]).sum(1), np.einsum("id,ikd->ik", u[a], v[k])
        if name == "node2vec":
            return (w * (softplus(-pos) + softplus(neg).sum(1))).sum()
        if name == "modularity":
            return (w * (-pos + neg.sum(1) + 6 / 2 * (u[c] * v[d]).sum(1) ** 2)).sum()
        return (w * (-pos + neg.sum(1) ** 2 / 2)).sum()

    got = added(tables, _pair_steps(name, u, v, a, b, k, (c, d), 6, w))
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(got, slopes(tables, loss), strict=True))


def test_gradients_of_the_tree_are_slopes():
    r = np.random.default_rng(4)
    tables = [r.normal(size=(5, 3)) for _ in range(3)]
    u, v, s = tables
    codes = by_heap({0: 1.0, 1: 1.0, 2: 2.0, 3: 7.0, 4: 8.0})
    deepest = max(len(c) for c, _ in codes.values())
    points, code = np.full((5, deepest), -1), np.zeros((5, deepest))
    for i, (c, p) in codes.items():
        points[i, : len(p)], code[i, : len(c)] = p, c
    a, b, k = np.array([0, 3, 1]), np.array([[1, 2, -1], [4, 4, 0], [2, -1, -1]]), r.integers(0, 5, (3, 2))

    def loss():
        total = 0.0
        for i in range(3):
            h = u[b[i][b[i] >= 0]].mean(0)
            total += softplus(-h @ v[a[i]]) + softplus(v[k[i]] @ h).sum()
            total += sum(softplus((2 * c - 1) * (s[p] @ h)) for c, p in zip(*codes[a[i]], strict=True))
        return total

    got = added(tables, _bag_steps(u, v, s, a, b, k, points, code))
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(got, slopes(tables, loss), strict=True))


def test_the_tree_sums_to_one():
    r = np.random.default_rng(5)
    codes, inner, h = by_heap({i: float(i % 4 + 1) for i in range(9)}), r.normal(size=(8, 3)), r.normal(size=3)
    share = sum(np.prod([1 / (1 + np.exp((2 * c - 1) * (inner[p] @ h))) for c, p in zip(*x, strict=True)]) for x in codes.values())
    assert abs(share - 1) < 1e-12


# ------------------------------------------------------------ tables in blocks


def ring_score(vectors, d):
    v = vectors.withColumn("label", F.floor(F.col("node_id") / 10))
    return metrics.element_similarity(metrics.contingency(clustering.voronoi(v, "label", d), "label", "p")).first()["esim"]


@pytest.mark.parametrize("options", [{"parts": 3}, {"parts": 2, "noise_sampler": uniform_distribution}, {"loss": "cbow", "hierarchical": True, "parts": 2}])
def test_cliques_separate(spark, options):
    ring = generators.ring_of_cliques(spark, 50, 10)
    model = SampledEmbedding(walk_length=20, num_walks=10, window_length=3, epochs=4, **options).fit(ring)
    assert ring_score(model.transform(8), 8) > 0.8
    assert model.transform(8, return_out_vector=True).count() == 50


def read(frame):
    return {x.node_id: tuple(x.vec) for x in frame.collect()}


def test_blocks_do_not_depend_on_partitions(spark):
    ring = generators.ring_of_cliques(spark, 30, 10).select("src", "dst", "w")
    pairs = ring.select(F.col("src").alias("center"), F.col("dst").alias("context"))
    step = partial(_pair_steps, "node2vec")
    fit = lambda p: [read(t) for t in strata.train(p, noise_distribution(ring), 4, step, epochs=2, blocks=3, repeats=2)]
    first = fit(pairs.union(pairs).union(pairs))
    assert first == fit(pairs.union(pairs).union(pairs).repartition(7, "context"))
    assert len(first[0]) == len(first[1]) == 30 and first[0] != first[1]


def test_training_resumes(spark, tmp_path):
    ring = generators.ring_of_cliques(spark, 30, 10).select("src", "dst", "w")
    pairs, noise = ring.select(F.col("src").alias("center"), F.col("dst").alias("context")), noise_distribution(ring)
    step = partial(_pair_steps, "node2vec")

    def broken(*_):
        raise RuntimeError("not to be called")

    fit = lambda s, epochs, folder: [read(t) for t in strata.train(pairs, noise, 4, s, epochs=epochs, blocks=2, folder=folder)]
    folder = f"file://{tmp_path}/run"
    whole, half = fit(step, 2, None), fit(step, 1, folder)
    assert half != whole
    with pytest.raises(Exception, match="not to be called"):
        fit(broken, 2, folder)  # stops in the third turn
    assert fit(broken, 1, folder) == half
    assert fit(step, 2, folder) == whole
    assert fit(broken, 2, folder) == whole


def test_blocks_of_odd_tables(spark):
    noise = spark.createDataFrame([(1, 0.5), (2, None), (2, 0.5), (3, 0.0), (None, 1.0)], "node_id long, p double")
    rows = [(1, 2), (1, 2), (2, 1), (None, 1), (1, None), (9, 1), (1, 9)]
    step = partial(_pair_steps, "node2vec")
    some = lambda r: spark.createDataFrame(r, "center long, context long").withColumn("n", F.lit("x"))
    start = [read(t) for t in strata.train(some([]), noise, 2, step, blocks=2)]
    for blocks in (1, 4):
        got = [read(t) for t in strata.train(some(rows), noise, 2, step, epochs=3, blocks=blocks)]
        assert got[0].keys() == got[1].keys() == {1, 2, 3}
        assert got[0][3] == start[0][3] and got[0][1] != start[0][1]  # a node without pairs stays
    assert [read(t) for t in strata.train(some([]), noise.limit(0), 2, step)] == [{}, {}]


# ------------------------------------------------------------ walks by rejection

EDGES = "src long, dst long, w double"
SMALL = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 1.0), (0, 2, 2.0), (2, 0, 1.0), (2, 3, 1.0), (3, 2, 2.0), (1, 3, 0.5), (3, 1, 1.0), (1, 4, 2.0), (4, 1, 1.0)]


@pytest.mark.parametrize("weighted", [False, True])
def test_rejection_follows_the_law(spark, weighted):
    rows = SMALL if weighted else [(a, b, 1.0) for a, b, _ in SMALL]
    e = spark.createDataFrame(rows, EDGES)
    p, q = 0.4, 3.0
    walks = rejection_walks(e, 3, p, q, walks=4000, seed=3)
    triples = [tuple(x.path) for x in walks.select("path").collect()]
    assert len(triples) == 20000 and all(len(x) == 3 for x in triples)
    out = {a: sum(w for s, _, w in rows if s == a) for a, _, _ in rows}
    for a, b, w in rows:  # the first step follows the weights
        n = sum(x[0] == a for x in triples)
        assert abs(sum(x[:2] == (a, b) for x in triples) / n - w / out[a]) < 4 * 0.5 / n**0.5
    law = {}
    for x in line_graph(e, p, q).collect():
        law.setdefault((x.prev, x.cur), {})[x.nxt] = x.w
    for (a, b), after in law.items():
        n = sum(x[:2] == (a, b) for x in triples)
        for c, w in after.items():
            assert abs(sum(x == (a, b, c) for x in triples) / n - w / sum(after.values())) < 4 * 0.5 / n**0.5


def test_rejection_does_not_depend_on_tries_or_partitions(spark):
    e = spark.createDataFrame(SMALL, EDGES)
    fit = lambda frame, tries: sorted(map(tuple, walk_steps(frame, 5, 0.1, 8.0, walks=3, tries=tries).collect()))
    assert fit(e, 1) == fit(e.repartition(5), 7)


def test_rejection_at_a_hub(spark):
    leaves = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    star = leaves.unionByName(leaves.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    steps = walk_steps(star, 4, 100.0, 1.0)
    assert steps.count() == 4 * 100_001
    assert steps.groupBy("start", "round").agg(F.count(F.lit(1)).alias("n")).filter("n <> 4").count() == 0
    second = steps.filter("pos = 2 AND start <> 0")
    assert second.filter("node = start").count() < 10  # a return has a hundredth of the odds of one of 100 000
    assert second.select("node").distinct().count() > 60_000


def test_rejection_of_odd_tables(spark):
    rows = [(0, 1, 1.0), (0, 1, 2.0), (1, 2, 1.0), (3, 3, 1.0), (4, 0, 0.0), (4, 0, -1.0), (5, None, 1.0), (None, 5, 1.0), (6, 0, None)]
    e = spark.createDataFrame(rows, EDGES).withColumn("node", F.lit("x"))
    got = {x.start: x.path for x in rejection_walks(e, 4, 0.5, 2.0).collect()}
    assert got == {0: [0, 1, 2], 1: [1, 2], 3: [3, 3, 3, 3]}
    assert {x.start: x.path for x in rejection_walks(e, 1).collect()} == {0: [0], 1: [1], 3: [3]}
    assert rejection_walks(e.filter("w > 9"), 4).collect() == []


def test_models_of_walks_make_their_edges_once(spark):
    """Walks, their weights and the noise read the written edges."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ring = spark.createDataFrame([(i, (i + s) % 6, 1.0) for i in range(6) for s in (1, 5)], "src long, dst long, w double").mapInArrow(count, "src long, dst long, w double")
    vectors = SampledEmbedding(walk_length=4, num_walks=1, window_length=1, epochs=1, parts=1).fit(ring).transform(2)
    assert vectors.count() == 6 and made.value == 12
