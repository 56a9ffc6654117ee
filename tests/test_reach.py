"""Shortest paths and eigenpairs of matrices that aren't symmetric against brute force."""

import heapq
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.catalogue import ORACLES
from quillgraph.operators import paths
from quillgraph.operators.embeddings import NonBacktracking
from quillgraph.operators.graph import nonbacktracking_matrix
from quillgraph.operators.krylov import nonsymmetric_eigenpairs, power_steps
from quillgraph.operators.paths import shortest_paths, trace_paths
from quillgraph.reach import l2_nonbacktracking_eigs
from quillgraph.sources import generators
from tests.verify_oracles import compare, connect

SCHEMA = "src long, dst long, w double"


def dijkstra(rows, s):
    best, heap = {s: 0.0}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        for a, b, w in rows:
            if a == u and d + w < best.get(b, float("inf")):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize("weighted", [False, True])
def test_paths_equal_dijkstra(spark, weighted):
    r = random.Random(4)
    rows = [(r.randrange(30), r.randrange(30), float(r.choice([1, 2, 3, 5]))) for _ in range(70)]
    e = spark.createDataFrame([*rows, *rows[:5], (3, 4, 0.0), (4, 3, -1.0), (5, 6, None)], SCHEMA)
    tree = shortest_paths(e, spark.createDataFrame([(0,), (7,), (7,), (99,), (None,)], "node_id long"), weighted)
    got = {(x.source, x.node_id): (x.dist, x.pred) for x in tree.collect()}
    plain = rows if weighted else [(a, b, 1.0) for a, b, _ in rows]
    want = {}
    for s in (0, 7, 99):
        best = dijkstra(plain, s)
        for v, d in best.items():
            want[s, v] = (d, min((a for a, b, w in plain if b == v and a in best and best[a] + w == d), default=None))
    assert got == want
    pairs = [(s, t) for s in (0, 7, 99) for t in range(30)]
    for x in trace_paths(tree, spark.createDataFrame(pairs, "source long, target long")).collect():
        path = [x.target]
        while want.get((x.source, path[0]), (0, None))[1] is not None:
            path.insert(0, want[x.source, path[0]][1])
        assert x.path == path


def test_long_and_missing_paths(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], SCHEMA)
    tree = shortest_paths(chain, spark.createDataFrame([(0,)], "node_id long"))
    assert {x.node_id: x.dist for x in tree.collect()} == {i: float(i) for i in range(31)}
    ends = spark.createDataFrame([(0, 30), (0, 0), (0, 77)], "source long, target long")
    paths = {x.target: x.path for x in trace_paths(tree, ends, most=20).collect()}
    assert paths == {30: list(range(10, 31)), 0: [0], 77: [77]}
    assert shortest_paths(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "node_id long")).collect() == []


def test_pairs_without_a_path_pass_by_once(spark, monkeypatch):
    """Many pairs, few of them linked: rows of the rest are in no written table, whether tables are sent or kept by key."""
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], SCHEMA)
    nodes = spark.range(300).select(F.col("id").alias("node_id"))
    tree = shortest_paths(chain, nodes)
    pairs = nodes.select(F.col("node_id").alias("source")).crossJoin(nodes.select(F.col("node_id").alias("target")))
    pairs = pairs.unionByName(pairs.filter("source = 1 AND target IN (3, 9)"))  # repeated ones stay
    want = {(s, t): list(range(s, t + 1)) if s < t <= 5 else [t] for s in range(300) for t in range(300)}
    write, sizes = paths.checkpoint, []

    def kept(df, *by):
        out = write(df, *by)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "checkpoint", kept)
    for sent in (1_000_000, 0):
        monkeypatch.setattr(paths, "SENT", sent)
        got = trace_paths(tree, pairs, most=10, cut_every=2)
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
        rows = got.collect()
        assert len(rows) == 90002 and {(r.source, r.target): r.path for r in rows} == want
    assert max(sizes) == 15


def dense(rows, n):
    a = np.zeros((n, n))
    for s, t, w in rows:
        a[s, t] += w
    return a


def read(v, column, n):
    out = np.zeros((n, len(v.first()[column])))
    for x in v.collect():
        out[x.node_id] = x[column]
    return out


def test_eigenpairs_of_a_random_matrix(spark):
    r = np.random.default_rng(2)
    n = 90
    rows = [(int(i), int(j), float(r.normal())) for i in range(n) for j in r.choice(n, 8, replace=False)]
    for i, size in ((0, 14.0), (2, 11.0)):  # two pairs and two values that stand out
        rows += [(i, i + 1, size), (i + 1, i, -size)]
    rows += [(5, 5, 9.0), (6, 6, -7.0)]
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    values, v, residuals = nonsymmetric_eigenpairs(spark.createDataFrame(rows, SCHEMA), nodes, 6, tolerance=1e-6)
    a = dense(rows, n)
    want = sorted(np.linalg.eigvals(a), key=lambda z: -abs(z))
    assert np.allclose(np.abs(values), np.abs(want[:6]), rtol=1e-5) and (np.abs(values.imag) > 1e-6).any()
    u = read(v, "re", n) + 1j * read(v, "im", n)
    assert np.allclose(np.linalg.norm(u, axis=0), 1, atol=1e-8)
    assert (np.linalg.norm(a @ u - u * values, axis=0) <= 2e-6 * np.abs(values) + 1e-9).all()
    assert np.allclose((u.real * u.imag).sum(0), 0, atol=1e-8)


def test_eigenpairs_of_small_matrices(spark):
    nodes = spark.range(3).withColumnRenamed("id", "node_id")
    turn = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], SCHEMA)  # the cubic roots of one
    values, _, _ = nonsymmetric_eigenpairs(turn, nodes, 5)
    assert np.allclose(sorted(values, key=lambda z: z.imag), sorted(np.exp(2j * np.pi * np.arange(3) / 3), key=lambda z: z.imag))
    empty, v, _ = nonsymmetric_eigenpairs(turn.filter("w > 1"), nodes.limit(0), 2)
    assert len(empty) == 0 and v.collect() == []


def test_nonbacktracking_fills_all_columns(spark):
    e, _ = generators.planted_partition(spark, 28, 2, 8.0, 1.0, seed=5)
    rows = [tuple(x) for x in e.select("src", "dst", "w").collect()]
    n = 1 + max(max(a, b) for a, b, _ in rows)
    a = dense(rows, n)
    degrees = a.sum(1)
    linked = np.diag((degrees > 0).astype(float))  # a node without links has no entries
    b = np.block([[np.zeros((n, n)), np.diag(degrees - 1) @ linked], [-linked, a]])
    model = NonBacktracking(tolerance=1e-6).fit(e)
    low = read(model.transform(5), "vec", n)
    assert low.shape == (n, 5) and (np.linalg.norm(low, axis=0) > 0.1).all()
    assert np.allclose(sorted(np.abs(model.values)), sorted(np.abs(np.linalg.eigvals(b)))[-5:], rtol=1e-4)
    for j, s in enumerate(model.values):
        if abs(s.imag) < 1e-9:  # (s^2 - s A + D - I) u = 0
            u = low[:, j] / np.linalg.norm(low[:, j])
            assert np.linalg.norm(s.real**2 * u - s.real * (a @ u) + (a.sum(1) - 1) * u) < 1e-3 * s.real**2
    auto = NonBacktracking(auto_dim=True).fit(e)
    kept = (np.abs(np.linalg.eigvals(b)) > int(a.sum() / n)).sum()
    assert read(auto.transform(1), "vec", n).shape == (n, max(kept - 1, 0))


def test_power_steps_are_counted(spark):
    """Equal components, trees and a path: nothing converges, the vector after so many steps is still the same everywhere."""
    rows = [(b + i, b + (i + 1) % 4, 1.0) for b in (0, 4) for i in range(4)] + [(8, 9, 1.0), (9, 10, 1.0), (0, 2, 1.0)]
    rows += [(t, s, w) for s, t, w in rows]
    b = nonbacktracking_matrix(spark.createDataFrame(rows, SCHEMA), 11)
    start = spark.range(22).select(F.col("id").alias("node_id"), F.when(F.col("id") >= 11, 1.0).otherwise(0.0).alias("x"))
    a = dense(rows, 11)
    whole = np.block([[np.zeros((11, 11)), np.diag(a.sum(1) - 1)], [-np.eye(11), a]])
    for steps in (1, 2, 7, 9):
        value, v = power_steps(b, start, steps, F.col("node_id") >= 11)
        x = [np.linalg.matrix_power(whole, k) @ np.r_[np.zeros(11), np.ones(11)] for k in (steps - 1, steps)]
        top = [np.abs(y[11:]).max() for y in x]
        assert abs(value - top[1] / top[0]) < 1e-12
        got = {r.node_id: r.x for r in v.collect()}
        assert np.allclose([got[i] for i in range(22)], x[1] / top[1])


def test_nonbacktracking_query_equals_sql_without_convergence(spark, tmp_path):
    """Two copies of a ring with a chord and a tree: the leading value is double, its vector not unique."""
    links = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (4, 5), (5, 6)]
    items = [(100 * k + 10 * i + j, 10 * k + x) for k in (0, 1) for i, ab in enumerate(links) for j in (0, 1) for x in ab]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.node_id: (r.value, r.entry) for r in l2_nonbacktracking_eigs(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {n: (v, e) for n, v, e in con.execute(f"SELECT node_id, value, entry FROM ({ORACLES['l2_nonbacktracking_eigs']})").fetchall()}
    assert got == want and len(got) == 14


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
@pytest.mark.parametrize("name", ["x6_shortest_path_tree", "x6_shortest_paths", "l2_nonbacktracking_eigs"])
def test_equal_sql_on_more_rows(spark, name):
    larger = "/root/testdata/sf0.01"
    assert compare(spark, connect(larger), name, larger) == ""
