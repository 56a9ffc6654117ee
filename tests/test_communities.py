"""Map equation, neighbour search, density clusters and vector communities against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import clustering, detectors, hdbscan, mapequation, neighbours
from quillgraph.sources import generators


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "node_id long, vec array<double>")


def blobs(seed, sizes, d=6, spread=0.25, noise=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(len(sizes), d))
    rows = [c + spread * (k + 1) / len(sizes) * r.normal(size=d) for k, (c, n) in enumerate(zip(centres, sizes, strict=True)) for _ in range(n)]
    return np.array(rows + [r.normal(size=d) for _ in range(noise)])


# --- map equation ---------------------------------------------------------------------------------------------------


def plogp(x):
    return x * math.log2(x) if x > 1e-14 else 0.0


def code_length(edges, labels):
    total = sum(w for *_, w in edges)
    p, q, node = {}, {}, {}
    for a, b, w in edges:
        node[a] = node.get(a, 0) + w / total
        p[labels[a]] = p.get(labels[a], 0) + w / total
        q.setdefault(labels[a], 0.0)
        if labels[a] != labels[b]:
            q[labels[a]] += w / total
    return plogp(sum(q.values())) - 2 * sum(map(plogp, q.values())) - sum(map(plogp, node.values())) + sum(plogp(q[g] + p[g]) for g in p)


def test_map_equation_finds_cliques(spark):
    edges = generators.ring_of_cliques(spark, 8, 5)
    found, trace = mapequation.map_equation(edges, rounds=4, levels=2)
    labels = {r.node_id: r.g for r in found.collect()}
    rows = [tuple(r) for r in edges.select("src", "dst", "w").collect()]
    assert abs(trace[-1] - code_length(rows, labels)) < 1e-9
    assert all(b <= a + 1e-9 for a, b in zip(trace, trace[1:], strict=False)) and len(trace) == 4 * 3
    assert trace[-1] <= code_length(rows, {i: i // 5 for i in labels}) + 1e-9
    assert all((labels[a] == labels[b]) == (a // 5 == b // 5) for a in labels for b in labels)


def test_map_equation_small_graphs(spark):
    schema = "src long, dst long, w double"
    assert mapequation.map_equation(spark.createDataFrame([], schema))[0].collect() == []
    loops = spark.createDataFrame([(1, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0)], schema)
    found = {r.node_id: r.g for r in mapequation.map_equation(loops, rounds=2, levels=2)[0].collect()}
    assert found[2] == found[3] != found[1]


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def brute_neighbours(rows, k, asked):
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(norms > 0, norms, 1)
    w = np.round(unit @ unit.T, 9)
    return {(i, j, w[i, j]) for i in asked for j in sorted((j for j in range(len(rows)) if j != i), key=lambda j, i=i: (-w[i, j], j))[:k]}


@pytest.mark.parametrize("block,lot", [(4096, 1024), (7, 5)])
def test_neighbours_equal_all_pairs(spark, block, lot):
    rows = blobs(3, [60, 40, 20])
    rows = np.vstack([rows, rows[:10], np.zeros((1, rows.shape[1]))])  # repeated vectors and a zero one
    v = vectors(spark, rows)
    asked = v.filter("node_id % 5 = 0")
    got = {(r.src, r.dst, r.w) for r in neighbours.nearest_blocked(v, 4, asked, block=block, lot=lot).collect()}
    assert got == brute_neighbours(rows, 4, range(0, len(rows), 5))


def test_neighbours_of_few_and_none(spark):
    v = vectors(spark, np.eye(3))
    assert neighbours.nearest_blocked(v, 5).count() == 6
    assert neighbours.nearest_blocked(v.limit(0), 5).collect() == []


def test_weak_bounds_copy_a_vector_few_times(spark):
    """Vectors without structure: all cells stay open, and small tiles grow with the table."""
    v = vectors(spark, np.random.default_rng(1).normal(size=(2000, 32)))
    cells = neighbours.Cells.of(v)
    lots, blocks = cells.deal(4), cells.deal(8)
    asked = lots.number(cells.rows, "lot").withColumn("bound", F.lit(None).cast("double"))
    done = cells.own(lots, blocks)
    wide = cells.open(asked, "bound", blocks, done)
    pairs = {(r.lot, r.block) for r in done.union(wide).collect()}
    most = 2 * neighbours.COPIES
    assert pairs == {(i, j) for i in {i for i, _ in pairs} for j in {j for _, j in pairs}}
    assert done.count() + wide.count() == len(pairs) and max(i for i, _ in pairs) < most and max(j for _, j in pairs) < most


# --- density clusters -----------------------------------------------------------------------------------------------


def brute_tree(rows, samples):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    w = np.round(unit @ unit.T, 9)
    apart = np.round(np.sqrt(np.maximum(2 - 2 * w, 0)), 9)
    core = np.array([np.sort(np.delete(apart[i], i))[min(samples, len(rows) - 1) - 1] for i in range(len(rows))])
    reach = np.maximum(np.maximum(apart, core[:, None]), core[None, :])
    edges = sorted((reach[a, b], a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    out = []
    for x, a, b in edges:
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, float(x)))
    return out


def brute_labels(n, tree, least):
    """From the top: edges go heaviest first; parts of fewer than ``least`` points fall out."""
    order = sorted(((w, a, b) for a, b, w in tree), reverse=True)

    def part(start, edges):
        seen, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for _, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == i and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    density = lambda w: 1 / max(w, 1e-9)

    def cluster(points, birth):
        """(stability of the best choice, chosen clusters, own stability)."""
        mass, now = 0.0, set(points)
        for w, a, b in order:
            if a in now and b in now:
                inner = [e for e in order if e < (w, a, b) and e[1] in now and e[2] in now]
                left, right = part(a, inner), part(b, inner)
                if len(left) >= least and len(right) >= least:
                    mass += len(now) * (density(w) - birth)
                    kids = [cluster(side, density(w)) for side in (left, right)]
                    best = kids[0][0] + kids[1][0]
                    if round(mass, 9) >= round(best, 9):
                        return mass, [points], True
                    return best, kids[0][1] + kids[1][1], False
                gone = (left if len(left) < least else set()) | (right if len(right) < least else set())
                mass += len(gone) * (density(w) - birth)
                now -= gone
        return mass, [points], True

    labels = [-1] * n
    first = cluster(set(range(n)), 0.0)
    chosen = first[1]
    if first[2]:  # the root itself: look at what lies within it
        now = set(range(n))
        chosen = []
        for w, a, b in order:
            if a in now and b in now:
                inner = [e for e in order if e < (w, a, b) and e[1] in now and e[2] in now]
                left, right = part(a, inner), part(b, inner)
                if len(left) >= least and len(right) >= least:
                    chosen = [p for side in (left, right) for p in cluster(side, density(w))[1]]
                    break
                now -= (left if len(left) < least else set()) | (right if len(right) < least else set())
    for points in chosen:
        for i in points:
            labels[i] = min(points)
    return labels


@pytest.mark.parametrize("seed,sizes,least", [(2, [12] * 6, 4)])
def test_density_clusters_equal_brute_force(spark, seed, sizes, least):
    rows = blobs(seed, sizes)
    tree = brute_tree(rows, least)
    found = hdbscan.spanning_tree(vectors(spark, rows), least, block=40, lot=30)
    assert sorted((r.a, r.b, r.w) for r in found.collect()) == sorted(tree)
    got = {r.node_id: r.p for r in hdbscan.density_labels(vectors(spark, rows), found, least).collect()}
    want = brute_labels(len(rows), tree, least)
    assert [got[i] for i in range(len(rows))] == want and len(set(want)) > 2


def test_tree_searches_all_vectors_where_lists_end(spark, monkeypatch):
    """Vectors without structure need their lists alone, after one search; clusters and copies beyond their lists are looked for further."""
    asked = []
    monkeypatch.setattr(hdbscan, "tiles", lambda *a: asked.append(a) or neighbours.tiles(*a))
    rows = np.random.default_rng(5).normal(size=(150, 24))
    found = hdbscan.spanning_tree(vectors(spark, rows), 4, block=40, lot=30)
    assert sorted((r.a, r.b, r.w) for r in found.collect()) == sorted(brute_tree(rows, 4)) and not asked
    monkeypatch.setattr(hdbscan, "QUERIES", 8)
    rows = blobs(6, [30, 30, 20])
    rows = np.vstack([rows, rows[:12], np.repeat(rows[40:41], 15, axis=0)])
    found = hdbscan.spanning_tree(vectors(spark, rows), 2, block=40, lot=30, listed=2)
    assert sorted((r.a, r.b, r.w) for r in found.collect()) == sorted(brute_tree(rows, 2)) and asked


def test_density_clusters_search_once(spark, monkeypatch):
    """Neighbours are searched once, and nothing else compares vectors; the clusters equal brute force."""
    tasks = []

    def lists(cells, blocks, k, digits):
        tasks.append(int((blocks.first + blocks.pieces).max()))
        return neighbours.nearest_lists(cells, blocks, k, digits)

    monkeypatch.setattr(hdbscan, "nearest_lists", lists)
    monkeypatch.setattr(hdbscan, "tiles", None)  # not asked
    rows = np.random.default_rng(9).normal(size=(120, 16))
    v = vectors(spark, rows)
    found = hdbscan.spanning_tree(v, 3, block=30, lot=10)
    got = {r.node_id: r.p for r in hdbscan.density_labels(v, found, 3).collect()}
    assert [got[i] for i in range(len(rows))] == brute_labels(len(rows), brute_tree(rows, 3), 3)
    assert len(tasks) == 1 and 4 <= tasks[0] <= 8


@pytest.mark.parametrize("least", [3])
def test_condensed_tree_of_paths_and_stars(spark, least):
    """Chains of rising and falling weights, equal weights and a star."""
    r = random.Random(least)
    shapes = [[(i, i + 1, float(i + 1)) for i in range(14)], [(i, i + 1, float(abs(7 - i) + 1)) for i in range(14)], [(0, i, 1.0 + i % 3) for i in range(1, 15)]]
    shapes.append([(r.randrange(i), i, round(r.random(), 2) + 0.01) for i in range(1, 40)])
    for tree in shapes:
        n = len(tree) + 1
        edges = spark.createDataFrame(tree, "a long, b long, w double")
        got = {x.node_id: x.p for x in hdbscan.density_labels(spark.range(n).withColumnRenamed("id", "node_id"), edges, least).collect()}
        assert [got[i] for i in range(n)] == brute_labels(n, tree, least)


def test_high_hierarchies_take_few_jobs(spark):
    """Sixty clusters fall into a chain one by one; ranges of seven edges give the same as one range."""
    r, tree = random.Random(8), []
    for k in range(60):
        tree += [(3 * k + i, 3 * k + i + 1, round(0.01 + 0.01 * r.random(), 6)) for i in (0, 1)]
        tree += [(3 * k - 1, 3 * k, 1.0 + k)] if k else []
    nodes, edges = spark.range(180).withColumnRenamed("id", "node_id"), spark.createDataFrame(tree, "a long, b long, w double")
    want = brute_labels(180, tree, 3)
    for options in ({}, {"smallest": 7}):
        spark.sparkContext.setJobGroup(group := f"hierarchy{len(options)}", "")
        got = {x.node_id: x.p for x in hdbscan.density_labels(nodes, edges, 3, **options).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [got[i] for i in range(180)] == want and len(set(want)) > 2
        assert options or jobs < 150


def test_density_clusters_without_clusters(spark):
    few = vectors(spark, np.eye(3))
    assert {r.p for r in hdbscan.hdbscan(few, least=5).collect()} == {-1}
    with pytest.raises(ValueError, match="least"):
        hdbscan.hdbscan(few, least=1)


# --- vector communities ---------------------------------------------------------------------------------------------


def test_vector_communities_gain_level_by_level(spark):
    rows = blobs(5, [15, 15, 15], spread=0.1, noise=0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    v = vectors(spark, rows)
    near = neighbours.nearest_blocked(v, 4)
    rho = clustering.neighbour_threshold(v, near)
    found, trace = clustering.louvain_levels(v, near, rho, rows.shape[1], levels=3, rounds=6)
    labels = {r.node_id: r.g for r in found.collect()}
    sums = {}
    for i, g in labels.items():
        total, n = sums.get(g, (0, 0))
        sums[g] = (total + rows[i], n + 1)
    assert abs(trace[-1] - sum(float(s @ s) - rho * n * n for s, n in sums.values())) < 1e-6
    assert all(b >= a for a, b in zip(trace, trace[1:], strict=False))
    assert 0 < rho < 1 and len(sums) == 3 and all(len({labels[i] for i in range(k, k + 15)}) == 1 for k in (0, 15, 30))


def test_neighbours_of_communities_are_searched_once(spark):
    """Every reader of a neighbour table reads it from the shared folder: its rows are made in one place alone."""
    v = vectors(spark, blobs(5, [8, 8], spread=0.1, noise=0))
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    near = neighbours.nearest_blocked(v, 2).select("src", "dst", (1 - F.col("w")).alias("distance")).mapInArrow(count, "src long, dst long, distance double")
    for use in (lambda: clustering.louvain(v, near, 0.2, 6, 2), lambda: clustering.louvain_levels(v, near, None, 6, levels=1, rounds=2)[0], lambda: detectors.density_clusters(near, 2, 0.7)):
        made.value = 0
        use().collect()
        assert made.value == 32
