"""Algebraic invariants, quality on planted structure, and every registered query against its SQL."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import catalogue
from quillgraph.operators import algebra, clustering, detectors, graph, mapequation, metrics, sampling, spectral, walks
from quillgraph.operators.embeddings import PRESETS
from quillgraph.sources import generators, tables
from tests.verify_oracles import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


@pytest.mark.parametrize("name", ["l7_modularity_power", "l8_raw_modularity_power"])
def test_steps_until_a_limit_equal_sql_on_more_rows(spark, name):
    """The number of steps depends on the table."""
    larger = "/root/testdata/sf0.01"
    assert compare(spark, connect(larger), name, larger) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_karate(spark):
    k = generators.karate(spark)
    assert k.count() == 156 and graph.nodes_of(k).count() == 34


def test_rows_sum_to_one(spark):
    p = algebra.window_transition(generators.karate(spark), 3)
    assert p.groupBy("src").agg(F.sum("w").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_walks_follow_edges(spark):
    k = generators.karate(spark)
    w = walks.uniform_walks(k, 10, 2, backtrack=False)
    steps = w.select(F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i-1] as src, path[i] as dst))")).alias("e")).select("e.*")
    assert steps.join(k, ["src", "dst"], "left_anti").count() == 0
    assert w.filter(F.expr("exists(sequence(2, size(path) - 1), i -> size(path) > 2 and path[i] = path[i-2])")).count() == 0


def test_identical_partitions_score_one(spark):
    cells = metrics.contingency(spark.range(90).select((F.col("id") % 3).alias("y"), (F.col("id") % 3).alias("p")))
    assert abs(metrics.element_similarity(cells).first()["esim"] - 1) < 1e-9 and abs(metrics.mutual_information(cells).first()["nmi"] - 1) < 1e-9


def test_ring_of_cliques_recovered(spark):
    ring = generators.ring_of_cliques(spark, 50, 10)
    v = PRESETS["leigenmap"]().fit(ring).transform(4).withColumn("label", F.floor(F.col("node_id") / 10))
    cells = metrics.contingency(clustering.voronoi(v, "label", 4), "label", "p")
    assert metrics.element_similarity(cells).first()["esim"] > 0.9


def test_deflated_modularity_equals_dense_eigenvalues(spark):
    import numpy as np

    k = generators.karate(spark)
    a = np.zeros((34, 34))
    for r in k.collect():
        a[r["src"], r["dst"]] = r["w"]
    d, m = a.sum(1), a.sum()
    want = np.linalg.eigvalsh(a / m - np.outer(d, d) / m**2)
    model = PRESETS["modspec2"]().fit(k)
    assert model.transform(2).count() == 34
    assert np.allclose(model.values, want[np.argsort(-abs(want))][:2], atol=1e-4)


def test_losses_on_a_small_table(spark):
    import math

    from quillgraph.operators import losses

    pos = spark.createDataFrame([(0, 1, 2.0), (0, 2, -1.0), (1, 0, 0.0)], "center long, context long, score double")
    neg = spark.createDataFrame([(0, 1, 5, 1.0), (0, 2, 5, -800.0), (1, 0, 5, 800.0), (1, 0, 6, 0.5)], "center long, context long, negative long, score double")
    ls = lambda x: min(x, 0.0) - math.log1p(math.exp(-abs(x)))
    o = [(ls(2.0) + ls(-1.0)) / 2, ls(0.0)]
    n = [(ls(-1.0) + ls(800.0)) / 2, ls(-800.0) + ls(-0.5)]
    assert abs(losses.negative_sampling(pos, neg).first()[0] + (o[0] + n[0] + o[1] + n[1]) / 2) < 1e-9
    assert losses.negative_sampling(pos.limit(0), neg).first()[0] is None
    assert abs(losses.modularity_triplet(pos, neg, pos, 6).first()[0] - ((-399.5 + 800.5) / 2 - 0.25 + 3 * 5 / 3)) < 1e-9


def test_batch_run_twice_counts_once(spark, tmp_path):
    from quillgraph.streaming.incremental import merge_sums, read_sums

    merge, path = merge_sums(str(tmp_path / "sums"), 2), str(tmp_path / "sums")
    first = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "g long, vec array<double>")
    for epoch in (0, 0, 1):
        merge(first, epoch)
    got = {r["g"]: (r["n"], list(r["ls"])) for r in read_sums(spark, path, 2).collect()}
    assert got == {1: (4, [8.0, 12.0]), 2: (2, [10.0, 12.0])}


def test_sinks_replace_what_was_there(spark, tmp_path):
    from quillgraph.sources import tables

    k = generators.karate(spark)
    for _ in range(2):
        tables.write_edges(k, str(tmp_path / "net"))
    assert tables.read_edges(spark, str(tmp_path / "net")).count() == 156


def test_discriminant_uses_whole_vectors(spark):
    import numpy as np

    from quillgraph import catalogue
    from quillgraph.sources import tables

    d = "/root/testdata/sf0.001"
    rows = tables.vectors(spark, d).collect()
    x, y = np.array([r["vec"] for r in rows], float), np.array([r["label"] for r in rows])
    classes = np.unique(y)
    means = np.array([x[y == c].mean(axis=0) for c in classes])
    centered = x - means[np.searchsorted(classes, y)]
    weights = means @ np.linalg.pinv(centered.T @ centered / (len(x) - len(classes)))
    scores = x @ weights.T - 0.5 * (weights * means).sum(axis=1) + np.log([(y == c).mean() for c in classes])
    want = {r["node_id"]: int(classes[k]) for r, k in zip(rows, scores.argmax(axis=1), strict=True)}
    assert x.shape[1] == 64 and {r["node_id"]: r["p"] for r in catalogue.QUERIES["c10_lda"](spark, d).collect()} == want


def _ring_score(vectors, d):
    v = vectors.withColumn("label", F.floor(F.col("node_id") / 10))
    return metrics.element_similarity(metrics.contingency(clustering.voronoi(v, "label", d), "label", "p")).first()["esim"]


@pytest.mark.parametrize("loss", ["node2vec", "cbow", "modularity", "laplacian"])
def test_sampled_models_separate_cliques(spark, loss):
    from quillgraph.operators.embeddings import SampledEmbedding

    model = SampledEmbedding(loss, walk_length=20, num_walks=10, window_length=3, epochs=4, parts=2).fit(generators.ring_of_cliques(spark, 50, 10))
    inside = model.transform(8)
    outside = model.transform(8, return_out_vector=True)
    assert inside.count() == outside.count() == 50
    assert inside.join(outside.withColumnRenamed("vec", "other"), "node_id").filter("vec = other").count() == 0
    assert _ring_score(inside, 8) > 0.8


def test_nonbacktracking_columns_differ(spark):
    import numpy as np

    v = np.array([r.vec for r in PRESETS["nonbacktracking"]().fit(generators.karate(spark)).transform(4).orderBy("node_id").collect()])
    c = np.abs(np.corrcoef(v.T))
    np.fill_diagonal(c, 0)
    assert v.shape[0] == 34 and c.max() < 0.999


def test_cf_tree_keeps_sums_and_splits():
    import numpy as np

    from quillgraph.operators.detectors import _CFTree

    r = np.random.default_rng(2)
    x = r.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = _CFTree(0.8, 5, 6)
    for row in x:
        tree.insert(1.0, row)
    n, ls = zip(*tree.leaves())
    assert sum(n) == 400 and np.allclose(np.sum(ls, axis=0), x.sum(axis=0)) and len(n) > 25


def test_birch_finds_directions(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, (np.eye(5)[i % 5] + r.normal(scale=0.05, size=5)).tolist()) for i in range(200)]
    from quillgraph.operators.detectors import cosine_birch

    out = {x.node_id: x.p for x in cosine_birch(spark.createDataFrame(rows, "node_id long, vec array<double>"), 0.6, 5).collect()}
    assert len({(i % 5, p) for i, p in out.items()}) == 5 == len(set(out.values()))


def test_discriminant_auc_against_numpy(spark):
    import numpy as np

    from quillgraph.operators.detectors import discriminant_auc

    r = np.random.default_rng(4)
    y = np.arange(120) % 2
    x = r.normal(size=(120, 3)) + y[:, None] * np.array([0.8, 0.0, -0.4])
    m = [x[y == k].mean(axis=0) for k in (0, 1)]
    pooled = sum((x[y == k] - m[k]).T @ (x[y == k] - m[k]) for k in (0, 1)) / 118
    score = x @ np.linalg.solve(pooled, m[1] - m[0])
    want = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    frame = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "vec array<double>, label long")
    assert abs(discriminant_auc(frame, 3).first()["auc"] - max(want, 1 - want)) < 1e-9


def test_draws_follow_the_distribution(spark):
    from quillgraph.operators import sampling

    law = spark.createDataFrame([(0, 0.5), (1, 0.0), (2, 0.2), (7, 0.3)], "node_id long, p double")
    drawn = sampling.draw(spark.range(20000), sampling.whole_cdf(law), None, 9, "id").groupBy("drawn").count().collect()
    got = {r["drawn"]: r["count"] / 20000 for r in drawn}
    assert set(got) == {0, 2, 7} and all(abs(got[k] - p) < 0.015 for k, p in ((0, 0.5), (2, 0.2), (7, 0.3)))


def test_running_sum_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    out = graph.running_sum(rows, ["k"], F.col("k"), "s").collect()
    assert all(r.s == r.k * (r.k + 1) // 2 for r in out) and len(out) == 1000


def test_dense_spectrum_refuses_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(algebra, "DENSE_NODES", 10)
    with pytest.raises(ValueError):
        algebra.dense_spectrum(generators.karate(spark))


def test_components_of_paths(spark):
    edges = spark.range(500).filter("id % 100 <> 99").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = graph.connected_components(edges).collect()
    assert all(r.component == r.node_id // 100 * 100 for r in out) and len(out) == 500


def test_graph_of_parts_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """More line items make more tasks, each pair counted once however the rows are dealt."""
    lines = [(o, (o * k) % 11) for o in range(60) for k in (1, 2, 3)] + [(0, 5), (1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    counts = {}
    for o in range(60):
        mine = [p for x, p in lines if x == o]
        for a in mine:
            for b in mine:
                if a < b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    want = {e for (a, b), n in counts.items() if n >= 2 for e in ((a, b), (b, a))}
    monkeypatch.setattr(tables, "ROWS_A_TASK", 10)
    found = tables.parts(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 19 and sorted((r.src, r.dst) for r in found.collect()) == sorted(want)


def test_detectors_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, w double").mapInArrow(count, "src long, dst long, w double")
    start = spark.range(6).select(F.col("id").alias("node_id"), (1.0 + F.col("id")).alias("val"))
    for use in (lambda: detectors.label_switching(edges, rounds=2), lambda: detectors.block_model(edges, 2, 2), lambda: algebra.raw_modularity_power(edges, start, 2), lambda: mapequation.flows(edges)[0]):
        made.value = 0
        use().collect()
        assert made.value == 14


def test_scores_of_all_pairs_over_several_blocks(spark, monkeypatch):
    """Each pair once, whatever the blocks; the work is dealt out by pairs of blocks."""
    r = np.random.default_rng(3)
    rows = np.vstack([r.normal(size=(57, 4)), np.ones((3, 4))])
    label = [i % 3 for i in range(60)]
    v = spark.createDataFrame([(i, [float(x) for x in x], label[i]) for i, x in enumerate(rows)], "node_id long, vec array<double>, label long").coalesce(1)
    monkeypatch.setattr(metrics, "TILE", 9)
    want = {}
    for i in range(60):
        for j in range(i + 1, 60):
            pair = want.setdefault(round(float(rows[i] @ rows[j]), 6), [0, 0])
            pair[label[i] != label[j]] += 1
    found = metrics.scored_pairs(v, 6).groupBy("score").agg(F.sum("pos"), F.sum("neg")).collect()
    assert {x[0]: [x[1], x[2]] for x in found} == want
    assert sum(x.n for x in metrics.log_distances(v).collect()) == 60 * 59 // 2


def test_no_pair_becomes_a_row(spark, monkeypatch):
    """AUC and average precision of all pairs by ranges of scores equal a count of the pairs; runs of scores are passed on, not scores."""
    r = np.random.default_rng(4)
    rows = np.vstack([r.normal(size=(150, 3)).round(1), np.ones((30, 3)), 40 * r.normal(size=(20, 3))])
    label = [i % 4 for i in range(200)]
    v = spark.createDataFrame([(i, [float(x) for x in x], label[i]) for i, x in enumerate(rows)] + [(200, None, 1), (201, [1.0] * 3, None)], "node_id long, vec array<double>, label long")
    i, j = np.triu_indices(200, 1)
    score = np.round((rows[i] * rows[j]).sum(axis=1), 6)
    same = np.equal(label, np.array(label)[:, None])[i, j]
    at, of = np.unique(score, return_inverse=True)
    pos, neg = (np.bincount(of, x, len(at)) for x in (same, ~same))
    auc = (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())
    tp, seen = (np.cumsum(x[::-1])[::-1] for x in (pos, pos + neg))
    ap = (pos * tp / seen).sum() / pos.sum()
    monkeypatch.setattr(metrics, "WIDE_TILE", 70)
    for dense, few in ((1 << 22, 1 << 22), (1 << 14, 300), (1 << 30, 1)):  # one range, sorted or counted in an array
        monkeypatch.setattr(metrics, "DENSE", dense)
        monkeypatch.setattr(metrics, "FEW_PAIRS", few)
        monkeypatch.setattr(metrics, "MOST_PAIRS", 500 if dense == 1 << 14 else 1 << 26)
        monkeypatch.setattr(metrics, "BINS", 20 if dense < 1 << 30 else 8)
        if dense < 1 << 30:
            assert abs(metrics.all_pairs_auc(v, 6).first().auc - auc) < 1e-12
            assert abs(metrics.all_pairs_precision(v, 6).first().ap - ap) < 1e-12
        ranges = metrics.by_score(v, lambda s, p, n, below, above: pa.table({"rows": [len(s)], "pairs": [int((p + n).sum())], "other": [sum(below + above)]}), "rows long, pairs long, other long", 6).collect()
        assert sum(x.pairs for x in ranges) == len(i) and sum(x.rows for x in ranges) == len(at)
        assert {x.pairs + x.other for x in ranges} == {len(i)}
        assert dense != 1 << 14 or len(ranges) > 10
    assert metrics.all_pairs_auc(v.limit(1)).first().auc is None and metrics.all_pairs_precision(v.limit(0)).first().ap is None


def test_trade_is_made_once(spark, tmp_path):
    """What is made of the trade network reads its few rows, not the line items again; keys that meet nothing are left out."""
    tables_of = {
        "lineitem": ("l_orderkey long, l_suppkey long", [(1, 1), (1, 1), (1, 2), (2, 1), (3, 9), (8, 1), (4, 2), (None, 1)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 5), (2, 6), (3, 5), (4, 7)]),
        "customer": ("c_custkey long, c_nationkey int", [(5, 0), (6, 1)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 3)]),
    }
    for name, (schema, rows) in tables_of.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    trade = tables.trade(spark, str(tmp_path))
    assert sorted(tuple(r) for r in trade.collect()) == [(0, 0, 2.0), (0, 3, 1.0), (1, 0, 1.0)]
    assert not [f for f in trade.inputFiles() if "lineitem" in f]


def test_edges_are_made_once(spark):
    """Walks by budget and samples of losses read the edges that they are given once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ring = spark.createDataFrame([(i, (i + s) % 6, 1.0) for i in range(6) for s in (1, 5)], "src long, dst long, w double").mapInArrow(count, "src long, dst long, w double")
    assert walks.token_budget_walks(ring, 4, 2).count() == 12 and made.value == 12
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "node_id long, vec array<double>")
    made.value = 0
    samples = spectral.loss_samples(ring, 2, 7, 6)
    assert spectral.batch_losses(samples, vectors, {"edge": (-1.0, 1), "random": (1.0, 1), "base": (1.0, 2)}, 2).count() == 2 and made.value == 12


def test_positive_pairs_of_one_large_label_over_tiles(spark):
    """Lots of seven, labels of different sizes and a null label: every pair once, and one label is the work of several tasks."""
    rows = [(i, 0 if i < 40 else None if i < 43 else 1 + i % 2) for i in range(60)]
    items = spark.createDataFrame(rows, "node_id long, label long")
    got = sampling.positive_pairs(items, lot=7)
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x is not None and x == y)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.filter("a < 40").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sampling.positive_pairs(items.limit(0)).collect() == []
