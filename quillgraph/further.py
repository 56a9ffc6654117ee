"""More registered queries: sources, generators, walks, samplers, training samples, decompositions, streams.

They join those of :mod:`quillgraph.catalogue` in the same two tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import EVT, PARTS, REGIONS, TOP, TRADE, VECS, _folder, query, r6, rounded, trade
from .functions import prng
from .operators import algebra, graph, results, sampling, walks
from .plans.lineage import shared_folder
from .sources import generators, tables

# ------------------------------------------------------------ sources and sinks


@query(f"WITH {REGIONS} SELECT node_id, membership::INTEGER AS membership FROM regions")
def s2_membership_csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.regions(s, d).select("node_id", "membership").write.option("header", True).csv(path)
    return tables.read_membership(s, path)


@query(f"WITH {REGIONS} SELECT v.variant AS variant, membership, count(*) AS n FROM regions, (VALUES ('a'), ('b')) v(variant) WHERE variant = 'a' OR node_id % 2 = 0 GROUP BY 1, 2")
def s4_partition_bundle(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    r = tables.regions(s, d).select("node_id", "membership")
    tables.write_partitions(r.withColumn("variant", F.lit("a")).unionByName(r.filter("node_id % 2 = 0").withColumn("variant", F.lit("b"))), path)
    parts = [p.groupBy("membership").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("variant"), "membership", "n") for v, p in tables.read_partitions(s, path).items()]
    return results.concat_results(parts)


def _score_files(s: SparkSession, d: str, sep: str) -> str:
    """A folder of score tables, one for each (K, mu), named by their parameters."""
    path = _folder(s)
    scores = tables.read(s, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("score"))
    for odd, k, mu in ((1, 2, "0.10"), (0, 50, "0.55")):
        scores.filter(F.col("s_suppkey") % 2 == odd).write.option("header", True).csv(f"{path}/score_K{sep}{k}_mu{sep}{mu}_x.csv")
    return path


_LOADED = "SELECT s_suppkey, round(s_acctbal, 2) AS score, CASE s_suppkey % 2 WHEN 1 THEN 2 ELSE 50 END::INTEGER AS k, CASE s_suppkey % 2 WHEN 1 THEN 0.1 ELSE 0.55 END::DOUBLE AS mu FROM supplier"



def _loaded(s: SparkSession, path: str, sep: str) -> DataFrame:
    rows = results.load_files(s, f"{path}/*.csv", "s_suppkey long, score double", sep)
    wide = results.to_numeric(results.widen(rows, ["K", "mu"]), ["K"], ["mu"])
    return wide.select("s_suppkey", "score", F.col("K").alias("k"), "mu")


@query(_LOADED)
def s5_s7_load_files(s: SparkSession, d: str) -> DataFrame:
    return _loaded(s, _score_files(s, d, "~"), "~")


@query(_LOADED)
def s6_load_files_equals(s: SparkSession, d: str) -> DataFrame:
    return _loaded(s, _score_files(s, d, "="), "=")


@query(f"WITH {TRADE} SELECT src, dst, 1.0::DOUBLE AS w FROM trade")
def s9_edge_text(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_edge_text(trade(s, d), path)
    return tables.read_edge_text(s, path)


@query("SELECT l_suppkey::BIGINT AS src, l_linenumber::BIGINT AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2")
def s10_as_edges(s: SparkSession, d: str) -> DataFrame:
    return tables.as_edges(tables.read(s, d, "lineitem"), "l_suppkey", "l_linenumber")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS score FROM supplier")
def k6_results_json(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_results(tables.read(s, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("score")), path)
    return s.read.schema("s_suppkey long, score double").json(path)


# ------------------------------------------------------------ generators


@query(f"""WITH r AS (SELECT n_nationkey::BIGINT AS g, (n_nationkey * 37)::BIGINT AS n, ((n_nationkey - 3) / 20.0)::DOUBLE AS p FROM nation),
t AS (SELECT g, count(*) AS e FROM (SELECT g, p, unnest(range(1, n + 1)) AS k FROM r) WHERE {prng.uniform_sql(4, 'g', 'k')} < p GROUP BY g)
SELECT r.g, CASE WHEN p <= 0 OR n <= 0 THEN 0 WHEN p >= 1 THEN n ELSE coalesce(e, 0) END::BIGINT AS edges FROM r LEFT JOIN t USING (g)""")
def n2_edge_counts(s: SparkSession, d: str) -> DataFrame:
    r = tables.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("g"), (F.col("n_nationkey") * 37).cast("long").alias("n"), ((F.col("n_nationkey") - 3) / 20.0).alias("p"))
    return generators.edge_counts(r, 4, "g").select("g", "edges")


@query("SELECT cdiff, " + r6("greatest(1, (1000 - 500) / 1000.0 * cdiff + 50)") + " AS cin, " + r6("greatest(1, 50 - 500 / 1000.0 * cdiff)") + " AS cout FROM (VALUES (30.0::DOUBLE), (100.0::DOUBLE)) t(cdiff)")
def n3_difference_degrees(s: SparkSession, d: str) -> DataFrame:
    return rounded(s.createDataFrame([(c, *generators.difference_degrees(50.0, c, 1000, 2)) for c in (30.0, 100.0)], "cdiff double, cin double, cout double"), "cin", "cout")


@query(f"""WITH n AS (SELECT range AS i, range // 60 AS g FROM range(120)), p AS (SELECT a.i AS src, b.i AS dst FROM n a JOIN n b ON a.i < b.i WHERE {prng.uniform_sql(2, 'a.i', 'b.i')} < CASE WHEN a.g = b.g THEN 18.0 / 120 ELSE 6.0 / 120 END)
SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT * FROM p UNION ALL SELECT dst, src FROM p)""")
def n4_n11_two_communities(s: SparkSession, d: str) -> DataFrame:
    return generators.two_communities(s, 120, 12.0, 12.0, seed=2)[0]


@query(f"WITH n AS (SELECT range AS i, range // 25 AS g FROM range(100)) SELECT a.i AS src, b.i AS dst, 1.0::DOUBLE AS w FROM n a JOIN n b ON a.i <> b.i WHERE {prng.uniform_sql(5, 'a.i', 'b.i')} < CASE WHEN a.g = b.g THEN 16.0 / 100 ELSE 4.0 / 100 END")
def n5_ordered_pairs(s: SparkSession, d: str) -> DataFrame:
    return generators.ordered_partition(s, 100, 4, 16.0, 4.0, seed=5)[0]


_POISSON = " + ".join(f"(u >= {'+'.join(f'exp(-r) * pow(r, {i}) / {f}' for i, f in list(enumerate((1, 1, 2, 6, 24, 120, 720, 5040)))[: k + 1])})::INTEGER" for k in range(8))


@query(f"""WITH n AS (SELECT range AS i, (range >= 40)::BIGINT AS g FROM range(80)), p AS (SELECT a.i AS src, b.i AS dst, CASE WHEN a.g = b.g THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS r, {prng.uniform_sql(1, 'a.i', 'b.i')} AS u FROM n a JOIN n b ON a.i < b.i),
h AS (SELECT src, dst, ({_POISSON})::DOUBLE AS w FROM p) SELECT src, dst, w FROM h WHERE w > 0 UNION ALL SELECT dst, src, w FROM h WHERE w > 0""")
def n9_poisson_blocks(s: SparkSession, d: str) -> DataFrame:
    return generators.poisson_blocks(s, [40, 40], [[0.3, 0.1], [0.1, 0.3]])[0]


_H = lambda *parts: prng.bits_sql(6, *parts)


@query(f"""WITH n AS (SELECT n_nationkey::BIGINT AS node_id, n_regionkey::BIGINT AS g, (2 + n_nationkey % 5)::INTEGER AS ko, (2 + (n_nationkey * 3) % 5)::INTEGER AS ki FROM nation),
o AS (SELECT node_id, g, unnest(range(1, ko + 1)) AS k FROM n), o2 AS (SELECT node_id, k, CASE WHEN {prng.uniform_sql(6, "'mix'", 'node_id', 'k')} < 0.3 THEN (g + 1 + {_H("'to'", 'node_id', 'k')} % 4) % 5 ELSE g END AS grp FROM o),
i AS (SELECT node_id, g AS grp, unnest(range(1, ki + 1)) AS k FROM n),
a AS (SELECT node_id AS src, grp, row_number() OVER (PARTITION BY grp ORDER BY {_H("'out'", 'node_id', 'k')}, node_id, k) AS r FROM o2), b AS (SELECT node_id AS dst, grp, row_number() OVER (PARTITION BY grp ORDER BY {_H("'in'", 'node_id', 'k')}, node_id, k) AS r FROM i)
SELECT src, dst, count(*)::DOUBLE AS w FROM a JOIN b USING (grp, r) GROUP BY 1, 2""")
def n10_stub_matching(s: SparkSession, d: str) -> DataFrame:
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("membership"))
    n = n.withColumn("k_out", (2 + F.col("node_id") % 5).cast("int")).withColumn("k_in", (2 + F.col("node_id") * 3 % 5).cast("int"))
    return generators.stub_matching(n, 0.3, 5, seed=6)


@query("SELECT n::BIGINT AS n, floor(sqrt(10 * n))::BIGINT AS maxk, ceil(n / 4)::BIGINT AS maxc FROM (VALUES (1000), (10000), (99)) t(n)")
def n13_lfr_defaults(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(n, *generators.lfr_defaults(n)) for n in (1000, 10000, 99)], "n long, maxk long, maxc long")


@query(f"WITH n AS (SELECT range AS i, range // 10 AS g FROM range(40)) SELECT a.i AS i, b.i AS j, {r6('((16.0 - 4.0) / 40) * ((a.g = b.g)::INTEGER - 0.25)')} AS product FROM n a JOIN n b ON a.i <= b.i")
def n14_truth_embedding(s: SparkSession, d: str) -> DataFrame:
    e = generators.truth_embedding(s, 40, 4, 16.0, 4.0)
    from .functions.vectors import dot

    a, b = e.select(F.col("node_id").alias("i"), F.col("vec").alias("u")), e.select(F.col("node_id").alias("j"), F.col("vec").alias("v"))
    return rounded(a.join(b, F.col("i") <= F.col("j")).select("i", "j", dot("u", "v").alias("product")), "product")


# ------------------------------------------------------------ reshaping and windows


@query(f"WITH {VECS} SELECT node_id, CASE WHEN vec[1] >= 0 THEN (vec[2] > 0)::BIGINT::DOUBLE END AS p FROM vecs")
def p5_scatter_back(s: SparkSession, d: str) -> DataFrame:
    from .functions import vectors as V

    v = tables.vectors(s, d).withColumn("vec", F.transform("vec", lambda x, i: F.when((i == 0) & (x < 0), float("nan")).otherwise(x)))
    labelled = v.filter(V.is_whole("vec")).select("node_id", (F.col("vec")[1] > 0).cast("double").alias("p"))
    return graph.reexpand(v.select("node_id"), labelled)


@query(f"WITH {TRADE} SELECT src, dst, {r6('sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) / greatest(sum(w) OVER (PARTITION BY src), 1)')} AS cumulated FROM trade")
def w2_cumulated(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("src")
    run = F.sum("w").over(by.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("w").over(by), F.lit(1.0))
    return rounded(trade(s, d).select("src", "dst", run.alias("cumulated")), "cumulated")


_RANKED = VECS + ", v AS (SELECT node_id AS id, round(vec[1] * list_sum(vec), 9) AS value FROM vecs)"


@query(f"WITH {_RANKED} SELECT id, r AS rank, kind FROM (SELECT id, 'descending' AS kind, row_number() OVER (ORDER BY value DESC, id)::INTEGER AS r FROM v UNION ALL SELECT id, 'magnitude', row_number() OVER (ORDER BY abs(value) DESC, id)::INTEGER FROM v UNION ALL SELECT id, 'ascending', row_number() OVER (ORDER BY value, id)::INTEGER FROM v) WHERE r <= 10")
def w9_ranked_values(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d).select(F.col("node_id").alias("id"), F.round(F.col("vec")[0] * F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 9).alias("value"))
    return results.concat_results([algebra.ranked_values(v, k, 10).select("id", "rank", F.lit(k).alias("kind")) for k in ("descending", "magnitude", "ascending")])


@query(f"WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c FROM nation), k AS (SELECT range AS k, floor({prng.uniform_sql(8, 'range')} * 25)::BIGINT AS i FROM range(60)) SELECT k, n_name FROM k JOIN n USING (i)")
def o6_with_replacement(s: SparkSession, d: str) -> DataFrame:
    n = graph.running_sum(tables.read(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], F.lit(1), "at").withColumn("index", F.col("at").cast("long") - 1)
    return sampling.with_replacement(s.range(60).withColumnRenamed("id", "k"), n.count(), 8, "k").join(n, "index").select("k", "n_name")


_BLOCKS = f"{TRADE}, {REGIONS}, b0 AS (SELECT a.membership AS src, c.membership AS dst, sum(w) AS w FROM trade JOIN regions a ON src = a.node_id JOIN regions c ON dst = c.node_id GROUP BY 1, 2), b AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM b0)"
_B3 = _BLOCKS + ", b2 AS (SELECT x.src, y.dst, sum(x.w * y.w) AS w FROM b x JOIN b y ON x.dst = y.src GROUP BY 1, 2), b3 AS (SELECT x.src, y.dst, sum(x.w * y.w) AS w FROM b2 x JOIN b y ON x.dst = y.src GROUP BY 1, 2)"
_SHARE = "share AS (SELECT dst AS node_id, membership, sum(w) / sum(sum(w)) OVER (PARTITION BY membership) AS p FROM trade JOIN regions ON dst = node_id GROUP BY 1, 2)"


@query(f"WITH {_B3}, {_SHARE} SELECT b3.src AS g, node_id, {r6('b3.w * p')} AS p FROM b3 JOIN share ON membership = b3.dst")
def a10_partial_propagation(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.partial_propagation(trade(s, d), tables.regions(s, d), 3), "p")


# ------------------------------------------------------------ walks

WTOP = TOP + ", wtop AS (SELECT src, dst, (1 + (src + dst) % 4)::DOUBLE AS w FROM top)"


def _weighted(s: SparkSession, d: str) -> DataFrame:
    return tables.trade_top(s, d).withColumn("w", (1 + (F.col("src") + F.col("dst")) % 4).cast("double"))


def _path(w: DataFrame, *keys: str) -> DataFrame:
    return w.select(*keys, F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _weighted_walk_sql(length: int, rounds: int) -> str:
    cdf = "CASE WHEN row_number() OVER (PARTITION BY src ORDER BY dst) = count(*) OVER (PARTITION BY src) THEN 1.0 ELSE round(sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY src), 12) END AS cdf"
    parts = [WTOP, f"c AS (SELECT src AS cur, dst AS nxt, {cdf} FROM wtop)", f"w0 AS (SELECT src AS start, r.range AS round, [src] AS path FROM (SELECT DISTINCT src FROM wtop), range({rounds}) r)"]
    for t in range(1, length):
        parts.append(f"w{t} AS (SELECT start, round, list_append(any_value(path), arg_min(nxt, (cdf, nxt))) AS path FROM w{t - 1} JOIN c ON cur = path[-1] WHERE cdf >= {prng.uniform_sql(1, 'start', 'round', str(t))} GROUP BY start, round)")
    return f"WITH {', '.join(parts)} SELECT start, round, array_to_string(path, ',') AS path FROM w{length - 1}"


@query(_weighted_walk_sql(6, 1))
def r2_walk_weighted(s: SparkSession, d: str) -> DataFrame:
    return _path(walks.weighted_walks(_weighted(s, d), 6), "start", "round")


@query(_weighted_walk_sql(5, 3))
def r3_r4_simulate(s: SparkSession, d: str) -> DataFrame:
    return _path(walks.simulate(_weighted(s, d), 5, 3), "start", "round")


_SPARSE = TOP + ", sp AS (SELECT src, dst FROM top WHERE (src + dst) % 3 = 0)"
_NB = f"""nb AS (SELECT src, list_sort(list(dst)) AS next FROM sp GROUP BY src), walk(start, round, path) AS (SELECT src, r.range, [src] FROM nb, range(12) r UNION ALL
SELECT start, round, list_append(path, o[({prng.bits_sql(1, 'start', 'round', 'len(path)')} % len(o))::BIGINT + 1]) FROM (SELECT w.start, w.round, w.path, CASE WHEN len(w.path) > 1 THEN list_filter(nb.next, lambda x: x <> w.path[-2]) ELSE nb.next END AS o FROM walk w JOIN nb ON nb.src = w.path[-1] WHERE len(w.path) < 6) WHERE len(o) > 0)"""


@query(f"""WITH RECURSIVE {_SPARSE}, {_NB}, whole AS (SELECT start, round, arg_max(path, len(path)) AS path FROM walk GROUP BY 1, 2), sizes AS (SELECT round, sum(len(path)) AS n FROM whole GROUP BY 1),
ok AS (SELECT round FROM (SELECT round, coalesce(sum(n) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes) WHERE before < 6 * 4 * (SELECT count(*) FROM nb)) SELECT start, round, array_to_string(path, ',') AS path FROM whole JOIN ok USING (round)""")
def r6_token_budget(s: SparkSession, d: str) -> DataFrame:
    return _path(walks.token_budget_walks(tables.trade_top(s, d).filter("(src + dst) % 3 = 0"), 6, 4), "start", "round")


@query(f"WITH RECURSIVE {_SPARSE}, {_NB} SELECT start, array_to_string((arg_max(path, len(path)) || [-1, -1, -1, -1, -1, -1])[1:6], ',') AS path FROM walk WHERE round = 0 GROUP BY start")
def r7_padded_walks(s: SparkSession, d: str) -> DataFrame:
    w = walks.uniform_walks(tables.trade_top(s, d).filter("(src + dst) % 3 = 0"), 6, backtrack=False)
    return _path(walks.padded(w, 6), "start")


@query(f"WITH {TOP}, e AS (SELECT r.range AS epoch, src AS start, {prng.bits_sql(1, 'r.range', 'src')} AS h FROM (SELECT DISTINCT src FROM top), range(3) r) SELECT epoch, start, row_number() OVER (PARTITION BY epoch ORDER BY h, start)::INTEGER AS position FROM e")
def r8_epochs(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = walks.epochs(tables.trade_top(s, d), 3)
    return e.select("epoch", "start", F.row_number().over(Window.partitionBy("epoch").orderBy("position_key", "start")).alias("position"))


# ------------------------------------------------------------ samplers and training samples

_LAST = "CASE WHEN row_number() OVER (PARTITION BY {g} ORDER BY {n}) = count(*) OVER (PARTITION BY {g}) THEN 1.0 ELSE round(sum({p}) OVER (PARTITION BY {g} ORDER BY {n} ROWS UNBOUNDED PRECEDING) / sum({p}) OVER (PARTITION BY {g}), 12) END"


@query(f"""WITH {_B3}, {_SHARE}, mean AS (SELECT src, dst, sum(w) / 3 AS p FROM (SELECT * FROM b UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) GROUP BY 1, 2), rc AS (SELECT src, dst, {_LAST.format(g='src', n='dst', p='p')} AS cdf FROM mean),
nc AS (SELECT membership, node_id, {_LAST.format(g='membership', n='node_id', p='p')} AS cdf FROM share), q AS (SELECT node_id AS center, membership, k.range AS k FROM regions, range(4) k),
q2 AS (SELECT center, k, arg_min(rc.dst, (cdf, rc.dst)) AS block FROM q JOIN rc ON rc.src = membership WHERE cdf >= {prng.uniform_sql(21, 'center', 'k')} GROUP BY 1, 2)
SELECT center, k, block, arg_min(node_id, (cdf, node_id)) AS drawn FROM q2 JOIN nc ON membership = block WHERE cdf >= {prng.uniform_sql(22, 'center', 'k')} GROUP BY 1, 2, 3""")
def m1_block_samples(s: SparkSession, d: str) -> DataFrame:
    asked = tables.regions(s, d).select(F.col("node_id").alias("center"), F.explode(F.expr("sequence(0L, 3L)")).alias("k"))
    return sampling.block_noise(asked, trade(s, d), tables.regions(s, d), 21, "center", "k", window=3)


def _noise_sql(p: str, seed: int) -> str:
    return f"cdf AS (SELECT node_id, CASE WHEN node_id = max(node_id) OVER () THEN 1.0 ELSE round(sum(p) OVER (ORDER BY node_id ROWS UNBOUNDED PRECEDING), 12) END AS cdf FROM ({p})) SELECT center, k, arg_min(node_id, (cdf, node_id)) AS drawn FROM (SELECT n_nationkey::BIGINT AS center, r.range AS k FROM nation, range(4) r) JOIN cdf ON cdf >= {prng.uniform_sql(seed, 'center', 'k')} GROUP BY 1, 2"


def _asked(s: SparkSession, d: str) -> DataFrame:
    return tables.regions(s, d).select(F.col("node_id").alias("center"), F.explode(F.expr("sequence(0L, 3L)")).alias("k"))


@query(f"WITH {TRADE}, " + _noise_sql("SELECT dst AS node_id, pow(sum(w), 0.75) / sum(pow(sum(w), 0.75)) OVER () AS p FROM trade GROUP BY dst", 31))
def m2_config_samples(s: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_asked(s, d), sampling.whole_cdf(sampling.noise_distribution(trade(s, d), 0.75)), None, 31, "center", "k")


@query(f"WITH {TRADE}, " + _noise_sql("SELECT node_id, 1.0 / count(*) OVER () AS p FROM (SELECT src AS node_id FROM trade UNION SELECT dst FROM trade)", 33))
def m3_uniform_samples(s: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_asked(s, d), sampling.whole_cdf(sampling.uniform_distribution(trade(s, d))), None, 33, "center", "k")


_PAIRS = f"{EVT}, pr AS (SELECT a.user_id, a.pos::INTEGER AS pos, a.k AS center, b.k AS context FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN 1 AND 2)"
_TRIPLES = _PAIRS + f""", fr AS (SELECT k AS node_id, pow(count(*), 0.75) AS v FROM ev GROUP BY k), ns AS (SELECT node_id, CASE WHEN node_id = max(node_id) OVER () THEN 1.0 ELSE round(sum(v) OVER (ORDER BY node_id ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 12) END AS cdf FROM fr),
st AS (SELECT node_id, cdf, coalesce(lag(cdf) OVER (ORDER BY node_id), -1) AS low FROM ns),
tr AS (SELECT user_id, pos, center, context, k, node_id AS negative FROM (SELECT pr.*, r.range::INTEGER AS k, {prng.uniform_sql(41, 'user_id', 'pos', 'context', 'r.range')} AS u FROM pr, range(2) r) JOIN st ON low < u AND u <= cdf)"""


def _samples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Context pairs of the event sequences and the noise distribution of the event types."""
    paths = tables.event_sequences(s, d)
    seen = paths.select(F.explode("path").alias("node_id")).groupBy("node_id").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(0.75)).alias("v"))
    noise = seen.crossJoin(F.broadcast(seen.agg(F.sum("v").alias("t")))).select("node_id", (F.col("v") / F.col("t")).alias("p"))  # one row is broadcast
    return walks.context_pairs(paths, ["user_id"], 2, "right"), noise


@query(f"WITH {_TRIPLES} SELECT * FROM tr")
def m6_m8_triplets(s: SparkSession, d: str) -> DataFrame:
    pairs, noise = _samples(s, d)
    return sampling.triplets(pairs, noise, 2, 41, "user_id", "pos", "context").select("user_id", "pos", "center", "context", "k", "negative")


_BASE = "floor({u} * 5)::BIGINT"


@query(f"WITH {_TRIPLES} SELECT tr.*, {_BASE.format(u=prng.uniform_sql(43, chr(39) + 'center' + chr(39), 'user_id', 'pos', 'context', 'k'))} AS base_center, {_BASE.format(u=prng.uniform_sql(43, chr(39) + 'context' + chr(39), 'user_id', 'pos', 'context', 'k'))} AS base_context FROM tr")
def m7_base_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs, noise = _samples(s, d)
    rows = sampling.triplets(pairs, noise, 2, 41, "user_id", "pos", "context").select("user_id", "pos", "center", "context", "k", "negative")
    return sampling.with_base_pairs(rows, 5, 43, "user_id", "pos", "context", "k")


@query(f"WITH {_TRIPLES} SELECT user_id, pos, center, context, 1.0::DOUBLE AS y FROM pr UNION ALL SELECT user_id, pos, center, negative, -1.0::DOUBLE FROM tr")
def m9_signed_pairs(s: SparkSession, d: str) -> DataFrame:
    # the key column `context` names the pair's own context while noise is drawn
    pairs, noise = _samples(s, d)
    keyed = pairs.withColumn("own", F.col("context"))
    return sampling.signed_pairs(keyed, noise, 2, 41, "user_id", "pos", "own").drop("own")


@query(f"WITH {_TRIPLES} SELECT user_id, pos, center, context, 1.0::DOUBLE AS y, 1 AS power FROM pr UNION ALL SELECT user_id, pos, center, negative, -1.0::DOUBLE, 1 FROM tr UNION ALL SELECT user_id, pos, {_BASE.format(u=prng.uniform_sql(41, chr(39) + 'center' + chr(39), 'user_id', 'pos', 'context'))}, {_BASE.format(u=prng.uniform_sql(41, chr(39) + 'context' + chr(39), 'user_id', 'pos', 'context'))}, -0.5::DOUBLE, 2 FROM pr")
def m10_modularity_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs, noise = _samples(s, d)
    keyed = pairs.withColumn("own", F.col("context"))
    return sampling.modularity_pairs(keyed, noise, 5, 2, 41, "user_id", "pos", "own").drop("own")


# ------------------------------------------------------------ decompositions, by what SQL can say of them

_SQ = "s2 AS (SELECT a.src, b.src AS dst, sum(a.w * b.w) AS w FROM {t} a JOIN {t} b ON a.dst = b.dst GROUP BY 1, 2)"


@query(f"WITH {TRADE}, {_SQ.format(t='trade')} SELECT round((SELECT sum(w * w) FROM trade), 1) AS second, round(sqrt(sum(w * w)), 1) AS fourth FROM s2")
def l3_l4_randomized_svd(s: SparkSession, d: str) -> DataFrame:
    """All singular values of the trade table: the sum of their squares, and the root of that of their fourth powers."""
    values, _, _ = algebra.randomized_svd(trade(s, d), 25, oversampling=0, power=2)
    v = s.createDataFrame([(float(x),) for x in values], "s double")
    return v.agg(F.round(F.sum(F.pow("s", F.lit(2.0))), 1).alias("second"), F.round(F.sqrt(F.sum(F.pow("s", F.lit(4.0)))), 1).alias("fourth"))


_SUM = TRADE + ", p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM trade), pp AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM p a JOIN p b ON a.dst = b.src GROUP BY 1, 2), f AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM p UNION ALL SELECT * FROM pp) GROUP BY 1, 2)"


@query(f"WITH {_SUM}, {_SQ.format(t='f')} SELECT {r6('(SELECT sum(w * w) FROM f)')} AS second, {r6('sqrt(sum(w * w))')} AS fourth FROM s2")
def l5_factored_svd(s: SparkSession, d: str) -> DataFrame:
    """The same for P + P P, of which no product is built."""
    p = graph.row_probability(trade(s, d)).select("src", "dst", "w")
    values, _, _ = algebra.factored_svd([[p], [p, p]], 25, oversampling=0, power=1)
    v = s.createDataFrame([(float(x),) for x in values], "s double")
    return rounded(v.agg(F.sum(F.pow("s", F.lit(2.0))).alias("second"), F.sqrt(F.sum(F.pow("s", F.lit(4.0)))).alias("fourth")), "second", "fourth")


@query(f"WITH {_SUM} SELECT dst AS src, src AS dst, {r6('w')} AS w FROM f")
def l6_assembled_transpose(s: SparkSession, d: str) -> DataFrame:
    p = graph.row_probability(trade(s, d)).select("src", "dst", "w")
    return rounded(algebra.assembled(algebra.transposed([[p], [p, p]])), "w")


def _raw_power_sql(steps: int) -> str:
    start = "1 + ((node_id * 7919) % 101) / 101.0::DOUBLE"
    parts = [TOP, "dg AS (SELECT src AS node_id, sum(w) AS d FROM top GROUP BY src)", "mm AS (SELECT sum(w) AS m FROM top)", f"x0 AS (SELECT node_id, {start} AS val FROM dg)", "c0 AS (SELECT false AS done)"]
    for k in range(1, steps + 1):
        parts.append(f"y{k} AS (SELECT node_id, ax - d * (SELECT sum(d * val) FROM dg JOIN x{k - 1} USING (node_id)) / m AS y FROM dg JOIN (SELECT src AS node_id, sum(w * val) AS ax FROM top JOIN x{k - 1} ON dst = node_id GROUP BY src) USING (node_id), mm)")
        parts.append(f"n{k} AS (SELECT node_id, CASE WHEN first_value(y) OVER (ORDER BY node_id) < 0 THEN -1 ELSE 1 END * y / sqrt(sum(y * y) OVER ()) AS new FROM y{k})")
        parts.append(f"x{k} AS (SELECT node_id, CASE WHEN done THEN val ELSE new END AS val FROM n{k} JOIN x{k - 1} USING (node_id), c{k - 1})")
        parts.append(f"c{k} AS (SELECT done OR (SELECT max(abs(new - val)) FROM n{k} JOIN x{k - 1} USING (node_id)) < 1 / m AS done FROM c{k - 1}, mm)")
    return f"WITH {', '.join(parts)} SELECT node_id, {r6('val')} AS val FROM x{steps}"


@query(_raw_power_sql(6))
def l8_raw_modularity_power(s: SparkSession, d: str) -> DataFrame:
    e = tables.trade_top(s, d)
    start = e.select(F.col("src").alias("node_id")).distinct().select("node_id", (1 + (F.col("node_id") * 7919 % 101) / 101.0).alias("val"))
    return rounded(algebra.raw_modularity_power(e, start, 6), "val")


_T = TOP + ", t2 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM top a JOIN top b ON a.dst = b.src GROUP BY 1, 2), t3 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM t2 a JOIN top b ON a.dst = b.src GROUP BY 1, 2), t4 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM t2 a JOIN t2 b ON a.dst = b.src GROUP BY 1, 2)"
_MOMENTS = " UNION ALL ".join(f"SELECT {k} AS k, coalesce(sum(w), 0)::DOUBLE AS moment FROM {t} WHERE src = dst" for k, t in ((1, "top"), (2, "t2"), (3, "t3"), (4, "t4")))


@query(f"WITH {_T} {_MOMENTS}")
def l9_spectrum_moments(s: SparkSession, d: str) -> DataFrame:
    return algebra.spectrum_moments(tables.trade_top(s, d), 4)


@query(f"WITH {_T} SELECT k, round(moment, 3) + 0.0 AS moment FROM ({_MOMENTS})")
def l9_dense_spectrum(s: SparkSession, d: str) -> DataFrame:
    _, values, _ = algebra.dense_spectrum(tables.trade_top(s, d))
    return rounded(s.createDataFrame([(k, float((values**k).sum())) for k in range(1, 5)], "k int, moment double"), "moment", digits=3)


@query(f"WITH {_T} SELECT src, dst, round(w, 3)::DOUBLE AS w FROM (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM top UNION ALL SELECT src, dst, w / 2 FROM t2 UNION ALL SELECT src, dst, w / 6 FROM t3) GROUP BY 1, 2)")
def l10_matrix_function(s: SparkSession, d: str) -> DataFrame:
    m = algebra.matrix_function(tables.trade_top(s, d), lambda x: x + x**2 / 2 + x**3 / 6)
    return rounded(m, "w", digits=3).filter("abs(w) > 1e-3")


@query(f"WITH {_T} SELECT k, round(moment, 3) + 0.0 AS moment FROM ({_MOMENTS})")
def l1_block_iteration(s: SparkSession, d: str) -> DataFrame:
    """All eigenvalues of the symmetric trade graph by block iteration, through their first four moments."""
    e = tables.trade_top(s, d)
    nodes = graph.nodes_of(e)
    values, _ = algebra.leading_eigenpairs(e, nodes, nodes.count(), shift=12.0)
    return rounded(s.createDataFrame([(k, float((values**k).sum())) for k in range(1, 5)], "k int, moment double"), "moment", digits=3)


# ------------------------------------------------------------ streams


def _streamed(s: SparkSession, frame: DataFrame, work, keys: list[str], files: int = 4) -> DataFrame:
    """``work`` on ``frame`` read as a stream of a few files; every batch replaces the result's rows in a shared table."""
    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    frame.repartition(files, *keys).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    started = work(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    started.awaitTermination()
    return s.read.parquet(f"{folder}/out")


@query(f"WITH {PARTS} SELECT src AS node_id, count(*) AS degree, sum(w) AS strength FROM parts GROUP BY src")
def stream_degrees(s: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import degree_stream

    return _streamed(s, tables.parts(s, d), degree_stream, ["src", "dst"])


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id % 50 AS src, event_type AS dst, count(*) AS w FROM events GROUP BY ALL")
def stream_windowed_edges(s: SparkSession, d: str) -> DataFrame:
    from .streaming.incremental import windowed_edges

    e = tables.read(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("src"), F.col("event_type").alias("dst"), "event_id")
    out = _streamed(s, e, lambda x: windowed_edges(x, "ts", "1 day", "3650 days"), ["event_id"])
    return out.select(F.col("window.start").alias("day"), "src", "dst", "w")


@query(f"WITH {VECS}, l AS (SELECT label AS g, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM vecs) SELECT g, dim::INTEGER AS dim, {r6('sum(val)')} AS c FROM l GROUP BY 1, 2")
def c5d_streamed_sums(s: SparkSession, d: str) -> DataFrame:
    """Online sub-cluster sums over micro-batches."""
    from .streaming.incremental import merge_sums, read_sums

    folder = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    v = tables.vectors(s, d).select(F.col("label").alias("g"), "vec", "node_id")
    v.repartition(4, "node_id").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(v.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    started = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge_sums(f"{folder}/out", 64)).start()
    started.awaitTermination()
    return rounded(read_sums(s, f"{folder}/out", 64).select("g", F.posexplode("ls").alias("dim", "c")), "c")


# ------------------------------------------------------------ models and detectors, unrolled in SQL


def _fastrp_sql(dim: int, window: int, sparsity: int = 3, seed: int = 5) -> str:
    h = f"({prng.bits_sql(seed, 'node_id', 'k')} % {2 * sparsity})"
    parts = [
        TOP,
        "p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM top)",
        "dg AS (SELECT dst AS node_id, sum(w) AS d FROM top GROUP BY dst)",
        f"st AS (SELECT node_id, k, pow(d, -0.5) * CASE {h} WHEN 0 THEN sqrt({sparsity}.0) WHEN 1 THEN -sqrt({sparsity}.0) ELSE 0.0 END AS v FROM dg, (SELECT range AS k FROM range({dim})))",
        "x0 AS (SELECT src AS node_id, k, sum(w * v) AS v FROM p JOIN st ON dst = node_id GROUP BY 1, 2)",
        "y0 AS (SELECT * FROM x0)",
    ]
    for t in range(1, window + 1):
        parts.append(f"y{t} AS (SELECT a.node_id, a.k, a.v + coalesce(b.v, 0) AS v FROM x0 a LEFT JOIN (SELECT src AS node_id, k, sum(w * v) AS v FROM p JOIN y{t - 1} ON dst = node_id GROUP BY 1, 2) b USING (node_id, k))")
    return f"WITH {', '.join(parts)} SELECT node_id, k::INTEGER AS k, {r6(f'v / {window + 1}')} AS v FROM y{window}"


def _fastrp(s: SparkSession, d: str):
    from .operators.embeddings import FastRP

    model = FastRP().fit(tables.trade_top(s, d))
    model.transform(4)
    return model


@query(_fastrp_sql(4, 3))
def e21_fastrp_trade(s: SparkSession, d: str) -> DataFrame:
    return rounded(_fastrp(s, d).in_vec.select("node_id", F.posexplode("vec").alias("k", "v")), "v")


@query(_fastrp_sql(4, 3))
def k7_saved_model(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import load, save

    path, model = _folder(s), _fastrp(s, d)
    save(model, path)
    return rounded(load(model.edges, path).transform(4).select("node_id", F.posexplode("vec").alias("k", "v")), "v")


def _switching_sql(edges: str, rounds: int) -> list[str]:
    parts = [f"dg AS (SELECT src AS node_id, sum(w) AS d FROM {edges} GROUP BY src)", "mm AS (SELECT sum(d) AS m FROM dg)", "l0 AS (SELECT node_id, node_id AS g FROM dg)"]
    for r in range(rounds):
        gain = "k - d * (s - CASE WHEN t = g THEN d ELSE 0 END) / m"
        parts.append(f"s{r} AS (SELECT g AS t, sum(d) AS s FROM l{r} JOIN dg USING (node_id) GROUP BY g)")
        parts.append(f"k{r} AS (SELECT e.src AS node_id, l.g AS t, sum(w) AS k FROM {edges} e JOIN l{r} l ON e.dst = l.node_id WHERE e.src <> e.dst GROUP BY 1, 2)")
        parts.append(f"b{r} AS (SELECT node_id, arg_max(t, (round({gain}, 9), -t)) AS new, max({gain}) AS gain FROM k{r} JOIN l{r} USING (node_id) JOIN dg USING (node_id) JOIN s{r} USING (t), mm WHERE {prng.bits_sql(r, 'node_id')} % 2 = 0 GROUP BY node_id)")
        parts.append(f"l{r + 1} AS (SELECT node_id, CASE WHEN gain > 0 THEN new ELSE g END AS g FROM l{r} LEFT JOIN b{r} USING (node_id))")
    return parts


@query(f"WITH {TOP}, {', '.join(_switching_sql('top', 5))} SELECT node_id, g FROM l5")
def g2_label_switching_trade(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import label_switching

    return label_switching(tables.trade_top(s, d), rounds=5)


@query(f"""WITH RECURSIVE {_SPARSE}, reach(node_id, label) AS (SELECT src, src FROM sp UNION SELECT e.dst, r.label FROM reach r JOIN sp e ON e.src = r.node_id AND r.label < e.dst), comp AS (SELECT node_id, min(label) AS c FROM reach GROUP BY node_id),
best AS (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1), inn AS (SELECT sp.src, sp.dst, 1.0::DOUBLE AS w FROM sp JOIN comp ON src = node_id WHERE c = (SELECT c FROM best)), {', '.join(_switching_sql('inn', 3))} SELECT comp.node_id, g::DOUBLE AS g FROM comp LEFT JOIN l3 USING (node_id)""")
def g5_in_largest_component(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import in_largest_component, label_switching

    found = in_largest_component(tables.trade_top(s, d).filter("(src + dst) % 3 = 0"), lambda e: label_switching(e, rounds=3))
    return found.withColumn("g", F.col("g").cast("double"))


def _block_model_sql(q: int, rounds: int, seed: int = 1) -> str:
    parts = [TOP, f"l0 AS (SELECT DISTINCT src AS node_id, {prng.bits_sql(seed, 'src')} % {q} AS g FROM top)", f"gr AS (SELECT a.range AS a, b.range AS b FROM range({q}) a, range({q}) b)"]
    for r in range(rounds):
        parts.append(f"w{r} AS (SELECT a, b, 1e-6 + coalesce(w, 0) AS w FROM gr LEFT JOIN (SELECT x.g AS a, y.g AS b, sum(w) AS w FROM top JOIN l{r} x ON src = x.node_id JOIN l{r} y ON dst = y.node_id GROUP BY 1, 2) USING (a, b))")
        parts.append(f"k{r} AS (SELECT a, sum(w) AS k FROM w{r} GROUP BY a)")
        parts.append(f"v{r} AS (SELECT w{r}.a AS t, w{r}.b AS h, ln(w / (x.k * y.k)) AS v FROM w{r} JOIN k{r} x ON w{r}.a = x.a JOIN k{r} y ON w{r}.b = y.a)")
        parts.append(f"p{r} AS (SELECT src AS node_id, g AS h, sum(w) AS k FROM top JOIN l{r} ON dst = node_id GROUP BY 1, 2)")
        parts.append(f"b{r} AS (SELECT node_id, arg_max(t, (round(s, 9), -t)) AS new FROM (SELECT node_id, t, sum(k * v) AS s FROM p{r} JOIN v{r} USING (h) GROUP BY 1, 2) GROUP BY node_id)")
        parts.append(f"l{r + 1} AS (SELECT node_id, CASE WHEN {prng.bits_sql(seed + r + 1, 'node_id')} % 2 = 0 THEN coalesce(new, g) ELSE g END AS g FROM l{r} LEFT JOIN b{r} USING (node_id))")
    return f"WITH {', '.join(parts)} SELECT node_id, g AS membership FROM l{rounds}"


@query(_block_model_sql(3, 4))
def g3_block_model_trade(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import block_model

    return block_model(tables.trade_top(s, d), 3, rounds=4)


def _belief_sql(rounds: int) -> str:
    n, pin, pout = 200, 16.0 / 200, 4.0 / 200
    log = lambda m: f"ln({pout!r} * {n} + ({pin!r} - {pout!r}) * {n} * {m})"
    parts = [
        "nd AS (SELECT range AS node_id, range // 100 AS g FROM range(200))",
        f"pe AS (SELECT a.node_id AS src, b.node_id AS dst FROM nd a JOIN nd b ON a.node_id < b.node_id WHERE {prng.uniform_sql(1, 'a.node_id', 'b.node_id')} < CASE WHEN a.g = b.g THEN 0.08 ELSE 0.02 END)",
        "e AS (SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe)",
        "b0 AS (SELECT node_id, CASE g WHEN 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS x, CASE g WHEN 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS y FROM nd)",
        "m0 AS (SELECT src, dst, x, y FROM e JOIN b0 ON src = node_id)",
    ]
    soft = lambda a, b: f"exp({a} - greatest({a}, {b})) / (exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b})))"
    for k in range(1, rounds + 1):
        parts.append(f"h{k} AS (SELECT (sum(x) + sum(y)) * {pout!r} + ({pin!r} - {pout!r}) * sum(x) AS hx, (sum(x) + sum(y)) * {pout!r} + ({pin!r} - {pout!r}) * sum(y) AS hy FROM b{k - 1})")
        parts.append(f"i{k} AS (SELECT dst, sum({log('x')}) AS lx, sum({log('y')}) AS ly FROM m{k - 1} GROUP BY dst)")
        parts.append(f"b{k} AS (SELECT node_id, {soft('ax', 'ay')} AS x, {soft('ay', 'ax')} AS y FROM (SELECT node_id, coalesce(lx, 0) - hx AS ax, coalesce(ly, 0) - hy AS ay FROM nd LEFT JOIN i{k} ON dst = node_id, h{k}))")
        parts.append(f"m{k} AS (SELECT src, dst, {soft('ax', 'ay')} AS x, {soft('ay', 'ax')} AS y FROM (SELECT m.dst AS src, m.src AS dst, lx - {log('x')} - hx AS ax, ly - {log('y')} - hy AS ay FROM m{k - 1} m JOIN i{k} i ON m.dst = i.dst, h{k}))")
    return f"WITH {', '.join(parts)} SELECT node_id, CASE WHEN x >= y THEN 0 ELSE 1 END::BIGINT AS g FROM b{rounds}"


@query(_belief_sql(3))
def g4_belief_propagation_rounds(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import belief_propagation

    edges, nodes = generators.planted_partition(s, 200, 2, 16.0, 4.0, exact=True)
    return belief_propagation(edges, nodes, 2, 16.0, 4.0, 3)


_COSINE = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"


def _near_sql(k: int) -> str:
    return f"{VECS}, nn AS (SELECT a.node_id AS src, b.node_id AS dst, round({_COSINE}, 9) AS w FROM vecs a JOIN vecs b ON a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY w DESC, b.node_id) <= {k})"


@query(f"""WITH RECURSIVE {_near_sql(10)}, di AS (SELECT src, dst, 1 - w AS distance FROM nn), co AS (SELECT src, max(distance) AS core FROM (SELECT * FROM di QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 5) GROUP BY src),
cl AS (SELECT di.src, di.dst FROM di JOIN co a ON di.src = a.src JOIN co b ON di.dst = b.src WHERE greatest(distance, a.core, b.core) <= 0.7), both_ AS (SELECT src, dst FROM cl UNION SELECT dst, src FROM cl),
reach(node_id, label) AS (SELECT src, src FROM both_ UNION SELECT e.dst, r.label FROM reach r JOIN both_ e ON e.src = r.node_id AND r.label < e.dst), comp AS (SELECT node_id, min(label) AS c FROM reach GROUP BY node_id)
SELECT v.node_id, coalesce(c, -1) AS p FROM vecs v LEFT JOIN comp USING (node_id)""")
def c4_c8_density_flat(s: SparkSession, d: str) -> DataFrame:
    from .operators import clustering
    from .operators.detectors import density_clusters

    near = clustering.nearest(tables.vectors(s, d), 10).select("src", "dst", (1 - F.col("w")).alias("distance"))
    return density_clusters(near, 5, 0.7)


def _louvain_sql(rounds: int, rho: float) -> str:
    parts = [_near_sql(5), "long AS (SELECT node_id, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM vecs)", "own AS (SELECT node_id, sum(val * val) AS zz FROM long GROUP BY node_id)", "l0 AS (SELECT node_id, node_id AS g FROM vecs)"]
    for r in range(rounds):
        parts.append(f"v{r} AS (SELECT g AS t, dim, sum(val) AS v FROM long JOIN l{r} USING (node_id) GROUP BY 1, 2)")
        parts.append(f"n{r} AS (SELECT g AS t, count(*) AS n FROM l{r} GROUP BY 1)")
        parts.append(f"mv{r} AS (SELECT node_id, g FROM l{r} WHERE {prng.bits_sql(0, 'node_id')} % 2 = {r % 2})")
        parts.append(f"op{r} AS (SELECT node_id, g AS t FROM mv{r} UNION SELECT src, l.g FROM nn JOIN l{r} l ON dst = l.node_id JOIN mv{r} m ON src = m.node_id)")
        parts.append(f"ga{r} AS (SELECT o.node_id, o.t, sum(val * v) AS zv FROM op{r} o JOIN long USING (node_id) JOIN v{r} v ON v.t = o.t AND v.dim = long.dim GROUP BY 1, 2)")
        parts.append(f"b{r} AS (SELECT ga.node_id, arg_max(ga.t, (round(zv - CASE WHEN ga.t = m.g THEN zz ELSE 0 END - {rho!r} * (n - CASE WHEN ga.t = m.g THEN 1 ELSE 0 END), 9), -ga.t)) AS new FROM ga{r} ga JOIN mv{r} m USING (node_id) JOIN own USING (node_id) JOIN n{r} n ON n.t = ga.t GROUP BY 1)")
        parts.append(f"l{r + 1} AS (SELECT node_id, coalesce(new, g) AS g FROM l{r} LEFT JOIN b{r} USING (node_id))")
    return f"WITH {', '.join(parts)} SELECT node_id, g FROM l{rounds}"


@query(_louvain_sql(3, 0.2))
def c7_c7a_louvain_rounds(s: SparkSession, d: str) -> DataFrame:
    from .operators import clustering

    v = tables.vectors(s, d)
    return clustering.louvain(v.select("node_id", "vec"), clustering.nearest(v, 5), 0.2, 64, 3)


def _logistic_sql(steps: int) -> str:
    parts = [_near_sql(5), "nv AS (SELECT count(*) AS n FROM vecs)", "pt AS (SELECT list_dot_product(a.vec, b.vec) AS x, 1 AS y FROM nn JOIN vecs a ON src = a.node_id JOIN vecs b ON dst = b.node_id UNION ALL SELECT list_dot_product(a.vec, b.vec), 0 FROM vecs a, range(3) j, nv JOIN vecs b ON b.node_id = (a.node_id * 7 + 3 * j.range + 1) % nv.n)".replace("FROM vecs a, range(3) j, nv JOIN vecs b ON", "FROM vecs a CROSS JOIN range(3) j CROSS JOIN nv JOIN vecs b ON")]
    parts += ["cw AS (SELECT sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM pt)", "wp AS (SELECT x, y, CASE y WHEN 1 THEN (p + n) / (2 * p) ELSE (p + n) / (2 * n) END AS wt FROM pt, cw)", "c0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"]
    for k in range(1, steps + 1):
        parts.append(f"q{k} AS (SELECT x, y, wt, 1 / (1 + exp(-(b0 + b1 * x))) AS q FROM wp, c{k - 1})")
        parts.append(f"s{k} AS (SELECT sum(wt * (y - q)) AS g0, sum(wt * (y - q) * x) AS g1, sum(wt * q * (1 - q)) AS h0, sum(wt * q * (1 - q) * x) AS h1, sum(wt * q * (1 - q) * x * x) AS h2 FROM q{k})")
        parts.append(f"c{k} AS MATERIALIZED (SELECT b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b0, b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b1 FROM c{k - 1}, s{k})")
    return f"WITH {', '.join(parts)} SELECT round(b0, 4) + 0.0 AS intercept, round(b1, 4) + 0.0 AS slope, round(-b0 / b1, 4) + 0.0 AS rho FROM c{steps}"


@query(_logistic_sql(6))
def c7c_logistic_rho(s: SparkSession, d: str) -> DataFrame:
    """Where neighbours (1) and arbitrary pairs (0) are equally likely, by their inner product."""
    from .functions.vectors import dot
    from .operators import clustering

    v = tables.vectors(s, d)
    n = v.count()
    a, b = v.select(F.col("node_id").alias("src"), F.col("vec").alias("u")), v.select(F.col("node_id").alias("dst"), F.col("vec").alias("v"))
    near = clustering.nearest(v, 5).select("src", "dst", F.lit(1).alias("y"))
    other = v.select(F.col("node_id").alias("src"), F.explode(F.array(*(F.lit(j) for j in range(3)))).alias("j")).select("src", ((F.col("src") * 7 + 3 * F.col("j") + 1) % n).alias("dst"), F.lit(0).alias("y"))
    points = near.unionByName(other).join(a, "src").join(b, "dst").select(dot("u", "v").alias("x"), "y")
    return rounded(clustering.logistic_threshold(points, 6), "intercept", "slope", "rho", digits=4)


def _minibatch_sql(batches: int) -> str:
    best = lambda name, rows, c: f"{name} AS (SELECT node_id, g AS p FROM (SELECT x.node_id, c.g, round(-sqrt(sum((x.val - c.c) * (x.val - c.c))), 9) AS s FROM {rows} x JOIN {c} c USING (dim) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY s DESC, g) = 1)"
    parts = [VECS, "ol AS (SELECT node_id, label, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM vecs)", "long AS (SELECT node_id, label, dim, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY node_id)), 1e-24) AS val FROM ol)"]
    parts.append("c0 AS (SELECT l.label AS g, dim, val AS c, 0 AS n FROM long l JOIN (SELECT label, min(node_id) AS node_id FROM vecs GROUP BY label) f USING (node_id))")
    for b in range(batches):
        parts.append(f"r{b} AS (SELECT * FROM long WHERE {prng.bits_sql(0, 'node_id')} % {batches} = {b})")
        parts.append(best(f"a{b}", f"r{b}", f"c{b}"))
        parts.append(f"s{b} AS (SELECT p AS g, dim, sum(val) AS s, count(*) AS m FROM r{b} JOIN a{b} USING (node_id) GROUP BY 1, 2)")
        parts.append(f"c{b + 1} AS (SELECT c.g, c.dim, CASE WHEN m > 0 THEN (c * n + s) / (n + m) ELSE c END AS c, n + coalesce(m, 0) AS n FROM c{b} c LEFT JOIN s{b} s ON c.g = s.g AND c.dim = s.dim)")
    parts.append(best("last", "long", f"c{batches}"))
    return f"WITH {', '.join(parts)} SELECT node_id, p FROM last"


@query(_minibatch_sql(3))
def c3_minibatch_kmeans(s: SparkSession, d: str) -> DataFrame:
    from .operators import clustering

    v = clustering.unit_rows(tables.vectors(s, d))
    start = v.groupBy("label").agg(F.min_by("vec", "node_id").alias("c")).select(F.col("label").alias("g"), "c")
    return clustering.minibatch_kmeans(tables.vectors(s, d), start, 64, 3)


# ------------------------------------------------------------ scores and theory tables


def _compared_sql() -> str:
    from .catalogue import CELLS, ESIM, NMI, _voronoi_cte

    cells = CELLS[len(_voronoi_cte("cosine")) :]
    line = lambda m: f"(WITH {_voronoi_cte(m)}{cells}{ESIM}{NMI} SELECT '{m}' AS model, {r6('nmi')} AS nmi, {r6('esim')} AS esim FROM nm, es)"
    return " UNION ALL ".join(map(line, ("cosine", "euclidean")))


_SAMPLE = f"""{VECS}, nu AS (SELECT row_number() OVER (ORDER BY node_id) - 1 AS at, vec, label FROM vecs), nc AS (SELECT count(*) AS n FROM vecs),
aq AS (SELECT floor({prng.uniform_sql(1, 'range')} * n)::BIGINT AS i, floor({prng.uniform_sql(2, 'range')} * n)::BIGINT AS j FROM range(20000), nc),
gs AS (SELECT score, sum(same) AS pos, sum(1 - same) AS neg FROM (SELECT round(list_dot_product(a.vec, b.vec), 9) AS score, (a.label = b.label)::BIGINT AS same FROM aq JOIN nu a ON i = a.at JOIN nu b ON j = b.at WHERE i <> j) GROUP BY score)"""


@query(f"WITH {_SAMPLE} SELECT {r6('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs)")
def v5_auc_sampled(s: SparkSession, d: str) -> DataFrame:
    from .operators import metrics

    return rounded(metrics.roc_auc(metrics.sampled_pairs(tables.vectors(s, d), 20000)), "auc")


@query(f"WITH {_SAMPLE} SELECT {r6('sum(pos * tp / seen) / sum(pos)')} AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen FROM gs)")
def v9_average_precision_sampled(s: SparkSession, d: str) -> DataFrame:
    from .operators import metrics

    return rounded(metrics.average_precision(metrics.sampled_pairs(tables.vectors(s, d), 20000)), "ap")


@query(_compared_sql())
def v12_c2c_comparison(s: SparkSession, d: str) -> DataFrame:
    from .operators import clustering, metrics

    v = tables.vectors(s, d)
    both = [clustering.voronoi(v, "label", 64, m).select("node_id", "label", F.col("p").alias(m)) for m in ("cosine", "euclidean")]
    return rounded(metrics.comparison(both[0].join(both[1].drop("label"), "node_id"), ["cosine", "euclidean"], "label"), "nmi", "esim")


_AUC = "(SELECT abs(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) - 0.5) + 0.5 FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT round(vec[{k}], 9) AS score, sum((label >= 5)::BIGINT) AS pos, sum((label < 5)::BIGINT) AS neg FROM vecs GROUP BY 1)))"


@query(f"WITH {VECS} SELECT {r6('abs(corr(vec[1], vec[2]))')} AS pearson, {r6(_AUC.format(k=1))} AS auc_x, {r6(_AUC.format(k=2))} AS auc_y FROM vecs")
def t9_agreement(s: SparkSession, d: str) -> DataFrame:
    from .operators import metrics

    v = tables.vectors(s, d).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), (F.col("label") >= 5).cast("long").alias("same"))
    return rounded(metrics.agreement(v), "pearson", "auc_x", "auc_y")


@query()
def v8_discriminant_auc(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import discriminant_auc

    v = tables.vectors(s, d).select("vec", (F.col("label") >= 5).cast("long").alias("label"))
    return rounded(discriminant_auc(v, 64), "auc")


def _ensemble_sql(seeds: tuple[int, ...]) -> str:
    one = lambda s: f"SELECT a.i AS src, b.i AS dst FROM n a JOIN n b ON a.i < b.i WHERE {prng.uniform_sql(s, 'a.i', 'b.i')} < CASE WHEN a.g = b.g THEN 0.25 ELSE 0.1 END"
    k = len(seeds)
    return f"WITH n AS (SELECT range AS i, range // 30 AS g FROM range(60)), p AS ({' UNION ALL '.join(map(one, seeds))}), e AS (SELECT * FROM p UNION ALL SELECT dst, src FROM p) SELECT src, dst, {r6(f'count(*) / {k}.0')} AS mean, {r6(f'count(*) / {k}.0 - (count(*) / {k}.0) * (count(*) / {k}.0)')} AS var FROM e GROUP BY 1, 2"


@query(_ensemble_sql((1, 2, 3, 4)))
def t6_ensemble_moments(s: SparkSession, d: str) -> DataFrame:
    from .operators import spectral

    members = [generators.planted_partition(s, 60, 2, 15.0, 6.0, seed=k, exact=True)[0] for k in (1, 2, 3, 4)]
    return rounded(spectral.ensemble_moments(members), "mean", "var")


_DRAW = "(SELECT node_id FROM st WHERE low < {u} AND {u} <= cdf)"
_SAMPLED = f"""{TOP}, {VECS}, long AS (SELECT node_id, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM vecs), dn AS (SELECT dst AS node_id, sum(w) AS d FROM top GROUP BY dst), mm AS (SELECT sum(d) AS m, count(*) AS nn FROM dn),
cd AS (SELECT node_id, CASE WHEN node_id = max(node_id) OVER () THEN 1.0 ELSE round(sum(d / m) OVER (ORDER BY node_id ROWS UNBOUNDED PRECEDING), 12) END AS cdf FROM dn, mm), st AS (SELECT node_id, cdf, coalesce(lag(cdf) OVER (ORDER BY node_id), -1) AS low FROM cd),
ed AS (SELECT src, dst, {prng.bits_sql(51, "'batch'", 'src', 'dst')} % 4 AS batch, {prng.uniform_sql(52, 'src', 'dst')} AS ua, {prng.uniform_sql(53, 'src', 'dst')} AS ub FROM top),
rd AS (SELECT batch, a.node_id AS a, b.node_id AS b FROM ed JOIN st a ON a.low < ua AND ua <= a.cdf JOIN st b ON b.low < ub AND ub <= b.cdf),
bs AS (SELECT {prng.bits_sql(51, "'batch'", 'src', 'dst')} % 4 AS batch, floor({prng.uniform_sql(54, 'src', 'dst')} * 25)::BIGINT AS a, floor({prng.uniform_sql(55, 'src', 'dst')} * 25)::BIGINT AS b FROM top)"""


def _batch_sql(vectors: str, kinds: str) -> str:
    """``part``: batch, a, b, value of the term, coefficient of its gradient."""
    return f"""{_SAMPLED}, {vectors}, sm AS ({kinds}), sz AS (SELECT batch, kind, count(*) AS n FROM sm GROUP BY 1, 2),
dt AS (SELECT sm.batch, kind, sm.a, sm.b, f, pw, sum(x.val * y.val) AS s, any_value(sm.i) AS i FROM (SELECT *, row_number() OVER () AS i FROM sm) sm JOIN z x ON sm.a = x.node_id JOIN z y ON sm.b = y.node_id AND x.dim = y.dim GROUP BY sm.batch, kind, sm.a, sm.b, f, pw, sm.i),
pt AS (SELECT batch, a, b, f / n * pow(s, pw) AS part, f * pw / n * pow(s, pw - 1) AS c FROM dt JOIN sz USING (batch, kind)), ls AS (SELECT batch, sum(part) AS loss FROM pt GROUP BY batch),
gd AS (SELECT batch, node_id, dim, sum(v) AS g FROM (SELECT batch, a AS node_id, dim, c * val AS v FROM pt JOIN z ON b = z.node_id UNION ALL SELECT batch, b, dim, c * val FROM pt JOIN z ON a = z.node_id) GROUP BY 1, 2, 3), g2 AS (SELECT batch, sum(g * g) AS gradient2 FROM gd GROUP BY batch)"""


_MODULARITY_KINDS = "SELECT batch, 'edge' AS kind, src AS a, dst AS b, -2 / m AS f, 1 AS pw FROM ed, mm UNION ALL SELECT batch, 'random', a, b, 2 / m, 1 FROM rd, mm UNION ALL SELECT batch, 'base', a, b, 1 / ((m / nn) * (m / nn)), 2 FROM bs, mm"
_PLAIN_Z = "z AS (SELECT * FROM long)"
_LAPLACIAN_KINDS = "SELECT batch, 'edge' AS kind, src AS a, dst AS b, -2.0::DOUBLE AS f, 1 AS pw FROM ed UNION ALL SELECT batch, 'random', a, b, 1.0, 2 FROM rd"
_SCALED_Z = "z AS (SELECT long.node_id, dim, val * sqrt(m / greatest(d, 1)) AS val FROM long JOIN dn USING (node_id), mm)"


def _modularity_batches(s: SparkSession, d: str) -> DataFrame:
    from .operators import spectral

    e, v = tables.trade_top(s, d), tables.vectors(s, d).select("node_id", "vec")
    row = e.agg(F.sum("w").alias("m"), F.count_distinct("dst").alias("n")).first()
    m, mean = float(row["m"]), row["m"] / row["n"]
    return spectral.batch_losses(spectral.loss_samples(e, 4, 51, 25), v, {"edge": (-2 / m, 1), "random": (2 / m, 1), "base": (1 / mean**2, 2)}, 64)


def _laplacian_batches(s: SparkSession, d: str) -> DataFrame:
    from .operators import spectral

    e = tables.trade_top(s, d)
    v = spectral.degree_scaled(tables.vectors(s, d).select("node_id", "vec"), e)
    return spectral.batch_losses(spectral.loss_samples(e, 4, 51), v, {"edge": (-2.0, 1), "random": (1.0, 2)}, 64)


@query(f"WITH {_batch_sql(_PLAIN_Z, _MODULARITY_KINDS)} SELECT batch, {r6('loss')} AS loss, {r6('gradient2')} AS gradient2 FROM ls JOIN g2 USING (batch)")
def t13_batch_losses(s: SparkSession, d: str) -> DataFrame:
    return rounded(_modularity_batches(s, d), "loss", "gradient2")


@query(f"WITH {_batch_sql(_PLAIN_Z, _MODULARITY_KINDS)} SELECT {r6('0.5 + 0.1 / 4 * avg(gradient2)')} AS q FROM g2")
def t12_implicit_loss(s: SparkSession, d: str) -> DataFrame:
    from .operators import spectral

    return rounded(spectral.implicit_loss(0.5, _modularity_batches(s, d), 0.1), "q")


@query(f"WITH {_batch_sql(_SCALED_Z, _LAPLACIAN_KINDS)} SELECT batch, {r6('loss')} AS loss, {r6('gradient2')} AS gradient2 FROM ls JOIN g2 USING (batch)")
def t15_laplacian_batches(s: SparkSession, d: str) -> DataFrame:
    return rounded(_laplacian_batches(s, d), "loss", "gradient2")


# ------------------------------------------------------------ walk models on the tables' own graphs


@query()
def e1_node2vec_trade(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import Node2Vec

    return Node2Vec(walk_length=40, num_walks=10, window_length=5).fit(tables.trade_top(s, d)).transform(8)


@query()
def e2_deepwalk_cbow(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import DeepWalk

    return DeepWalk(walk_length=40, num_walks=10, window_length=5).fit(tables.trade_top(s, d)).transform(8)


@query()
def e17_word2vec_trade(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import Word2VecEmbedding

    return Word2VecEmbedding(walk_length=40, num_walks=10, window_length=5).fit(tables.trade_top(s, d)).transform(8)
