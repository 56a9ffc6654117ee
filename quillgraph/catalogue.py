"""Registered queries for the graph operators, each with the same thing in DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import prng
from .functions import vectors as V
from .operators import algebra, clustering, graph, losses, metrics, results, sampling, spectral, walks
from .plans.lineage import shared_folder
from .sources import generators, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

D = 64  # length of the vectors in `embeddings`


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Named double columns rounded, with -0.0 as 0.0."""
    return df.select(*((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns))


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0"


# ------------------------------------------------------------ common SQL parts

TRADE = """trade AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
TOP = TRADE + """, ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM trade WHERE src <> dst),
top AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM ranked WHERE r <= 5 UNION ALL SELECT dst, src FROM ranked WHERE r <= 5))"""
PARTS = """pp AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
parts AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM pp UNION ALL SELECT dst, src FROM pp))"""
REGIONS = "regions AS (SELECT n_nationkey::BIGINT AS node_id, n_regionkey::BIGINT AS membership FROM nation)"
VECS = "vecs AS (SELECT vec_id AS node_id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"
LONG = VECS + ", long AS (SELECT node_id, label, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM vecs)"


def trade(s: SparkSession, d: str) -> DataFrame:
    return tables.trade(s, d)


# ------------------------------------------------------------ scans and reshaping


@query(f"WITH {TRADE} SELECT src, dst, w FROM trade")
def s1_trade_network(s: SparkSession, d: str) -> DataFrame:
    return trade(s, d)


@query("SELECT vec_id AS node_id, " + r6("list_sum(list_transform(embedding, lambda x: x::DOUBLE))") + " AS total, len(embedding)::BIGINT AS dim FROM embeddings")
def s3_embedding_scan(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d)
    return rounded(v.select("node_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("vec").cast("long").alias("dim")), "total")


@query(f"WITH {TRADE} SELECT src, dst, w FROM trade WHERE w <> 0 AND src <> dst")
def s12_edge_list(s: SparkSession, d: str) -> DataFrame:
    return graph.without_loops(graph.nonzero(trade(s, d)))


@query(f"WITH {TOP} SELECT src AS node_id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM top GROUP BY src")
def s14_adjacency_lists(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency_lists(tables.trade_top(s, d)).select("node_id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("SELECT a.k AS k, b.c AS c, m.mu AS mu FROM (VALUES (2), (50)) a(k) CROSS JOIN (VALUES (5), (10), (50)) b(c) CROSS JOIN (VALUES ('0.10'), ('0.50')) m(mu)")
def s16_param_space(s: SparkSession, d: str) -> DataFrame:
    return results.param_space(s, {"k": [2, 50], "c": [5, 10, 50], "mu": ["0.10", "0.50"]}).select(F.col("k").cast("int").alias("k"), F.col("c").cast("int").alias("c"), "mu")


@query(f"WITH {TRADE} SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade)")
def p1_symmetrize(s: SparkSession, d: str) -> DataFrame:
    return graph.symmetrize(trade(s, d))


@query(f"WITH {TRADE}, {REGIONS} SELECT t.* FROM trade t JOIN regions a ON t.src = a.node_id JOIN regions b ON t.dst = b.node_id WHERE a.membership = 1 AND b.membership = 1")
def p14_induced(s: SparkSession, d: str) -> DataFrame:
    return graph.induced(trade(s, d), tables.regions(s, d).filter("membership = 1"))


@query(f"WITH {TRADE} SELECT * FROM trade WHERE src <> dst")
def p15_no_loops(s: SparkSession, d: str) -> DataFrame:
    return graph.without_loops(trade(s, d))


@query(f"WITH {TRADE} SELECT * FROM trade WHERE src <= dst")
def p16_triu(s: SparkSession, d: str) -> DataFrame:
    return graph.upper_triangle(trade(s, d))


@query(f"WITH {TRADE}, u AS (SELECT src % 5 AS src, dst % 5 AS dst, w FROM trade) SELECT src, dst, sum(w) AS w FROM u GROUP BY 1, 2 HAVING sum(w) >= 10")
def p17_coalesce(s: SparkSession, d: str) -> DataFrame:
    return graph.coalesce_edges(trade(s, d).select((F.col("src") % 5).alias("src"), (F.col("dst") % 5).alias("dst"), "w"), 10.0)


@query("SELECT a, b, (a + b) * (a + b + 1) // 2 + b AS z FROM (SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation)")
def p18_cantor(s: SparkSession, d: str) -> DataFrame:
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    return n.withColumn("z", graph.pair_number(F.col("a"), F.col("b")))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS g FROM customer")
def p19_reindex(s: SparkSession, d: str) -> DataFrame:
    return graph.reindex_column(tables.read(s, d, "customer"), "c_mktsegment", "g").select("c_custkey", "g")


@query(f"WITH {REGIONS} SELECT node_id, membership FROM regions")
def p20_membership_matrix(s: SparkSession, d: str) -> DataFrame:
    return tables.regions(s, d)


@query(f"WITH {TRADE} SELECT src, dst, {r6('w / greatest(sum(w) OVER (PARTITION BY src), 1e-32)')} AS w FROM trade")
def p7_transition(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.row_probability(trade(s, d)), "w")


@query(f"WITH {TRADE} SELECT src, dst, {r6('w / greatest(sqrt(sum(w * w) OVER (PARTITION BY src)), 1e-32)')} AS w FROM trade")
def p8_l2_rows(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.row_unit(trade(s, d)), "w")


@query(f"WITH {TRADE}, g AS (SELECT src, greatest(sqrt(sum(w)), 1e-12) AS d FROM trade GROUP BY src) SELECT t.src, t.dst, {r6('w / (a.d * b.d)')} AS w FROM trade t JOIN g a ON t.src = a.src JOIN g b ON t.dst = b.src")
def p9_sym_norm(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.symmetric_normalized(trade(s, d)), "w")


@query(f"WITH {LONG} SELECT node_id, {r6('sqrt(sum(val * val))')} AS norm, {r6('max(val) / sqrt(sum(val * val))')} AS peak FROM long GROUP BY node_id")
def p10_unit_rows(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d)
    return rounded(v.select("node_id", V.norm("vec").alias("norm"), F.array_max(V.unit("vec")).alias("peak")), "norm", "peak")


@query(f"WITH {LONG} SELECT node_id, {r6('sum(v)')} AS total FROM (SELECT node_id, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY dim)), 1e-32) AS v FROM long) GROUP BY node_id")
def p11_column_norm(s: SparkSession, d: str) -> DataFrame:
    v = clustering.column_normalized(tables.vectors(s, d), D)
    return rounded(v.select("node_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


DIM_NORMS = LONG + ", norms AS (SELECT dim, sqrt(sum(val * val)) AS norm FROM long GROUP BY dim)"


@query(f"""WITH {DIM_NORMS}, top AS (SELECT arg_max(dim, norm) AS top, max(norm) AS most FROM norms), ok AS (SELECT dim::INTEGER AS dim, norm, norm >= sqrt(most) AND dim <> top AS ok, dim = top AS best FROM norms, top)
SELECT dim, {r6('norm')} AS norm FROM ok WHERE ok OR (best AND NOT (SELECT bool_or(ok) FROM ok))""")
def p12_dim_threshold(s: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.kept_dimensions(clustering.dimension_norms(tables.vectors(s, d), D)), "norm")


@query(f"WITH {DIM_NORMS} SELECT dim::INTEGER AS dim, {r6('norm')} AS norm, row_number() OVER (ORDER BY round(norm, 9) DESC, dim)::INTEGER AS r FROM norms QUALIFY r <= 5")
def p13_focal_dims(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = clustering.dimension_norms(tables.vectors(s, d), D)
    ranked = n.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.round("norm", 9)), "dim")))
    return rounded(ranked.filter("r <= 5"), "norm")


@query(f"WITH {VECS} SELECT node_id, dense_rank() OVER (ORDER BY sign(vec[1])) - 1 AS g FROM vecs")
def c9_sign(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d).withColumn("sign", F.signum(F.col("vec")[0]))
    return graph.reindex_column(v, "sign", "g").select("node_id", "g")


@query(f"""WITH {TOP} SELECT e1.src AS prev, e1.dst AS cur, e2.dst AS nxt, {r6("e2.w * CASE WHEN e2.dst = e1.src THEN 1 / 0.5 WHEN e3.src IS NOT NULL THEN 1.0 ELSE 1 / 2.0 END")} AS w
FROM top e1 JOIN top e2 ON e1.dst = e2.src LEFT JOIN top e3 ON e3.src = e1.src AND e3.dst = e2.dst""")
def p21_supra_graph(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.line_graph(tables.trade_top(s, d), 0.5, 2.0), "w")


@query(f"""WITH {TOP}, g AS (SELECT src, sum(w) AS d FROM top GROUP BY src), m AS (SELECT src, src + 25 AS dst, d - 1.0 AS w FROM g UNION ALL SELECT src + 25, src, -1.0 FROM g UNION ALL SELECT src + 25, dst + 25, w FROM top)
SELECT src, dst, w::DOUBLE AS w FROM m WHERE w <> 0""")
def p22_nonbacktracking_matrix(s: SparkSession, d: str) -> DataFrame:
    return graph.nonbacktracking_matrix(tables.trade_top(s, d), 25)


# ------------------------------------------------------------ aggregations and windows


@query(f"WITH {PARTS} SELECT src AS node_id, count(*) AS degree, sum(w) AS strength FROM parts GROUP BY src")
def a1_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(tables.parts(s, d))


@query("SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label")
def a3_sizes(s: SparkSession, d: str) -> DataFrame:
    return tables.vectors(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 1")
def a4_mode(s: SparkSession, d: str) -> DataFrame:
    return a3_sizes(s, d).orderBy(F.desc("n"), "label").limit(1)


@query("SELECT event_type, " + r6("avg(value)") + " AS mean, " + r6("var_samp(value)") + " AS var, " + r6("var_pop(value)") + " AS vp, " + r6("stddev_samp(value)") + " AS sd, count(*) AS n FROM events GROUP BY event_type")
def a5_a6_a7_a12_moments(s: SparkSession, d: str) -> DataFrame:
    e = tables.read(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.var_pop("value").alias("vp"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    return rounded(e, "mean", "var", "vp", "sd")


@query(f"WITH {LONG} SELECT label, dim::INTEGER AS dim, {r6('sum(val)')} AS c FROM long GROUP BY label, dim")
def a8_centroids(s: SparkSession, d: str) -> DataFrame:
    c = clustering.centroids(tables.vectors(s, d), "label", D)
    return rounded(c.select(F.col("g").alias("label"), F.posexplode("c").alias("dim", "c")), "c")


@query(f"WITH {TRADE}, {REGIONS} SELECT a.membership AS g_src, b.membership AS g_dst, sum(w) AS w FROM trade JOIN regions a ON src = a.node_id JOIN regions b ON dst = b.node_id GROUP BY 1, 2")
def a9_block_matrix(s: SparkSession, d: str) -> DataFrame:
    return graph.block_matrix(trade(s, d), tables.regions(s, d))


@query(f"WITH {TRADE}, v AS (SELECT dst AS node_id, pow(sum(w), 0.75) AS v FROM trade GROUP BY dst) SELECT node_id, {r6('v / sum(v) OVER ()')} AS p FROM v")
def a11_noise_distribution(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.noise_distribution(trade(s, d), 0.75), "p")


@query("SELECT " + r6("-sum(n / t * ln(n / t))") + " AS entropy, " + r6("sum(n / t * ln((n / t) / 0.2))") + " AS kl FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM events GROUP BY event_type)")
def a13_entropy(s: SparkSession, d: str) -> DataFrame:
    n = tables.read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    p = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select((F.col("n") / F.col("t")).alias("p"))
    return rounded(p.agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.sum(F.col("p") * F.ln(F.col("p") / 0.2)).alias("kl")), "entropy", "kl")


@query(f"WITH {LONG} SELECT a.dim::INTEGER AS i, b.dim::INTEGER AS j, {r6('sum(a.val * b.val)')} AS g FROM long a JOIN long b ON a.node_id = b.node_id GROUP BY 1, 2")
def a14_gram(s: SparkSession, d: str) -> DataFrame:
    long = tables.vectors(s, d).select("vec", F.posexplode("vec").alias("i", "x"))
    rows = long.groupBy("i").agg(F.array(*(F.sum(F.col("x") * F.col("vec")[j]) for j in range(D))).alias("row"))
    return rounded(rows.select("i", F.posexplode("row").alias("j", "g")), "g")


@query(f"WITH {VECS} SELECT {r6('corr(vec[1], vec[2])')} AS r FROM vecs")
def a16_pearson(s: SparkSession, d: str) -> DataFrame:
    return rounded(tables.vectors(s, d).agg(F.corr(F.col("vec")[0], F.col("vec")[1]).alias("r")), "r")


@query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def a17_histogram(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "events").groupBy(F.floor(F.col("value") / 10).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRADE} SELECT src, arg_min(dst, (w, dst)) AS lowest, arg_max(dst, (w, -dst)) AS highest FROM trade GROUP BY src")
def a18_arg_extremes(s: SparkSession, d: str) -> DataFrame:
    return trade(s, d).groupBy("src").agg(F.min_by("dst", F.struct("w", "dst")).alias("lowest"), F.max_by("dst", F.struct(F.col("w"), -F.col("dst"))).alias("highest"))


CDF = "CASE WHEN row_number() OVER (PARTITION BY src ORDER BY dst) = count(*) OVER (PARTITION BY src) THEN 1.0 ELSE sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY src) END"


@query(f"WITH {TRADE} SELECT src, dst, {r6(CDF)} AS cdf FROM trade")
def w1_row_cdf(s: SparkSession, d: str) -> DataFrame:
    return rounded(graph.row_cdf(trade(s, d)), "cdf")


@query(f"""WITH {TRADE}, c AS (SELECT src, dst, round({CDF}, 12) AS cdf FROM trade), u AS (SELECT DISTINCT src, {prng.uniform_sql(3, 'src')} AS u FROM trade)
SELECT src, arg_min(dst, (cdf, dst)) AS drawn FROM c JOIN u USING (src) WHERE cdf >= u GROUP BY src""")
def w3_roulette(s: SparkSession, d: str) -> DataFrame:
    cdf = graph.row_cdf(trade(s, d)).select("src", F.col("dst").alias("node_id"), F.round("cdf", 12).alias("cdf"))
    return sampling.draw(cdf.select("src").distinct(), cdf, "src", 3, "src")


EVT = """ev AS (SELECT user_id, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def _context_sql(condition: str) -> str:
    return f"WITH {EVT} SELECT a.user_id, a.pos::INTEGER AS pos, a.k AS center, b.k AS context FROM ev a JOIN ev b ON a.user_id = b.user_id AND {condition}"


def _contexts(side: str) -> Query:
    return lambda s, d: walks.context_pairs(tables.event_sequences(s, d), ["user_id"], 2, side)


query(_context_sql("abs(b.pos - a.pos) BETWEEN 1 AND 2"), "w4_context_double")(_contexts("double"))
query(_context_sql("a.pos - b.pos BETWEEN 1 AND 2"), "w5_context_left")(_contexts("left"))
query(_context_sql("b.pos - a.pos BETWEEN 1 AND 2"), "w6_context_right")(_contexts("right"))


@query(f"WITH {EVT}, t AS (SELECT user_id, count(*) AS t FROM ev GROUP BY user_id) SELECT user_id, 2 * least(2, t - 1) * t - least(2, t - 1) * (least(2, t - 1) + 1) AS pairs FROM t")
def w7_pair_count(s: SparkSession, d: str) -> DataFrame:
    t = tables.event_sequences(s, d).select("user_id", F.size("path").cast("long").alias("t"))
    m = F.least(F.lit(2), F.col("t") - 1)
    return t.select("user_id", (2 * m * F.col("t") - m * (m + 1)).alias("pairs"))


@query(f"WITH {EVT} SELECT a.user_id, a.pos::BIGINT AS start, a.k || ',' || b.k || ',' || c.k AS frame FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos = a.pos + 1 JOIN ev c ON a.user_id = c.user_id AND c.pos = a.pos + 2")
def w8_rolling(s: SparkSession, d: str) -> DataFrame:
    e = tables.event_sequences(s, d).filter(F.size("path") >= 3)
    return e.select("user_id", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 3)).alias("i")).select("user_id", F.col("i").cast("long").alias("start"), F.array_join(F.slice("path", F.col("i") + 1, 3).cast("array<string>"), ",").alias("frame"))


PMI_PAIRS = f"WITH {EVT}, c AS (SELECT a.k AS center, b.k AS context, count(*)::DOUBLE AS n FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(b.pos - a.pos) BETWEEN 1 AND 2 GROUP BY 1, 2)"


@query(PMI_PAIRS + f" SELECT center, context, {r6('ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY center) * sum(n) OVER (PARTITION BY context))) - ln(5.0)')} AS pmi FROM c")
def t17_pmi(s: SparkSession, d: str) -> DataFrame:
    return rounded(walks.pmi(walks.context_pairs(tables.event_sequences(s, d), ["user_id"], 2), 5), "pmi")


# ------------------------------------------------------------ components

COMP = f"""WITH RECURSIVE {PARTS}, reach(node_id, label) AS (SELECT src, src FROM parts UNION SELECT e.dst, r.label FROM reach r JOIN parts e ON e.src = r.node_id AND r.label < e.dst),
comp AS (SELECT node_id, min(label) AS component FROM reach GROUP BY node_id), best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
lcc AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM comp WHERE component = (SELECT component FROM best))"""


@query(COMP + " SELECT node_id, component FROM comp")
def g1_components(s: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(tables.parts(s, d))


@query(COMP + " SELECT node_id FROM lcc")
def p2_lcc(s: SparkSession, d: str) -> DataFrame:
    return graph.largest_component(tables.parts(s, d))


@query(COMP + " SELECT a.new_id AS src, b.new_id AS dst, w FROM parts JOIN lcc a ON src = a.node_id JOIN lcc b ON dst = b.node_id")
def p3_lcc_reindex(s: SparkSession, d: str) -> DataFrame:
    return graph.project_to_component(tables.parts(s, d))


@query(COMP + ", deg AS (SELECT src AS node_id, count(*) AS degree FROM parts GROUP BY src) SELECT p_partkey AS node_id, CASE WHEN l.node_id IS NOT NULL THEN degree::DOUBLE END AS degree FROM part LEFT JOIN lcc l ON p_partkey = l.node_id LEFT JOIN deg g ON p_partkey = g.node_id")
def p4_reexpand(s: SparkSession, d: str) -> DataFrame:
    e = tables.parts(s, d)
    inner = graph.degrees(graph.induced(e, graph.largest_component(e))).select("node_id", F.col("degree").cast("double").alias("degree"))
    return graph.reexpand(tables.read(s, d, "part").select(F.col("p_partkey").alias("node_id")), inner)


@query(COMP + " SELECT p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT node_id FROM lcc)")
def j7_outside_lcc(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "part").select(F.col("p_partkey").alias("node_id")).join(graph.largest_component(tables.parts(s, d)), "node_id", "left_anti")


# ------------------------------------------------------------ products, walks in the mean, theory

P = TRADE + ", p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM trade)"


def _product(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM {a} a JOIN {b} b ON a.dst = b.src GROUP BY 1, 2)"


POW = P + ", " + ", ".join([_product("p2", "p", "p"), _product("p3", "p2", "p"), _product("p4", "p3", "p")])
MEAN4 = POW + ", mean4 AS (SELECT src, dst, sum(w) / 4 AS w FROM (SELECT * FROM p UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) GROUP BY 1, 2)"


@query(f"WITH {TRADE} SELECT a.src AS node_id, {r6('sum(a.w * (b.node_id + 1))')} AS val FROM trade a JOIN (SELECT n_nationkey::BIGINT AS node_id FROM nation) b ON a.dst = b.node_id GROUP BY 1")
def j4_spmv(s: SparkSession, d: str) -> DataFrame:
    x = tables.regions(s, d).select("node_id", (F.col("node_id") + 1).cast("double").alias("val"))
    return rounded(algebra.multiply_vector(trade(s, d), x), "val")


@query(f"WITH {POW} SELECT src, dst, {r6('w')} AS w FROM p2")
def j4_spmm(s: SparkSession, d: str) -> DataFrame:
    p = graph.row_probability(trade(s, d))
    return rounded(algebra.multiply(p, p), "w")


@query(f"WITH {MEAN4} SELECT src, dst, {r6('w')} AS w FROM mean4")
def r10_avg_transition(s: SparkSession, d: str) -> DataFrame:
    return rounded(algebra.window_transition(trade(s, d), 4), "w")


RWR = [0.85**i for i in range(4)]


@query(f"WITH {POW} SELECT src, dst, {r6('sum(w)')} AS w FROM (" + " UNION ALL ".join(f"SELECT src, dst, w * {RWR[i] / sum(RWR)!r} AS w FROM {t}" for i, t in enumerate(("p", "p2", "p3", "p4")) if i) + ") GROUP BY 1, 2")
def r9_restart_walk(s: SparkSession, d: str) -> DataFrame:
    return rounded(algebra.restart_walk(trade(s, d), 0.15, 4, offset=1), "w")


TOP_POW = TOP + ", " + ", ".join([_product("a2", "top", "top"), _product("a3", "a2", "top")])


@query(f"WITH {TOP_POW} SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT * FROM top UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) GROUP BY 1, 2")
def r11_power_sum(s: SparkSession, d: str) -> DataFrame:
    return algebra.power_sum(tables.trade_top(s, d), 3)


def _stationary_sql(steps: int) -> str:
    parts = [P, "n AS (SELECT DISTINCT src AS node_id FROM (SELECT src FROM trade UNION ALL SELECT dst FROM trade))", "x0 AS (SELECT node_id, 1.0 / count(*) OVER () AS val FROM n)"]
    parts += [f"x{k} AS (SELECT dst AS node_id, sum(w * val) AS val FROM p JOIN x{k - 1} ON src = node_id GROUP BY dst)" for k in range(1, steps + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(1, steps + 1))
    return f"WITH {', '.join(parts)}, t AS (SELECT node_id, sum(val) AS val FROM ({union}) GROUP BY node_id) SELECT node_id, {r6('val / sum(val) OVER ()')} AS val FROM t"


@query(_stationary_sql(6))
def r12_stationary(s: SparkSession, d: str) -> DataFrame:
    return rounded(algebra.stationary(trade(s, d), 6), "val")


DEG = "deg AS (SELECT src AS node_id, sum(w) AS d FROM trade GROUP BY src), m AS (SELECT sum(w) AS m FROM trade)"


@query(f"WITH {MEAN4}, {DEG} SELECT src, dst, {r6('ln(w) - ln(d / m)')} AS w FROM mean4 JOIN deg ON dst = node_id, m")
def t1_node2vec_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.node2vec_matrix(trade(s, d), 4), "w")


@query(f"WITH {MEAN4}, {DEG} SELECT src, dst, {r6('w * m / d - 1')} AS w FROM mean4 JOIN deg ON dst = node_id, m")
def t2_limit_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.limit_matrix(trade(s, d), 4), "w")


@query(f"WITH {MEAN4}, {DEG}, {REGIONS} SELECT (a.membership = b.membership)::BIGINT AS same, {r6('avg(ln(w) - ln(d / m))')} AS mean, count(*) AS n FROM mean4 JOIN deg ON dst = deg.node_id JOIN regions a ON src = a.node_id JOIN regions b ON dst = b.node_id, m GROUP BY 1")
def t4_block_means(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.block_averages(spectral.node2vec_matrix(trade(s, d), 4), tables.regions(s, d)), "mean")


@query(f"SELECT k, {r6('x')} AS x, {r6('2 * sqrt(greatest(0.4 - x * x, 0)) / (pi() * 0.4)')} AS density FROM (SELECT range AS k, -2 / sqrt(10.0::DOUBLE) + 4 / sqrt(10.0::DOUBLE) * range / 99 AS x FROM range(100))")
def t7_semicircle(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.semicircle(s, 10.0), "x", "density")


@query(f"WITH g AS (SELECT range AS k, -2 / sqrt(10.0::DOUBLE) + 4 / sqrt(10.0::DOUBLE) * range / 99 AS x FROM range(100)), f AS (SELECT x, 2 * sqrt(greatest(0.4 - x * x, 0)) / (pi() * 0.4) AS y FROM g) SELECT {r6('sum(a)')} AS area FROM (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM f)")
def t8_a15_area(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.trapezoid(spectral.semicircle(s, 10.0), "x", "density"), "area")


XS = VECS + ", xs AS (SELECT node_id, vec FROM vecs)"
XL = "xl AS (SELECT node_id, unnest(range(0, 64)) AS dim, unnest(vec) AS val FROM xs)"
SQUARES = "(SELECT sum(pow(list_dot_product(a.vec, b.vec), 2)) FROM xs a, xs b)"  # tr((X'X)^2) = sum of squares of X X'


def _xs(s: SparkSession, d: str) -> DataFrame:
    return tables.vectors(s, d).select("node_id", "vec")


MODULARITY = f"""{XL}, mm AS (SELECT sum(w) AS m, sum(w * w) AS a2 FROM top), dg AS (SELECT src AS node_id, sum(w) AS d FROM top GROUP BY src),
q AS (SELECT (SELECT sum(w * list_dot_product(a.vec, b.vec)) FROM top JOIN xs a ON src = a.node_id JOIN xs b ON dst = b.node_id) AS xax,
(SELECT sum(s * s) FROM (SELECT sum(d * val) AS s FROM dg JOIN xl USING (node_id) GROUP BY dim)) AS xddx, {SQUARES} AS g,
(SELECT sum(d * d) FROM dg) AS d2, (SELECT sum(w * a.d * b.d) FROM top JOIN dg a ON src = a.node_id JOIN dg b ON dst = b.node_id) AS ad)"""


@query(f"WITH {TOP}, {XS}, {MODULARITY} SELECT {r6('(-2 * (xax - xddx / m) + g + a2 - 2 * ad / m + d2 * d2 / (m * m)) / (m * m)')} AS q FROM q, mm")
def t11_modularity_loss(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.modularity_loss(tables.trade_top(s, d), _xs(s, d), D), "q")


@query(f"""WITH {TOP}, {XS}, dg AS (SELECT src AS node_id, sum(w) AS d FROM top GROUP BY src)
SELECT {r6(f'c - 2 * x + {SQUARES}')} AS q FROM
(SELECT sum(w / (da.d * db.d)) AS c, sum(w * list_dot_product(a.vec, b.vec) / sqrt(da.d * db.d)) AS x FROM top JOIN xs a ON src = a.node_id JOIN xs b ON dst = b.node_id JOIN dg da ON src = da.node_id JOIN dg db ON dst = db.node_id)""")
def t14_laplacian_loss(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.laplacian_loss(tables.trade_top(s, d), _xs(s, d), D), "q")


@query(" UNION ALL ".join(f"(WITH {TOP}, {VECS}, xs AS (SELECT node_id, list_transform(range(1, 65), lambda i: (1 - {x!r}) * vec[i] + {x!r} * vec[i % 64 + 1]) AS vec FROM vecs), {MODULARITY} SELECT {x!r}::DOUBLE AS x, {r6('(-2 * (xax - xddx / m) + g + a2 - 2 * ad / m + d2 * d2 / (m * m)) / (m * m)')} AS q FROM q, mm)" for x in (-1.0, 0.5, 2.0)))
def t16_landscape(s: SparkSession, d: str) -> DataFrame:
    """From the vectors to the same with their dimensions moved on by one."""
    a = _xs(s, d)
    b = a.select("node_id", F.concat(F.slice("vec", 2, D - 1), F.slice("vec", 1, 1)).alias("vec"))
    out = None
    for x in (-1.0, 0.5, 2.0):
        part = spectral.modularity_loss(tables.trade_top(s, d), spectral.interpolate(a, b, x), D).select(F.lit(x).alias("x"), "q")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "q")


START = "1 + ((node_id * 7919) % 101) / 101.0::DOUBLE"


def _power_sql(steps: int) -> str:
    parts = [TOP, "dg AS (SELECT src AS node_id, sum(w) AS d FROM top GROUP BY src)", "mm AS (SELECT sum(w) AS m FROM top)", f"x0 AS (SELECT node_id, {START} AS val FROM dg)"]
    for k in range(1, steps + 1):
        parts.append(f"y{k} AS (SELECT node_id, ax / m - d * (SELECT sum(d * val) FROM dg JOIN x{k - 1} USING (node_id)) / (m * m) AS y FROM dg JOIN (SELECT src AS node_id, sum(w * val) AS ax FROM top JOIN x{k - 1} ON dst = node_id GROUP BY src) USING (node_id), mm)")
        parts.append(f"x{k} AS (SELECT node_id, y / sqrt(sum(y * y) OVER ()) AS val FROM y{k})")
    return f"WITH {', '.join(parts)} SELECT node_id, {r6('val')} AS val FROM x{steps}"


@query(_power_sql(5))
def l7_modularity_power(s: SparkSession, d: str) -> DataFrame:
    e = tables.trade_top(s, d)
    start = e.select(F.col("src").alias("node_id")).distinct().select("node_id", (1 + (F.col("node_id") * 7919 % 101) / 101.0).alias("val"))
    return rounded(algebra.modularity_power(e, start, 5), "val")


# ------------------------------------------------------------ clustering and scores


def _voronoi_cte(metric: str, normalized: bool = False) -> str:
    val = "val / greatest(sqrt(sum(val * val) OVER (PARTITION BY dim)), 1e-32)" if normalized else "val"
    score = {
        "cosine": "sum(x.val * c.c) / (sqrt(sum(x.val * x.val)) * sqrt(sum(c.c * c.c)))",
        "dotsim": "sum(x.val * c.c)",
        "euclidean": "-sqrt(sum((x.val - c.c) * (x.val - c.c)))",
    }[metric]
    return f"""{LONG}, x AS (SELECT node_id, label, dim, {val} AS val FROM long), c AS (SELECT label AS g, dim, sum(val) AS c FROM x GROUP BY 1, 2),
sc AS (SELECT x.node_id, x.label, c.g, round({score}, 9) AS s FROM x JOIN c USING (dim) GROUP BY 1, 2, 3),
vor AS (SELECT node_id, label, g AS p FROM sc QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY s DESC, g) = 1)"""


def _voronoi(metric: str, normalized: bool = False) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        v = tables.vectors(s, d)
        return clustering.voronoi(clustering.column_normalized(v, D) if normalized else v, "label", D, metric)

    return f


for _m in ("cosine", "dotsim", "euclidean"):
    query(f"WITH {_voronoi_cte(_m)} SELECT * FROM vor", f"c1_voronoi_{_m}")(_voronoi(_m))
query(f"WITH {_voronoi_cte('cosine', True)} SELECT * FROM vor", "c1_voronoi_normalized")(_voronoi("cosine", True))

CELLS = _voronoi_cte("cosine") + """, cells AS (SELECT label AS y, p, count(*)::DOUBLE AS n FROM vor GROUP BY 1, 2), ny AS (SELECT y, sum(n) AS ny FROM cells GROUP BY y),
np AS (SELECT p, sum(n) AS np FROM cells GROUP BY p), tt AS (SELECT sum(n) AS t FROM cells)"""
ESIM = """, s AS (SELECT sum(n * n / greatest(ny, np)) / max(t) AS raw FROM cells JOIN ny USING (y) JOIN np USING (p), tt),
r AS (SELECT sum((ny * np / t) * (ny * np / t) / greatest(ny, np)) / max(t) AS chance FROM ny, np, tt), es AS (SELECT raw, chance, (raw - chance) / nullif(1 - chance, 0) AS esim FROM s, r)"""
NMI = """, mi AS (SELECT sum(n / t * ln(n * t / (ny * np))) AS mi FROM cells JOIN ny USING (y) JOIN np USING (p), tt),
h AS (SELECT (SELECT -sum(ny / t * ln(ny / t)) FROM ny, tt) AS h_y, (SELECT -sum(np / t * ln(np / t)) FROM np, tt) AS h_p), nm AS (SELECT mi, h_y, h_p, CASE WHEN h_y + h_p = 0 THEN 1 ELSE 2 * mi / (h_y + h_p) END AS nmi FROM mi, h)"""


def _cells(s: SparkSession, d: str) -> DataFrame:
    return metrics.contingency(clustering.voronoi(tables.vectors(s, d), "label", D), "label", "p")


@query(f"WITH {CELLS} SELECT y, p, n::BIGINT AS n FROM cells")
def j8_contingency(s: SparkSession, d: str) -> DataFrame:
    return _cells(s, d)


@query(f"WITH {CELLS}{ESIM} SELECT {r6('raw')} AS raw, {r6('chance')} AS chance, {r6('esim')} AS esim FROM es")
def v1_v2_esim(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.element_similarity(_cells(s, d)), "raw", "chance", "esim")


@query(f"WITH {CELLS}{NMI} SELECT {r6('mi')} AS mi, {r6('h_y')} AS h_y, {r6('h_p')} AS h_p, {r6('nmi')} AS nmi FROM nm")
def v3_v4_nmi(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mutual_information(_cells(s, d)), "mi", "h_y", "h_p", "nmi")


@query(f"WITH {CELLS}{ESIM}{NMI} SELECT 'p' AS variant, 'nmi' AS score_type, {r6('nmi')} AS score FROM nm UNION ALL SELECT 'p', 'esim', {r6('esim')} FROM es")
def v10_score_rows(s: SparkSession, d: str) -> DataFrame:
    labels = clustering.voronoi(tables.vectors(s, d), "label", D)
    return rounded(metrics.score_rows(labels, ["p"], "label"), "score")


ALL_PAIRS = VECS + """, pr AS (SELECT round(list_dot_product(a.vec, b.vec), 9) AS score, (a.label = b.label)::BIGINT AS same FROM vecs a JOIN vecs b ON a.node_id < b.node_id),
gs AS (SELECT score, sum(same) AS pos, sum(1 - same) AS neg FROM pr GROUP BY score)"""


@query(f"WITH {ALL_PAIRS} SELECT {r6('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs)")
def v5_auc(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.all_pairs_auc(tables.vectors(s, d)), "auc")


@query(f"WITH {ALL_PAIRS} SELECT {r6('sum(pos * tp / seen) / sum(pos)')} AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS seen FROM gs)")
def v9_average_precision(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.all_pairs_precision(tables.vectors(s, d)), "ap")


DIST = "(1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))))"


@query(f"WITH {VECS}, n AS (SELECT avg(ln(greatest({DIST}, 1e-12))) AS m, a.label = b.label AS same FROM vecs a JOIN vecs b ON a.node_id < b.node_id GROUP BY 2) SELECT {r6('(SELECT m FROM n WHERE NOT same) - (SELECT m FROM n WHERE same)')} AS log_ratio")
def v7_distance_ratio(s: SparkSession, d: str) -> DataFrame:
    mean = lambda same: F.sum(F.when(same, F.col("total"))) / F.sum(F.when(same, F.col("n")))
    out = metrics.log_distances(tables.vectors(s, d)).agg((mean(~F.col("same")) - mean(F.col("same"))).alias("log_ratio"))
    return rounded(out, "log_ratio")


@query("SELECT c, " + r6("1 - 1 / sqrt(c::DOUBLE)") + " AS mu FROM (VALUES (5), (10), (50)) t(c)")
def v13_detectability(s: SparkSession, d: str) -> DataFrame:
    return rounded(s.createDataFrame([(5,), (10,), (50,)], "c int").withColumn("mu", 1 - 1 / F.sqrt("c")), "mu")


KNN = VECS + ", nn AS (SELECT a.node_id AS src, b.node_id AS dst, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS w FROM vecs a JOIN vecs b ON a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY w DESC, b.node_id) <= 5)"


@query(f"WITH {KNN} SELECT src, dst, {r6('w')} AS w FROM nn")
def j11_knn(s: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.nearest(tables.vectors(s, d), 5), "w")


@query("WITH g AS (SELECT DISTINCT label::BIGINT AS label, vec_id % 3 AS block FROM embeddings) SELECT a.block, a.label, b.label AS other FROM g a JOIN g b ON a.block = b.block AND a.label <> b.label")
def j12_negative_groups(s: SparkSession, d: str) -> DataFrame:
    return sampling.negative_groups(tables.vectors(s, d).withColumn("block", F.col("node_id") % 3))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def m5_positive_pairs(s: SparkSession, d: str) -> DataFrame:
    return sampling.positive_pairs(tables.vectors(s, d))


def _lloyd_sql(steps: int) -> str:
    parts = [LONG, "s0 AS (SELECT label AS g, min(node_id) AS node_id FROM vecs GROUP BY label)", "c0 AS (SELECT g, dim, val AS c FROM s0 JOIN long USING (node_id))"]
    for k in range(1, steps + 1):
        parts.append(f"a{k} AS (SELECT node_id, g AS p FROM (SELECT x.node_id, c.g, round(-sqrt(sum((x.val - c.c) * (x.val - c.c))), 9) AS s FROM long x JOIN c{k - 1} c USING (dim) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY s DESC, g) = 1)")
        parts.append(f"c{k} AS (SELECT p AS g, dim, avg(val) AS c FROM long JOIN a{k} USING (node_id) GROUP BY 1, 2)")
    return f"WITH {', '.join(parts)} SELECT node_id, p FROM a{steps}"


@query(_lloyd_sql(3))
def c2_lloyd_fixed(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d)
    start = v.groupBy("label").agg(F.min_by("vec", "node_id").alias("c")).select(F.col("label").alias("g"), "c")
    return clustering.lloyd(v.select("node_id", "vec"), start, D, 3)


@query(f"WITH {LONG}, g AS (SELECT label, dim, sum(val) AS v, sum(val * val) AS o, count(*) AS n FROM long GROUP BY 1, 2), h AS (SELECT label, sum(v * v) AS vv, sum(o) AS own, max(n) AS n FROM g GROUP BY label) SELECT {r6('sum(vv - own - 0.1 * n * (n - 1))')} AS objective FROM h")
def c7b_objective(s: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.vector_objective(tables.vectors(s, d), "label", D, 0.1), "objective")


# ------------------------------------------------------------ noise samplers


@query(f"WITH {TRADE}, {REGIONS}, b AS (SELECT a.membership AS src, c.membership AS dst, sum(w) AS w FROM trade JOIN regions a ON src = a.node_id JOIN regions c ON dst = c.node_id GROUP BY 1, 2) SELECT src, dst, {r6('w / sum(w) OVER (PARTITION BY src)')} AS w FROM b")
def m1_block_transition(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.block_transition(trade(s, d), tables.regions(s, d)), "w")


@query(f"WITH {TRADE}, v AS (SELECT dst AS node_id, sum(w) AS v FROM trade GROUP BY dst) SELECT node_id, {r6('v / sum(v) OVER ()')} AS p FROM v")
def m2_config_noise(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.noise_distribution(trade(s, d)), "p")


@query(f"WITH {TRADE}, n AS (SELECT src AS node_id FROM trade UNION SELECT dst FROM trade) SELECT node_id, {r6('1.0 / count(*) OVER ()')} AS p FROM n")
def m3_uniform_noise(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.uniform_distribution(trade(s, d)), "p")


@query(f"WITH {TRADE}, {REGIONS}, v AS (SELECT dst AS node_id, membership, sum(w) AS v FROM trade JOIN regions ON dst = node_id GROUP BY 1, 2) SELECT node_id, membership, {r6('v / sum(v) OVER (PARTITION BY membership)')} AS p, {r6('CASE WHEN row_number() OVER (PARTITION BY membership ORDER BY node_id) = count(*) OVER (PARTITION BY membership) THEN 1.0 ELSE sum(v) OVER (PARTITION BY membership ORDER BY node_id ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY membership) END')} AS cdf FROM v")
def m4_conditional_cdf(s: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.with_cdf(sampling.group_distribution(trade(s, d), tables.regions(s, d)), "membership"), "p", "cdf")


# ------------------------------------------------------------ walks


def _uniform_walk_sql(length: int, backtrack: bool) -> str:
    options = "nb.next" if backtrack else "CASE WHEN len(w.path) > 1 THEN list_filter(nb.next, lambda x: x <> w.path[-2]) ELSE nb.next END"
    h = prng.bits_sql(1, "w.start", "0", "len(w.path)")
    return f"""WITH RECURSIVE {TOP}, nb AS (SELECT src, list_sort(list(dst)) AS next FROM top GROUP BY src),
walk(start, path) AS (SELECT src, [src] FROM nb UNION ALL SELECT w.start, list_append(w.path, o[({h} % len(o))::BIGINT + 1]) FROM (SELECT w.start, w.path, {options} AS o FROM walk w JOIN nb ON nb.src = w.path[-1] WHERE len(w.path) < {length}) w WHERE len(o) > 0)
SELECT start, array_to_string(arg_max(path, len(path)), ',') AS path FROM walk GROUP BY start"""


@query(_uniform_walk_sql(8, True))
def r1_walk_uniform(s: SparkSession, d: str) -> DataFrame:
    w = walks.uniform_walks(tables.trade_top(s, d), 8)
    return w.select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(_uniform_walk_sql(8, False))
def r5_walk_nonbacktracking(s: SparkSession, d: str) -> DataFrame:
    w = walks.uniform_walks(tables.trade_top(s, d), 8, backtrack=False)
    return w.select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _biased_walk_sql(length: int) -> str:
    cdf = lambda by, n: f"CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY {n}) = count(*) OVER (PARTITION BY {by}) THEN 1.0 ELSE round(sum(w) OVER (PARTITION BY {by} ORDER BY {n} ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY {by}), 12) END AS cdf"
    parts = [
        TOP,
        f"c1 AS (SELECT src AS cur, dst AS nxt, {cdf('src', 'dst')} FROM top)",
        "lg AS (SELECT e1.src AS prev, e1.dst AS cur, e2.dst AS nxt, e2.w * CASE WHEN e2.dst = e1.src THEN 1 / 0.5 WHEN e3.src IS NOT NULL THEN 1.0 ELSE 1 / 2.0 END AS w FROM top e1 JOIN top e2 ON e1.dst = e2.src LEFT JOIN top e3 ON e3.src = e1.src AND e3.dst = e2.dst)",
        f"c2 AS (SELECT prev, cur, nxt, {cdf('prev, cur', 'nxt')} FROM lg)",
        f"w1 AS (SELECT cur AS start, [cur, arg_min(nxt, (cdf, nxt))] AS path FROM c1 WHERE cdf >= {prng.uniform_sql(1, 'cur', '0', '1')} GROUP BY cur)",
    ]
    for t in range(2, length):
        parts.append(f"w{t} AS (SELECT start, list_append(any_value(path), arg_min(nxt, (cdf, nxt))) AS path FROM w{t - 1} JOIN c2 ON prev = path[-2] AND cur = path[-1] WHERE cdf >= {prng.uniform_sql(1, 'start', '0', str(t))} GROUP BY start)")
    return f"WITH {', '.join(parts)} SELECT start, array_to_string(path, ',') AS path FROM w{length - 1}"


@query(_biased_walk_sql(6))
def r1_walk_node2vec(s: SparkSession, d: str) -> DataFrame:
    w = walks.biased_walks(tables.trade_top(s, d), 6, 0.5, 2.0)
    return w.select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


# ------------------------------------------------------------ result tables

ROWS = """(VALUES ('n~1000_K~2_mu~0.10_name~leigenmap_x', 0.5), ('n~1000_K~50_mu~0.55_name~modspec', 0.25), ('n~2000_mu~bad_name~modspec', NULL), ('plain', 0.75)) t(file, score)"""


def _rows(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("n~1000_K~2_mu~0.10_name~leigenmap_x", 0.5), ("n~1000_K~50_mu~0.55_name~modspec", 0.25), ("n~2000_mu~bad_name~modspec", None), ("plain", 0.75)], "file string, score double")


_PARAM = lambda k: f"nullif(regexp_extract(file, '(?:^|_){k}~([^_]*)', 1), '')"
PARSED = f"parsed AS (SELECT file, score::DOUBLE AS score, {_PARAM('n')} AS n, {_PARAM('K')} AS q, {_PARAM('mu')} AS mu, {_PARAM('name')} AS name FROM {ROWS})"


def _parsed(s: SparkSession) -> DataFrame:
    wide = results.widen(_rows(s).withColumn("params", results.parse_params("file")), ["n", "K", "mu", "name"])
    return wide.withColumnRenamed("K", "q")


@query(f"WITH {PARSED} SELECT * FROM parsed")
def s5_s8_parse_params(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s)


@query(f"WITH {PARSED} SELECT * FROM parsed WHERE (q IN ('2') OR q IS NULL) AND (name IN ('modspec', 'leigenmap') OR name IS NULL)")
def p23_wildcard_filter(s: SparkSession, d: str) -> DataFrame:
    return results.wildcard_filter(_parsed(s), {"q": ["2"], "name": ["modspec", "leigenmap"], "missing": ["x"]})


@query(f"WITH {PARSED} SELECT file, score FROM parsed WHERE score BETWEEN 0.2 AND 0.6 AND NOT contains(file, 'modspec')")
def p24_range_filter(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s).filter(F.col("score").between(0.2, 0.6) & ~F.contains("file", F.lit("modspec"))).select("file", "score")


@query(f"WITH {PARSED} SELECT file, {r6('2 * abs(score - 0.5)')} AS folded, CASE name WHEN 'modspec' THEN 'Modularity' WHEN 'leigenmap' THEN 'Laplacian' END AS label FROM parsed")
def p25_derive(s: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("modspec"), F.lit("Modularity"), F.lit("leigenmap"), F.lit("Laplacian"))
    return rounded(_parsed(s).select("file", (2 * F.abs(F.col("score") - 0.5)).alias("folded"), F.try_element_at(names, F.col("name")).alias("label")), "folded")


@query(f"WITH {PARSED} SELECT file, trunc(TRY_CAST(n AS DOUBLE)) AS n, TRY_CAST(mu AS DOUBLE) AS mu FROM parsed")
def p26_to_numeric(s: SparkSession, d: str) -> DataFrame:
    return results.to_numeric(_parsed(s).select("file", "n", "mu"), ["n"], ["mu"]).withColumn("n", F.col("n").cast("double"))


@query(f"WITH {PARSED} SELECT file, coalesce(q, '') AS q, coalesce(name, '') AS name FROM parsed")
def p27_fillna(s: SparkSession, d: str) -> DataFrame:
    return results.blank_nulls(_parsed(s).select("file", "q", "name"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_inner(s: SparkSession, d: str) -> DataFrame:
    o, c = tables.read(s, d, "orders"), tables.read(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT w.l_suppkey, " + r6("ln(b.m / w.m)") + " AS log_ratio FROM a w JOIN a b ON w.l_suppkey = b.l_suppkey WHERE w.l_returnflag = 'R' AND b.l_returnflag = 'A'")
def j2_within_between(s: SparkSession, d: str) -> DataFrame:
    # one pass with conditional averages instead of a self-join
    l = tables.read(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("w"), F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("b"))
    return rounded(l.filter("w IS NOT NULL AND b IS NOT NULL").select("l_suppkey", F.ln(F.col("b") / F.col("w")).alias("log_ratio")), "log_ratio")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, " + r6("avg(l_quantity)") + " AS mean, " + r6("avg(v)") + " AS var FROM lineitem JOIN (SELECT l_returnflag, l_linestatus, l_linenumber, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linestatus, l_linenumber) GROUP BY ALL")
def j3_three_keys(s: SparkSession, d: str) -> DataFrame:
    l = tables.read(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    k = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return rounded(l.join(l.groupBy(*k).agg(F.var_samp("l_quantity").alias("v")), k).groupBy(*k).agg(F.avg("l_quantity").alias("mean"), F.avg("v").alias("var")), "mean", "var")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j6_semi(s: SparkSession, d: str) -> DataFrame:
    big = tables.read(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.read(s, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j14_left(s: SparkSession, d: str) -> DataFrame:
    c = tables.read(s, d, "customer").select("c_custkey")
    return c.join(tables.read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def o1_o3_sorted_head(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)


@query(f"WITH {TRADE} SELECT * FROM trade QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 3")
def o2_top_k(s: SparkSession, d: str) -> DataFrame:
    return algebra.top_k(trade(s, d), "src", "w", 3, "dst")


@query(f"SELECT n_nationkey, {prng.bits_sql(9, 'n_nationkey')} AS position_key FROM nation")
def o4_shuffle(s: SparkSession, d: str) -> DataFrame:
    n = tables.read(s, d, "nation").select(F.col("n_nationkey").alias("node_id"))
    return sampling.shuffled(n, 9).withColumnRenamed("node_id", "n_nationkey")


@query("SELECT n_nationkey, ntile(4) OVER (ORDER BY n_nationkey)::INTEGER AS batch FROM nation")
def o5_batches(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return tables.read(s, d, "nation").select("n_nationkey", F.ntile(4).over(Window.orderBy("n_nationkey")).alias("batch"))


@query("SELECT s_nationkey::BIGINT AS k, 's' AS kind, s_acctbal AS bal FROM supplier UNION ALL SELECT c_nationkey::BIGINT, 'c', NULL FROM customer")
def o7_union_all(s: SparkSession, d: str) -> DataFrame:
    a = tables.read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"))
    b = tables.read(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.lit("c").alias("kind"))
    return results.concat_results([a, b])


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def o8_o9_union_distinct(s: SparkSession, d: str) -> DataFrame:
    return tables.read(s, d, "lineitem").select(F.col("l_partkey").alias("k")).union(tables.read(s, d, "part").select("p_partkey")).distinct()


@query("SELECT event_type, stat, v FROM (SELECT event_type, " + r6("avg(value)") + " AS mean, " + r6("var_samp(value)") + " AS var FROM events GROUP BY 1) UNPIVOT (v FOR stat IN (mean, var))")
def o10_o11_unpivot(s: SparkSession, d: str) -> DataFrame:
    e = tables.read(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return results.melt(rounded(e, "mean", "var"), ["event_type"], ["mean", "var"], "stat", "v")


# ------------------------------------------------------------ generators


@query("""WITH a AS (SELECT range AS src, range // 10 AS c FROM range(50)), e AS (SELECT a.src, b.src AS dst FROM a JOIN a b ON a.c = b.c AND a.src <> b.src UNION ALL SELECT range * 10 + 9, ((range + 1) * 10) % 50 FROM range(5))
SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst""")
def n6_ring_of_cliques(s: SparkSession, d: str) -> DataFrame:
    return generators.ring_of_cliques(s, 50, 10)


@query("SELECT range AS node_id, (range % 7)::BIGINT AS r, m.g AS membership FROM range(100) JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT (range % 7)::BIGINT AS g FROM range(100))) m ON m.i = range")
def n7_membership(s: SparkSession, d: str) -> DataFrame:
    return generators.membership(s, 100, 7).withColumn("r", F.col("node_id") % 7).select("node_id", "r", "membership")


@query(f"""WITH n AS (SELECT range AS i, range // 50 AS g FROM range(100)), p AS (SELECT a.i AS src, b.i AS dst FROM n a JOIN n b ON a.i < b.i WHERE {prng.uniform_sql(1, 'a.i', 'b.i')} < CASE WHEN a.g = b.g THEN 0.16 ELSE 0.04 END)
SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT * FROM p UNION ALL SELECT dst, src FROM p)""")
def n1_planted_exact(s: SparkSession, d: str) -> DataFrame:
    return generators.planted_partition(s, 100, 2, 16.0, 4.0, exact=True)[0]


@query("SELECT mu, " + r6("2 * 10 - mu * 10") + " AS cin, " + r6("mu * 10") + " AS cout FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) t(mu)")
def n8_cin_cout(s: SparkSession, d: str) -> DataFrame:
    rows = [(mu, *generators.mixing_degrees(10.0, mu, 2)) for mu in (0.1, 0.5)]
    return rounded(s.createDataFrame(rows, "mu double, cin double, cout double"), "cin", "cout")


@query("SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT a AS src, unnest(b) AS dst FROM (VALUES " + ", ".join(f"({a}, {list(b)})" for a, b in generators.KARATE.items()) + ") t(a, b)) UNION ALL SELECT dst, src, 1.0::DOUBLE FROM (SELECT a AS src, unnest(b) AS dst FROM (VALUES " + ", ".join(f"({a}, {list(b)})" for a, b in generators.KARATE.items()) + ") t(a, b))")
def s15_karate(s: SparkSession, d: str) -> DataFrame:
    return generators.karate(s)


@query()
def n1_planted_partition(s: SparkSession, d: str) -> DataFrame:
    return generators.planted_partition(s, 2000, 4, *generators.mixing_degrees(10.0, 0.2, 4))[0]


@query()
def n12_lfr(s: SparkSession, d: str) -> DataFrame:
    return generators.lfr(s, 1000, k=10, minc=50, mu=0.2)[0]


# ------------------------------------------------------------ models: rows only, properties are tested


def _model(key: str, dim: int = 4) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        from .operators.embeddings import PRESETS

        return PRESETS[key]().fit(tables.trade_top(s, d)).transform(dim)

    return f


for _name, _key in (("e6_leigenmap", "leigenmap"), ("e7_adjspec", "adjspec"), ("e8_modspec", "modspec"), ("e10_highorder_modspec", "highorder-modspec"), ("e11_linearized_node2vec", "linearized-node2vec"), ("e12_nonbacktracking", "nonbacktracking"), ("e13_matrixfact", "node2vec-matrixfact"), ("e21_fastrp", "fastrp")):
    query(None, _name)(_model(_key))


@query()
def e1_node2vec(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import Node2Vec

    return Node2Vec(walk_length=20, num_walks=5, window_length=5).fit(tables.trade_top(s, d)).transform(8)


def _walk_model(**options: object) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        from .operators.embeddings import Node2Vec

        return Node2Vec(walk_length=20, **options).fit(tables.trade_top(s, d)).transform(8)

    return f


@query()
def e2_deepwalk(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import DeepWalk

    return DeepWalk(walk_length=20, num_walks=15, window_length=5).fit(tables.trade_top(s, d)).transform(8)



query(None, "e3_line")(_walk_model(num_walks=30, window_length=1))
query(None, "e4_depthfirst")(_walk_model(num_walks=5, window_length=5, p=100.0))
query(None, "e5_nonbacktracking_walks")(_walk_model(num_walks=5, window_length=5, backtrack=False))


@query()
def e9_modspec2(s: SparkSession, d: str) -> DataFrame:
    from .operators.embeddings import DeflatedModularity

    return DeflatedModularity().fit(tables.trade_top(s, d)).transform(4)


def _sampled(loss: str) -> Query:
    def f(s: SparkSession, d: str) -> DataFrame:
        from .operators.embeddings import SampledEmbedding

        return SampledEmbedding(loss, walk_length=20, num_walks=3, window_length=3, epochs=2).fit(tables.trade_top(s, d)).transform(8)

    return f


for _name, _loss in (("e14_sampled_node2vec", "node2vec"), ("e15_sampled_modularity", "modularity"), ("e16_sampled_laplacian", "laplacian")):
    query(None, _name)(_sampled(_loss))


@query()
def c2_kmeans(s: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(tables.vectors(s, d), 10)


@query()
def c4_density(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import density_clusters

    near = clustering.nearest(tables.vectors(s, d), 10).select("src", "dst", (1 - F.col("w")).alias("distance"))
    return density_clusters(near, 5, 0.7)


@query()
def c5_birch(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import cosine_birch

    return cosine_birch(tables.vectors(s, d), 0.3, 10)


@query()
def c7_louvain_vectors(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d)
    return clustering.louvain(v.select("node_id", "vec"), clustering.nearest(v, 5), 0.2, D, 4)


@query()
def c10_lda(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import linear_discriminant

    return linear_discriminant(tables.vectors(s, d).select("node_id", "label", "vec"), D)


@query()
def g2_label_switching(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import label_switching

    return label_switching(tables.parts(s, d))


@query()
def g3_block_model(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import block_model

    return block_model(tables.parts(s, d), 5)


@query()
def g4_belief_propagation(s: SparkSession, d: str) -> DataFrame:
    from .operators.detectors import belief_propagation

    edges, nodes = generators.planted_partition(s, 200, 2, 16.0, 4.0, exact=True)
    return belief_propagation(edges, nodes, 2, 16.0, 4.0, 4)


# ------------------------------------------------------------ training objectives

SAMPLES = VECS + """, nn AS (SELECT count(*) AS n FROM vecs), ctx AS (SELECT node_id AS center, (node_id + j) % n AS context, j, n FROM vecs, nn, (VALUES (1), (2)) t(j)),
pos AS (SELECT center, context, list_dot_product(a.vec, b.vec) AS score FROM ctx JOIN vecs a ON center = a.node_id JOIN vecs b ON context = b.node_id),
draws AS (SELECT center, context, (center + 3 * j + k) % n AS negative FROM ctx, (VALUES (5), (11)) t(k)),
neg AS (SELECT center, context, negative, list_dot_product(a.vec, b.vec) AS score FROM draws JOIN vecs a ON center = a.node_id JOIN vecs b ON negative = b.node_id)"""


def _contexts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Vectors, the next two nodes of every node as contexts, two noise nodes for each context, number of nodes."""
    v = tables.vectors(s, d)
    n = v.count()
    c = v.select(F.col("node_id").alias("center"), F.explode(F.array(F.lit(1), F.lit(2))).alias("j")).withColumn("context", (F.col("center") + F.col("j")) % n)
    noise = c.select("center", "context", F.explode(F.array(F.lit(5), F.lit(11))).alias("k"), "j").select("center", "context", ((F.col("center") + 3 * F.col("j") + F.col("k")) % n).alias("negative"))
    return v, c.select("center", "context"), noise, n


def _scored_samples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    v, c, noise, n = _contexts(s, d)
    return losses.scored(c, v, v, "context"), losses.scored(noise, v, v, "negative"), n


def _center_sql(near: str, far: str) -> str:
    return f"""{SAMPLES}, o AS (SELECT center, avg({near}) AS o FROM pos GROUP BY center), ns AS (SELECT center, avg(n) AS n FROM (SELECT center, context, sum({far}) AS n FROM neg GROUP BY 1, 2) GROUP BY 1), both_ AS (SELECT o, ns.n AS n FROM o JOIN ns USING (center))"""


@query(f"WITH {_center_sql('-ln(1 + exp(-score))', '-ln(1 + exp(score))')} SELECT {r6('-avg(o + n)')} AS loss FROM both_")
def x1_negative_sampling(s: SparkSession, d: str) -> DataFrame:
    pos, neg, _ = _scored_samples(s, d)
    return rounded(losses.negative_sampling(pos, neg), "loss")


@query(f"WITH {_center_sql('score', 'score')} SELECT {r6('avg(both_.n) - avg(o) + 0.5 * (SELECT n FROM nn) * (SELECT avg(score * score) FROM neg)')} AS loss FROM both_")
def x2_modularity_triplet(s: SparkSession, d: str) -> DataFrame:
    pos, neg, n = _scored_samples(s, d)
    return rounded(losses.modularity_triplet(pos, neg, neg, n), "loss")


@query(f"WITH {_center_sql('score', '-score')} SELECT {r6('-avg(o - 0.5 * n * n)')} AS loss FROM both_")
def x3_laplacian_triplet(s: SparkSession, d: str) -> DataFrame:
    pos, neg, _ = _scored_samples(s, d)
    return rounded(losses.laplacian_triplet(pos, neg), "loss")


_COS = "(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))))"
DISTANCES = {"euclidean": "list_distance(u, v)", "cosine": f"(1 - {_COS})", "angular": f"acos(0.99 * {_COS})", "dotsim": "(-list_dot_product(u, v))"}
UV = SAMPLES + """, uv AS (SELECT a.vec AS u, b.vec AS v, y, CASE WHEN y = 1 THEN 1 ELSE 2 END AS pow FROM (SELECT center, context AS other, 1 AS y FROM ctx UNION ALL SELECT center, negative, -1 FROM draws) JOIN vecs a ON center = a.node_id JOIN vecs b ON other = b.node_id)"""


def _uv(s: SparkSession, d: str) -> DataFrame:
    v, c, noise, _ = _contexts(s, d)
    pairs = c.select("center", F.col("context").alias("other"), F.lit(1).alias("y")).unionByName(noise.select("center", F.col("negative").alias("other"), F.lit(-1).alias("y")))
    a, b = (v.select(F.col("node_id").alias(i), F.col("vec").alias(x)) for i, x in (("center", "u"), ("other", "v")))
    return pairs.join(a, "center").join(b, "other").select("u", "v", "y", F.when(F.col("y") == 1, 1).otherwise(2).alias("pow"))


@query(" UNION ALL ".join(f"(WITH {UV} SELECT '{m}' AS metric, {r6(f'-avg(-ln(1 + exp({x} * y)))')} AS logistic, {r6(f'avg({x} * y)')} AS linear FROM uv)" for m, x in DISTANCES.items()))
def x4_pair_loss(s: SparkSession, d: str) -> DataFrame:
    uv, out = _uv(s, d), None
    for m in DISTANCES:
        part = losses.pair_loss(uv, m).withColumnRenamed("loss", "logistic").crossJoin(losses.pair_loss(uv, m, logistic=False).withColumnRenamed("loss", "linear"))  # one row each
        part = part.select(F.lit(m).alias("metric"), "logistic", "linear")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "logistic", "linear")


@query(f"WITH {UV} SELECT {r6('-avg(y * pow(list_dot_product(u, v), pow))')} AS loss FROM uv")
def x4_modularity_pairs(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.modularity_pair_loss(_uv(s, d)), "loss")


# ------------------------------------------------------------ theory tables and further scores


@query(f"WITH {MEAN4}, {DEG} SELECT src, dst, {r6('ln(greatest(w, 1e-12)) - ln(d / m)')} AS w FROM mean4 JOIN deg ON dst = node_id, m")
def t3_floored_matrix(s: SparkSession, d: str) -> DataFrame:
    return rounded(spectral.floored_matrix(trade(s, d), 4), "w")


@query(f"WITH t AS (SELECT range AS t, pow(20 / 60.0::DOUBLE, range) AS lam FROM range(1, 11)) SELECT {r6('avg(1 + lam) / 2000 * 1e6')} AS p_within, {r6('avg(1 - lam) / 2000 * 1e6')} AS p_between, {r6('sum((1 + lam) / pow(30.0, t)) / 2000 / 100 * 1e6')} AS var_within, {r6('sum((1 - lam) / pow(30.0, t)) / 2000 / 100 * 1e6')} AS var_between FROM t")
def t5_pair_moments(s: SparkSession, d: str) -> DataFrame:
    names = ("p_within", "p_between", "var_within", "var_between")
    m = spectral.pair_moments(s, cin=40.0, cout=20.0, size=1000, steps=10)
    return rounded(m.select(*((F.col(c) * 1e6).alias(c) for c in names)), *names)


@query(f"SELECT c, {r6('2 * sqrt(c)')} AS bulk_edge FROM (VALUES (5), (10), (50)) t(c)")
def t10_bulk_edge(s: SparkSession, d: str) -> DataFrame:
    c = results.param_space(s, {"c": [5, 10, 50]}).select(F.col("c").cast("int").alias("c"))
    return rounded(c.withColumn("bulk_edge", 2.0 * F.sqrt("c")), "bulk_edge")


@query(f"""WITH {TRADE}, {REGIONS}, u AS (SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade), b AS (SELECT x.membership AS g, y.membership AS h, sum(w) AS w FROM u JOIN regions x ON src = x.node_id JOIN regions y ON dst = y.node_id GROUP BY 1, 2),
z AS (SELECT g, sum(w) AS s FROM b GROUP BY g) SELECT {r6('min(CASE WHEN g = h THEN w / s END)')} AS within, {r6('max(CASE WHEN g <> h THEN w / s END)')} AS between_, min(CASE WHEN g = h THEN w / s END) > max(CASE WHEN g <> h THEN w / s END) AS holds FROM (SELECT b.g, b.h, w, s FROM b JOIN z ON b.h = z.g)""")
def t18_cut_condition(s: SparkSession, d: str) -> DataFrame:
    e = trade(s, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return rounded(spectral.cut_condition(both, tables.regions(s, d)), "within", "between_")


HALVES = VECS + ", pr AS (SELECT round(vec[1], 9) AS score, (label >= 5)::BIGINT AS same FROM vecs), gs AS (SELECT score, sum(same) AS pos, sum(1 - same) AS neg FROM pr GROUP BY score)"


@query(f"WITH {HALVES} SELECT {r6('abs(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) - 0.5) + 0.5')} AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM gs)")
def v6_folded_auc(s: SparkSession, d: str) -> DataFrame:
    points = tables.vectors(s, d).select(F.round(F.col("vec")[0], 9).alias("score"), (F.col("label") >= 5).cast("long").alias("same"))
    return rounded(metrics.folded_auc(points), "auc")


SIGNS = VECS + """, cells AS (SELECT label >= 5 AS y, vec[1] >= 0 AS p, count(*)::DOUBLE AS n FROM vecs GROUP BY 1, 2), ny AS (SELECT y, sum(n) AS ny FROM cells GROUP BY y),
np AS (SELECT p, sum(n) AS np FROM cells GROUP BY p), tt AS (SELECT sum(n) AS t FROM cells)"""


@query(f"WITH {SIGNS}{NMI} SELECT {r6('nmi')} AS nmi FROM nm")
def v11_sign_nmi(s: SparkSession, d: str) -> DataFrame:
    labels = tables.vectors(s, d).select((F.col("label") >= 5).alias("y"), (F.col("vec")[0] >= 0).alias("p"))
    return rounded(metrics.mutual_information(metrics.contingency(labels)), "nmi").select("nmi")


@query(f"WITH {VECS} SELECT node_id, {r6('list_sum(list_transform(vec, lambda x: CASE WHEN x < 0 THEN 0 ELSE ln(x + 1) END))')} AS total, (list_min(vec) >= 0) AS whole FROM vecs")
def p6_zero_bad(s: SparkSession, d: str) -> DataFrame:
    logs = F.transform("vec", lambda x: F.when(x < 0, float("nan")).otherwise(F.log1p(x)))
    v = tables.vectors(s, d).withColumn("log", logs)
    return rounded(v.select("node_id", F.aggregate(V.zero_bad("log"), F.lit(0.0), lambda a, x: a + x).alias("total"), V.is_whole("log").alias("whole")), "total")


@query("SELECT n AS size, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def a19_size_distribution(s: SparkSession, d: str) -> DataFrame:
    sizes = tables.read(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


# ------------------------------------------------------------ sinks, written to the shared folder and read again


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/sink-{uuid.uuid4().hex}"


@query(f"WITH {TRADE} SELECT src, dst, w FROM trade")
def k1_write_network(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_edges(trade(s, d), path)
    return tables.read_edges(s, path)


@query(f"WITH {VECS} SELECT node_id, {r6('list_sum(vec)')} AS total, 10::INTEGER AS window_length, 'voronoi' AS model FROM vecs")
def k2_write_embedding(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_embedding(tables.vectors(s, d).select("node_id", "vec"), path, window_length=10, model="voronoi")
    read = s.read.parquet(path)
    return rounded(read.select("node_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), "window_length", "model"), "total")


@query(f"WITH {REGIONS} SELECT node_id, membership, v.variant FROM regions, (VALUES ('normalize~False'), ('normalize~True')) v(variant)")
def k3_write_partitions(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    variants = F.explode(F.array(F.lit("normalize~True"), F.lit("normalize~False"))).alias("variant")
    tables.write_partitions(tables.regions(s, d).select("node_id", "membership", variants), path)
    return s.read.parquet(path).select("node_id", "membership", "variant")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS score, 'esim' AS score_type FROM supplier")
def k4_write_scores(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_scores(tables.read(s, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("score"), F.lit("esim").alias("score_type")), path)
    return s.read.schema("s_suppkey long, score double, score_type string").option("header", True).csv(path)


@query(f"WITH {REGIONS} SELECT node_id, membership, 25::BIGINT AS n, 0.5::DOUBLE AS mu FROM regions")
def k5_write_network_bundle(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    tables.write_network(trade(s, d), tables.regions(s, d), {"n": 25, "mu": 0.5}, path)
    params = s.read.schema("n long, mu double").json(f"{path}/params")
    community = s.read.schema("node_id long, membership long").option("sep", "\t").csv(f"{path}/community")
    return community.crossJoin(F.broadcast(params))  # one row of parameters
