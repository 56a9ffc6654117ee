"""Registered queries: modules by the map equation, density clusters, neighbour search and vector communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import PARTS, VECS, D, query, rounded
from .functions import prng
from .further import _logistic_sql
from .operators import clustering, hdbscan, mapequation
from .operators.neighbours import nearest_blocked
from .sources import tables

_PARTS, _LABELS, _STEPS = mapequation.oracle_ctes("parts", 3, 2)
_MAP = f"WITH {PARTS}, " + ", ".join(_PARTS)


@query(f"{_MAP} SELECT node_id::BIGINT AS node_id, g::BIGINT AS g FROM {_LABELS}")
def g2_map_equation(s: SparkSession, d: str) -> DataFrame:
    return mapequation.map_equation(tables.parts(s, d), rounds=3, levels=2)[0]


@query(f"{_MAP} " + " UNION ALL ".join(f"SELECT {k} AS step, round(len, 6) AS code_length FROM {c}" for k, c in enumerate(_STEPS)))
def g2_code_lengths(s: SparkSession, d: str) -> DataFrame:
    _, trace = mapequation.map_equation(tables.parts(s, d), rounds=3, levels=2)
    return s.createDataFrame(list(enumerate(trace)), "step int, code_length double").withColumn("code_length", F.round("code_length", 6))


_COSINE = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"


@query(f"WITH {VECS} SELECT a.node_id AS src, b.node_id AS dst, round(round({_COSINE}, 9), 6) + 0.0 AS w FROM vecs a JOIN vecs b ON a.node_id <> b.node_id WHERE a.node_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY round({_COSINE}, 9) DESC, b.node_id) <= 10")
def j11_knn_blocked(s: SparkSession, d: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 50, among all vectors."""
    v = tables.vectors(s, d)
    return rounded(nearest_blocked(v, 10, v.filter("node_id % 50 = 0")), "w")


@query(f"WITH {VECS} SELECT a.node_id AS src, b.node_id AS dst, round(round({_COSINE}, 9), 6) + 0.0 AS w FROM vecs a JOIN vecs b ON a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY round({_COSINE}, 9) DESC, b.node_id) <= 5")
def j11_knn_graph(s: SparkSession, d: str) -> DataFrame:
    """Five neighbours of every vector, through tiles of 128 x 64."""
    return rounded(nearest_blocked(tables.vectors(s, d), 5, block=128, lot=64), "w")


def _tree_ctes(samples: int, rounds: int, jumps: int) -> tuple[list[str], list[str]]:
    """Boruvka rounds in SQL: the lightest edge of every component; pointers are followed by doubling."""
    parts = [
        VECS,
        f"pw AS MATERIALIZED (SELECT a.node_id AS a, b.node_id AS b, round(sqrt(greatest(2 - 2 * round({_COSINE}, 9), 0)), 9) AS x FROM vecs a JOIN vecs b ON a.node_id <> b.node_id)",
        f"co AS MATERIALIZED (SELECT a, max(x) AS core FROM (SELECT a, x FROM pw QUALIFY row_number() OVER (PARTITION BY a ORDER BY x, b) <= {samples}) GROUP BY a)",
        "mr AS MATERIALIZED (SELECT pw.a, pw.b, greatest(x, p.core, q.core) AS w FROM pw JOIN co p ON pw.a = p.a JOIN co q ON pw.b = q.a)",
        "l0 AS (SELECT node_id, node_id AS c FROM vecs)",
    ]
    for r in range(rounds):
        parts.append(f"b{r} AS MATERIALIZED (SELECT x.c, min({{'w': w, 'a': least(a, b), 'b': greatest(a, b)}}) AS e FROM mr JOIN l{r} x ON a = x.node_id JOIN l{r} y ON b = y.node_id WHERE x.c <> y.c GROUP BY x.c)")
        parts.append(f"t{r} AS MATERIALIZED (SELECT b.c, CASE WHEN x.c = b.c THEN y.c ELSE x.c END AS d FROM b{r} b JOIN l{r} x ON x.node_id = e.a JOIN l{r} y ON y.node_id = e.b)")
        parts.append(f"p{r}_0 AS MATERIALIZED (SELECT t.c, CASE WHEN u.d = t.c AND t.c < t.d THEN t.c ELSE t.d END AS d FROM t{r} t JOIN t{r} u ON u.c = t.d)")
        for j in range(jumps):
            parts.append(f"p{r}_{j + 1} AS MATERIALIZED (SELECT t.c, u.d FROM p{r}_{j} t JOIN p{r}_{j} u ON u.c = t.d)")
        parts.append(f"l{r + 1} AS MATERIALIZED (SELECT node_id, coalesce(d, l.c) AS c FROM l{r} l LEFT JOIN p{r}_{jumps} p ON p.c = l.c)")
    return parts, [f"SELECT e.a AS a, e.b AS b, e.w AS w FROM b{r}" for r in range(rounds)]


_TREE, _CHOSEN = _tree_ctes(5, 9, 9)


@query(f"WITH {', '.join(_TREE)} SELECT a, b, round(w, 6) + 0.0 AS w FROM ({' UNION '.join(_CHOSEN)})")
def c4_spanning_tree(s: SparkSession, d: str) -> DataFrame:
    return rounded(hdbscan.spanning_tree(tables.vectors(s, d), 5), "w")


@query()
def c4_hdbscan(s: SparkSession, d: str) -> DataFrame:
    """Clusters of five vectors or more; the tree equals SQL, the hierarchy a brute-force version in the tests."""
    return hdbscan.hdbscan(tables.vectors(s, d), least=5)


def _levels_ctes(levels: int, rounds: int, k: int, d: int) -> tuple[list[str], str, list[str]]:
    """Vector communities in SQL: CTEs, the last labels, and for every round the expression of its sum."""
    near = f"SELECT a.node_id AS src, b.node_id AS dst FROM vecs a JOIN vecs b ON a.node_id <> b.node_id QUALIFY row_number() OVER (PARTITION BY a.node_id ORDER BY round({_COSINE}, 9) DESC, b.node_id) <= {k}"
    parts = [VECS, f"rh AS MATERIALIZED (SELECT rho FROM ({_logistic_sql(6)}))", f"e0 AS MATERIALIZED ({near})", f"z0 AS MATERIALIZED (SELECT node_id, unnest(range(0, {d})) AS dim, unnest(vec) AS val FROM vecs)", "n0 AS (SELECT node_id, 1::BIGINT AS size FROM vecs)"]
    steps: list[str] = []

    def groups(name: str, labels: str, level: int) -> None:
        parts.append(f"{name}v AS MATERIALIZED (SELECT g, dim, sum(val) AS v FROM z{level} JOIN {labels} USING (node_id) GROUP BY 1, 2)")
        parts.append(f"{name}n AS MATERIALIZED (SELECT g, sum(size) AS n FROM n{level} JOIN {labels} USING (node_id) GROUP BY 1)")
        parts.append(f"{name}t AS MATERIALIZED (SELECT (SELECT sum(v * v) FROM {name}v) - rho * (SELECT sum(n * n) FROM {name}n) AS total FROM rh)")

    whole = ""
    for level in range(levels):
        current = f"i{level}"
        parts.append(f"{current} AS (SELECT node_id, node_id AS g FROM n{level})")
        groups(f"s{level}_0", current, level)
        for r in range(rounds):
            x, s = f"r{level}_{r}", f"s{level}_{r}"
            parts.append(f"{x}m AS MATERIALIZED (SELECT node_id, g, size FROM {current} JOIN n{level} USING (node_id) WHERE {prng.bits_sql(0, 'node_id')} % 2 = {r % 2})")
            parts.append(f"{x}o AS MATERIALIZED (SELECT node_id, g AS t FROM {x}m UNION SELECT src, l.g FROM e{level} JOIN {current} l ON dst = l.node_id JOIN {x}m m ON src = m.node_id)")
            parts.append(f"{x}q AS MATERIALIZED (SELECT node_id, sum(val * val) AS zz FROM z{level} GROUP BY 1)")
            parts.append(f"{x}z AS MATERIALIZED (SELECT o.node_id, o.t, sum(val * v) AS zv FROM {x}o o JOIN z{level} z ON z.node_id = o.node_id JOIN {s}v v ON v.g = o.t AND v.dim = z.dim GROUP BY 1, 2)")
            gain = "round(zv - CASE WHEN z.t = m.g THEN zz ELSE 0 END - rho * m.size * (n - CASE WHEN z.t = m.g THEN m.size ELSE 0 END), 9)"
            parts.append(f"{x}b AS MATERIALIZED (SELECT z.node_id, arg_max(z.t, ({gain}, -z.t)) AS t FROM {x}z z JOIN {x}m m ON m.node_id = z.node_id JOIN {x}q q ON q.node_id = z.node_id JOIN {s}n n ON n.g = z.t, rh GROUP BY 1)")
            parts.append(f"{x}a AS MATERIALIZED (SELECT l.node_id, coalesce(t, g) AS g FROM {current} l LEFT JOIN {x}b b ON b.node_id = l.node_id)")
            groups(x, f"{x}a", level)
            better = f"(SELECT total FROM {x}t) > (SELECT total FROM {s}t) + 1e-9"
            parts.append(f"{x}l AS MATERIALIZED (SELECT l.node_id, CASE WHEN {better} THEN a.g ELSE l.g END AS g FROM {current} l JOIN {x}a a ON a.node_id = l.node_id)")
            current = f"{x}l"
            groups(f"s{level}_{r + 1}", current, level)
            steps.append(f"s{level}_{r + 1}t")
        if whole:
            parts.append(f"w{level} AS MATERIALIZED (SELECT a.node_id, b.g FROM {whole} a JOIN {current} b ON a.g = b.node_id)")
            whole = f"w{level}"
        else:
            whole = current
        last = f"s{level}_{rounds}"
        parts.append(f"z{level + 1} AS (SELECT g AS node_id, dim, v AS val FROM {last}v)")
        parts.append(f"n{level + 1} AS (SELECT g AS node_id, n::BIGINT AS size FROM {last}n)")
        parts.append(f"e{level + 1} AS MATERIALIZED (SELECT DISTINCT a.g AS src, b.g AS dst FROM e{level} JOIN {current} a ON src = a.node_id JOIN {current} b ON dst = b.node_id WHERE a.g <> b.g)")
    return parts, whole, steps


_LOUVAIN, _GROUPS, _SUMS = _levels_ctes(2, 3, 5, D)


@query(f"WITH {', '.join(_LOUVAIN)} SELECT node_id, g FROM {_GROUPS}")
def c7_louvain_levels(s: SparkSession, d: str) -> DataFrame:
    v = tables.vectors(s, d).select("node_id", "vec")
    return clustering.louvain_levels(v, nearest_blocked(v, 5), None, D, levels=2, rounds=3, least_moved=0.0)[0]


@query(f"WITH {', '.join(_LOUVAIN)} " + " UNION ALL ".join(f"SELECT {k} AS step, round(total, 4) + 0.0 AS total FROM {c}" for k, c in enumerate(_SUMS)))
def c7_louvain_sums(s: SparkSession, d: str) -> DataFrame:
    """The sum that the rounds raise, after each of them."""
    v = tables.vectors(s, d).select("node_id", "vec")
    _, trace = clustering.louvain_levels(v, nearest_blocked(v, 5), None, D, levels=2, rounds=3, least_moved=0.0)
    return rounded(s.createDataFrame(list(enumerate(trace)), "step int, total double"), "total", digits=4)
