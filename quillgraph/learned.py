"""Registered queries: the tree of the hierarchical softmax and models that train on partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import PARTS, TRADE, query
from .functions import prng
from .operators.embeddings import SampledEmbedding
from .operators.huffman import huffman_codes
from .operators.rejection import rejection_walks
from .operators.sampling import uniform_distribution
from .sources import tables


def _huffman_sql(rounds: int) -> str:
    """Rounds of merged pairs, unrolled; once one node is left nothing more changes."""
    out = [PARTS, "a0 AS MATERIALIZED (SELECT sum(w) AS w, 0 AS inn, src AS id FROM parts GROUP BY src)", "size AS (SELECT count(*) AS n FROM a0)"]
    for i in range(rounds):
        out.append(f"s{i} AS (SELECT sum(w) AS s FROM (SELECT w FROM a{i} ORDER BY w, inn, id LIMIT 2) HAVING count(*) = 2)")
        out.append(f"l{i} AS (SELECT w, inn, id, row_number() OVER (ORDER BY w, inn, id) - 1 AS r, count(*) OVER () AS m FROM a{i} WHERE w <= (SELECT s FROM s{i}))")
        out.append(f"c{i} AS MATERIALIZED (SELECT w, inn, id, (SELECT n FROM size) - (SELECT count(*) FROM a{i}) + r // 2 AS parent, r % 2 AS bit FROM l{i} WHERE r < m - m % 2)")
        out.append(f"a{i + 1} AS MATERIALIZED (SELECT w, inn, id FROM a{i} ANTI JOIN c{i} USING (inn, id) UNION ALL SELECT sum(w), 1, parent FROM c{i} GROUP BY parent)")
    tree = " UNION ALL ".join(f"SELECT inn, id, parent, bit FROM c{i}" for i in range(rounds))
    out.append(f"tree AS MATERIALIZED ({tree})")
    out.append(
        f"down AS (SELECT inn, id, '' AS code, '' AS points FROM a{rounds} UNION ALL "
        "SELECT t.inn, t.id, d.code || t.bit::VARCHAR, d.points || CASE WHEN d.points = '' THEN '' ELSE ' ' END || t.parent::VARCHAR FROM down d JOIN tree t ON d.inn = 1 AND t.parent = d.id)"
    )
    return "WITH RECURSIVE " + ", ".join(out)


@query(f"{_huffman_sql(24)} SELECT id AS node_id, code, points FROM down WHERE inn = 0")
def e2_huffman_codes(s: SparkSession, d: str) -> DataFrame:
    """Codes and inner nodes of the parts by degree, the frequency of a node in walks."""
    degrees = tables.parts(s, d).groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("weight"))
    codes = huffman_codes(degrees)
    return codes.select("node_id", *(F.concat_ws(sep, F.col(c).cast("array<string>")).alias(c) for c, sep in (("code", ""), ("points", " "))))


@query()
def e14_sampled_parts(s: SparkSession, d: str) -> DataFrame:
    """Skip-gram on the graph of parts, both tables in four blocks that meet in turns; cliques and gradients are tested, no SQL."""
    return SampledEmbedding(walk_length=20, num_walks=3, window_length=3, epochs=1, parts=4).fit(tables.parts(s, d)).transform(8)


@query()
def e14_uniform_noise_parts(s: SparkSession, d: str) -> DataFrame:
    """The same with noise nodes alike by a sampler of the caller's."""
    return SampledEmbedding(walk_length=20, num_walks=3, window_length=3, epochs=1, parts=2, noise_sampler=uniform_distribution).fit(tables.parts(s, d)).transform(8)


def _rejection_sql(edges: str, name: str, length: int, p: float, q: float) -> str:
    """One attempt of every open walk in each step of the recursion."""
    most = max(1 / p, 1.0, 1 / q)
    key = ("start", "0", "len(path)", "attempt")
    bias = f"CASE WHEN len(path) = 1 THEN {most} WHEN cand = path[-2] THEN {1 / p} WHEN e.src IS NOT NULL THEN 1.0 ELSE {1 / q} END::DOUBLE"
    return f"""WITH RECURSIVE {edges}, nb AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS o, list(w ORDER BY dst) AS ws, max(w) AS most FROM {name} GROUP BY src),
walk(start, path, attempt) AS (SELECT src, [src], 0 FROM nb UNION ALL
SELECT start, CASE WHEN ok THEN list_append(path, cand) ELSE path END, CASE WHEN ok THEN 0 ELSE attempt + 1 END FROM (
SELECT start, path, attempt, cand, n = 1 OR {prng.uniform_sql(2, *key)} < share * ({bias} / {most}::DOUBLE) AS ok FROM (
SELECT start, path, attempt, len(o) AS n, o[i] AS cand, ws[i] / most AS share FROM (
SELECT w.*, nb.*, ({prng.bits_sql(1, *key)} % len(o))::BIGINT + 1 AS i FROM walk w JOIN nb ON nb.src = w.path[-1] WHERE len(path) < {length})) LEFT JOIN {name} e ON e.src = path[-2] AND e.dst = cand))
SELECT start, array_to_string(arg_max(path, len(path)), ',') AS path FROM walk GROUP BY start"""


def _joined(paths: DataFrame) -> DataFrame:
    return paths.select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(_rejection_sql(PARTS, "parts", 6, 0.5, 2.0))
def r1_rejection_parts(s: SparkSession, d: str) -> DataFrame:
    """Biased walks from every part by rejection; the line graph isn't built."""
    return _joined(rejection_walks(tables.parts(s, d), 6, 0.5, 2.0))


@query(_rejection_sql(TRADE, "trade", 6, 4.0, 0.5))
def r2_rejection_weighted(s: SparkSession, d: str) -> DataFrame:
    """Biased walks that also follow the weights of trade."""
    return _joined(rejection_walks(tables.trade(s, d), 6, 4.0, 0.5))
