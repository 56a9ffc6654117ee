"""Clustering of vectors ``(node_id, vec)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prng
from ..functions.vectors import cosine, dot, euclidean, norm, vector_sum
from ..plans.lineage import checkpoint
from .neighbours import nearest_blocked


def centroids(vectors: DataFrame, group: str, d: int, how: str = "sum") -> DataFrame:
    """``g, c``: sum (or mean) of the member vectors of each group."""
    out = vectors.groupBy(F.col(group).alias("g")).agg(vector_sum("vec", d).alias("c"), F.count(F.lit(1)).alias("n"))
    return out.select("g", "c" if how == "sum" else F.transform("c", lambda x: x / F.col("n")).alias("c"))


#: Centres are sent to every task only up to so many numbers in them all.
MAX_CENTRE_NUMBERS = 50_000_000


def assign(vectors: DataFrame, centers: DataFrame, metric: str = "cosine", digits: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    """Best centre of each vector, the lowest label on ties.

    The centres (as many as groups) are sent to every task, which keeps the
    best one in a running aggregate instead of ranking all combinations.  Their
    size is looked at first; beyond :data:`MAX_CENTRE_NUMBERS` a ValueError is
    raised.
    """
    centers = checkpoint(centers)
    numbers = centers.agg(F.sum(F.size("c"))).first()[0] or 0
    if numbers > MAX_CENTRE_NUMBERS:
        raise ValueError(f"{numbers} numbers in the centres: too many to send to every task")
    score = {"cosine": cosine("vec", "c"), "dotsim": dot("vec", "c"), "euclidean": -euclidean("vec", "c")}[metric]
    scored = vectors.crossJoin(F.broadcast(centers)).select("node_id", *keep, "g", F.round(score, digits).alias("s"))
    best = F.max_by("g", F.struct("s", -F.col("g")))
    return scored.groupBy("node_id", *keep).agg(best.alias("p"))


def voronoi(vectors: DataFrame, group: str, d: int, metric: str = "cosine", how: str = "sum") -> DataFrame:
    """Assignment to the centroids of the true groups: ``node_id, <group>, p``."""
    known = vectors.filter(F.col(group).isNotNull())
    return assign(known, centroids(known, group, d, how), metric, keep=(group,))


def column_normalized(vectors: DataFrame, d: int, guard: float = 1e-32) -> DataFrame:
    """Every dimension scaled to norm 1; one aggregation row is broadcast."""
    norms = vectors.agg(F.array(*(F.greatest(F.sqrt(F.sum(F.col("vec")[i] * F.col("vec")[i])), F.lit(guard)) for i in range(d))).alias("_norms"))
    out = vectors.crossJoin(F.broadcast(norms))
    return out.withColumn("vec", F.zip_with("vec", "_norms", lambda x, n: x / n)).drop("_norms")


def dimension_norms(vectors: DataFrame, d: int) -> DataFrame:
    """``dim, norm`` long form."""
    row = vectors.agg(F.array(*(F.sqrt(F.sum(F.col("vec")[i] * F.col("vec")[i])) for i in range(d))).alias("norms"))
    return row.select(F.posexplode("norms").alias("dim", "norm"))


def kept_dimensions(norms: DataFrame) -> DataFrame:
    """Dimensions with norm of at least the root of the largest, without the largest; that one alone if none is left."""
    top = norms.agg(F.max_by("dim", F.struct("norm", -F.col("dim"))).alias("top"), F.max("norm").alias("most"))
    marked = norms.crossJoin(F.broadcast(top)).withColumn("ok", (F.col("norm") >= F.sqrt("most")) & (F.col("dim") != F.col("top")))
    some = marked.agg(F.max("ok").alias("some"))
    return marked.crossJoin(F.broadcast(some)).filter(F.col("ok") | (~F.col("some") & (F.col("dim") == F.col("top")))).select("dim", "norm")


def lloyd(vectors: DataFrame, start: DataFrame, d: int, steps: int) -> DataFrame:
    """K-means with fixed starting centres ``g, c`` and a fixed number of steps: ``node_id, p``."""
    centers = start
    for k in range(steps):
        labels = assign(vectors, centers, "euclidean")
        if k == steps - 1:
            return labels
        members = vectors.join(labels, "node_id")
        centers = centroids(members, "p", d, "mean")
    raise ValueError("steps must be at least 1")


def minibatch_kmeans(vectors: DataFrame, start: DataFrame, d: int, batches: int, seed: int = 0) -> DataFrame:
    """K-means that sees one keyed batch of the unit vectors after the other; each centre is the mean of all it was given.

    ``start``: ``g, c``.  Returns ``node_id, p`` of the last centres.
    """
    rows = checkpoint(unit_rows(vectors.select("node_id", "vec")))
    centers = start.select("g", "c", F.lit(0).cast("long").alias("n"))
    for b in range(batches):
        batch = rows.filter(prng.bits(seed, "node_id") % batches == b)
        given = batch.join(assign(batch, centers.select("g", "c"), "euclidean"), "node_id").groupBy(F.col("p").alias("g")).agg(vector_sum("vec", d).alias("s"), F.count(F.lit(1)).alias("m"))
        joined = centers.join(given, "g", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        mean = F.zip_with("c", "s", lambda c, x: (c * F.col("n") + x) / (F.col("n") + F.col("m")))
        centers = checkpoint(joined.select("g", F.when(F.col("m") > 0, mean).otherwise(F.col("c")).alias("c"), (F.col("n") + F.col("m")).alias("n")))
    return assign(rows, centers.select("g", "c"), "euclidean")


def nearest(vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact cosine neighbours ``src, dst, w``, ties by id."""
    return nearest_blocked(vectors, k, digits=digits)


def nearest_lsh(vectors: DataFrame, k: int, bucket: float = 0.5, tables: int = 4, within: float = 1.0) -> DataFrame:
    """Approximate neighbours by random projections: only vectors that share a bucket are compared."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("node_id", array_to_vector("vec").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(data)
    pairs = model.approxSimilarityJoin(data, data, within, "distance").select(F.col("datasetA.node_id").alias("src"), F.col("datasetB.node_id").alias("dst"), "distance").filter("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return pairs.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def kmeans(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("node_id", array_to_vector("vec").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="p").fit(data)
    return model.transform(data).select("node_id", "p")


def vector_objective(vectors: DataFrame, group: str, d: int, rho: float) -> DataFrame:
    """Sum over groups of |V|^2 - rho N (N - 1), less the vectors' own squares."""
    by = vectors.groupBy(group).agg(vector_sum("vec", d).alias("v"), F.count(F.lit(1)).alias("n"), F.sum(dot("vec", "vec")).alias("own"))
    return by.agg(F.sum(dot("v", "v") - F.col("own") - rho * F.col("n") * (F.col("n") - 1)).alias("objective"))


def louvain(vectors: DataFrame, neighbours: DataFrame, rho: float, d: int, rounds: int = 6) -> DataFrame:
    """Label switching for vectors: each takes the neighbouring group with the largest <z, V> - rho N.

    Odd and even keyed numbers move in turns, which keeps two neighbours from
    swapping labels; a group joins only if it gains.
    """
    neighbours = checkpoint(neighbours.select("src", "dst"))  # read in every round
    labels = vectors.select("node_id", F.col("node_id").alias("g"))
    for r in range(rounds):
        members = checkpoint(vectors.join(labels, "node_id"))
        groups = members.groupBy("g").agg(vector_sum("vec", d).alias("v"), F.count(F.lit(1)).alias("n"))
        movers = members.filter(prng.bits(0, "node_id") % 2 == r % 2)
        around = neighbours.select(F.col("src").alias("node_id"), F.col("dst")).join(labels.select(F.col("node_id").alias("dst"), F.col("g").alias("to")), "dst").select("node_id", "to")
        options = movers.select("node_id", F.col("g").alias("to")).union(around.join(movers.select("node_id"), "node_id", "left_semi")).distinct()
        own = F.when(F.col("to") == F.col("g"), 1).otherwise(0)
        gains = options.join(movers, "node_id").join(groups.select(F.col("g").alias("to"), "v", "n"), "to")
        gains = gains.select("node_id", "to", (dot("vec", "v") - own * dot("vec", "vec") - rho * (F.col("n") - own)).alias("gain"))
        best = gains.groupBy("node_id").agg(F.max_by("to", F.struct(F.round("gain", 9), -F.col("to"))).alias("new"))
        labels = checkpoint(labels.join(best, "node_id", "left").select("node_id", F.coalesce("new", "g").alias("g")))
    return labels


def unit_rows(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", F.transform("vec", lambda x: x / F.greatest(norm("vec"), F.lit(1e-24))))


def logistic_threshold(points: DataFrame, steps: int = 8) -> DataFrame:
    """One row ``intercept, slope, rho`` of the logistic curve of ``y`` (0/1) over ``x``: rho is where the odds are even.

    Both classes weigh as much as each other.  Newton steps; five sums reach
    the driver in each.
    """
    points = checkpoint(points)  # read in every step
    counts = points.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    p, n = float(counts["p"] or 1), float(counts["n"] or 1)
    weight = F.when(F.col("y") == 1, (p + n) / (2 * p)).otherwise((p + n) / (2 * n))
    b0 = b1 = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.col("x"))))
        r, h = weight * (F.col("y") - q), weight * q * (1 - q)
        row = points.agg(F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(h).alias("h00"), F.sum(h * F.col("x")).alias("h01"), F.sum(h * F.col("x") * F.col("x")).alias("h11")).first()
        det = row["h00"] * row["h11"] - row["h01"] ** 2
        b0, b1 = b0 + (row["h11"] * row["g0"] - row["h01"] * row["g1"]) / det, b1 + (row["h00"] * row["g1"] - row["h01"] * row["g0"]) / det
    return points.sparkSession.createDataFrame([(b0, b1, -b0 / b1)], "intercept double, slope double, rho double")


def neighbour_threshold(vectors: DataFrame, neighbours: DataFrame, *, others: int = 3, steps: int = 6, digits: int = 4) -> float:
    """Inner product at which neighbours and arbitrary pairs are equally likely, rounded.

    Every vector is paired with ``others`` vectors by a rule on its id; ids run
    from 0 to the number of vectors less 1.
    """
    n = vectors.count()
    a, b = vectors.select(F.col("node_id").alias("src"), F.col("vec").alias("u")), vectors.select(F.col("node_id").alias("dst"), F.col("vec").alias("v"))
    near = neighbours.select("src", "dst", F.lit(1).alias("y"))
    other = vectors.select(F.col("node_id").alias("src"), F.explode(F.array(*(F.lit(j) for j in range(others)))).alias("j")).select("src", ((F.col("src") * 7 + 3 * F.col("j") + 1) % n).alias("dst"), F.lit(0).alias("y"))
    points = near.unionByName(other).join(a, "src").join(b, "dst").select(dot("u", "v").alias("x"), "y")
    return round(float(logistic_threshold(points, steps).first()["rho"]), digits)


def _group_sums(nodes: DataFrame, labels: DataFrame, d: int) -> DataFrame:
    return checkpoint(nodes.join(labels, "node_id").groupBy("g").agg(vector_sum("vec", d).alias("v"), F.sum("size").alias("n")))


def louvain_levels(vectors: DataFrame, neighbours: DataFrame, rho: float | None, d: int, *, levels: int = 10, rounds: int = 10, least_moved: float = 0.001) -> tuple[DataFrame, list[float]]:
    """Communities of vectors: ``node_id, g``, and the sum over groups of |V|^2 - rho N^2 after every round.

    A node moves to the group of a neighbour with the largest gain <z, V> - rho
    n N (z its vector, n its size; V, N without itself).  Keyed halves take
    turns; a round that would lower the sum is left out.  A level ends when
    fewer than ``least_moved`` of its nodes move in two turns; groups then
    become nodes with summed vectors and sizes, until a level moves nothing.
    ``rho``: :func:`neighbour_threshold` by default.
    """
    neighbours = checkpoint(neighbours.select("src", "dst"))  # read by the threshold and as links
    rho = neighbour_threshold(vectors, neighbours) if rho is None else rho
    nodes = checkpoint(vectors.select("node_id", "vec", F.lit(1).cast("long").alias("size")))
    links = checkpoint(neighbours.distinct())
    whole, trace = None, []
    for _ in range(levels):
        labels = nodes.select("node_id", F.col("node_id").alias("g"))
        groups = _group_sums(nodes, labels, d)
        total = lambda g: float(g.agg(F.sum(dot("v", "v") - rho * F.col("n") * F.col("n"))).first()[0] or 0.0)
        best_sum, n, idle, any_moved = total(groups), nodes.count(), 0, False
        for r in range(rounds):
            if idle < 2:
                members = nodes.join(labels, "node_id")
                movers = checkpoint(members.filter(prng.bits(0, "node_id") % 2 == r % 2))
                around = links.withColumnRenamed("src", "node_id").join(labels.select(F.col("node_id").alias("dst"), F.col("g").alias("to")), "dst").select("node_id", "to").join(movers.select("node_id"), "node_id", "left_semi")
                options = movers.select("node_id", F.col("g").alias("to")).union(around).distinct()
                own = F.when(F.col("to") == F.col("g"), 1).otherwise(0)
                gains = options.join(movers, "node_id").join(groups.select(F.col("g").alias("to"), "v", "n"), "to")
                gains = gains.select("node_id", "g", "to", F.round(dot("vec", "v") - own * dot("vec", "vec") - rho * F.col("size") * (F.col("n") - own * F.col("size")), 9).alias("gain"))
                best = gains.groupBy("node_id", "g").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"))
                moved = checkpoint(best.filter("to <> g").select("node_id", "to"))
                then = checkpoint(labels.join(moved, "node_id", "left").select("node_id", F.coalesce("to", "g").alias("g")))
                sums = _group_sums(nodes, then, d)
                now, count = total(sums), moved.count()
                if now > best_sum + 1e-9:
                    labels, groups, best_sum, any_moved = then, sums, now, True
                    idle = 0 if count >= least_moved * n else idle + 1
                else:
                    idle += 1
            trace.append(best_sum)
        whole = labels if whole is None else checkpoint(whole.withColumnRenamed("g", "inner").join(labels.withColumnRenamed("node_id", "inner"), "inner").select("node_id", "g"))
        if not any_moved:
            break
        ends = (labels.select(F.col("node_id").alias(c), F.col("g").alias(f"g{c}")) for c in ("src", "dst"))
        a, b = ends
        links = checkpoint(links.join(a, "src").join(b, "dst").filter("gsrc <> gdst").select(F.col("gsrc").alias("src"), F.col("gdst").alias("dst")).distinct())
        nodes = groups.select(F.col("g").alias("node_id"), F.col("v").alias("vec"), F.col("n").alias("size"))
    return whole, trace
