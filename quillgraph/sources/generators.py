"""Synthetic networks, all reproducible from a seed and generated by executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prng
from ..operators.graph import symmetrize, without_loops


def ring_of_cliques(spark: SparkSession, n: int, size: int) -> DataFrame:
    """Cliques of ``size`` nodes; the last of each is joined to the first of the next; both directions."""
    a = spark.range(n).select(F.col("id").alias("src"), F.floor(F.col("id") / size).alias("c"))
    inside = a.join(a.select(F.col("src").alias("dst"), "c"), "c").filter("src <> dst").select("src", "dst")
    bridges = spark.range(n // size).select((F.col("id") * size + size - 1).alias("src"), F.pmod((F.col("id") + 1) * size, F.lit(n)).alias("dst"))
    return without_loops(symmetrize(inside.union(bridges).withColumn("w", F.lit(1.0))))


def membership(spark: SparkSession, n: int, q: int) -> DataFrame:
    """Balanced sorted membership: group sizes differ by one at most, larger groups first."""
    base, extra = divmod(n, q)
    i = F.col("id")
    cut = extra * (base + 1)
    group = F.when(i < cut, F.floor(i / (base + 1))).otherwise(F.floor((i - cut) / max(base, 1)) + extra)
    return spark.range(n).select(i.alias("node_id"), group.cast("long").alias("membership"))


def mixing_degrees(cave: float, mixing: float, q: int) -> tuple[float, float]:
    """Expected within and between degrees (cin, cout) of a planted partition."""
    cout = cave * mixing
    return q * cave - (q - 1) * cout, cout


def difference_degrees(cave: float, cdiff: float, n: int, k: int) -> tuple[float, float]:
    nc = round(n / k)
    return max(1.0, (n - nc) / n * cdiff + cave), max(1.0, cave - nc / n * cdiff)


def planted_partition(spark: SparkSession, n: int, q: int, cin: float, cout: float, seed: int = 1, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes).  ``exact``: every pair is tried by its own keyed number (small n).

    Otherwise each node draws a Poisson number of partners in its own and in
    other groups by keyed numbers, so the work grows with the edges.
    """
    nodes = membership(spark, n, q)
    if exact:
        a = nodes.select(F.col("node_id").alias("src"), F.col("membership").alias("g"))
        b = nodes.select(F.col("node_id").alias("dst"), F.col("membership").alias("h"))
        p = F.when(F.col("g") == F.col("h"), cin / n).otherwise(cout / n)
        pairs = a.join(b, F.col("src") < F.col("dst")).filter(prng.uniform(seed, "src", "dst") < p).select("src", "dst", F.lit(1.0).alias("w"))
        return symmetrize(pairs), nodes
    base, extra = divmod(n, q)
    within, between = cin * (n / q) / n / 2, cout * (n - n / q) / n / 2
    most = int(max(within, between) + 8 * math.sqrt(max(within, between)) + 12)

    def drawn(rate: float, kind: str) -> DataFrame:
        # a Poisson number of draws: the exponential gaps that fit into the rate
        gaps = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.struct(k.alias("k"), (-F.ln(prng.uniform(seed, F.lit(kind), F.col("node_id"), k) + 1e-12)).alias("e")))
        count = F.aggregate(gaps, F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("c")), lambda s, g: F.struct((s["t"] + g["e"]).alias("t"), (s["c"] + F.when(s["t"] + g["e"] <= rate, 1).otherwise(0)).alias("c")), lambda s: s["c"])
        return nodes.withColumn("_c", count).filter("_c > 0").select("node_id", "membership", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("k"))

    start = F.when(F.col("membership") < extra, F.col("membership") * (base + 1)).otherwise(extra * (base + 1) + (F.col("membership") - extra) * base)
    size = F.when(F.col("membership") < extra, base + 1).otherwise(base)
    h = lambda kind: prng.bits(seed, F.lit(kind + "-target"), F.col("node_id"), F.col("k"))
    own = drawn(within, "in").select(F.col("node_id").alias("src"), (start + F.pmod(h("in"), size)).cast("long").alias("dst"))
    other = drawn(between, "out").select(F.col("node_id").alias("src"), F.pmod(start + size + F.pmod(h("out"), F.lit(n) - size), F.lit(n)).cast("long").alias("dst"))
    return without_loops(symmetrize(own.union(other).withColumn("w", F.lit(1.0)))), nodes


def edge_counts(requests: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``requests(n, p, ...)`` with ``edges``, a binomial number: n keyed trials where p lies inside (0, 1).

    p <= 0 gives 0 and p >= 1 gives n.  Beyond 10^5 trials a normal draw with
    the same mean and variance takes their place.
    """
    n, p = F.col("n"), F.col("p")
    trials = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(100_000)).cast("int")), lambda k: F.when(prng.uniform(seed, *keys, k) < p, 1).otherwise(0))
    counted = F.aggregate(trials, F.lit(0), lambda a, x: a + x).cast("long")
    u, v = prng.uniform(seed, *keys, F.lit("u")), prng.uniform(seed, *keys, F.lit("v"))
    normal = F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)
    many = F.greatest(F.lit(0), F.least(n, F.round(n * p + normal * F.sqrt(n * p * (1 - p))).cast("long")))
    return requests.withColumn("edges", F.when((p <= 0) | (n <= 0), 0).when(p >= 1, n).when(n > 100_000, many).otherwise(counted).cast("long"))


def two_communities(spark: SparkSession, n: int, cave: float, cdiff: float, seed: int = 1, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Planted partition of two groups with cin = cdiff / 2 + cave and cout = cave - cdiff / 2, without a floor."""
    return planted_partition(spark, n, 2, cdiff / 2 + cave, cave - cdiff / 2, seed, exact)


def ordered_partition(spark: SparkSession, n: int, q: int, cin: float, cout: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Planted partition that tries every ordered pair by itself and keeps its direction (small n)."""
    nodes = membership(spark, n, q)
    a = nodes.select(F.col("node_id").alias("src"), F.col("membership").alias("g"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("membership").alias("h"))
    p = F.when(F.col("g") == F.col("h"), cin / n).otherwise(cout / n)
    return a.join(b, F.col("src") != F.col("dst")).filter(prng.uniform(seed, "src", "dst") < p).select("src", "dst", F.lit(1.0).alias("w")), nodes


def poisson_blocks(spark: SparkSession, sizes: list[int], rates: list[list[float]], seed: int = 1, connected: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """(edges, nodes, seed): every pair i < j has a Poisson number of edges with the rate of its blocks.

    The number is found by inverse CDF (up to 8 edges).  With ``connected``
    seeds are tried in turn until the network is one component.
    """
    from ..operators.graph import connected_components

    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    group = F.lit(len(sizes) - 1)
    for k in range(len(sizes) - 2, -1, -1):
        group = F.when(F.col("id") < ends[k], k).otherwise(group)
    nodes = spark.range(ends[-1]).select(F.col("id").alias("node_id"), group.cast("long").alias("membership"))
    a = nodes.select(F.col("node_id").alias("src"), F.col("membership").alias("g"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("membership").alias("h"))
    table = spark.createDataFrame([(g, h, float(r)) for g, row in enumerate(rates) for h, r in enumerate(row)], "g long, h long, rate double")
    pairs = a.join(b, F.col("src") < F.col("dst")).join(F.broadcast(table), ["g", "h"])  # one row for each pair of blocks
    while True:
        u, term, total, w = prng.uniform(seed, "src", "dst"), F.exp(-F.col("rate")), F.lit(0.0), F.lit(0)
        for k in range(8):
            total = total + term
            w = w + F.when(u >= total, 1).otherwise(0)
            term = term * F.col("rate") / (k + 1)
        half = pairs.select("src", "dst", w.cast("double").alias("w")).filter("w > 0")
        edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        if not connected:
            return edges, nodes, seed
        found = connected_components(edges)
        if found.count() == ends[-1] and found.select("component").distinct().count() == 1:
            return edges, nodes, seed
        seed += 1


def stub_matching(degrees: DataFrame, mu: float, q: int, seed: int = 1) -> DataFrame:
    """Block model with prescribed degrees: ``degrees(node_id, membership, k_out, k_in)`` to ``src, dst, w``.

    Every out-stub goes to its own group or, with probability ``mu``, to
    another one, drawn by keyed numbers.  Out-stubs towards a group and its
    in-stubs are put in keyed orders and matched by rank, so in-degrees are
    met as far as there are out-stubs; repeated edges add up.
    """
    from pyspark.sql import Window

    out = degrees.select("node_id", "membership", F.explode(F.expr("sequence(1, k_out)")).alias("k"))
    away = prng.uniform(seed, F.lit("mix"), "node_id", "k") < mu
    shift = 1 + prng.bits(seed, F.lit("to"), "node_id", "k") % max(1, q - 1)
    out = out.withColumn("group", F.when(away, (F.col("membership") + shift) % q).otherwise(F.col("membership")))
    into = degrees.select("node_id", F.col("membership").alias("group"), F.explode(F.expr("sequence(1, k_in)")).alias("k"))
    rank = lambda kind: F.row_number().over(Window.partitionBy("group").orderBy(prng.bits(seed, F.lit(kind), "node_id", "k"), "node_id", "k"))
    a = out.select(F.col("node_id").alias("src"), "group", rank("out").alias("r"))
    b = into.select(F.col("node_id").alias("dst"), "group", rank("in").alias("r"))
    return a.join(b, ["group", "r"]).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def lfr_defaults(n: int) -> tuple[int, int]:
    """(largest degree, largest community) where none are given."""
    return int(math.sqrt(10 * n)), math.ceil(n / 4)


def truth_embedding(spark: SparkSession, n: int, q: int, cin: float, cout: float) -> DataFrame:
    """Embedding of the planted model itself, ``node_id, vec``: eigenvectors of the block probabilities less their mean.

    They are lifted to the nodes, scaled to unit columns, and multiplied by the
    root of the eigenvalue of the whole matrix.  The q x q problem is solved on
    the driver and its rows are joined by group.
    """
    import numpy as np

    pin, pout = cin / n, cout / n
    s = pout * np.ones((q, q)) + (pin - pout) * np.eye(q)
    values, vectors = np.linalg.eigh(s - s.mean())
    size = n / q
    rows = vectors / np.sqrt(size) * np.sqrt(np.maximum(0.0, values * size))
    table = spark.createDataFrame([(g, rows[g].tolist()) for g in range(q)], "membership long, vec array<double>")
    return membership(spark, n, q).join(F.broadcast(table), "membership").select("node_id", "vec")  # q rows are broadcast


def lfr(spark: SparkSession, n: int, k: float = 10, maxk: int | None = None, minc: int = 50, maxc: int | None = None, tau: float = 2.5, tau2: float = 1.0, mu: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """LFR benchmark from its published description.

    Power-law degrees (exponent tau, mean k) and community sizes (tau2); every
    node spends the share mu of its stubs outside.  Stubs of a community, and
    the external stubs, are matched by sorting keyed numbers in salted ranges,
    so repeated edges merge and degrees are met approximately.
    """
    import numpy as np

    most = lfr_defaults(n)
    maxk, maxc = maxk or most[0], maxc or most[1]
    rng = np.random.default_rng(seed)
    sizes: list[int] = []
    support = np.arange(minc, max(maxc, minc) + 1)
    law = support ** -float(tau2)
    law /= law.sum()
    while sum(sizes) < n:  # a few values for each community
        sizes.append(int(rng.choice(support, p=law)))
    sizes[-1] -= sum(sizes) - n
    if sizes[-1] < minc and len(sizes) > 1:
        sizes[-2] += sizes.pop()
    edges_at = np.concatenate([[0], np.cumsum(sizes)])
    ranges = spark.createDataFrame([(int(a), int(b), c) for c, (a, b) in enumerate(zip(edges_at[:-1], edges_at[1:], strict=True))], "first long, last long, membership long")
    nodes = ranges.select("membership", F.explode(F.expr("sequence(first, last - 1)")).alias("node_id"))
    # lower cut of the degree law by bisection on its mean
    low, high = 1.0, float(maxk)
    for _ in range(60):
        mid = (low + high) / 2
        ks = np.arange(max(1, int(mid)), maxk + 1)
        w = ks ** -float(tau)
        low, high = (mid, high) if (ks * w).sum() / w.sum() < k else (low, mid)
    kmin = float(max(1, int(low)))
    u = prng.uniform(seed, F.lit("k"), "node_id")
    e = 1.0 - tau
    degree = F.floor(F.pow(F.lit(kmin**e) + u * (float(maxk + 1) ** e - kmin**e), F.lit(1.0 / e)))
    sized = nodes.join(F.broadcast(ranges.select("membership", (F.col("last") - F.col("first")).alias("size"))), "membership")  # one row for each community
    inner = F.least(F.round(degree * (1 - mu)), F.col("size") - 1)
    stubs = sized.select("node_id", "membership", inner.cast("int").alias("i"), F.greatest(degree - inner, F.lit(0)).cast("int").alias("o"))

    def match(count: str, group: list) -> DataFrame:
        s = stubs.filter(F.col(count) > 0).select("node_id", "membership", F.explode(F.sequence(F.lit(1), F.col(count))).alias("k"))
        s = s.select("node_id", *group, prng.bits(seed, F.lit(count), F.col("node_id"), F.col("k")).alias("h")).withColumn("lot", F.floor(F.col("h") / (1 << 20)))
        from pyspark.sql import Window

        names = [g if isinstance(g, str) else "lot" for g in group]
        by = names or ["lot"]
        r = F.row_number().over(Window.partitionBy(*by).orderBy("h", "node_id")) - 1
        numbered = s.withColumn("r", r).withColumn("pair", F.floor(F.col("r") / 2))
        return numbered.groupBy(*by, "pair").agg(F.min("node_id").alias("src"), F.max("node_id").alias("dst"), F.count(F.lit(1)).alias("c")).filter("c = 2 AND src <> dst").select("src", "dst")

    return symmetrize(match("i", ["membership"]).union(match("o", [])).withColumn("w", F.lit(1.0))), nodes.select("node_id", "membership")


#: Neighbours with a larger id, for each node of the public club network.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31],
    1: [2, 3, 7, 13, 17, 19, 21, 30],
    2: [3, 7, 8, 9, 13, 27, 28, 32],
    3: [7, 12, 13],
    4: [6, 10],
    5: [6, 10, 16],
    6: [16],
    8: [30, 32, 33],
    9: [33],
    13: [33],
    14: [32, 33],
    15: [32, 33],
    18: [32, 33],
    19: [33],
    20: [32, 33],
    22: [32, 33],
    23: [25, 27, 29, 32, 33],
    24: [25, 27, 31],
    25: [31],
    26: [29, 33],
    27: [33],
    28: [31, 33],
    29: [32, 33],
    30: [32, 33],
    31: [32, 33],
    32: [33],
}


def karate(spark: SparkSession) -> DataFrame:
    """The public 34-node club network, both directions, weight 1."""
    return symmetrize(spark.createDataFrame([(a, b, 1.0) for a, bs in KARATE.items() for b in bs], "src long, dst long, w double"))
