"""Random walks as one join a step, and context windows over the paths.

Choices come from keyed numbers of (seed, walk, step), so a walk is the same
however the data are partitioned and after any task is rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint


def _starts(edges: DataFrame, walks: int, first_round: int = 0) -> DataFrame:
    nodes = edges.select(F.col("src").alias("start")).distinct()
    rounds = edges.sparkSession.range(first_round, first_round + walks).select(F.col("id").alias("round"))
    return nodes.crossJoin(F.broadcast(rounds)).select("start", "round", F.array("start").alias("path"))  # `walks` rows are broadcast


def uniform_walks(edges: DataFrame, length: int, walks: int = 1, seed: int = 1, backtrack: bool = True, cut_every: int = 8, first_round: int = 0) -> DataFrame:
    """``start, round, path``: each step goes to neighbour number ``h mod degree`` in order of id.

    Without ``backtrack`` the previous node is no candidate; a walk without
    candidates stops early.
    """
    ordered = edges.select(F.col("src").alias("cur"), "dst").distinct()
    lists = checkpoint(ordered.groupBy("cur").agg(F.array_sort(F.collect_list("dst")).alias("next")))  # the neighbours of one node
    out = _starts(lists.select(F.col("cur").alias("src")), walks, first_round)
    for t in range(1, length):
        at = out.withColumn("cur", F.element_at("path", -1)).join(lists, "cur", "left")
        options = F.coalesce("next", F.array().cast("array<long>"))
        if not backtrack and t > 1:
            options = F.filter(options, lambda x: x != F.element_at("path", -2))
        picked = at.withColumn("_o", options).withColumn("_h", prng.bits(seed, F.col("start"), F.col("round"), F.lit(t)))
        done = (F.size("path") < t) | (F.size("_o") == 0)
        step = F.get(F.col("_o"), F.when(F.size("_o") > 0, F.pmod(F.col("_h"), F.size("_o"))).otherwise(0).cast("int"))
        out = picked.select("start", "round", F.when(done, F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"))
        if t % cut_every == 0:
            out = checkpoint(out)
    return out


def biased_walks(edges: DataFrame, length: int, p: float = 1.0, q: float = 1.0, walks: int = 1, seed: int = 1, digits: int = 12, cut_every: int = 4) -> DataFrame:
    """Second-order walks: a step from (prev, cur) follows the line graph's weights by inverse CDF.

    The same law as accepting proposals with 1/p, 1 and 1/q, without
    rejections.  CDF values are rounded so that every engine picks alike.
    """
    from .graph import line_graph

    def cdf(frame: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by)
        run = F.sum("w").over(w.orderBy("nxt").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(w)
        last = F.row_number().over(w.orderBy("nxt")) == F.count(F.lit(1)).over(w)
        table = frame.select(*by, "nxt", F.when(last, 1.0).otherwise(F.round(run, digits)).alias("cdf"))
        return checkpoint(table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cdf", "nxt"))).alias("table")))

    first = cdf(edges.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w"), ["cur"])
    later = cdf(line_graph(edges, p, q), ["prev", "cur"])
    out = _starts(edges, walks)
    for t in range(1, length):
        at = out.withColumn("cur", F.element_at("path", -1))
        at = at.join(first, "cur", "left") if t == 1 else at.withColumn("prev", F.element_at("path", -2)).join(later, ["prev", "cur"], "left")
        u = prng.uniform(seed, F.col("start"), F.col("round"), F.lit(t))
        choice = F.get(F.filter("table", lambda x: x["cdf"] >= F.col("_u")), F.lit(0))["nxt"]
        picked = at.withColumn("_u", u).withColumn("_next", choice)
        done = F.col("_next").isNull() | (F.size("path") < t)
        out = picked.select("start", "round", F.when(done, F.col("path")).otherwise(F.concat("path", F.array("_next"))).alias("path"))
        if t % cut_every == 0:
            out = checkpoint(out)
    return out


def weighted_walks(edges: DataFrame, length: int, walks: int = 1, seed: int = 1, digits: int = 12, cut_every: int = 8) -> DataFrame:
    """First-order walks that follow the weights by inverse CDF; a walk without candidates stops early."""
    by = Window.partitionBy("src")
    run = F.sum("w").over(by.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(by)
    last = F.row_number().over(by.orderBy("dst")) == F.count(F.lit(1)).over(by)
    steps = edges.select(F.col("src").alias("cur"), "dst", F.when(last, 1.0).otherwise(F.round(run, digits)).alias("cdf"))
    table = checkpoint(steps.groupBy("cur").agg(F.array_sort(F.collect_list(F.struct("cdf", "dst"))).alias("table")))  # the neighbours of one node
    out = _starts(edges, walks)
    for t in range(1, length):
        at = out.withColumn("cur", F.element_at("path", -1)).join(table, "cur", "left").withColumn("_u", prng.uniform(seed, F.col("start"), F.col("round"), F.lit(t)))
        step = F.get(F.filter("table", lambda x: x["cdf"] >= F.col("_u")), F.lit(0))["dst"]
        picked = at.withColumn("_next", step)
        done = F.col("_next").isNull() | (F.size("path") < t)
        out = picked.select("start", "round", F.when(done, F.col("path")).otherwise(F.concat("path", F.array("_next"))).alias("path"))
        if t % cut_every == 0:
            out = checkpoint(out)
    return out


def simulate(edges: DataFrame, length: int = 80, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """Walks from every node ``walks`` times: biased where p or q says so (by rejection), weighted where weights differ, else uniform."""
    if p != 1.0 or q != 1.0:
        from .rejection import rejection_walks

        return rejection_walks(edges, length, p, q, walks, seed)
    row = edges.agg(F.min("w").alias("least"), F.max("w").alias("most")).first()
    same = row["least"] is None or row["least"] == row["most"]
    return uniform_walks(edges, length, walks, seed) if same else weighted_walks(edges, length, walks, seed)


def token_budget_walks(edges: DataFrame, length: int, walks: int, seed: int = 1) -> DataFrame:
    """Non-backtracking walks, round after round, until they hold ``length * walks * nodes`` nodes in all.

    Rounds are made ``walks`` at a time.  A round is kept if those before it
    fall short of the budget.
    """
    edges = checkpoint(edges.select("src", "dst"))  # read in every turn
    wanted = length * walks * edges.select("src").distinct().count()
    out, first, total = None, 0, 0
    while total < wanted:
        more = checkpoint(uniform_walks(edges, length, walks, seed, backtrack=False, first_round=first))
        sizes = {r["round"]: r["n"] for r in more.groupBy("round").agg(F.sum(F.size("path")).alias("n")).collect()}  # `walks` rows
        kept = []
        for r in sorted(sizes):
            if total < wanted:
                kept.append(r)
                total += sizes[r]
        part = more.filter(F.col("round").isin(kept))
        out = part if out is None else out.unionByName(part)
        first += walks
        if not sizes:
            break
    return more if out is None else out


def epochs(edges: DataFrame, number: int, seed: int = 1) -> DataFrame:
    """``epoch, start, position_key``: for each epoch all nodes in an order of its own, as a sort key."""
    return _starts(edges, number).select(F.col("round").alias("epoch"), "start", prng.bits(seed, F.col("round"), F.col("start")).alias("position_key"))


def positions(walks: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    return walks.select(*keys, F.posexplode(path).alias("pos", "node"))


def context_pairs(walks: DataFrame, keys: list[str], window: int, side: str = "double", path: str = "path") -> DataFrame:
    """``keys, pos, center, context``: partners within the window, ``double``, ``left`` or ``right``.

    Computed inside the array, so no join is needed whatever the number of walks.
    """
    low, high = {"double": (-window, window), "left": (-window, -1), "right": (1, window)}[side]
    offsets = [o for o in range(low, high + 1) if o]
    partners = F.array(*(F.struct(F.lit(o).alias("o"), F.when(F.col("pos") + o >= 0, F.get(F.col(path), F.col("pos") + o)).alias("context")) for o in offsets))
    at = walks.select(*keys, path, F.posexplode(path).alias("pos", "center"))
    out = at.select(*keys, "pos", "center", F.explode(F.filter(partners, lambda x: x["context"].isNotNull())).alias("x"))
    return out.select(*keys, "pos", "center", F.col("x.context").alias("context"))


def padded(walks: DataFrame, length: int, padding: int = -1, path: str = "path") -> DataFrame:
    return walks.withColumn(path, F.slice(F.concat(path, F.array_repeat(F.lit(padding).cast("long"), length)), 1, length))


def pmi(pairs: DataFrame, negatives: int = 1) -> DataFrame:
    """ln(w_ij W / (w_i w_j)) - ln k of the pair counts."""
    c = pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy("center").agg(F.sum("n").alias("na"))
    b = c.groupBy("context").agg(F.sum("n").alias("nb"))
    t = c.agg(F.sum("n").alias("t"))
    joined = c.join(a, "center").join(b, "context").crossJoin(F.broadcast(t))
    return joined.select("center", "context", (F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))) - F.ln(F.lit(float(negatives)))).alias("pmi"))
