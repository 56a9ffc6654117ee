"""Two-level map equation on symmetric links.

The flow through a node is its strength over the total weight, the flow along
a link its weight over the total.  The code length of a partition is

    plogp(sum q) - 2 sum plogp(q) - sum plogp(p of nodes) + sum plogp(q + p of modules)

in bits, where q is the flow that leaves a module.  Nodes move to the
neighbouring module that shortens the code most; modules then become nodes of
a smaller network, and at the end single nodes move once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prng
from ..plans.lineage import checkpoint

#: Smaller gains and changes of the code length count as none; flows below ``TINY`` as 0.
LEAST, TINY = 1e-9, 1e-14


def plogp(x: Column) -> Column:
    return F.when(x > TINY, x * F.log2(x)).otherwise(0.0)


def flows(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, p, o`` (flow through it, flow along links to others) and links ``src, dst, f`` between different nodes."""
    edges = checkpoint(edges.select("src", "dst", "w"))  # read three times
    total = float(edges.agg(F.sum("w")).first()[0] or 1.0)
    other = F.when(F.col("src") != F.col("dst"), F.col("w")).otherwise(0.0)
    nodes = edges.groupBy(F.col("src").alias("node_id")).agg((F.sum("w") / total).alias("p"), (F.sum(other) / total).alias("o"))
    return checkpoint(nodes), checkpoint(edges.filter("src <> dst").groupBy("src", "dst").agg((F.sum("w") / total).alias("f")))


@dataclass
class _State:
    """Labels, flow from each node to each module around it, modules with their flow and exit, and the length of the code."""

    labels: DataFrame
    around: DataFrame
    modules: DataFrame
    exit: float
    length: float


def _state(nodes: DataFrame, links: DataFrame, labels: DataFrame, node_bits: float) -> _State:
    around = checkpoint(links.join(labels.select(F.col("node_id").alias("dst"), F.col("g").alias("to")), "dst").groupBy(F.col("src").alias("node_id"), "to").agg(F.sum("f").alias("k")))
    own = around.select("node_id", F.col("to").alias("g"), "k")
    modules = checkpoint(nodes.join(labels, "node_id").join(own, ["node_id", "g"], "left").groupBy("g").agg(F.sum("p").alias("p"), F.sum(F.col("o") - F.coalesce("k", F.lit(0.0))).alias("q")))
    row = modules.agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("exits"), F.sum(plogp(F.col("q") + F.col("p"))).alias("all"), plogp(F.sum("q")).alias("index")).first()
    return _State(labels, around, modules, row["q"] or 0.0, (row["index"] or 0.0) - 2 * (row["exits"] or 0.0) - node_bits + (row["all"] or 0.0))


def _proposals(nodes: DataFrame, now: _State) -> DataFrame:
    """Of every node that gains by moving its best module: ``node_id, g, to, gain``."""
    own = now.around.select("node_id", F.col("to").alias("g"), F.col("k").alias("ka"))
    source = now.modules.select("g", F.col("p").alias("pa"), F.col("q").alias("qa"))
    target = now.modules.select(F.col("g").alias("to"), F.col("p").alias("pb"), F.col("q").alias("qb"))
    options = now.around.join(now.labels, "node_id").filter("to <> g").join(nodes, "node_id").join(own, ["node_id", "g"], "left").join(source, "g").join(target, "to")
    ka, k, o, p = F.coalesce("ka", F.lit(0.0)), F.col("k"), F.col("o"), F.col("p")
    qa, qb, pa, pb = F.col("qa") - o + 2 * ka, F.col("qb") + o - 2 * k, F.col("pa") - p, F.col("pb") + p
    was = plogp(F.lit(now.exit)) - 2 * (plogp(F.col("qa")) + plogp(F.col("qb"))) + plogp(F.col("qa") + F.col("pa")) + plogp(F.col("qb") + F.col("pb"))
    then = plogp(F.lit(now.exit) + qa + qb - F.col("qa") - F.col("qb")) - 2 * (plogp(qa) + plogp(qb)) + plogp(qa + pa) + plogp(qb + pb)
    scored = options.select("node_id", "g", "to", F.round(was - then, 10).alias("gain"))
    best = scored.groupBy("node_id", "g").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"), F.max("gain").alias("gain"))
    return best.filter(F.col("gain") > LEAST)


def _dominant(moves: DataFrame) -> DataFrame:
    """Moves that are the best of both modules they touch, so each module takes part in one at most."""
    ends = moves.select("node_id", "gain", F.explode(F.array("g", "to")).alias("module"))
    best = ends.groupBy("module").agg(F.max_by("node_id", F.struct("gain", -F.col("node_id"))).alias("node_id"))
    twice = best.groupBy("node_id").count().filter("count = 2").select("node_id")
    return moves.join(twice, "node_id", "left_semi")


def _sweeps(nodes: DataFrame, links: DataFrame, now: _State, node_bits: float, rounds: int, trace: list[float]) -> _State:
    """Rounds of moves, none of which lengthens the code.

    A round tries the moves of one keyed half of the nodes together; where
    they get in each other's way it makes the dominant ones alone, and where
    those do not help either it leaves the labels.  After two such rounds,
    one for each half, the rest is skipped.
    """
    idle = 0
    for r in range(rounds):
        if idle < 2:
            moves = checkpoint(_proposals(nodes, now))
            for chosen in (moves.filter(prng.bits(r % 2, "node_id") % 2 == 0), _dominant(moves)):
                labels = checkpoint(now.labels.join(chosen.select("node_id", "to"), "node_id", "left").select("node_id", F.coalesce("to", "g").alias("g")))
                then = _state(nodes, links, labels, node_bits)
                if then.length < now.length - LEAST:
                    now, idle = then, 0
                    break
            else:
                idle += 1
        trace.append(now.length)
    return now


def map_equation(edges: DataFrame, *, rounds: int = 10, levels: int = 8) -> tuple[DataFrame, list[float]]:
    """Modules of symmetric links ``src, dst, w``: ``node_id, g``, and the code length after every round.

    ``rounds`` rounds at each of ``levels`` levels of contracted modules, then
    ``rounds`` of single nodes.  Levels end where contraction gains nothing;
    their rounds then repeat the length in the trace.  A node without links
    but a loop is a module of its own.
    """
    nodes, links = flows(edges)
    node_bits = nodes.agg(F.sum(plogp(F.col("p")))).first()[0] or 0.0
    trace: list[float] = []
    labels = nodes.select("node_id", F.col("node_id").alias("g"))
    small_nodes, small_links = nodes, links
    for level in range(levels):
        start = _state(small_nodes, small_links, small_nodes.select("node_id", F.col("node_id").alias("g")), node_bits)
        found = _sweeps(small_nodes, small_links, start, node_bits, rounds, trace)
        if level:
            labels = checkpoint(labels.withColumnRenamed("g", "inner").join(found.labels.withColumnRenamed("node_id", "inner"), "inner").select("node_id", "g"))
        else:
            labels = found.labels
        if found.length > start.length - LEAST:
            trace += [found.length] * (rounds * (levels - 1 - level))
            break
        small_nodes = found.modules.select(F.col("g").alias("node_id"), "p", F.col("q").alias("o"))
        a, b = (found.labels.select(F.col("node_id").alias(c), F.col("g").alias(f"g{c}")) for c in ("src", "dst"))
        small_links = checkpoint(small_links.join(a, "src").join(b, "dst").filter("gsrc <> gdst").groupBy(F.col("gsrc").alias("src"), F.col("gdst").alias("dst")).agg(F.sum("f").alias("f")))
    final = _sweeps(nodes, links, _state(nodes, links, labels, node_bits), node_bits, rounds, trace)
    return final.labels, trace


def oracle_ctes(edges: str, rounds: int, levels: int) -> tuple[list[str], str, list[str]]:
    """The same in DuckDB SQL: common table expressions, the last labels and the tables with the length after each round."""
    log = lambda x: f"(CASE WHEN ({x}) > {TINY!r} THEN ({x}) * log2(greatest({x}, {TINY!r})) ELSE 0 END)"
    parts = [
        f"me_t AS MATERIALIZED (SELECT sum(w) AS t FROM {edges})",
        f"me_n0 AS MATERIALIZED (SELECT src AS node_id, sum(w) / any_value(t) AS p, sum(CASE WHEN src <> dst THEN w ELSE 0 END) / any_value(t) AS o FROM {edges}, me_t GROUP BY src)",
        f"me_e0 AS MATERIALIZED (SELECT src, dst, sum(w) / any_value(t) AS f FROM {edges}, me_t WHERE src <> dst GROUP BY src, dst)",
        f"me_h AS MATERIALIZED (SELECT sum({log('p')}) AS h FROM me_n0)",
    ]
    steps: list[str] = []

    def state(name: str, labels: str, nodes: str, links: str) -> None:
        parts.append(f"{name}k AS MATERIALIZED (SELECT src AS node_id, g AS t, sum(f) AS k FROM {links} JOIN {labels} ON dst = node_id GROUP BY 1, 2)")
        parts.append(f"{name}m AS MATERIALIZED (SELECT l.g, sum(p) AS p, sum(o - coalesce(k, 0)) AS q FROM {labels} l JOIN {nodes} n ON l.node_id = n.node_id LEFT JOIN {name}k k ON k.node_id = l.node_id AND k.t = l.g GROUP BY l.g)")
        parts.append(f"{name}c AS MATERIALIZED (SELECT sum(q) AS q, {log('sum(q)')} - 2 * sum({log('q')}) - any_value(h) + sum({log('q + p')}) AS len FROM {name}m, me_h)")

    def sweeps(tag: str, labels: str, nodes: str, links: str) -> str:
        current = labels
        state(f"{tag}s0", current, nodes, links)
        for r in range(rounds):
            x, now = f"{tag}r{r}", f"{tag}s{r}"
            qa, qb = "a.q - o + 2 * coalesce(own.k, 0)", "b.q + o - 2 * k.k"
            was = f"{log('c.q')} - 2 * ({log('a.q')} + {log('b.q')}) + {log('a.q + a.p')} + {log('b.q + b.p')}"
            then = f"{log(f'c.q + ({qa}) + ({qb}) - a.q - b.q')} - 2 * ({log(qa)} + {log(qb)}) + {log(f'({qa}) + a.p - n.p')} + {log(f'({qb}) + b.p + n.p')}"
            parts.append(
                f"{x}o AS MATERIALIZED (SELECT k.node_id, l.g, k.t, round({was} - ({then}), 10) AS gain FROM {now}k k JOIN {current} l ON l.node_id = k.node_id AND k.t <> l.g JOIN {nodes} n ON n.node_id = k.node_id "
                f"LEFT JOIN {now}k own ON own.node_id = k.node_id AND own.t = l.g JOIN {now}m a ON a.g = l.g JOIN {now}m b ON b.g = k.t, {now}c c)"
            )
            parts.append(f"{x}b AS MATERIALIZED (SELECT node_id, g, arg_max(t, (gain, -t)) AS t, max(gain) AS gain FROM {x}o GROUP BY node_id, g HAVING max(gain) > {LEAST!r})")
            parts.append(f"{x}d AS (SELECT node_id FROM (SELECT m, arg_max(node_id, (gain, -node_id)) AS node_id FROM (SELECT node_id, gain, unnest([g, t]) AS m FROM {x}b) GROUP BY m) GROUP BY node_id HAVING count(*) = 2)")
            parts.append(f"{x}la AS MATERIALIZED (SELECT l.node_id, coalesce(b.t, l.g) AS g FROM {current} l LEFT JOIN (SELECT * FROM {x}b WHERE {prng.bits_sql(r % 2, 'node_id')} % 2 = 0) b ON b.node_id = l.node_id)")
            parts.append(f"{x}lb AS MATERIALIZED (SELECT l.node_id, coalesce(b.t, l.g) AS g FROM {current} l LEFT JOIN (SELECT {x}b.* FROM {x}b JOIN {x}d USING (node_id)) b ON b.node_id = l.node_id)")
            state(f"{x}a", f"{x}la", nodes, links)
            state(f"{x}z", f"{x}lb", nodes, links)
            better = lambda side: f"(SELECT len FROM {x}{side}c) < (SELECT len FROM {now}c) - {LEAST!r}"  # noqa: E731, B023
            parts.append(f"{x}l AS MATERIALIZED (SELECT l.node_id, CASE WHEN {better('a')} THEN la.g WHEN {better('z')} THEN lb.g ELSE l.g END AS g FROM {current} l JOIN {x}la la ON la.node_id = l.node_id JOIN {x}lb lb ON lb.node_id = l.node_id)")
            current = f"{x}l"
            state(f"{tag}s{r + 1}", current, nodes, links)
            steps.append(f"{tag}s{r + 1}c")
        return current

    labels, nodes, links = "", "me_n0", "me_e0"
    for level in range(levels):
        tag = f"me{level}"
        parts.append(f"{tag}i AS (SELECT node_id, node_id AS g FROM {nodes})")
        found = sweeps(tag, f"{tag}i", nodes, links)
        if level:
            parts.append(f"{tag}l AS MATERIALIZED (SELECT a.node_id, b.g FROM {labels} a JOIN {found} b ON a.g = b.node_id)")
            labels = f"{tag}l"
        else:
            labels = found
        parts.append(f"{tag}n AS MATERIALIZED (SELECT g AS node_id, p, q AS o FROM {tag}s{rounds}m)")
        parts.append(f"{tag}e AS MATERIALIZED (SELECT a.g AS src, b.g AS dst, sum(f) AS f FROM {links} JOIN {found} a ON src = a.node_id JOIN {found} b ON dst = b.node_id WHERE a.g <> b.g GROUP BY 1, 2)")
        nodes, links = f"{tag}n", f"{tag}e"
    return parts, sweeps("mef", labels, "me_n0", "me_e0"), steps
