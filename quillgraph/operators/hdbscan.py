"""Density clusters by the hierarchy of a minimum spanning tree.

The tree of mutual reachability comes from Boruvka rounds over lists of
neighbours, which are searched once; where they don't settle what is nearest
outside a component, it is looked for among all vectors.  Of the tree's hierarchy
only components of ``least`` or more points count.  It is built from below:

* Edges go by ranges of their order.  One task unites the components at the
  ends of a range's edges; the points that fall into a cluster and the
  clusters that end are written, and the edges still to come are renamed.  There are at most ``RANGES`` ranges, whatever the height of the
  hierarchy, and a component is one row: its points until it is a cluster of
  ``least`` points, its sums from then on.
* Two clusters that unite end, and their stability (excess of mass) is
  settled: of a cluster and those within it the more stable choice is kept.
  The highest choice above each cluster is found by doubled reach.

Edges are in the strict order (weight, smaller id, larger id), so the tree and
the hierarchy are unique.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint
from .graph import connected_components, running_sum
from .neighbours import BLOCK, LOT, QUERIES, ROWS, WIDE_COPIES, WIDEST, Cells, _matrix, close_pairs, nearest_lists, products, tiles

#: Distances below count as this in densities.
CLOSEST = 1e-9
#: Neighbours of a vector that are kept for all rounds.
LISTED = 16
#: Edges of the tree go by so many ranges at most, of so many edges at least.
RANGES, SMALLEST = 32, 4096


def _nearest_outside(digits: int):
    """Of every query the row of another component with the least mutual reachability, the smallest id on ties; more than its ``bound`` doesn't count."""
    margin = 4 * 10.0**-digits

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            column = lambda t, c: np.asarray(t.column(c))
            src, core, comp = (column(queries, c) for c in ("node_id", "core", "comp"))
            bound = np.asarray(queries.column("bound").fill_null(np.inf), dtype=np.float64).copy()
            order = np.argsort(column(rows, "_id"), kind="stable")
            dst, cores, comps = (column(rows, c)[order] for c in ("_id", "_core", "_comp"))
            left, right = _matrix(queries.column("vec")), _matrix(rows.column("_vec"))[order]
            reach = lambda i, j: np.maximum(np.maximum(np.round(np.sqrt(np.maximum(2 - 2 * np.round(products(left, right, i, j), digits), 0)), digits), core[i]), cores[j])
            free = np.flatnonzero(np.isinf(bound))
            for at in range(0, len(free), QUERIES):  # any one outside bounds the search
                part = free[at : at + QUERIES]
                most, who = np.full(len(part), -np.inf), np.zeros(len(part), np.int64)
                for start in range(0, len(dst), 8 * ROWS):
                    w = np.where(comp[part, None] != comps[None, start : start + 8 * ROWS], left[part] @ right[start : start + 8 * ROWS].T, -np.inf)
                    best = w.argmax(axis=1)
                    better = w[np.arange(len(part)), best] > most
                    most[better], who[better] = w[np.arange(len(part)), best][better], best[better] + start
                some = np.isfinite(most)
                bound[part] = -1.0
                bound[part[some]] = reach(part[some], who[some])
            asked = np.flatnonzero(bound >= core)  # in the order of their components, as rows of the same one are left out
            asked = asked[np.argsort(comp[asked], kind="stable")]
            least = np.where(bound < 2, 1 - bound * bound / 2 - margin, -np.inf)
            sorted_rows = np.argsort(comps, kind="stable")
            names, first, count = np.unique(comp[asked], return_index=True, return_counts=True)
            alone = count >= QUERIES
            groups = [(asked[f : f + n], c) for c, f, n in zip(names[alone], first[alone], count[alone], strict=True)]
            groups.append((asked[np.repeat(~alone, count)], None))
            for part, c in groups:
                start, end = (0, 0) if c is None else np.searchsorted(comps[sorted_rows], [c, c + 1])
                others = np.arange(len(dst)) if start == end else np.sort(np.r_[sorted_rows[:start], sorted_rows[end:]])
                for i, j in close_pairs(left[part], right[others], least[part]) if len(part) and len(others) else ():
                    i, j = part[i], others[j]
                    kept = (comp[i] != comps[j]) & (np.maximum(core[i], cores[j]) <= bound[i])
                    i, j = i[kept], j[kept]
                    apart = reach(i, j)
                    kept = apart <= bound[i]
                    i, j, apart = i[kept], j[kept], apart[kept]
                    by = np.lexsort((j, apart, i))  # the first of equal ones has the smallest id
                    i, j, apart = i[by], j[by], apart[by]
                    top = np.r_[True, i[1:] != i[:-1]][: len(i)]
                    found.append((src[i[top]], dst[j[top]], apart[top]))
        return pa.table(dict(zip(("src", "dst", "w"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def spanning_tree(vectors: DataFrame, samples: int, *, digits: int = 9, block: int = BLOCK, lot: int = LOT, listed: int = LISTED) -> DataFrame:
    """Exact minimum spanning tree of mutual reachability: ``a, b, w`` with ``a < b``.

    Mutual reachability is the distance of two unit vectors, or the core
    distance (to the ``samples``-th neighbour) of either where that is more.
    ``listed`` neighbours of every vector are found once.  A component whose
    lightest link in these lists is lighter than all lists' ends has found its
    lightest edge outwards.  Where too few have, the others but the largest
    look for it among all vectors: only those with a list that ends before.
    A round joins an eighth of the components, so there are few.
    """
    k = max(samples, listed)
    cells = Cells.of(vectors)
    blocks = cells.deal(block, copies=WIDE_COPIES, largest=WIDEST)
    near = checkpoint(nearest_lists(cells, blocks, k, digits))
    apart = lambda w: F.round(F.sqrt(F.greatest(2 - 2 * w, F.lit(0.0))), digits)
    lists = near.groupBy(F.col("src").alias("node_id")).agg(F.sort_array(F.collect_list("w"), asc=False).alias("_w"))  # k numbers
    points = lists.select("node_id", apart(F.element_at("_w", F.least(F.size("_w"), F.lit(samples)))).alias("core"), F.when(F.size("_w") >= k, apart(F.element_at("_w", -1))).alias("radius"))
    points = checkpoint(cells.rows.select("node_id").join(points, "node_id", "left").withColumn("core", F.coalesce("core", F.lit(0.0))))
    rows = None
    labels = points.select("node_id", F.col("node_id").alias("comp"), "radius")
    core = lambda end: points.select(F.col("node_id").alias(end), F.col("core").alias(f"_{end}"))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    links = near.select(a.alias("a"), b.alias("b"), apart(F.col("w")).alias("w")).distinct().join(core("a"), "a").join(core("b"), "b")
    links = checkpoint(links.select("a", "b", F.greatest("w", "_a", "_b").alias("w"), F.col("a").alias("ca"), F.col("b").alias("cb")))
    edge = lambda comp, other: [F.col(comp).alias("comp"), F.struct("w", "a", "b", F.col(other).alias("other")).alias("e")]
    lightest = lambda found: found.select(*edge("ca", "cb")).union(found.select(*edge("cb", "ca"))).groupBy("comp").agg(F.min("e").alias("e"))
    tree = None
    while True:
        held = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("radius"))
        state = checkpoint(held.join(lightest(links), "comp", "left").withColumn("sure", F.col("e").isNotNull() & (F.col("radius").isNull() | (F.col("e.w") < F.col("radius")))))
        total, sure, largest = state.agg(F.count(F.lit(1)), F.count(F.when(F.col("sure"), 1)), F.max(F.struct("n", "comp"))["comp"]).first()
        if total < 2:
            return tree if tree is not None else links.select("a", "b", "w").limit(0)
        best = state.filter("sure").select("comp", "e")
        if sure * 4 < total - 1:
            if rows is None:
                rows = checkpoint(blocks.number(cells.rows, "block").join(points, "node_id"))
            now = checkpoint(rows.drop("radius").join(labels, "node_id"))
            unsure = state.filter(~F.col("sure") & (F.col("comp") != largest)).select("comp", "e")
            asked = checkpoint(now.join(unsure.select("comp", F.col("e.w").alias("bound")), "comp").filter("bound IS NULL OR radius IS NULL OR radius <= bound").drop("block"))
            lots = cells.deal(lot, asked, copies=WIDE_COPIES, largest=WIDEST)
            asked = checkpoint(lots.number(asked, "lot"))
            done = cells.own(lots, blocks)
            compared = lambda asked, pairs: tiles(asked, now, pairs, ["core", "comp", "bound"], ["core", "comp"], _nearest_outside(digits))  # noqa: B023, E731
            inside = checkpoint(compared(asked, done))
            # A component needs its lightest edge alone: its best so far bounds all its vectors.
            bound = inside.withColumnRenamed("src", "node_id").join(asked.select("node_id", "comp"), "node_id").groupBy("comp").agg(F.min("w").alias("_bound"))
            asked = checkpoint(asked.join(bound, "comp", "left").withColumn("bound", F.least("bound", "_bound")).drop("_bound").filter("bound IS NULL OR radius IS NULL OR radius <= bound"))
            found = inside.unionByName(compared(asked, cells.open(asked, "bound", blocks, done)))
            of = lambda end, name: labels.select(F.col("node_id").alias(end), F.col("comp").alias(name))  # noqa: B023, E731
            found = found.join(of("src", "ca"), "src").join(of("dst", "cb"), "dst").select("ca", "cb", "w", a.alias("a"), b.alias("b"))
            found = found.select(*edge("ca", "cb")).unionByName(unsure.filter("e IS NOT NULL")).groupBy("comp").agg(F.min("e").alias("e"))
            best = best.unionByName(found)
        best = checkpoint(best)
        added = best.select("e.a", "e.b", "e.w").distinct()
        tree = checkpoint(added if tree is None else tree.unionByName(added))
        joined = connected_components(best.select(F.col("comp").alias("src"), F.col("e.other").alias("dst"))).toDF("comp", "_new")
        labels = checkpoint(labels.join(joined, "comp", "left").select("node_id", F.coalesce("_new", "comp").alias("comp"), "radius"))
        for end in ("ca", "cb"):
            links = links.join(joined.withColumnRenamed("comp", end), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        links = checkpoint(links.filter("ca <> cb").select("a", "b", "w", "ca", "cb"))


def _density(distance: float) -> float:
    return 1 / max(distance, CLOSEST)


_STATE = "comp long, n long, members array<long>, c string, mass double, fell long, below long, since double, within double"
#: ``kind`` move: ``comp`` is part of ``into`` now (the state of ``into`` stands in its own row); point: ``comp`` falls into ``c``; cluster: ``c`` ends in ``parent``.
_FOUND = f"kind string, into long, parent string, stability double, {_STATE}"


def _judged(state: dict, end: float) -> tuple[float, float]:
    """Stability of a cluster that ends at the density ``end``, and the best within it."""
    stable = state["mass"] - state["fell"] * end
    if state["below"]:
        stable += state["below"] * (_density(state["since"]) - end)
    stable = round(stable, 9)
    return stable, stable if state["within"] is None else max(stable, state["within"])


def _unite(least: int):
    """The edges of one range in order, between components with known states."""

    def run(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        names, fields = [f.split()[0] for f in _FOUND.split(", ")], [f.split()[0] for f in _STATE.split(", ")]
        known = {r["comp"]: r | {f: None for f in ("c", "since", "within") if pd.isna(r[f])} | {"members": [] if r["members"] is None else [int(i) for i in r["members"]]} for r in states[fields].to_dict("records")}
        point = lambda i: {"comp": i, "n": 1, "members": [i], "c": None, "mass": 0.0, "fell": 0, "below": 0, "since": None, "within": None}
        up: dict[int, int] = {}
        out: list[dict] = []

        def find(i: int) -> int:
            up.setdefault(i, i)
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def fall(into: dict, members: list[int], w: float) -> None:
            out.extend({"kind": "point", "comp": i, "c": into["c"]} for i in members)
            into["mass"] += len(members) * _density(w)
            into["fell"] += len(members)

        edges = edges.sort_values(["w", "a", "b"])
        for c, d, w, a, b in zip(*(edges[k].tolist() for k in ("c", "d", "w", "a", "b")), strict=True):
            left, right = find(c), find(d)
            one, other = (known.pop(i, None) or point(i) for i in (left, right))
            if one["n"] < other["n"]:
                one, other = other, one
            new = one | {"n": one["n"] + other["n"]}
            if other["c"] is not None:  # two clusters
                name, end = f"{a}-{b}", _density(w)
                best = 0.0
                for x in (one, other):
                    stable, most = _judged(x, end)
                    best += most
                    out.append({"kind": "cluster", "c": x["c"], "parent": name, "stability": stable, "within": x["within"]})
                new |= {"c": name, "mass": 0.0, "fell": 0, "below": new["n"], "since": w, "within": best}
            elif one["c"] is not None:
                fall(new, other["members"], w)
            else:
                new["members"] = one["members"] + other["members"]
                if new["n"] >= least:
                    new["c"] = f"{a}-{b}"
                    fall(new, new["members"], w)
                    new["members"] = []
            up[other["comp"]] = one["comp"]
            known[one["comp"]] = new
        out.extend({"kind": "move", "into": find(i)} | (known[i] if up[i] == i else {"comp": i}) for i in up)
        return pd.DataFrame([[r.get(k) for k in names] for r in out], columns=names, dtype=object)

    return run


def condensed_tree(nodes: DataFrame, tree: DataFrame, least: int, ranges: int = RANGES, smallest: int = SMALLEST) -> tuple[DataFrame, DataFrame]:
    """Clusters ``c, parent, stability, chosen`` (parent null for a root) and where each point fell: ``node_id, c``.

    ``chosen``: at least as stable as the best choice within it.  A point that
    never belongs to a cluster has none.  Edges are taken in ``ranges`` ranges
    of their order, or fewer of ``smallest`` edges.
    """
    spark = nodes.sparkSession
    numbered = checkpoint(running_sum(tree.select("a", "b", "w"), ["w", "a", "b"], F.lit(1), "_number"))
    count = numbered.count()
    size = max(smallest, -(-count // ranges))
    edges = numbered.select(F.col("a").alias("c"), F.col("b").alias("d"), "w", "a", "b", F.floor((F.col("_number") - 1) / size).alias("turn"))
    states = spark.createDataFrame([], _STATE)
    found = []
    for turn in range(-(-count // size)):
        here = edges.filter(F.col("turn") == turn)
        ends = here.select(F.col("c").alias("comp")).union(here.select("d"))
        touched = states.join(ends, "comp", "left_semi")
        out = checkpoint(here.withColumn("_k", F.lit(0)).groupBy("_k").cogroup(touched.withColumn("_k", F.lit(0)).groupBy("_k")).applyInPandas(_unite(least), _FOUND), "kind")  # `size` edges
        found.append(out)
        moves = out.filter("kind = 'move'")
        states = checkpoint(states.join(moves.select("comp"), "comp", "left_anti").unionByName(moves.filter("comp = into").select(*states.columns)))
        edges = edges.filter(F.col("turn") > turn)
        for end in ("c", "d"):
            edges = edges.join(moves.filter("comp <> into").select(F.col("comp").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        edges = checkpoint(edges.select("c", "d", "w", "a", "b", "turn"))
    # Nothing ends the roots.
    since = 1 / F.greatest("since", F.lit(CLOSEST))
    stable = F.col("mass") + F.when(F.col("below") > 0, F.col("below") * since).otherwise(0.0)
    done = states.filter("c IS NOT NULL").select("c", F.lit(None).cast("string").alias("parent"), F.round(stable, 9).alias("stability"), "within")
    placed = spark.createDataFrame([], "node_id long, c string")
    for out in found:
        done = done.unionByName(out.filter("kind = 'cluster'").select("c", "parent", "stability", "within"))
        placed = placed.unionByName(out.filter("kind = 'point'").select(F.col("comp").alias("node_id"), "c"))
    chosen = F.col("within").isNull() | (F.col("stability") >= F.col("within"))
    return done.select("c", "parent", "stability", chosen.alias("chosen")), nodes.select("node_id").join(placed, "node_id", "left")


def density_labels(nodes: DataFrame, tree: DataFrame, least: int, ranges: int = RANGES, smallest: int = SMALLEST) -> DataFrame:
    """``node_id, p``: the smallest id in the point's cluster, -1 for noise.  A root is never a cluster."""
    found, placed = condensed_tree(nodes, tree, least, ranges, smallest)
    # ``cluster``: the highest choice from ``c`` to below ``up``; each round doubles the reach.
    given = checkpoint(found.select("c", F.col("parent").alias("up"), F.when(F.col("chosen") & F.col("parent").isNotNull(), F.col("c")).alias("cluster")))
    while not given.filter("up IS NOT NULL").isEmpty():
        above = given.select(F.col("c").alias("up"), F.col("up").alias("_up"), F.col("cluster").alias("_cluster"))
        given = checkpoint(given.join(above, "up", "left").select("c", F.col("_up").alias("up"), F.coalesce("_cluster", "cluster").alias("cluster")))
    marked = checkpoint(placed.join(given.select("c", "cluster"), "c", "left"))
    smallest_id = marked.filter("cluster is not null").groupBy("cluster").agg(F.min("node_id").alias("_p"))
    return marked.join(smallest_id, "cluster", "left").select("node_id", F.coalesce("_p", F.lit(-1)).cast("long").alias("p"))


def hdbscan(vectors: DataFrame, *, least: int = 5, samples: int | None = None) -> DataFrame:
    """``node_id, p`` of ``node_id, vec``: clusters of at least ``least`` unit vectors, -1 for noise.

    ``samples`` neighbours define the core distance (``least`` by default).
    """
    if least < 2:
        raise ValueError("least: 2 or more")
    return density_labels(vectors.select("node_id"), spanning_tree(vectors, samples or least), least)
