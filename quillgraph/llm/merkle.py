"""Merkle manifest of a table: one tree for each group of rows, one over the groups.

Leaves are ordered within their group and cut into contiguous pieces, one for
each range partition that the group touches.  A task reads a piece in order and
keeps, for every level, the nodes of the run that is still open - the stack of
a mountain range.  A run of ``fanout`` nodes is hashed as soon as it is whole
and its digest is carried to the next level; the last run of a level may be
shorter and is hashed without padding, as the number of leaves is known.
Nodes of runs that begin or end in another piece (at most two runs for each
piece and level) leave the stack as loose nodes; they are joined by run, level by level.

Every finished run is a node record: group, level, run, the digests of its
nodes.  The records are the manifest; proofs come from them from the top down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 16

_NODES = "_group string, _n long, _level int, _run long, _place int, _nodes string, _digest string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def levels(n: int, fanout: int = FANOUT) -> int:
    """Levels of runs over ``n`` leaves; 0 for a lone leaf."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


class _Peaks:
    """The open runs of one piece of a group's leaves, level by level."""

    def __init__(self, group: str | None, n: int, fanout: int, out: list[tuple]):
        self.group, self.fanout, self.out = group, fanout, out
        self.width = [n]  # nodes of each level
        while self.width[-1] > 1:
            self.width.append(-(-self.width[-1] // fanout))
        self.open: list[list[str]] = [[] for _ in self.width]
        self.first = [0] * len(self.width)

    def add(self, index: int, digest: str) -> None:
        level = 0
        while level < len(self.width) - 1:
            run, place = divmod(index, self.fanout)
            nodes = self.open[level]
            if not nodes:
                self.first[level] = index
            nodes.append(digest)
            if index + 1 < min((run + 1) * self.fanout, self.width[level]):
                return
            if self.first[level] % self.fanout:  # the run began in another piece
                self.loose(level)
                return
            joined = "".join(nodes)
            digest = hashlib.sha256(joined.encode()).hexdigest()
            self.out.append((self.group, self.width[0], level, run, None, joined, digest))
            nodes.clear()
            level, index = level + 1, run

    def loose(self, level: int) -> None:
        for i, digest in enumerate(self.open[level], self.first[level]):
            self.out.append((self.group, self.width[0], level, i // self.fanout, i % self.fanout, None, digest))
        self.open[level].clear()

    def close(self) -> None:
        for level in range(len(self.width) - 1):
            self.loose(level)


def _climb(fanout: int):
    names = [c.split()[0] for c in _NODES.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def flush(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        out.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        piece, peaks = None, None
        for batch in batches:
            for part, group, n, index, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if peaks is None or (part, group) != piece:
                    if peaks is not None:
                        peaks.close()
                    piece, peaks = (part, group), _Peaks(group, n, fanout, out)
                peaks.add(index, digest)
                if len(out) >= 4096:
                    yield flush(out)
        if peaks is not None:
            peaks.close()
        if out:
            yield flush(out)

    return run


@dataclass
class Trees:
    """``leaves``: the given columns, ``_n`` and ``_index`` in the group; ``runs``: node records; ``tops``: group, ``_n``, ``_top``."""

    leaves: DataFrame
    runs: DataFrame
    tops: DataFrame
    height: int


def trees(leaves: DataFrame, *, group: str, order: list[str], digest: str, fanout: int = FANOUT) -> Trees:
    """One tree for each group; ``leaves`` is ordered by ``order`` (null first), then by digest.

    Rows alike in all of these are leaves of their own in any order, which
    changes no digest.  A null group is a group, before all others.
    """
    numbered = materialize(leaves.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, digest, "_tie")]
    ordered = materialize(numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33))
    # One row for each piece: where it begins among the group's leaves.
    pieces = ordered.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_from"))
    of_group = Window.partitionBy(group)
    pieces = pieces.select(
        F.col("_part").alias("_p"),
        F.col(group).alias("_g"),
        (F.sum("_count").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_count") - F.col("_from")).alias("_shift"),
        F.sum("_count").over(of_group).alias("_n"),
    )
    indexed = ordered.join(pieces, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    indexed = indexed.withColumn("_index", F.col("_at") + F.col("_shift"))
    indexed = materialize(indexed.select(*leaves.columns, "_part", "_n", "_index"), "indexed")

    n_max = indexed.agg(F.max("_n")).first()[0] or 0
    height = levels(n_max, fanout)
    dealt = indexed.repartition("_part", group).sortWithinPartitions("_part", F.col(group).asc_nulls_first(), "_index")
    nodes = materialize(dealt.select("_part", group, "_n", "_index", digest).mapInArrow(_climb(fanout), _NODES), "nodes")
    records = [nodes.filter("_nodes is not null").drop("_place")]
    carried: DataFrame | None = None
    for level in range(height):
        loose = nodes.filter((F.col("_level") == level) & F.col("_nodes").isNull()).select("_group", "_n", "_run", "_place", "_digest")
        if carried is not None:
            # A run that pieces share: its digest is a loose node of the level above.
            above = carried.filter(f"ceil(_n / pow({fanout}, {level})) > 1")
            loose = loose.unionByName(above.select("_group", "_n", (F.col("_run") / fanout).cast("long").alias("_run"), (F.col("_run") % fanout).cast("int").alias("_place"), "_digest"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_digest"))), lambda s: s.getField("_digest")), "")
        merged = loose.groupBy("_group", "_n", "_run").agg(joined.alias("_nodes"))  # at most ``fanout`` nodes
        carried = materialize(merged.select("_group", "_n", F.lit(level).alias("_level"), "_run", "_nodes", F.sha2("_nodes", 256).alias("_digest")), "merged")
        records.append(carried)
    runs = reduce(DataFrame.unionByName, records)
    # Nodes that a task has carried to a level where its run is shared are in ``nodes`` as loose ones already.
    top_runs = runs.filter(F.col("_run") == 0).groupBy("_group", "_n").agg(F.max_by("_digest", "_level").alias("_top"))
    lone = indexed.filter("_n = 1").select(F.col(group).alias("_group"), "_n", F.col(digest).alias("_top"))
    return Trees(indexed, runs, top_runs.unionByName(lone), height)


def _step(nodes: Column, place: Column) -> Column:
    """Siblings to the left and to the right of a node in its run."""
    at = place.cast("int") * 64
    return F.struct(F.substring(nodes, F.lit(1), at).alias("left"), F.substring(nodes, at + 65, F.length(nodes)).alias("right"))


def paths(found: Trees, above: DataFrame | None = None, *, fanout: int = FANOUT) -> DataFrame:
    """``_group, _run, _nodes, _path`` of the runs of leaves: ``_path`` are the steps from the run's digest to the top.

    ``above`` (``_group, _beyond``) has the steps that follow the top.  A lone
    leaf counts as a run of one node that has no step of its own.
    """
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = found.tops if above is None else found.tops.join(above.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    tops = tops.select("_group", "_n", "_top", (F.lit(none) if above is None else F.col("_beyond")).alias("_path"))
    # The step to a lone leaf's run is the leaf itself; other groups begin below their top run.
    current = tops.filter("_n > 1").select("_group", "_n", F.lit(0).cast("long").alias("_run"), "_path")
    waiting, lone = current, tops.filter("_n = 1").select("_group", F.lit(0).cast("long").alias("_run"), F.col("_top").alias("_nodes"), "_path")
    current = None
    for level in range(found.height - 1, -1, -1):
        runs = found.runs.filter(F.col("_level") == level).select(F.col("_group").alias("_g"), F.col("_n").alias("_m"), F.col("_run").alias("_r"), "_nodes")
        begins = waiting.filter(f"_n > {fanout**level} and _n <= {fanout ** (level + 1)}")
        if current is not None:
            begins = begins.unionByName(current)
        joined = begins.join(runs, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")))
        if level == 0:
            return joined.select("_group", "_run", "_nodes", "_path").unionByName(lone)
        each = joined.withColumn("_place", F.explode(F.sequence(F.lit(0), (F.length("_nodes") / 64).cast("int") - 1)))
        current = each.select("_group", "_n", (F.col("_run") * fanout + F.col("_place")).alias("_run"), F.concat(F.array(_step(F.col("_nodes"), F.col("_place"))), "_path").alias("_path"))
    return lone


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s.getField("left"), acc, s.getField("right")), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s.getField("left"), s.getField("right"))))


def manifest(docs: DataFrame, *, fields: list[str], group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Proof of every row, and the node records of all trees.

    The first table has ``key``, the columns of ``carry``, ``leaf``,
    ``subroot`` (top of its group), ``root`` and ``path`` (the siblings of each
    level, left and right of the node, from the leaf to the root); the second
    ``tree`` (``group`` or ``root``), ``grp``, ``level``, ``run``, ``nodes``
    and ``digest``.

    Null fields count as ``-``; a null key comes first in its group and a null
    group before the others; repeated rows are leaves of their own; other
    columns, whatever their names, are not read; an empty table gives no rows.
    A lone leaf is its group's top and a lone group's top the root.
    """
    rows = docs.select(F.col(group).cast("string").alias("_group"), F.col(key).alias("_key"), leaf_digest(*(F.col(c) for c in fields)).alias("_leaf"), *(v.alias(f"_c{i}") for i, v in enumerate((carry or {}).values())))
    inner = trees(rows, group="_group", order=["_key"], digest="_leaf", fanout=fanout)
    tops = materialize(inner.tops, "tops")
    inner.tops = tops
    # One tree over the groups: their tops are the leaves of a single group.
    outer = trees(tops.select(F.lit("").alias("_all"), F.col("_group").alias("_name"), "_top"), group="_all", order=["_name"], digest="_top", fanout=fanout)
    root = outer.tops.first()  # one row, or none of an empty table
    of_run = paths(outer, fanout=fanout).drop("_group").withColumn("root", F.lit(root["_top"] if root else None).cast("string"))
    each = outer.leaves.select(F.col("_name").alias("_group"), F.col("_top").alias("subroot"), "_n", "_index").join(of_run, F.expr(f"_index div {fanout} = _run"))
    beyond = F.when(F.col("_n") > 1, F.concat(F.array(_step(F.col("_nodes"), F.col("_index") % fanout)), "_path")).otherwise(F.col("_path"))
    beyond = materialize(each.select("_group", "subroot", "root", beyond.alias("_beyond")), "beyond")
    # Subroot and root travel with the path, so a group's name meets one row for each run, not each leaf.
    last = F.struct(F.col("subroot").alias("left"), F.col("root").alias("right"))
    carried = beyond.select("_group", F.concat("_beyond", F.array(last)).alias("_beyond"))
    of_leaf = paths(inner, carried, fanout=fanout).select(F.col("_group").alias("_g"), "_run", "_nodes", "_path")
    joined = inner.leaves.withColumn("_r", F.expr(f"_index div {fanout}")).join(of_leaf, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_run")))
    rest = F.slice("_path", F.lit(1), F.size("_path") - 1)
    path = F.when(F.col("_n") > 1, F.concat(F.array(_step(F.col("_nodes"), F.col("_index") % fanout)), rest)).otherwise(rest)
    out = joined.select(
        F.col("_key").alias(key),
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry or {})),
        F.col("_leaf").alias("leaf"),
        F.element_at("_path", -1).getField("left").alias("subroot"),
        F.element_at("_path", -1).getField("right").alias("root"),
        path.alias("path"),
    )
    named = [F.col(f"_{c}").alias(c) for c in ("level", "run", "nodes", "digest")]
    records = inner.runs.select(F.lit("group").alias("tree"), F.col("_group").alias("grp"), *named).unionByName(outer.runs.select(F.lit("root").alias("tree"), F.lit(None).cast("string").alias("grp"), *named))
    return out, records


def oracle_sql(levels: int = 5, fanout: int = FANOUT) -> str:
    """The registered query in DuckDB SQL, for at most ``fanout ** levels`` rows of a group and as many groups."""

    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))

    def tree(name: str) -> str:
        """Nodes of every level with the siblings of each; a group of one node keeps it."""
        out = []
        for k in range(levels):
            out.append(
                f"{name}r{k} AS (SELECT g, i // {fanout} AS r, list(h ORDER BY i) AS m, any_value(c) AS c FROM {name}{k} GROUP BY ALL), "
                f"{name}{k + 1} AS (SELECT g, r AS i, CASE WHEN c > 1 THEN sha256(array_to_string(m, '')) ELSE m[1] END AS h, count(*) OVER (PARTITION BY g) AS c FROM {name}r{k}), "
            )
        return "".join(out)

    def climb(source: str, name: str, at: str) -> str:
        """Siblings and folded digest of each row of ``source`` (g, ``at``, s, f) through the tree."""
        last, out = source, []
        for k in range(levels):
            place = f"((x.{at} // {fanout**k}) % {fanout})"
            left, right = f"array_to_string(y.m[1:{place}], '')", f"array_to_string(y.m[{place} + 2:], '')"
            out.append(
                f"{source}{name}{k} AS (SELECT x.* EXCLUDE (s, f), CASE WHEN y.c > 1 THEN x.s || {left} || {right} ELSE x.s END AS s, "
                f"CASE WHEN y.c > 1 THEN sha256({left} || x.f || {right}) ELSE x.f END AS f "
                f"FROM {last} x JOIN {name}r{k} y ON x.{name}g IS NOT DISTINCT FROM y.g AND x.{at} // {fanout ** (k + 1)} = y.r), "
            )
            last = f"{source}{name}{k}"
        return "".join(out)

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # CRC-32 of the decimal number, bit by bit: polynomial 0xEDB88320, reflected.
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda t: ascii(t)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    return (
        f"WITH d AS (SELECT doc_id, source AS ag, sha256({fields('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(f"translate(text, '{upper}', '{lower}')")}) END AS t FROM documents), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY ag ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d), "
        "a0 AS (SELECT ag AS g, i, leaf AS h, count(*) OVER (PARTITION BY ag) AS c FROM n), "
        + tree("a")
        + f"o AS (SELECT a{levels}.g AS og, h, row_number() OVER (ORDER BY a{levels}.g NULLS FIRST) - 1 AS oi FROM a{levels}), "
        "b0 AS (SELECT 'all' AS g, oi AS i, h, count(*) OVER () AS c FROM o), "
        + tree("b")
        + "leaves AS (SELECT doc_id, ag, i, leaf, '' AS s, coalesce(t, leaf) AS f FROM n), "
        + climb("leaves", "a", "i")
        + f"tops AS (SELECT x.*, o.oi, o.h AS subroot, 'all' AS bg FROM leavesa{levels - 1} x JOIN o ON x.ag IS NOT DISTINCT FROM o.og), "
        + climb("tops", "b", "oi")
        + f"root AS (SELECT h FROM b{levels}) "
        f"SELECT doc_id, leaf, subroot, root.h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM topsb{levels - 1}, root"
    )
