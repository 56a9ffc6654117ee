"""Near-duplicate detection with BagMinHash signatures of word shingles.

A text is the multiset of its runs of five words.  BagMinHash gives registers
that agree with a probability equal to the weighted Jaccard similarity: for
every shingle there are Poisson processes over blocks of weights (0, 1],
(1, 2], (2, 4], (4, 8], ...; a block counts as far as the shingle's weight
reaches, and a register keeps the earliest of the points that fall to it.
Only points before a text's time limit are generated, about
``m (ln m + 5)`` of them whatever its length.

Bands of registers propose pairs of different texts and the multiset overlap of
the shingles decides; copies of a text count as one node.  First every text of
a band is compared with the first of its band, and links make classes.  Where a
band still holds several classes, all its texts of different classes are
compared: the band is cut into blocks, a task takes two blocks at a time,
computes their overlaps as matrix products, and returns only which classes they
join.  So no pair of texts in a common band is left out, however large the
band, and no band is expanded into its pairs.  Two texts of similarity 0.8 have
a common band with probability 1 - (1 - 0.8^4)^24 = 0.999997.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, materialize, text_or_empty

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Texts and shingles of a block; a longer text is a block with others by chance.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
#: Members of at most so many multisets are counted pair by pair; cells of one dense slice for the others.
RARE_MEMBER, DENSE_CELLS = 16, 1 << 22
#: Texts worked on at once; one longer text makes a batch of its own.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of at most 1024 texts: index of the text, hash (54 bits), weight; ordered by both.

    Words are separated by white space.  A text with fewer words than
    ``size`` is one shingle of them all; one without words has none.
    """
    import xxhash

    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    counts = np.diff(np.asarray(words.offsets))
    encoded = words.flatten().dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.to_pylist()], dtype=np.uint64)
    if not len(table):
        table = np.zeros(1, np.uint64)
    hashed = table[np.asarray(encoded.indices)] if len(encoded) else np.zeros(0, np.uint64)
    blank = xxhash.xxh3_64_intdigest("")
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(hashed))
    first = np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.where(end - first >= size, at + size <= end, (at == first) & (hashed != blank))
    at, owner, end = at[starts], owner[starts], end[starts]
    total = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([hashed, np.zeros(size, np.uint64)])
    for k in range(size):
        value = np.where(at + k < end, padded[at + k], np.uint64(0))
        total = _mix(total * np.uint64(31) + value + _GOLDEN)
    key = np.sort((owner.astype(np.uint64) << np.uint64(54)) | (total >> np.uint64(10)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    places = np.flatnonzero(new)
    weight = np.diff(np.append(places, len(key)))
    key = key[places]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), weight


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash registers of ``n`` multisets: float times, infinite for an empty multiset."""
    out = np.full(n * m, np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    # units: one process for each shingle and block of weights that its weight reaches into
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    unit = np.repeat(np.arange(len(owner)), blocks)
    block = np.arange(len(unit)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0.0, 2.0 ** (block - 1))
    width = np.where(block == 0, 1.0, low)
    seed = _mix(shingle[unit] * np.uint64(64) + block.astype(np.uint64) + _GOLDEN)
    reach = np.minimum(weight[unit] - low, width) / width  # share of the block that counts
    doc = owner[unit]
    limit = np.where(total > 0, m * (math.log(m) + 5) / np.maximum(total, 1), 0.0)
    todo = np.arange(n)[total > 0]
    while len(todo):
        wanted = np.zeros(n, dtype=bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[doc])
        time = np.zeros(len(live))
        step = 1
        while len(live):
            x = _mix(seed[live] + np.uint64(step * int(_GOLDEN) % (1 << 64)))
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width[live]
            on = time < limit[doc[live]]
            live, time, x = live[on], time[on], x[on]
            y = _mix(x ^ np.uint64(0xD6E8FEB86659FD93))
            inside = (y >> np.uint64(32)).astype(np.float64) / 2.0**32 < reach[live]
            register = ((y & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(out, doc[live[inside]] * m + register[inside].astype(np.int64), time[inside])
            step += 1
        todo = todo[np.isinf(out.reshape(n, m)[todo]).any(axis=1)]
        limit[todo] *= 2
    return out.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), (len(registers), bands)).copy()
    for r in range(rows):
        key = _mix(key ^ (bits[:, :, r] * np.uint64(0xFF51AFD7ED558CCD)))
    return key.view(np.int64)


def node(text: str | Column) -> Column:
    """Digest that names a text; equal texts are one node."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def banded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``_id`` (the key), ``_node``, ``_bands`` array<long> and ``_size``, the number of shingles, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, (2,), ROWS_PER_BATCH, BYTES_PER_BATCH):
                n = batch.num_rows
                owner, shingle, weight = shingles(batch.column(2))
                keys = band_keys(signatures(owner, shingle, weight, n, bands * rows), bands, rows)
                size = pa.array(np.bincount(owner, weights=weight, minlength=n).astype(np.int64))
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, size], names=["_id", "_node", "_bands", "_size"])

    source = docs.select(F.col(key).cast("long").alias("_id"), node(text).alias("_node"), text_or_empty(text).alias("_text"))
    return source.mapInArrow(run, "_id long, _node binary, _bands array<long>, _size long")


def _can_link(a: str, b: str, threshold: float) -> Column:
    """Whether two sizes leave the similarity a chance: it is at most the smaller over the larger."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold - 1e-9)


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Links among (``a``, ``b``, ``_ta``, ``_tb``) rows: multiset overlap of the texts' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, (2, 3), ROWS_PER_BATCH, BYTES_PER_BATCH):
                similarity = overlap(batch.column(2), batch.column(3))
                keep = pa.array(np.flatnonzero(similarity >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return pairs.select("a", "b", "_ta", "_tb").mapInArrow(run, "a binary, b binary")


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of paired texts; 1 if neither has a word."""
    n = len(left)
    sides = [shingles(x) for x in (left, right)]
    totals = [np.bincount(o, weights=w, minlength=n) for o, _, w in sides]
    keys = [(o.astype(np.uint64) << np.uint64(54)) | s for o, s, _ in sides]
    _, i, j = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
    common = np.bincount(sides[0][0][i], weights=np.minimum(sides[0][2][i], sides[1][2][j]), minlength=n)
    union = totals[0] + totals[1] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    ta = texts.select(F.col("_node").alias("a"), F.col("_text").alias("_ta"))
    tb = texts.select(F.col("_node").alias("b"), F.col("_text").alias("_tb"))
    return _verify(pairs.join(ta, "a").join(tb, "b"), threshold)


# ------------------------------------------------------- comparison of blocks


def common_weights(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """``n`` x ``n`` matrix of multiset intersections.

    A shingle of weight w counts as w members (shingle, 1) ... (shingle, w), so
    intersections are scalar products of 0/1 rows.  Members that few of the
    texts have are added pair by pair, the others by matrix products over
    slices of columns; sums stay below 2^24, where single precision is exact.
    """
    level = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    owner, key = np.repeat(owner, weight), np.repeat(shingle, weight)
    key = np.where(level > 0, _mix(key ^ _mix(level.astype(np.uint64) * _GOLDEN)), key)
    order = np.argsort(key, kind="stable")
    owner, key = owner[order], key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    often = np.diff(np.append(starts, len(key)))
    out = np.zeros((n, n), dtype=np.float64)
    frequency = np.repeat(often, often)
    rare = frequency <= RARE_MEMBER
    few, name = owner[rare], np.repeat(np.arange(len(often)), often)[rare]
    for step in range(1, RARE_MEMBER):
        same = np.flatnonzero(name[step:] == name[:-step]) if len(name) > step else name[:0]
        if not len(same):
            break
        a, b = few[same], few[same + step]
        out += np.bincount(np.minimum(a, b) * n + np.maximum(a, b), minlength=n * n).reshape(n, n)
    out += out.T
    many, column = owner[~rare], np.repeat(np.cumsum(often > RARE_MEMBER) - 1, often)[~rare]
    width = max(1, DENSE_CELLS // max(n, 1))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at, end = np.searchsorted(column, (first, first + width))
        rows = np.zeros((n, min(width, int(column[-1]) + 1 - first)), dtype=np.float32)
        rows[many[at:end], column[at:end] - first] = 1
        out += rows @ rows.T
    return out


def joined_classes(texts: pa.Array, classes: np.ndarray, threshold: float) -> np.ndarray:
    """For each class 0..k-1 of the texts the smallest class that a chain of links joins to it."""
    n, parts = len(texts), []
    for first in range(0, n, ROWS_PER_BATCH):
        owner, shingle, weight = shingles(texts.slice(first, ROWS_PER_BATCH))
        parts.append((owner + first, shingle, weight))
    owner, shingle, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(owner, weights=weight, minlength=n)
    common = common_weights(owner, shingle, weight, n)
    union = total[:, None] + total[None, :] - common
    linked = np.where(union > 0, common / np.maximum(union, 1), 1.0) >= threshold
    i, j = np.nonzero(linked & (classes[:, None] < classes[None, :]))
    a, b = np.unique(np.stack([classes[i], classes[j]]), axis=1) if len(i) else (i, j)
    label = np.arange(int(classes.max()) + 1)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    return label


def _by_blocks(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between classes of the texts in each group of ``mixed`` (``_group, _lo, _hi, _node, _label``).

    Every task holds two blocks of one group at a time.  What it returns are
    the joins of classes, fewer than there are texts in the blocks, and never
    the pairs.
    """

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        block = pa.Table.from_batches(rows).combine_chunks()
        names, classes = np.unique(np.array(block["_label"].to_pylist(), dtype=object), return_inverse=True)
        label = joined_classes(pa.concat_arrays(block["_text"].chunks), classes, threshold)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(names[label[moved]].tolist(), pa.binary()), pa.array(names[moved].tolist(), pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for first, end in zip(edges, edges[1:], strict=False):
                key = tuple(keys[first].tolist())
                if held and key != last:
                    yield solve(held)
                    held = []
                held.append(batch.slice(first, end - first).select(["_label", "_text"]))
                last = key
        if held:
            yield solve(held)

    by = ["_group", "_lo", "_hi"]
    rows = mixed.select(*by, "_node", "_label").join(texts, "_node").select(*by, "_label", "_text")
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")


def _mixed_groups(members: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``_group, _lo, _hi, _node, _label``: groups of ``members`` with several classes, cut into pairs of blocks.

    Groups with the same texts are one.  The largest class of a group is its
    bulk: pairs inside it are not needed, so its blocks meet only those of the
    other texts.  A group that fits into one block stays whole.
    """
    labelled = members.join(labels, "_node", "left").select("_band", "_key", "_node", "_size", F.coalesce("_label", "_node").alias("_label"))
    labelled = materialize(labelled, "labelled")
    # Two sums name the set of texts.
    per_class = labelled.groupBy("_band", "_key", "_label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"), F.min("_size").alias("_least"), F.max("_size").alias("_most"), *(F.sum(F.xxhash64("_node", F.lit(k)).cast("decimal(38,0)")).alias(f"_sum{k}") for k in (1, 2))
    )
    groups = (
        per_class.groupBy("_band", "_key")
        .agg(
            F.sum("_n").alias("_all"),
            F.sum("_s").alias("_all_s"),
            F.max_by("_label", F.struct("_n", "_label")).alias("_bulk"),
            F.max("_n").alias("_bulk_n"),
            F.max_by("_s", F.struct("_n", "_label")).alias("_bulk_s"),
            F.count(F.lit(1)).alias("_classes"),
            F.min("_least").alias("_least"),
            F.max("_most").alias("_most"),
            F.sum("_sum1").alias("_sum1"),
            F.sum("_sum2").alias("_sum2"),
        )
        .filter("_classes > 1")
        .filter((F.col("_all") > 2) | _can_link("_least", "_most", threshold))
        .withColumn("_group", F.xxhash64("_all", "_sum1", "_sum2"))
    )
    need = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    whole = need(F.col("_all"), F.col("_all_s")) == 1
    one = groups.groupBy("_group", "_all", "_sum1", "_sum2").agg(F.min(F.struct("_band", "_key", "_bulk", "_bulk_n", "_bulk_s", "_all_s")).alias("_g"))
    one = one.select("_group", "_all", "_g.*").select(
        "_group",
        "_band",
        "_key",
        "_bulk",
        F.when(whole, 0).otherwise(need(F.col("_bulk_n"), F.col("_bulk_s"))).alias("_bulk_blocks"),
        F.when(whole, 1).otherwise(need(F.col("_all") - F.col("_bulk_n"), F.col("_all_s") - F.col("_bulk_s"))).alias("_other_blocks"),
    )
    inside = labelled.join(one, ["_band", "_key"])
    is_bulk = (F.col("_bulk_blocks") > 0) & (F.col("_label") == F.col("_bulk"))
    inside = inside.withColumn("_is_bulk", is_bulk).withColumn(
        "_block", F.when(is_bulk, F.pmod(F.xxhash64("_node", F.lit(3)), F.col("_bulk_blocks"))).otherwise(F.col("_bulk_blocks") + F.pmod(F.xxhash64("_node", F.lit(3)), F.col("_other_blocks"))).cast("int")
    )
    meets = F.expr("explode(CASE WHEN _is_bulk THEN sequence(_bulk_blocks, _bulk_blocks + _other_blocks - 1) ELSE sequence(0, _bulk_blocks + _other_blocks - 1) END)")
    met = inside.select("_group", "_node", "_label", "_block", meets.alias("_with"))
    return met.select("_group", F.least("_block", "_with").alias("_lo"), F.greatest("_block", "_with").alias("_hi"), "_node", "_label")


# ------------------------------------------------------------------- classes


def components(links: DataFrame) -> DataFrame:
    """``_node, _label`` for all nodes with links: the smallest node of the component.

    Each round joins every node to the smallest of its neighbours and itself
    and goes on with the links between the joined nodes, of which there are
    fewer.  The smallest node of a component stays to the end.  Rounds are
    written to the shared folder.
    """
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while True:
        parents = edges.groupBy(F.col("a").alias("_node")).agg(F.least(F.min("b"), F.col("a")).alias("_label"))
        parents = materialize(parents, "parents")
        if labels is None:
            labels = parents
        else:
            further = parents.select(F.col("_node").alias("_label"), F.col("_label").alias("_further"))
            labels = materialize(labels.join(further, "_label", "left").select("_node", F.coalesce("_further", "_label").alias("_label")), "labels")
        of = lambda side: parents.select(F.col("_node").alias(side), F.col("_label").alias(f"_l{side}"))  # noqa: B023, E731
        joined = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_la").alias("a"), F.col("_lb").alias("b"))
        edges = materialize(joined.filter("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _classes(docs: DataFrame, key: str, text: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``_id, _node`` of every row, and ``_node, class_id, _keeper`` of every text; a class has one keeper, a text with its smallest key."""
    signed = materialize(banded(docs, key=key, text=text, bands=bands, rows=rows), "bands")
    nodes = materialize(signed.groupBy("_node").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.first("_size").alias("_size")), "nodes")
    keyed = nodes.select("_node", "_size", F.posexplode("_bands").alias("_band", "_key"))
    groups = keyed.groupBy("_band", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_node").alias("_first"), F.min_by("_size", "_node").alias("_first_size")).filter("_n > 1")
    members = materialize(keyed.join(materialize(groups, "groups"), ["_band", "_key"]).select("_node", "_size", "_band", "_key", "_first", "_first_size"), "members")
    star = members.filter((F.col("_node") != F.col("_first")) & _can_link("_size", "_first_size", threshold)).select(F.col("_first").alias("a"), F.col("_node").alias("b"))
    pairs = materialize(star.distinct(), "pairs")
    wanted = members.select("_node").distinct().join(nodes.select("_node", "_rep"), "_node")
    source = docs.select(F.col(key).cast("long").alias("_id"), node(text).alias("_of"), text_or_empty(text).alias("_text"))
    # The same plan at every size: texts are dealt out by their digest and key.
    texts = source.join(wanted.hint("merge"), (F.col("_of") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_rep"))).select("_node", "_text")
    texts = materialize(texts.dropDuplicates(["_node"]), "texts")
    labels = components(materialize(_links(pairs, texts, threshold), "links"))
    mixed = materialize(_mixed_groups(members, labels, threshold), "mixed")
    between = components(materialize(_by_blocks(mixed, texts, threshold).distinct(), "class-links"))
    merged = nodes.select("_node", "_rep").join(labels, "_node", "left").withColumn("_label", F.coalesce("_label", "_node"))
    merged = merged.join(between.select(F.col("_node").alias("_label"), F.col("_label").alias("_joined")), "_label", "left")
    merged = materialize(merged.select("_node", "_rep", F.coalesce("_joined", "_label").alias("_label")), "merged")
    first = merged.groupBy("_label").agg(F.min(F.struct(F.col("_rep").isNull().alias("_none"), "_rep", "_node")).alias("_first"))
    named = merged.join(first, "_label").select("_node", F.col("_first._rep").alias("class_id"), (F.col("_node") == F.col("_first._node")).alias("_keeper"))
    return signed.select("_id", "_node"), materialize(named, "classes")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: ``_id``, ``_node``, ``class_id`` (smallest key of its class).

    Texts are in one class if a chain of links, each of similarity
    ``threshold`` or more, joins them; equal texts always are.  Texts without
    words are alike.  A null key passes and is never the smallest unless all
    are null; null text counts as empty; repeated rows stay repeated; columns
    other than ``key`` and ``text`` are not read, so their names don't matter;
    an empty table gives an empty result.
    """
    signed, named = _classes(docs, key, text, threshold, bands, rows)
    return signed.join(named, "_node").select("_id", "_node", "class_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one with the smallest key, with all its columns.

    Of repeated rows, and of rows with one key in a class, one stays.  A row
    with a null key stays only where its class has no other key.  Columns of
    any name pass unchanged; an empty table gives an empty result.
    """
    _, named = _classes(docs, key, text, threshold, bands, rows)
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(key).cast("long").alias("_id"), node(text).alias("_node"))
    kept = named.filter("_keeper").select(F.col("_node").alias("_keep"), F.col("class_id").alias("_first_id"))
    joined = marked.join(kept, (F.col("_node") == F.col("_keep")) & F.col("_id").eqNullSafe(F.col("_first_id")))
    one = F.row_number().over(Window.partitionBy("_node", "_id").orderBy(F.lit(0)))
    return joined.withColumn("_one", one).filter("_one = 1").select("_row.*")
