"""Best-fit packing of token sequences by patterns and non-negative least squares.

The method works on the histogram of lengths, whose size is bounded by the
capacity and not by the data:

1. every pattern of at most three lengths that fills a sequence exactly is
   enumerated,
2. non-negative least squares fits how often each pattern is repeated so that
   the patterns' lengths add up to the histogram,
3. the counts are rounded down, never beyond what the histogram holds,
4. the residual lengths are packed best-fit, longest first, still as counts.

The outcome is a list of *slots* (length, first rank, repeats, first sequence,
offset).  A piece finds its slot by its rank among the pieces of its length;
ranks come from counts by salted group, so a length that a third of all rows
share is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty

#: The pieces of one length are dealt into so many groups at least for ranking, and so that a group has about so many of all pieces.
RANK_GROUPS, PIECES_PER_GROUP = 64, 1_000_000
ROWS_PER_BATCH = 256


def tiktoken_encoding(tokenizer_path: str):
    """A rank-based encoder with the vocabulary of a byte-level ``tokenizers`` file.

    In such a file the id of a merged token rises with the order of its merge,
    so the id serves as the rank and both libraries return the same ids
    (compared in the tests).  The file is opened on executors: it belongs to
    an installed package, not to the data.
    """
    import json

    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    # The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    import public_tokenizers

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenize(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text: str = "text",
    max_tokens: int = 2048,
    end_id: int | None = 0,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Token ids of every whole text, cut into pieces of at most ``max_tokens``.

    Returns ``keep`` columns plus ``piece`` int, ``start`` long, ``length``
    long, ``ids`` binary (little-endian unsigned 32-bit).  Only documents
    longer than ``max_tokens`` are cut; then the first piece takes the
    remainder and all later ones are full.  Null text counts as empty, a null
    in a ``keep`` column passes through, repeated rows stay repeated.  With
    ``end_id`` None an empty text has no tokens and no piece.
    """
    source = docs.select(*keep, text_or_empty(text).alias("_text"))
    schema = T.StructType(
        [*source.schema.fields[:-1], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(tokenizer_path)
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                row, piece, start, length, ids = [], [], [], [], []
                for i, value in enumerate(batch.column(batch.num_columns - 1)):
                    data = encoding.encode_to_numpy(value.as_py(), allowed_special="all").astype("<u4").tobytes() + tail
                    n = len(data) // 4
                    at = 0
                    end = (n % max_tokens or min(n, max_tokens)) if n > max_tokens else n
                    k = 0
                    while at < n:
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(end - at)
                        ids.append(data[4 * at : 4 * end])
                        at, end, k = end, min(n, end + max_tokens), k + 1
                kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                arrays = [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


# ---------------------------------------------------------------- histogram plan


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three of the given lengths with sum ``capacity``; rows are padded with 0."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    for a in map(int, lengths[lengths <= capacity // 2]):
        if have[capacity - a]:
            rows.append(np.array([[a, capacity - a, 0]]))
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        b = b[have[capacity - a - b]]
        if len(b):
            rows.append(np.stack([np.full(len(b), a), b, capacity - a - b], axis=1))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), dtype=np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares min ||A x - histogram||, x >= 0.

    Coordinate descent over blocks of patterns that share no length: inside a
    block every coordinate is minimised exactly, and the solution stays sparse
    enough for rounding to keep it.  It ends when no coordinate lowers the sum
    of squares by a quarter.
    """
    size = len(histogram)
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    weight = np.stack([patterns == patterns[:, [k]] for k in range(3)], axis=2).sum(axis=1) * (patterns > 0)
    square = np.maximum((weight * (patterns > 0)).sum(axis=1), 1).astype(float)  # |a_j|^2 = sum of squared multiplicities
    residual = histogram.astype(float).copy()
    residual[0] = 0
    while True:
        gradient = residual[patterns].sum(axis=1)  # residual[0] is 0: padding adds nothing
        new = np.maximum(0.0, x + gradient / square)
        gain = (new - x) ** 2 * square
        order = np.argsort(-gain, kind="stable")[: 8 * size]
        used = np.zeros(size, dtype=bool)
        chosen = []
        for j in order[gain[order] > 0.25].tolist():
            a, b, c = patterns[j]
            if not (used[a] or (b and used[b]) or (c and used[c])):
                used[a] = used[b] = used[c] = True
                used[0] = False
                chosen.append(j)
        if not chosen:
            break
        step = new[chosen] - x[chosen]
        x[chosen] = new[chosen]
        np.subtract.at(residual, patterns[chosen].ravel(), np.repeat(step, 3))
        residual[0] = 0
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths in one sequence, how many such sequences)."""
    spaces: list[int] = []  # sorted free spaces for which an open group exists
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], count: int) -> None:
        free = capacity - sum(content)
        if free not in groups:
            groups[free] = []
            bisect.insort(spaces, free)
        groups[free].append((content, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                free = spaces[k]
                content, count = groups[free].pop()
                if not groups[free]:
                    del groups[free]
                    spaces.pop(k)
            else:
                free, content, count = capacity, (), left
            each = free // length
            full = min(count, left // each)
            if full:
                put(content + (length,) * each, full)
                left -= full * each
                count -= full
            if left and left < each and count:
                put(content + (length,) * left, 1)
                count -= 1
                left = 0
            if count and content:
                put(content, count)
    return [item for group in groups.values() for item in group]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, repeats): rounded least-squares patterns, then the packed residual."""
    bad = [n for n in histogram if not 0 < n <= capacity]
    if bad:
        raise ValueError(f"lengths must lie in 1..{capacity}: {sorted(bad)[:5]}")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    x = fit_repeats(patterns, left)
    out: list[tuple[tuple[int, ...], int]] = []
    rounded = np.floor(x + 1e-9).astype(np.int64)  # down: a short pattern is worse than a larger residual
    for j in np.argsort(-x, kind="stable").tolist():
        if rounded[j] < 1:
            break
        content = tuple(int(v) for v in patterns[j] if v)
        need = {v: content.count(v) for v in content}
        repeats = min(int(rounded[j]), *(int(left[v]) // n for v, n in need.items()))
        if repeats > 0:
            out.append((content, repeats))
            for v, n in need.items():
                left[v] -= n * repeats
    rest = {int(v): int(left[v]) for v in np.flatnonzero(left)}
    return out + best_fit(rest, capacity)


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """One row per place in a group of equal sequences, ordered by (length, first_rank)."""
    rank: dict[int, int] = {}
    rows = []
    first = 0
    for content, repeats in sequences:
        offset = 0
        for length in content:
            rows.append((length, rank.get(length, 0), first, offset))
            rank[length] = rank.get(length, 0) + repeats
            offset += length
        first += repeats
    frame = pd.DataFrame(rows, columns=["length", "first_rank", "first_sequence", "offset"], dtype="int64")
    return frame.sort_values(["length", "first_rank"], ignore_index=True)


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset`` in it.

    All columns of ``pieces`` stay; ``sequence_id`` and ``offset`` of the input
    are replaced.  A piece with a null length has no place: both are null.
    Other lengths must lie in 1..capacity, or a ValueError is raised.  Ties and
    repeated rows each get a place of their own; which of two equal rows gets
    which place is arbitrary.  An empty table gives an empty result.
    Sequences are numbered from 0 without gaps.

    What reaches the driver is the histogram (at most ``capacity`` rows); what
    is sent to executors is the slot table, whose size depends on the capacity
    and not on the number of pieces.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # The salt is written with the pieces: it deals out equal keys, and every reader sees the same one.
    rows = pieces.select(F.struct(*(F.col(c) for c in keep)).alias("_row"), F.col(length).cast("long").alias("_length"), F.expr("cast(rand() * 9007199254740992 as long)").alias("_salt"))
    rows = materialize(rows, "pieces")
    groups = max(RANK_GROUPS, -(-rows.count() // PIECES_PER_GROUP))
    grouped = rows.filter("_length IS NOT NULL").withColumn("_group", (F.col("_salt") % groups).cast("int"))
    by_group = grouped.groupBy("_length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    counts = by_group.groupBy("_length").agg(F.sum("_n").alias("n")).collect()  # at most `capacity` rows
    table = slots(plan({int(r["_length"]): int(r["n"]) for r in counts}, capacity))
    by_length = Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    before = by_group.select("_length", "_group", (F.sum("_n").over(by_length) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_length", "_group").orderBy(*(F.col("_row").getField(c) for c in order), "_salt")
    ranked = (
        grouped.withColumn("_in_group", F.row_number().over(within) - 1)
        .join(before, ["_length", "_group"])
        .select(*(F.col("_row").getField(c).alias(c) for c in keep), "_length", (F.col("_in_group") + F.col("_before")).cast("long"))
    )
    key = table["length"].to_numpy() * (1 << 44) + table["first_rank"].to_numpy()
    first_rank, first_sequence, offset = (table[c].to_numpy() for c in ("first_rank", "first_sequence", "offset"))
    sent = pieces.sparkSession.sparkContext.broadcast((key, first_rank, first_sequence, offset))  # bounded by the capacity
    schema = T.StructType([*ranked.schema.fields[:-2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = sent.value
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(keys, np.asarray(batch.column(batch.num_columns - 2)) * (1 << 44) + rank, side="right") - 1
            found = [pa.array(sequences[slot] + rank - ranks[slot], pa.int64()), pa.array(offsets[slot], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=schema.names)

    placeless = rows.filter("_length IS NULL").select("_row.*", *(F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset")))
    return ranked.mapInArrow(place, schema).unionByName(placeless)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, text: str = "text", capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """Tokenise, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = tokenize(docs, tokenizer_path, text=text, max_tokens=capacity, end_id=end_id)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digest, capacity=capacity)


def check_layout(rows: list[tuple[int, int, int]], capacity: int) -> None:
    """Raise unless the (sequence, offset, length) rows fill every sequence gapless from 0."""
    for sequence, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        end = 0
        for _, offset, length in group:
            if offset != end:
                raise ValueError(f"sequence {sequence}: gap or overlap at {end}")
            end += length
        if end > capacity:
            raise ValueError(f"sequence {sequence}: {end} tokens")
