"""Substring deduplication by sliding spans of sentences.

A text is a sequence of sentences, cut further by winnowing: in every window
of eight words without the end of a sentence the word with the smallest hash
ends a part.  A cut depends on at most seven words on either side, so it falls
alike wherever the words stand, and any 50 words that two texts share have at
least 21 words between two common cuts.  For every part the shortest run of
several consecutive parts that starts there and has at least ``min_words``
words is hashed.  The hashes meet over all documents, and a part goes where
any run that covers it repeats an earlier one: earlier in the same document,
or in a document with a smaller ``doc_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: A run has at least so many parts and words.
MIN_SENTENCES = 2
MIN_WORDS = 15
#: In so many consecutive words there is a cut.
WINDOW = 8
ROWS_PER_BATCH = 1024
#: Stands for a null key, which comes before all others.
NULL_KEY = -(1 << 63)

_END = re.compile(r"[.!?]+\s+|\n+")
_WORD = re.compile(r"\S+")
# Odd constants of two polynomial hashes modulo 2^64, and their inverses.
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASE)


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the parts of sentences; together they are the whole text."""
    import xxhash

    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in words], dtype=np.int64)
    stops = np.array([m.end() for m in _END.finditer(text)], dtype=np.int64)
    bounds = stops
    if len(words) >= WINDOW:
        hashes = np.array([xxhash.xxh32_intdigest(text[a:b]) for a, b in words], dtype=np.int64)
        before = np.searchsorted(starts, stops)
        hashes[before[before > 0] - 1] = -1  # the end of a sentence comes first
        windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)
        chosen = np.unique(len(words) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))  # the last of equal ones
        chosen = chosen[(hashes[chosen] >= 0) & (chosen < len(words) - 1)]
        bounds = np.union1d(stops, np.array([b for _, b in words], dtype=np.int64)[chosen])
    bounds = np.unique(np.concatenate([[0], bounds, [len(text)]]))
    count = np.diff(np.searchsorted(starts, bounds))
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), count.tolist(), strict=True))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(texts: list[str], min_words: int, min_sentences: int) -> tuple[np.ndarray, ...]:
    """Of every text's runs: index of the text, first sentence, hash, second hash with the number of sentences."""
    import xxhash

    count, words, high, low = [], [], [], []
    for text in texts:
        found = sentences(text)
        count.append(len(found))
        for start, end, n in found:
            digest = xxhash.xxh3_128_intdigest(" ".join(text[start:end].split()))
            high.append(digest >> 64)
            low.append(digest & 0xFFFFFFFFFFFFFFFF)
            words.append(n)
    total = len(words)
    last = np.repeat(np.cumsum(count), count)  # end of the sentence's text, in all sentences
    owner = np.repeat(np.arange(len(texts)), count)
    first_of = last - np.repeat(np.array(count, dtype=np.int64), count)
    cumulated = np.concatenate([[0], np.cumsum(np.array(words, dtype=np.int64))])
    i = np.arange(total)
    end = np.maximum(np.searchsorted(cumulated, cumulated[:-1] + min_words), i + min_sentences)
    ok = end <= last
    i, end = i[ok], end[ok]
    hashes = []
    for values, base, inverse in zip((high, low), _BASE, _INVERSE, strict=True):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(values, dtype=np.uint64) * _powers(base, total), dtype=np.uint64)])
        hashes.append((sums[end] - sums[i]) * _powers(inverse, total)[i])
    size = np.minimum(end - i, 32767)
    second = (hashes[1] >> np.uint64(16) << np.uint64(15)) | size.astype(np.uint64)
    return owner[ok], (i - first_of[ok]), hashes[0].view(np.int64), second.view(np.int64), end - i


def spans(docs: DataFrame, *, text: str, key: str, min_words: int, min_sentences: int) -> DataFrame:
    """``_key, _text_hash, _place, _hash, _hash2``: all runs.

    ``_place`` is the first part times 2^32, plus twice the number of parts,
    plus one if the run is known to repeat: it was seen before in the same
    text, or among the texts worked on together in one with a smaller key.  So
    of a run that many documents share only one row for each thousand texts
    has to meet the others.
    """
    schema = "_key long, _text_hash long, _place long, _hash long, _hash2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                owner, at, h, h2, size = runs(batch.column(2).to_pylist(), min_words, min_sentences)
                order = np.lexsort((at, h2, h, owner))
                same = np.zeros(len(order), dtype=bool)
                if len(order) > 1:
                    a, b = order[1:], order[:-1]
                    same[a] = (owner[a] == owner[b]) & (h[a] == h[b]) & (h2[a] == h2[b])
                low = np.asarray(batch.column(0).fill_null(NULL_KEY)).astype(np.int64)[owner]
                order = np.lexsort((low, h2, h))
                if len(order):
                    a, b = order[1:], order[:-1]
                    begins = np.append(0, np.flatnonzero((h[a] != h[b]) | (h2[a] != h2[b])) + 1)
                    least = np.repeat(low[order[begins]], np.diff(np.append(begins, len(order))))
                    same[order] |= low[order] > least
                rows = pa.array(owner, pa.int64())
                place = (at.astype(np.int64) << 32) | (size.astype(np.int64) << 1) | same
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place, pa.int64()), pa.array(h), pa.array(h2)],
                    names=["_key", "_text_hash", "_place", "_hash", "_hash2"],
                )

    return docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text_or_empty(text)).alias("_text_hash"), text_or_empty(text).alias("_text")).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """Runs that repeat an earlier one: ``_key, _text_hash, _at, _size``.

    The first place of a run is the first one in the document with the
    smallest key.  The runs are dealt out once, by their hashes; those that are
    known to repeat need not meet the others and are spread by their keys, so
    a run that a third of all documents share does not gather in one task.
    """
    from pyspark.sql import Window

    found = spans(docs, text=text, key=key, min_words=min_words, min_sentences=min_sentences)
    low = F.coalesce("_key", F.lit(NULL_KEY))
    known = F.col("_place") % 2 == 1
    first = F.min(low).over(Window.partitionBy("_hash", "_hash2", F.when(known, F.col("_key"))))
    again = found.withColumn("_first", first).filter((low > F.col("_first")) | (F.col("_place") % 2 == 1))
    at = F.shiftright("_place", 32).cast("int").alias("_at")
    return again.select("_key", "_text_hash", at, F.shiftright(F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int").alias("_size"))


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """``docs`` with the repeated sentences removed from ``text``; all columns and rows stay.

    A text without repeats is unchanged; one that consists of repeats becomes
    empty; null stays null.  Rows with one key count as one document: what
    only they share stays in each of them, as do exact repeats of a row.  A
    null key comes before all others.  Columns of any name pass unchanged.  An
    empty table gives an empty result.
    """
    covers = (
        repeated_spans(docs, text=text, key=key, min_words=min_words, min_sentences=min_sentences)
        .groupBy("_key", "_text_hash")  # bounded by the sentences of one text
        .agg(F.collect_set(F.struct("_at", "_size")).alias("_covers"))
        .withColumnsRenamed({"_key": "_cover_key", "_text_hash": "_cover_hash"})
    )
    marked = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(key).cast("long").alias("_key"), F.xxhash64(text_or_empty(text)).alias("_text_hash"))
    joined = marked.join(covers, F.col("_key").eqNullSafe(F.col("_cover_key")) & (F.col("_text_hash") == F.col("_cover_hash")), "left")
    joined = joined.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns), F.col("_covers").alias(_free("_covers", docs.columns)))
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, covered in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if covered and texts[i] is not None:
                    texts[i] = cut(texts[i], [(c["_at"], c["_size"]) for c in covered])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, T.StructType(schema.fields))


def cut(text: str, covered: list[tuple[int, int]]) -> str:
    """The text without the sentences in the (first, number) ranges."""
    found = sentences(text)
    gone = np.zeros(len(found) + 1, dtype=np.int64)
    for first, size in covered:
        gone[first] += 1
        gone[min(first + size, len(found))] -= 1
    gone = np.cumsum(gone)
    return "".join(text[start:end] for (start, end, _), g in zip(found, gone.tolist(), strict=False) if not g)
