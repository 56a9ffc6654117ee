"""Periodic runs of words by an all-lag scan.

A run is a stretch of consecutive words with a smallest period q (words q
apart are identical), at least ``max(min_length, min_exp * q)`` words long,
that no neighbouring word extends.  The array of word ids of a text is compared
with itself at every shift up to n / ``min_exp``; a true stretch of at least
``max(min_length, min_exp * q) - q`` comparisons is a run of period q.  The
same words also match at the multiples of q, with the same first and last word
(Fine and Wilf), so of each (first, last) the smallest shift counts.

Spark deals out (document, range of shifts) pairs.  A text of up to
``LAGS * min_exp`` words is one such pair and is finished where it is read;
a longer one is read by as many tasks as it has ranges, and their stretches
meet by document, first and last word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, materialize, text_or_empty

MIN_LENGTH = 12
MIN_EXP = 2
#: Shifts in one range.
LAGS = 4096
#: Bytes of text for one word, for the number of ranges alone.
BYTES_A_WORD = 6
BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
#: Changes the words of a document (key, words) before the scan.
Edit = Callable[[object, list[str]], list[str]]


def word_ids(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one text after the other, and where each text begins; texts share no id."""
    ids, begins, used = [], [0], 0
    for words in texts:
        known: dict[str, int] = {}
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words)) + used)
        used += len(known)
        begins.append(begins[-1] + len(words))
    return (np.concatenate(ids) if ids else np.empty(0, np.int32)), np.array(begins, dtype=np.int64)


def long_stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the true stretches of at least ``least`` entries.

    Such a stretch covers an entry at a multiple of ``least`` and, to one side
    of it, (least - 1) / 2 further ones; the whole array is run-length encoded
    only where entries pass that test.
    """
    at = np.flatnonzero(equal[least - 1 :: least]) * least + least - 1
    half = (least - 1) // 2
    if half and len(at):
        n, right, left = len(equal), np.ones(len(at), bool), np.ones(len(at), bool)
        for step in sorted({1, (half + 3) // 4, (half + 1) // 2, half}):
            right &= equal[np.minimum(at + step, n - 1)] & (at + step < n)
            left &= equal[at - step]
        at = at[right | left]
    if not len(at):
        return at, at
    true = np.flatnonzero(equal)
    breaks = np.flatnonzero(np.diff(true) != 1)
    first = true[np.concatenate([[0], breaks + 1])]
    length = true[np.concatenate([breaks, [len(true) - 1]])] - first + 1
    ok = length >= least
    return first[ok], length[ok]


def scan(texts: list[list[str]], low: np.ndarray, high: np.ndarray, min_length: int, min_exp: int) -> tuple[np.ndarray, ...]:
    """Runs found at shifts ``low`` to ``high`` of each text: index of the text, start, length, period.

    The texts are laid behind each other, longest first, so that at every
    shift one comparison serves all texts long enough for it.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    ids, begins = word_ids([texts[i] for i in order])
    sizes, low, high = sizes[order], low[order], high[order]
    high = np.where(sizes < min_length, 0, np.minimum(high, sizes // min_exp))
    found = []
    for lag in range(int(low.min(initial=1)), int(high.max(initial=0)) + 1):
        reach = int(np.searchsorted(-sizes, -max(min_length, min_exp * lag), side="right"))
        end = begins[reach]
        if end <= lag:
            continue
        start, length = long_stretches(ids[lag:end] == ids[: end - lag], max(min_length - lag, (min_exp - 1) * lag, 1))
        if len(start):
            owner = np.searchsorted(begins, start, side="right") - 1
            ok = (low[owner] <= lag) & (lag <= high[owner])
            found.append((owner[ok], (start - begins[owner])[ok], (length + lag)[ok], np.full(int(ok.sum()), lag)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    owner, start, length, period = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    _, first = np.unique(np.stack([owner, start, length]), axis=1, return_index=True)  # shifts ascend: the first is the smallest
    return order[owner[first]], start[first], length[first], period[first]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that any run (start, length, period) holds after its first period, joined by a space."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return " ".join([words[i] for i in kept.tolist()])


def _words(key: object, text: str, edit: Edit | None) -> list[str]:
    words = WORD.findall(text)
    return edit(key, words) if edit else words


def periodic_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_exp: int = MIN_EXP, lags: int = LAGS, edit: Edit | None = None) -> DataFrame:
    """``key, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs`` is an array of (start, length, period) by start, then period;
    ``collapsed`` the words without the repeats of any run, joined by a space.
    Null and empty texts have no words and no runs; null keys and repeated
    rows or keys are rows of their own; other columns, whatever their names,
    are not read; an empty table gives an empty result.  Very long texts are
    compared whole, by several tasks.
    """
    ranges = F.ceil(F.octet_length("_text") / F.lit(BYTES_A_WORD * min_exp * lags)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("_ranges", F.greatest(ranges, F.lit(1)))
    key_type = docs.schema[key].dataType
    result = T.StructType([T.StructField("_key", key_type), T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])

    def finished(keys: pa.Array, texts: list[list[str]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                pa.array([collapse(t, r) for t, r in zip(texts, runs, strict=True)], pa.string()),
            ],
            names=result.names,
        )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in batches:
            for batch in by_size(read, (1,), BATCH_ROWS, BATCH_BYTES):
                texts = [_words(k, t, edit) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                every = np.full(len(texts), np.iinfo(np.int64).max)
                for owner, *run in zip(*(c.tolist() for c in scan(texts, np.ones(len(texts), np.int64), every, min_length, min_exp)), strict=True):
                    runs[owner].append(tuple(run))
                yield finished(batch.column(0), texts, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in batches:
            for batch in by_size(read, (1,), BATCH_ROWS, BATCH_BYTES):
                keys, texts, n, row, at = (batch.column(i).to_pylist() for i in range(5))
                words = [_words(k, t, edit) for k, t in zip(keys, texts, strict=True)]
                low = np.array([r * lags + 1 for r in at], dtype=np.int64)
                high = np.array([np.iinfo(np.int64).max if r + 1 == of else (r + 1) * lags for r, of in zip(at, n, strict=True)], dtype=np.int64)
                owner, *run = scan(words, low, high, min_length, min_exp)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row, dtype=np.int64)[owner]), *(pa.array(c) for c in run)], names=["_row", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [_words(k, t, edit) for k, t in zip(keys, batch.column(1).to_pylist(), strict=True)]
            runs = [sorted(((r["start"], r["length"], r["period"]) for r in of or ()), key=lambda x: (x[0], x[2])) for of in batch.column(2).to_pylist()]
            yield finished(batch.column(0), texts, runs)

    short = rows.filter("_ranges = 1").select("_key", "_text").mapInArrow(whole, result)
    # The rows of longer texts, numbered once, before their ranges are dealt out.
    long = materialize(rows.filter("_ranges > 1").withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    dealt = long.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ranges") - 1))).repartition("_row", "_range")
    stretches = dealt.mapInArrow(part, "_row long, start long, length long, period long")
    smallest = stretches.groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    of_row = smallest.groupBy("_row").agg(F.collect_list(F.struct("start", "length", "period")).alias("_runs"))  # fewer than the words of one text
    rest = long.join(of_row, "_row", "left").select("_key", "_text", "_runs").mapInArrow(joined, result)
    return short.unionByName(rest).withColumnRenamed("_key", key)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the greatest one and digests of all runs and of the collapsed text, for the rows of ``periodic_runs``."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast(RUN.elementType),
        lambda a, r: F.when(a.isNull() | (r.getField("length") > a.getField("length")), r).otherwise(a),  # by start: the first of equal ones
    )
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.getField("start").cast("string"), r.getField("length").cast("string"), r.getField("period").cast("string")), F.lit("\n"))))
    named = found.withColumn("_best", best)
    return named.select(
        *(c for c in found.columns if c not in ("runs", "collapsed", "n_words")),
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best").getField(c).alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("_best").getField("length") * 1000 / F.col("_best").getField("period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def loop_tail(key: object, words: list[str]) -> list[str]:
    """Deterministic loops for one document in ten: from word a on the first p of the remaining words repeat."""
    import zlib

    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
