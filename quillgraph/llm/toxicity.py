"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, and
digits or signs that stand for letters.  Entries are whole words or word
beginnings; a match inside an exception phrase doesn't count.  The weights,
and how the weight of a text relates to its length, are learned from labelled
rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sample_by_hash, text_or_empty

#: At most so many labelled rows are used for fitting (those with the smallest hashes of their ids).
MAX_LABELLED = 60_000
MIN_TOXIC, MIN_LOG_ODDS = 3, 3.0
PREFIXES = (4, 5, 6)
#: An entry in so many different toxic texts is taken even if others explain them.
SURE = 12
ROWS_PER_BATCH = 1024

# Look-alikes, and digits in the place of letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}
#: Phrases in which an entry is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "loser pays", "scum line", "pond scum", "soap scum", "idiot proof", "idiot light")

_FULLWIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_TABLE = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | {k: (v.lower() if not v.isdigit() else DIGITS.get(v, v)) for k, v in _FULLWIDTH.items()}
_SIGN = re.compile(r"[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes and substitutions undone; length may change."""
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return text


def entries_of(text: str) -> set[str]:
    """Entries a folded text could teach: words, and beginnings of words written ``begin*``."""
    words = set(_WORD.findall(text))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    """Entries with weights, and the logistic curve over (weight, weight per length)."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    exceptions: Sequence[str] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            table: dict[str, tuple] = {}
            for entry, weight in self.weights.items():
                stem = entry.rstrip("*")
                whole, begin = table.get(stem, (None, None, False))[:2]
                table[stem] = (whole, weight, False) if entry.endswith("*") else (weight, begin, False)
            for phrase in self.exceptions:
                p = fold(phrase)
                table[p] = (*table.get(p, (None, None))[:2], True)
            a = ahocorasick.Automaton()
            for stem, kinds in table.items():
                a.add_word(stem, (stem, *kinds))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> Counter[str]:
        """Entries found in a folded text; of several at one place the heaviest."""
        automaton = self.automaton()
        if not len(automaton):
            return Counter()
        best: dict[int, tuple[float, str]] = {}
        excused: list[tuple[int, int]] = []
        for end, (stem, whole, begin, exception) in automaton.iter(text):
            start = end - len(stem) + 1
            if start and text[start - 1].isalpha():
                continue
            ends = end + 1 == len(text) or not text[end + 1].isalpha()
            if exception and ends:
                excused.append((start, end))
            if whole is not None and ends and whole >= best.get(start, (-1.0, ""))[0]:
                best[start] = (whole, stem)
            if begin is not None and not ends and begin >= best.get(start, (-1.0, ""))[0]:
                best[start] = (begin, stem + "*")
        return Counter(e for start, (_, e) in best.items() if not any(a <= start <= b for a, b in excused))

    def weight(self, hits: Counter[str]) -> float:
        return sum(self.weights[e] * n for e, n in hits.items())

    def score(self, weight: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_features(weight, length) @ np.array(self.curve), -30, 30)))


def curve_features(weight: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Constant, log weight, log weight per thousand characters."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / (length + 100))], axis=1)


def labelled_sample(labels: DataFrame, *, key: str, label: str, limit: int) -> DataFrame:
    """``_key, _label`` of at most ``limit`` rows with both values; of repeated keys the largest label."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    return sample_by_hash(one, "_key", limit)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS_PER_BATCH):
            batch = whole.slice(first, ROWS_PER_BATCH)
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[1 if label else 0].update(entries_of(fold(text)))
            entries = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array([counts[1][e] for e in entries], pa.int64()), pa.array([counts[0][e] for e in entries], pa.int64())], names=["entry", "toxic", "clean"])


def select_entries(candidates: list[tuple[str, float]], found: list[tuple[int, str]], sure: int = SURE) -> dict[str, float]:
    """Entries that explain toxic texts which no more common entry explains, and those seen in many texts.

    ``found``: sketches of toxic rows, which near copies mostly share, and the
    candidates in them.  An entry counts once for each sketch, so the other
    words of a much copied toxic text don't look common.
    """
    sketches: dict[str, set[int]] = {}
    for sketch, entry in found:
        sketches.setdefault(entry, set()).add(sketch)
    explained: set[int] = set()
    chosen: dict[str, float] = {}
    for entry, weight in sorted(candidates, key=lambda c: (-len(sketches.get(c[0], ())), -c[1], c[0])):
        seen = sketches.get(entry, set())
        if len(seen) >= sure or seen - explained:
            chosen[entry] = weight
            explained |= seen
    return chosen


def fit_curve(weight: np.ndarray, length: np.ndarray, label: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = curve_features(weight, length)
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-3, ridge, ridge]) * max(1.0, math.sqrt(len(label)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (label - p) - penalty @ beta
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Learn entries, weights and the curve from at most ``limit`` labelled rows.

    The sample is broadcast (``limit`` rows of an id and a label).  Entry
    counts are summed on the executors.  What reaches the driver is bounded by
    the sample: candidate entries, the distinct (sketch, entry) pairs of its
    toxic rows, and three numbers for each row.  Null and repeated keys of the
    labels are one or none; a key that several documents have labels them all.
    Without toxic labels the lexicon is empty and every text gets the same low
    score.
    """
    sample = materialize(labelled_sample(labels, key=key, label=label, limit=limit), "labelled")
    rows = docs.select(text_or_empty(text).alias("_text"), F.col(key).alias("_key")).join(F.broadcast(sample), "_key").select("_text", "_label")
    totals = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sum(n for v, n in totals.items() if v > 0), sum(n for v, n in totals.items() if v <= 0)
    if not n_toxic:
        return Lexicon({}, (math.log(0.5 / (n_clean + 1)), 0.0, 0.0), exceptions)
    rows = materialize(rows, "labelled-texts")
    counts = rows.mapInArrow(_counted, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = min(MIN_TOXIC, max(1, n_toxic // 20))
    ranked = counts.filter((F.col("toxic") >= least) & (F.col("clean") * 20 <= F.col("toxic"))).withColumn("weight", odds).filter(F.col("weight") >= MIN_LOG_ODDS)
    candidates = [(r["entry"], float(r["weight"])) for r in ranked.select("entry", "weight").collect()]
    found = rows.filter("_label > 0").select("_text").mapInArrow(_sketcher({e for e, _ in candidates}), "sketch long, entry string").distinct()
    lexicon = Lexicon(select_entries(candidates, [(r["sketch"], r["entry"]) for r in found.collect()]), exceptions=exceptions)
    final = rows.mapInArrow(_weigher(lexicon), "weight double, length long, label int").collect()  # at most `limit` rows
    weight, length, label_ = (np.array([r[k] for r in final], dtype=float) for k in range(3))
    lexicon.curve = fit_curve(weight, length, (label_ > 0).astype(float))
    lexicon._automaton = None
    return lexicon


def _sketcher(candidates: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, entries = [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text)
                known = entries_of(folded) & candidates
                sketches += [min(zlib.crc32(w.encode()) for w in _WORD.findall(folded))] * len(known) if known else []
                entries += sorted(known)
            yield pa.RecordBatch.from_arrays([pa.array(sketches, pa.int64()), pa.array(entries, pa.string())], names=["sketch", "entry"])

    return run


def _weigher(lexicon: Lexicon):
    lexicon._automaton = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            weights = [lexicon.weight(lexicon.hits(fold(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), batch.column(1).cast(pa.int32())], names=["weight", "length", "label"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns, ``n_hits`` long and the score (0 to 1) of every whole text.

    Null counts as empty, equal texts score alike, repeated rows stay
    repeated, other columns are not read, and an empty table gives an empty
    result.
    """
    source = docs.select(*keep, text_or_empty(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_hits", T.LongType()), T.StructField(name, T.DoubleType())])
    lexicon._automaton = None  # built once on each worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                hits = [lexicon.hits(fold(t)) for t in texts]
                value = lexicon.score(np.array([lexicon.weight(h) for h in hits]), np.array([len(t) for t in texts], dtype=float))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sum(h.values()) for h in hits], pa.int64()), pa.array(value, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)
