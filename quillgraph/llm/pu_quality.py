"""Quality classifier learned from positive and unlabelled texts.

Features are hashed words and word pairs, and whole-text measures.  The terms
enter as one number, the mean of their log-odds: how often a bucket of terms
stands in trusted positives against all documents.  Number and measures are
binned, and a linear model over the bins minimises the non-negative unbiased
risk: the risk of the trusted positives, weighted by the class prior, and the
risk of the unlabelled web text as negatives less what its positives add to
it, which may not fall below zero.

Only the labels are bounded, by :data:`MAX_TRUSTED`: term counts, the class
prior and the risk cover every document.  The fit needs only how many documents fall into each combination of
bins, at most ``product of the bins`` rows whatever the size of the corpus.
In the fit, the log-odds that a trusted text meets leave out what it has taught
itself, so its feature is like that of an unlabelled text.  Scores come from
the plain table for every text, whatever its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, materialize, sample_by_hash, text_or_empty
from .quality import STATS, word_stats

#: At most so many trusted positives are used, those with the smallest hashes of their keys; their keys are broadcast.
MAX_TRUSTED = 100_000
RIDGE, STEPS, RATE = 1e-4, 400, 0.05
#: Buckets of hashed terms, and the tables of their counts that reach the driver.
BUCKETS = 1 << 16
#: The log-odds are drawn to 0 as if so many average documents were among the positives, and by so many occurrences.
DOCUMENTS_PRIOR, OCCURRENCES_PRIOR = 20.0, 20.0
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 1 << 22

#: Measure, SQL over the counts of :func:`quality.word_stats` (n words, c characters in them, l lines, each 1 at
#: least) and the mean log-odds ``_terms``, inner edges of its bins.
MEASURES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("terms", "_terms", (-1.5, -1.0, -0.6, -0.35, -0.2, -0.1, 0.0, 0.1, 0.2, 0.4)),
    ("symbols", "n_symbols / _n", (0.05, 0.25)),
    ("capitals", "n_upper / _c", (0.1, 0.35)),
    ("exclaims", "n_exclaim / _n", (0.05, 0.4)),
    ("pipes", "n_pipes / _n", (0.03, 0.15)),
    ("plain", "n_plain / _n", (0.6, 0.85)),
    ("variety", "n_distinct * n_distinct / _n", (6.0, 15.0)),
    ("repeats", "n_repeat_words / _n", (0.05, 0.3)),
    ("dup_lines", "n_dup_lines / _l", (0.1, 0.4)),
    ("word_length", "word_chars / _n", (3.0, 7.5, 12.0)),
    ("words", "ln(1 + n_words)", (2.2, 3.0, 4.0)),
)
NAMES = tuple(name for name, _, _ in MEASURES)
WIDTH = 1 + sum(len(edges) + 1 for _, _, edges in MEASURES)


# ----------------------------------------------------------------------- terms


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and bucket of every word and every pair of adjacent words, lower case."""
    import xxhash

    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    counts = np.diff(np.asarray(words.offsets))
    encoded = words.flatten().dictionary_encode()
    spelled = encoded.dictionary.to_pylist()
    table = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in spelled] or [0], dtype=np.uint64)
    hashed = table[np.asarray(encoded.indices)] if len(encoded) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    real = hashed != 0
    pair = real[1:] & real[:-1] & (owner[1:] == owner[:-1])
    both = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[1:])[pair]
    bucket = np.concatenate([hashed[real], both * np.uint64(0xC2B2AE3D27D4EB4F)]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate([owner[real], owner[:-1][pair]]), bucket.astype(np.int64)


def term_counts(texts: DataFrame) -> DataFrame:
    """``bucket, share, positive, often`` over all rows of ``_text, _trusted``.

    A text adds the shares of its terms, so long ones don't drown short ones;
    ``positive`` is the part of the trusted texts, ``often`` the plain number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS))
        for whole in batches:
            for batch in by_size(whole, (0,), ROWS_PER_BATCH, BYTES_PER_BATCH):
                owner, bucket = terms(batch.column(0))
                trusted = np.asarray(batch.column(1)).astype(float)
                share = 1 / np.maximum(np.bincount(owner, minlength=batch.num_rows), 1)[owner]
                for row, weight in enumerate((share, share * trusted[owner], None)):
                    total[row] += np.bincount(bucket, weights=weight, minlength=BUCKETS)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["bucket", "share", "positive", "often"])

    found = texts.mapInArrow(run, "bucket long, share double, positive double, often double")
    return found.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("share", "positive", "often")))


@dataclass(frozen=True)
class TermTable:
    """For each bucket its part of all texts, of the trusted ones, and how much its log-odds count."""

    everywhere: np.ndarray
    positive: np.ndarray
    trust: np.ndarray

    @staticmethod
    def of(counts: list[tuple[int, float, float, float]]) -> TermTable:
        """From rows of :func:`term_counts`; buckets that no text has stay at 0."""
        everywhere, positive, trust = (np.zeros(BUCKETS) for _ in range(3))
        if counts:
            bucket, share, trusted, often = (np.array(c) for c in zip(*sorted(counts), strict=True))
            at = bucket.astype(int)
            everywhere[at], positive[at], trust[at] = share / share.sum(), trusted, often / (often + OCCURRENCES_PRIOR)
        return TermTable(everywhere, positive, trust)

    def means(self, owner: np.ndarray, bucket: np.ndarray, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-odds of each text's terms, 0 for a text without terms: by the whole table, and as the fit takes it.

        For the fit a trusted text's own part is left out of the table.
        """
        n = len(trusted)
        length = np.maximum(np.bincount(owner, minlength=n), 1)
        key, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        who, what = key // BUCKETS, key % BUCKETS

        def mean(at: np.ndarray, own: np.ndarray | float, others: float) -> np.ndarray:
            everywhere = np.maximum(self.everywhere[what[at]], 1e-12)
            odds = np.log((np.maximum(self.positive[what[at]] - own, 0) + DOCUMENTS_PRIOR * everywhere) / (max(others, 0) + DOCUMENTS_PRIOR) / everywhere)
            return np.bincount(who[at], weights=odds * self.trust[what[at]] * times[at], minlength=n) / length

        total, mine = self.positive.sum(), np.flatnonzero(trusted[who])
        plain = mean(np.arange(len(who)), 0.0, total)
        return plain, np.where(trusted, mean(mine, times[mine] / length[who[mine]], total - 1), plain)


# -------------------------------------------------------------------- features


def binned(texts: DataFrame, table: TermTable) -> DataFrame:
    """``_key, _trusted``, the number of its bin for each measure and ``_fit_terms``, of every row of ``_key, _text, _trusted``.

    ``_fit_terms`` is the bin of the terms that the fit takes.
    """
    sent = texts.sparkSession.sparkContext.broadcast(table)  # 3 x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for whole in batches:
            for batch in by_size(whole, (1,), ROWS_PER_BATCH, BYTES_PER_BATCH):
                means = table.means(*terms(batch.column(1)), np.asarray(batch.column(2)).astype(bool))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, means)], names=["_key", "_body", "_trusted", "_terms", "_own_terms"])

    kind = texts.schema["_key"].dataType.simpleString()
    scored = texts.select("_key", "_text", "_trusted").mapInArrow(run, f"_key {kind}, _body string, _trusted boolean, _terms double, _own_terms double")
    least = {"_n": "n_words", "_c": "word_chars", "_l": "n_lines"}
    counts = word_stats(scored, "_body").withColumns({k: F.greatest(F.col(c), F.lit(1).cast("long")) for k, c in least.items()})
    fit_terms = ("_fit_terms", "_own_terms", MEASURES[0][2])
    bins = (sum((F.when(F.expr(sql).cast("double") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int").alias(name) for name, sql, edges in (*MEASURES, fit_terms))
    return counts.select("_key", "_trusted", *bins)


class Indicators:
    """A constant and one indicator for each bin, for rows of bins: the products of that sparse matrix."""

    def __init__(self, bins: np.ndarray):
        offsets = np.cumsum([1, *(len(edges) + 1 for _, _, edges in MEASURES[:-1])])
        self.columns = np.ascontiguousarray((bins + offsets).T)

    def times(self, w: np.ndarray) -> np.ndarray:
        """One number for each row."""
        return w[0] + sum(w[c] for c in self.columns)

    def summed(self, v: np.ndarray) -> np.ndarray:
        """One number for each indicator: the sum of ``v`` over its rows."""
        out = sum(np.bincount(c, weights=v, minlength=WIDTH) for c in self.columns)
        out[0] = v.sum()
        return out


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def score(self) -> Column:
        """Probability of class 1 from the bins, as one SQL expression."""
        total, at = F.lit(self.weights[0]), 1
        for name, _, edges in MEASURES:
            own = F.array(*(F.lit(w) for w in self.weights[at : at + len(edges) + 1]))
            total = total + own[F.col(name)]
            at += len(edges) + 1
        return 1 / (1 + F.exp(-total))


# ------------------------------------------------------------------------- fit


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(x: Indicators, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of class 1 among the unlabelled documents.

    ``positive`` and ``unlabelled`` count documents of each row of ``x`` in two
    halves.  On one half a classifier learns to tell positives from unlabelled
    ones; on the other, above a threshold that only class 1 passes, the
    unlabelled share over the positive share is the prior.  The smallest such
    ratio, with allowances for the numbers of documents, is taken.
    """
    p, u = positive[:, 0], unlabelled[:, 0]
    if not (p.sum() and u.sum() and positive[:, 1].sum() and unlabelled[:, 1].sum()):
        return 0.5
    p, u = 0.5 * p / p.sum(), 0.5 * u / u.sum()
    w = _adam(lambda b: x.summed((p + u) * _sigmoid(x.times(b)) - p) + RIDGE * b, WIDTH, STEPS // 2, RATE)
    order = np.argsort(-x.times(w), kind="stable")
    p, u = (np.cumsum(c[order, 1]) / c[:, 1].sum() for c in (positive, unlabelled))
    slack = sum(np.sqrt(np.log(20) / (2 * c[:, 1].sum())) for c in (positive, unlabelled))
    far = p >= 0.2
    best = np.flatnonzero(far)[np.argmin((u[far] + slack) / p[far])]
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def fit_counts(bins: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Non-negative risk minimisation with the logistic loss over combinations of bins.

    ``positive`` and ``unlabelled``: documents of each combination in two
    halves.  Without positives or documents every text scores one half.
    """
    p, u = positive.sum(axis=1), unlabelled.sum(axis=1)
    if not p.sum() or not u.sum():
        return Model((0.0,) * WIDTH, 0.5)
    x = Indicators(bins)
    prior = estimate_prior(x, positive, unlabelled) if prior is None else prior
    p, u = p / p.sum(), u / u.sum()

    def gradient(w: np.ndarray) -> np.ndarray:
        z = x.times(w)
        s, loss = _sigmoid(z), np.logaddexp(0, z)
        as_positive = x.summed(p * (s - 1)) * prior
        as_negative = x.summed((u - prior * p) * s)
        if (u - prior * p) @ loss < 0:  # the correction: step back from over-fitted negatives
            return -as_negative + RIDGE * w
        return as_positive + as_negative + RIDGE * w

    return Model(tuple(float(v) for v in _adam(gradient, WIDTH, STEPS, RATE)), prior)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """``key`` and ``score`` (0 to 1) for every row of ``docs``.

    Learns from the texts of rows with label 1 and from all documents whatever
    their label; other labels are not used.  Null or empty text is scored by
    its measures (all 0), equal texts and repeated rows alike whether labelled
    or not; a null key has no label; of repeated labels of a key one suffices; other columns are not
    read; an empty table gives an empty result.
    """
    trusted = materialize(labels.filter((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_labelled")).distinct(), "trusted")
    trusted = F.broadcast(sample_by_hash(trusted, "_labelled", max_trusted))
    source = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    source = source.join(trusted, F.col("_key") == F.col("_labelled"), "left").select("_key", "_text", F.col("_labelled").isNotNull().alias("_trusted"))
    table = TermTable.of([tuple(r) for r in term_counts(source.select("_text", "_trusted")).collect()])  # at most BUCKETS rows
    measured = materialize(binned(source, table), "bins")
    half = (F.xxhash64("_key") % 2 == 0).cast("int")
    counts = (F.sum(((half == k) & what).cast("long")).alias(f"_{n}{k}") for n, what in (("p", F.col("_trusted")), ("u", F.lit(True))) for k in (0, 1))
    patterns = measured.groupBy("_fit_terms", *NAMES[1:]).agg(*counts).collect()  # bounded by the bins
    found = np.array([tuple(r) for r in patterns], dtype=np.int64).reshape(-1, len(NAMES) + 4)
    found = found[np.lexsort(found[:, : len(NAMES)].T)]
    model = fit_counts(found[:, : len(NAMES)], found[:, -4:-2].astype(float), found[:, -2:].astype(float))
    return measured.select(F.col("_key").alias(key), model.score().alias("score"))
