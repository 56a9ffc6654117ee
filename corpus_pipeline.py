"""Corpus pipeline: quality rules, near-duplicates, repeated passages, pseudonyms, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import minhash, packing, pii, quality, substring
from quillgraph.llm.common import materialize
from quillgraph.llm.queries import DEMO_KEY


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like``, with ``n_chars`` of the changed text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as all of fewer than 20 words do; equal texts are
    judged alike and repeated rows stay repeated.  Columns of any name pass
    unchanged; an empty table gives an empty result.
    """
    return quality.accept(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each class of near-duplicates.

    Of repeated rows and of rows with one id in a class one stays; null and
    empty texts are one class; a null id stays only where its class has no
    other.  Very long texts are compared whole.  Columns of any name pass
    unchanged; an empty table gives an empty result.
    """
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat earlier ones; documents of which nothing remains go.

    A null text stays null; rows with one id count as one document, and a null
    id comes first.  ``n_chars`` is that of the new text.  Columns of any name
    pass; an empty table gives an empty result.
    """
    kept = substring.remove_repeats(docs)
    return _measured(kept.filter(F.col("text").isNull() | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data and secrets.

    Null and empty texts stay as they are, repeated rows are treated alike,
    and very long texts are read whole.  Columns of any name pass; an empty
    table gives an empty result.
    """
    return _measured(pii.pseudonymise(docs, DEMO_KEY), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a training sequence.

    Null text counts as empty and has the end token alone; longer texts are
    cut; ties and repeated rows get places of their own; an empty table gives
    an empty result.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Signatures, keyed permutations and byte-pair merges have no SQL form; the
#: stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
