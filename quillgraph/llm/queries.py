"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, merkle, minhash, packing, periodic, pii, pu_quality, quality, simhash, substring, suffix, toxicity
from .common import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op3_quality_rules"] = quality.oracle_sql()


@_query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


#: Key of the registered queries; production passes a secret of its own.
DEMO_KEY = "pseudonym-key-1"


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, DEMO_KEY, count="n_values")


@_query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text("f").alias("fingerprint"), simhash.as_text("e").alias("edited_fingerprint"), "near_edited", "near_next"
    )


#: Bits in which a fingerprint of the search may differ.
SEARCH_RADIUS = 6


@_query
def fingerprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second half of op7: the texts of ids divisible by 50 against all fingerprints, through the block tables.

    One row for each query and class of equal fingerprints within the radius;
    a class is named by its smallest id.
    """
    docs = table(spark, sf_dir, "documents")
    prints = materialize(simhash.text_fingerprints(docs), "index")
    return simhash.within_radius(prints.filter("doc_id % 50 = 0"), prints, radius=SEARCH_RADIUS, agree=1).withColumnRenamed("query", "doc_id").withColumnRenamed("class", "class_id")


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    lexicon = toxicity.fit(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = pu_quality.classify(docs, labels.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "class_id")


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    upper, lower = (b"".join(bytes([a + i]) for i in range(26)).decode() for a in b"Aa")
    changed = [F.translate("text", upper, lower) if c == "text" else F.col(c) for c in fields]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*changed))
    proofs, _ = merkle.manifest(table(spark, sf_dir, "documents"), fields=fields, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    shown = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


@_query
def op12_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.getField("stop") - s.getField("start"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), edit=periodic.loop_tail)
    return periodic.digests(found)


ORACLES["op11_merkle"] = merkle.oracle_sql()
ORACLES["op12_suffix"] = suffix.oracle_sql()
