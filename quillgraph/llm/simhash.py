"""Document fingerprints: SimHash of weighted terms, and search by permuted block tables.

The terms of a text are its adjacent word pairs (the last word stands alone);
a term weighs as much as it occurs.  Each occurrence votes +1 or -1 on every
bit of the fingerprint as its hash says.  The votes of four bits at a time are
counted in one 64-bit number with 16-bit lanes, in parts of at most
:data:`PART` words, so a lane cannot overflow whatever the length of a text.
DataFrame functions only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WORDS64 = 4  # 64-bit numbers in a fingerprint
BITS = 64 * WORDS64
PART = 32_768
_LANES = 0x0001000100010001


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``f0..f3`` long: the fingerprint of the whole text of each row.

    Keys must name a text: rows with equal keys must have equal texts and give
    one row.  A text without words has the fingerprint 0.
    """
    words = texts.select(*keys, F.split(F.btrim(text_or_empty(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+").alias("_word"))
    pairs = words.select(*keys, "_word", F.expr("slice(_word, 2, size(_word))").alias("_then"))
    terms = pairs.select(*keys, F.posexplode(F.arrays_zip("_word", "_then")).alias("_at", "_pair"))  # a word with the next one
    word, then = F.col("_pair._word"), F.coalesce("_pair._then", F.lit(""))
    hashed = terms.select(
        *keys,
        F.floor(F.col("_at") / PART).cast("int").alias("_part"),
        *(F.xxhash64(word, then, F.lit(k)).alias(f"_h{k}") for k in range(WORDS64)),
        (word != "").cast("long").alias("_real"),
    )
    lanes = [
        F.sum(F.when(F.col("_real") == 1, F.shiftrightunsigned(f"_h{k}", j).bitwiseAND(F.lit(_LANES))).otherwise(F.lit(0).cast("long"))).alias(f"_s{k}_{j}")
        for k in range(WORDS64)
        for j in range(16)
    ]
    parts = hashed.groupBy(*keys, "_part").agg(F.sum("_real").alias("_n"), *lanes)
    packed = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.collect_list(F.array(*(f"_s{k}_{j}" for k in range(WORDS64) for j in range(16)))).alias("_parts"))
    return packed.select(*keys, *(_bits(k).alias(f"f{k}") for k in range(WORDS64)))


def _bits(k: int) -> Column:
    """Bit b is set where more than half of the votes, over all parts of the text, are for it."""
    votes = f"aggregate(_parts, 0L, (v, p) -> v + (shiftrightunsigned(p[{16 * k} + b % 16], cast(16 * (b div 16) as int)) & 65535))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * {votes} > _n THEN shiftleft(1L, cast(b as int)) ELSE 0L END)")


def text_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``f0..f3`` of every row: the fingerprint of its text.  Nulls, repeats and empty tables as below."""
    source = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return fingerprints(source, ["_key", "_row"], "_text").select(F.col("_key").alias(key), *(f"f{k}" for k in range(WORDS64)))


def as_text(prefix: str = "f") -> Column:
    """The fingerprint in lowercase hexadecimal."""
    return F.concat(*(F.lpad(F.lower(F.hex(f"{prefix}{k}")), 16, "0") for k in range(WORDS64)))


def distance(a: str, b: str) -> Column:
    """Hamming distance of the fingerprints in columns ``a0..`` and ``b0..``."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, WORDS64)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def likeness(a: str, b: str) -> Column:
    return 1.0 - distance(a, b) / float(BITS)


def successors(rows: DataFrame) -> DataFrame:
    """``rows`` (``_key, _row, _n``) with ``_next``: the successor in ascending order; the last one's is the first.

    The rows are dealt out by ranges; inside a range a window finds the
    successor, and the few first rows of the ranges close the gaps.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("_key", "_row")
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("_next", F.lead("_row").over(Window.partitionBy("_range").orderBy(*order)))
    first = dealt.groupBy("_range").agg(F.min(F.struct(*order)).alias("_first"))
    by_range = Window.orderBy("_range")  # one row for each range
    ends = first.select("_range", F.coalesce(F.lead("_first").over(by_range), F.first("_first").over(by_range))["_row"].alias("_first_of_next"))
    return own.join(ends, "_range").select("_key", "_row", "_n", F.coalesce("_next", "_first_of_next").alias("_next"))


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document in ascending ``key``, the
    first one following the last.  Returns ``key, n_chars, edited_sha256,
    f0.., e0.., near_edited, near_next``, one row for each row of ``docs``.

    Null text counts as empty.  A null key comes first; rows with one key
    follow each other as they were read.  A
    single document is its own successor.  Other columns are not read.  An
    empty table gives an empty result.
    """
    body = text_or_empty(text)
    # Written once, so the numbers of the rows hold.
    source = materialize(docs.select(F.col(key).alias("_key"), body.alias("_text"), F.monotonically_increasing_id().alias("_row")), "texts")
    order = materialize(successors(source.select("_key", "_row", F.length("_text").cast("long").alias("_n"))), "successors")
    needed = order.select(F.col("_row").alias("_for"), F.col("_next").alias("_row"), F.floor(F.col("_n") / 2).cast("int").alias("_need"))
    heads = source.select("_row", "_text").join(needed, "_row").select(F.col("_for").alias("_row"), F.expr("substring(_text, 1, _need)").alias("_head"))
    both = (
        source.select("_row", "_text")
        .join(heads, "_row")
        .select("_row", "_text", F.concat(F.expr("substring(_text, 1, length(_text) - length(_text) div 2)"), F.col("_head")).alias("_edited"))
        .select("_row", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("t")))).alias("_x"))
        .select("_row", F.col("_x.kind").alias("_kind"), F.col("_x.t").alias("_t"), F.when(F.col("_x.kind") == 1, F.unhex(F.sha2("_x.t", 256))).alias("_sha"))
    )
    prints = materialize(fingerprints(both, ["_row", "_kind", "_sha"], "_t"), "fingerprints")
    own = prints.filter("_kind = 0").select("_row", *(F.col(f"f{k}").alias(f"f{k}") for k in range(WORDS64)))
    edited = prints.filter("_kind = 1").select("_row", F.lower(F.hex("_sha")).alias("edited_sha256"), *(F.col(f"f{k}").alias(f"e{k}") for k in range(WORDS64)))
    following = own.select(F.col("_row").alias("_next"), *(F.col(f"f{k}").alias(f"n{k}") for k in range(WORDS64)))
    return (
        order.join(own, "_row")
        .join(edited, "_row")
        .join(following, "_next")
        .select(
            F.col("_key").alias(key),
            F.col("_n").alias("n_chars"),
            "edited_sha256",
            *(f"f{k}" for k in range(WORDS64)),
            *(f"e{k}" for k in range(WORDS64)),
            likeness("f", "e").alias("near_edited"),
            likeness("f", "n").alias("near_next"),
        )
    )


# ------------------------------------------------------------------- search


def block_tables(radius: int, agree: int) -> list[tuple[tuple[int, int], ...]]:
    """The tables: choices of ``agree`` of ``radius + agree`` blocks, as (first bit, bits) ranges.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so
    they agree on all blocks of at least one table.
    """
    n = radius + agree
    if not 0 <= radius or agree < 1 or n > BITS:
        raise ValueError("radius and agree do not fit the fingerprint")
    edges = [b * BITS // n for b in range(n + 1)]
    return [tuple((edges[b], edges[b + 1] - edges[b]) for b in chosen) for chosen in itertools.combinations(range(n), agree)]


def _block(prefix: str, first: int, size: int) -> Column:
    out = []
    while size > 0:
        take = min(size, 64 - first % 64)
        value = F.shiftrightunsigned(f"{prefix}{first // 64}", first % 64)
        out.append(value if take == 64 else value.bitwiseAND(F.lit((1 << take) - 1)))
        first, size = first + take, size - take
    return F.concat_ws(".", *(c.cast("string") for c in out))


def _keyed(frame: DataFrame, tables: list[tuple[tuple[int, int], ...]]) -> DataFrame:
    keys = [F.struct(F.lit(t).alias("t"), F.concat_ws("|", *(_block("f", *b) for b in blocks)).alias("b")) for t, blocks in enumerate(tables)]
    return frame.withColumn("_k", F.explode(F.array(*keys))).withColumn("_t", F.col("_k.t")).withColumn("_b", F.col("_k.b")).drop("_k")


def within_radius(queries: DataFrame, index: DataFrame, *, radius: int, agree: int = 2, key: str = "doc_id") -> DataFrame:
    """All pairs (``query``, ``class``, ``distance``) of a query key and a fingerprint class within the radius.

    Both inputs have ``key`` and ``f0..``.  Equal fingerprints of the index
    form one class, named by its smallest key, so copies are compared once;
    :func:`classes` says which rows are in it.  Exact: the block tables miss
    no pair within the radius.
    """
    columns = [f"f{k}" for k in range(WORDS64)]
    representatives = index.groupBy(*columns).agg(F.min(key).alias("_class"))
    tables = block_tables(radius, agree)
    left = _keyed(queries.select(F.col(key).alias("query"), *columns), tables)
    right = _keyed(representatives, tables).withColumnsRenamed({c: f"g{c[1:]}" for c in columns})
    found = left.join(right.withColumnsRenamed({"_t": "_t2", "_b": "_b2"}), (F.col("_t") == F.col("_t2")) & (F.col("_b") == F.col("_b2")) & (distance("f", "g") <= radius))
    found = found.withColumn("distance", distance("f", "g"))
    return found.select("query", F.col("_class").alias("class"), "distance").distinct()


def classes(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``class``, the smallest key with the same fingerprint."""
    columns = [f"f{k}" for k in range(WORDS64)]
    return index.select(key, *columns).join(index.groupBy(*columns).agg(F.min(key).alias("class")), columns).select(key, "class")
