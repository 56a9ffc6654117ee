"""Byte-level BPE encoding with overlapping chunks, and decoding to raw bytes.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised on
its own; two neighbouring chunks are stitched at the first pre-token boundary
that both find in their overlap.  The pattern looks only forward, so two scans
that share a boundary agree from there on, and the first chunk starts where
the text starts.  The pieces between stitches are then encoded in parallel and
their ids concatenated.  Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
ROWS_PER_BATCH = 256


def load_ranks(ranks_path: str) -> dict[bytes, int]:
    """The table of a ``.tiktoken`` file; it lies in an installed package on every executor."""
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens in a chunk that are certain whatever follows, and follow a non-space.

    A match that touches the end of the chunk could go on behind it.  After a
    non-space a piece can end without the look-ahead for white space ever
    seeing the cut.
    """
    import regex

    return [m.end() for m in regex.finditer(pattern, text) if m.end() < len(text) - 2 and not text[m.end() - 1].isspace()]


def _encode_rows(frame: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``ids`` array<int> for the last column, which is dropped."""
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                ids = [encoding.encode_to_numpy(v.as_py(), disallowed_special=()) for v in batch.column(batch.num_columns - 1)]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=schema.names)

    return frame.mapInArrow(run, schema)


def stitch(chunks: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Per long text the positions at which it may be cut: ``_row, _cuts`` array<int>.

    ``chunks``: ``_row``, ``_chunk``, ``_text`` (the chunk with its overlap).
    Where an overlap has no common boundary, that stitch and all later ones of
    the text are left out: its rest stays one piece.
    """
    schema = "_row long, _chunk int, _head array<int>, _tail array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for chunk, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = boundaries(value, pattern)
                heads.append([chunk * chunk_chars + p for p in found if p < overlap_chars])
                tails.append([chunk * chunk_chars + p for p in found if p >= chunk_chars])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, ints), pa.array(tails, ints)], names=["_row", "_chunk", "_head", "_tail"])

    ends = chunks.select("_row", "_chunk", "_text").mapInArrow(scan, schema)
    by_row = Window.partitionBy("_row").orderBy("_chunk")  # the chunks of one text
    joined = ends.select("_row", "_chunk", F.array_min(F.array_intersect("_tail", F.lead("_head").over(by_row))).alias("_cut"), F.lead("_chunk").over(by_row).alias("_next"))
    inner = joined.filter(F.col("_next").isNotNull())
    missing = F.min(F.when(F.col("_cut").isNull(), F.col("_chunk")))
    return (
        inner.groupBy("_row")
        .agg(missing.alias("_missing"), F.collect_list(F.struct("_chunk", "_cut")).alias("_all"))
        .select("_row", F.expr("transform(filter(array_sort(_all), x -> _missing IS NULL OR x._chunk < _missing), x -> x._cut)").alias("_cuts"))
    )


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str | None = None,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``keep`` columns and ``ids`` array<int> of every whole text.

    The ids are those of encoding each match of the pattern separately by the
    ranks; strings of special tokens are ordinary text.  Null text counts as
    empty and has no ids; repeated rows, null ids and other columns pass.
    """
    if not 8 <= overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    source = docs.select(*keep, text_or_empty(text).alias("_text"))
    is_long = F.length("_text") > chunk_chars + overlap_chars
    short = _encode_rows(source.filter(~is_long), ranks_path, pattern)
    # Rows get a key of their own, so repeated or null ids do no harm.
    long = materialize(source.filter(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    chunks = long.select("_row", "_text", F.explode(F.expr(f"sequence(0, cast((length(_text) - {overlap_chars} - 1) div {chunk_chars} as int))")).alias("_chunk"))
    chunks = chunks.select("_row", "_chunk", F.expr(f"substring(_text, _chunk * {chunk_chars} + 1, {chunk_chars + overlap_chars})").alias("_text")).repartition("_row", "_chunk")
    cuts = stitch(chunks, pattern, chunk_chars, overlap_chars)
    pieces = (
        long.join(cuts, "_row", "left")
        .withColumn("_edges", F.expr("concat(array(0), coalesce(_cuts, cast(array() as array<int>)), array(length(_text)))"))
        .select(*keep, "_row", "_text", F.col("_edges"), F.expr("posexplode(slice(_edges, 1, size(_edges) - 1))").alias("_piece", "_from"))
        .select("_row", "_piece", F.expr("substring(_text, _from + 1, _edges[_piece + 1] - _from)").alias("_text"))
        .repartition("_row", "_piece")
    )
    joined = (
        _encode_rows(pieces, ranks_path, pattern)
        .groupBy("_row")  # the pieces of one text
        .agg(F.expr("flatten(transform(array_sort(collect_list(struct(_piece, ids))), x -> x.ids))").alias("ids"))
        .join(long.select("_row", *keep), "_row")
    )
    return short.unionByName(joined.select(*keep, "ids"))


def decode(encoded: DataFrame, ranks_path: str, *, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` binary: the bytes of the ids in their order; null ids give null."""
    schema = T.StructType([*(f for f in encoded.schema.fields if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        token = [b""] * (max(ranks.values()) + 1)
        for value, rank in ranks.items():
            token[rank] = value
        get = token.__getitem__
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(first, ROWS_PER_BATCH)
                out = [None if v is None else b"".join(map(get, v)) for v in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
