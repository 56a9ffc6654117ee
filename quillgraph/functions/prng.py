"""Portable keyed pseudo-random numbers.

The first 32 bits of an MD5 digest of ``seed|part|part``: the same integers in
any engine, independent of partitioning, and reproducible after a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 4294967296.0


def bits(seed: object, *parts: Column | str) -> Column:
    cols = [F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def uniform(seed: object, *parts: Column | str) -> Column:
    """In [0, 1)."""
    return bits(seed, *parts) / F.lit(RANGE)


def bits_sql(seed: object, *parts: str) -> str:
    """The same integer in DuckDB SQL."""
    inner = " || '|' || ".join([f"'{seed}'", *(f"({p})::VARCHAR" for p in parts)])
    return f"('0x' || substr(md5({inner}), 1, 8))::BIGINT"


def uniform_sql(seed: object, *parts: str) -> str:
    return f"({bits_sql(seed, *parts)} / {RANGE})"
