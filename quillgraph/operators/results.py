"""The result table: parameters in file names, filters with wildcards, casts and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_params(name: Column | str, sep: str = "~") -> Column:
    """Map of the ``key<sep>value`` tokens of a ``_``-separated name; other tokens are dropped, the last of a key wins."""
    col = F.col(name) if isinstance(name, str) else name
    tokens = F.filter(F.split(col, "_"), lambda t: F.contains(t, F.lit(sep)))
    entries = F.transform(tokens, lambda t: F.struct(F.substring_index(t, sep, 1).alias("k"), F.substr(t, F.position(F.lit(sep), t) + 1, F.length(t)).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"]))
    return F.map_from_entries(last)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.(csv|npz|txt|tsv|parquet)$", "")


def load_files(spark: SparkSession, pattern: str | Sequence[str], schema: str, sep: str = "~") -> DataFrame:
    """Rows of many CSV files, or of folders of them, with a ``params`` map parsed from each one's name."""
    paths = [pattern] if isinstance(pattern, str) else list(pattern)
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    whole = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")  # a table that Spark wrote is named by its folder
    return rows.withColumn("filename", F.regexp_replace(whole, r"^.*/", "")).withColumn("params", parse_params(stem(F.url_decode("filename")), sep))


def widen(df: DataFrame, keys: Sequence[str], params: str = "params") -> DataFrame:
    return df.select(*(c for c in df.columns if c != params), *(F.try_element_at(params, F.lit(k)).alias(k) for k in keys))


def to_numeric(df: DataFrame, to_int: Sequence[str] = (), to_float: Sequence[str] = ()) -> DataFrame:
    """Casts through double; what doesn't parse becomes null."""
    return df.select(*(F.col(c).try_cast("double").cast("int").alias(c) if c in to_int else F.col(c).try_cast("double").alias(c) if c in to_float else F.col(c) for c in df.columns))


def wildcard_filter(df: DataFrame, allowed: Mapping[str, Sequence[object]]) -> DataFrame:
    """Keeps rows whose value is allowed or null in every named column; unknown columns are ignored."""
    for name, values in allowed.items():
        if name in df.columns:
            df = df.filter(F.col(name).isin(list(values)) | F.col(name).isNull())
    return df


def blank_nulls(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def curve(df: DataFrame, by: Sequence[str], value: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def param_space(spark: SparkSession, options: Mapping[str, Sequence[object]]) -> DataFrame:
    """Cartesian product of option lists."""
    out = None
    for name, values in options.items():
        part = spark.createDataFrame([(v,) for v in values], [name])
        out = part if out is None else out.crossJoin(part)
    return out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def concat_results(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
