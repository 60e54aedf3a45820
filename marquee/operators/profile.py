"""Data-quality profile: row/column counts, null counts, samples, sizes.

Each table is scanned once: every per-column null count is one aggregate
expression of the same ``agg``, and the one-row result is unpivoted.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``table, rows, columns, column_names``."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).cast("int").alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def null_profile_of(df: DataFrame, table: str) -> DataFrame:
    """Columns of one table that hold nulls: ``table, column, null_count, null_pct``."""
    cols = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(_q(c).isNull()).alias(c) for c in cols],
    )
    long = counts.unpivot(["__rows"], cols, "column", "null_count")
    return long.where(F.col("null_count") > 0).select(
        F.lit(table).alias("table"),
        "column",
        "null_count",
        (F.col("null_count").cast("double") / F.col("__rows").cast("double") * F.lit(100.0)).alias("null_pct"),
    )


def null_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``null_profile_of`` for every table, stacked."""
    return reduce(DataFrame.unionByName, [null_profile_of(df, n) for n, df in tables.items()])


def table_sample(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """First ``n`` rows under a deterministic order (the profile's sample)."""
    return df.orderBy(*order_by).limit(n)


def dataset_summary(profile: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row: ``valid_tables, total_tables, all_valid``.

    ``profile`` is a ``table_profile`` of the tables that could be opened; a
    table counts as valid when it appears there.
    """
    total = len(expected)
    valid = profile.where(F.col("table").isin(list(expected))).agg(
        F.count_distinct("table").alias("valid_tables")
    )
    return valid.select(
        "valid_tables",
        F.lit(total).cast("bigint").alias("total_tables"),
        (F.col("valid_tables") == F.lit(total)).alias("all_valid"),
    )


def _unreadable(e: Exception) -> bool:
    """A missing path or a file that is not (sound) Parquet; not a lost executor."""
    said = str(e)
    return isinstance(e, AnalysisException) or any(
        x in said for x in ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "ParquetDecodingException"))


def open_tables(
    spark: SparkSession, root: str, names: Sequence[str], verify_rows: bool = False,
    reasons: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Open ``root/<name>.parquet`` for each name; skip missing or unreadable ones.

    Opening reads Parquet footers only (schema). Reads are lazy, so a damaged
    data page would only fail later; ``verify_rows`` also decodes every page
    of every column (one distributed aggregate of ``count(col)`` per table;
    a plain ``count()`` would be answered from row-group metadata) and skips
    tables whose scan fails. The loop runs over table names, not over data.
    ``reasons`` receives why a table was left out; any other failure is raised.
    """
    out: dict[str, DataFrame] = {}
    for name in names:
        try:
            df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
            if verify_rows:
                df.agg(*[F.count(_q(c)) for c in df.columns]).collect()
            out[name] = df
        except (PySparkException, Py4JJavaError) as e:
            if not _unreadable(e):
                raise
            if reasons is not None:
                reasons[name] = str(e).strip().splitlines()[0]
    return out


def file_sizes(spark: SparkSession, root: str, limit_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Bytes per dataset under ``root`` plus a total row and an over-limit flag.

    A dataset is a top-level entry of ``root`` (a single file or a folder of
    part files). Only ``path`` and ``length`` are read, not file contents.
    """
    root = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    # listed paths are URIs (file:/..., s3a://...) that contain the root as given
    anchor = root.split(":", 1)[1] if root.startswith("file:") else root
    rel = F.regexp_extract(F.col("path"), re.escape(anchor) + r"/(.+)", 1)
    per = (files.withColumn("rel", rel).where(~F.col("rel").rlike(r"(^|/)[_.]"))
           .groupBy(F.substring_index("rel", "/", 1).alias("dataset")).agg(F.sum("length").alias("bytes")))
    total = per.agg(F.lit("__total__").alias("dataset"), F.sum("bytes").alias("bytes"))
    both = per.unionByName(total)
    return both.withColumn(
        "over_limit", (F.col("dataset") == "__total__") & (F.col("bytes") > F.lit(limit_bytes))
    )
