"""Readers for the six gold tables written by the ETL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from marquee.schemas import GOLD_SCHEMAS, GOLD_TABLES


def read_gold(spark: SparkSession, root: str, names: Sequence[str] = GOLD_TABLES) -> dict[str, DataFrame]:
    """Lazy DataFrames over ``root/<name>.parquet``; nothing is read until an action.

    Filters and projections of later analyses reach these scans as pushed
    filters and a pruned read schema. Callers who run many analyses on one
    filtered table may ``cache()`` it themselves.
    """
    base = root.rstrip("/")
    out = {}
    for n in names:
        df = spark.read.parquet(f"{base}/{n}.parquet")
        # partitioned layouts put the partition column last; keep the canonical order
        canonical = GOLD_SCHEMAS[n].fieldNames() if n in GOLD_SCHEMAS else df.columns
        out[n] = df.select(*canonical) if sorted(canonical) == sorted(df.columns) else df
    return out
