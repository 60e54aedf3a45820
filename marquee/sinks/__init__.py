"""Sinks: ZSTD Parquet writers for the gold tables."""

from marquee.sinks.parquet import publish, write_table  # noqa: F401
