"""Scalar column expressions shared by the ETL and the analyses.

All of them are plain Catalyst expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c: str | Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals as ``round(x * 10^d) / 10^d``.

    ``F.round(x, d)`` rounds the exact decimal expansion of the double, so
    1.005 becomes 1.01; scaling first rounds the binary value, which is what
    the catalogue pipeline's SQL ``ROUND`` does (1.005 -> 1.0).
    """
    scale = float(10 ** digits)
    return F.round(_col(c) * F.lit(scale)) / F.lit(scale)


def reported_mean(df: DataFrame, digits: int | None, col: str = "avg_rating") -> DataFrame:
    """``df`` with a mean rounded for the report (after any ranking by it)."""
    return df if digits is None else df.withColumn(col, round_half_away(col, digits))


def decade(c: str | Column) -> Column:
    """Floor decade of an integer year: 1987 -> 1980, -1985 -> -1990."""
    y = _col(c)
    return (y - F.pmod(y, F.lit(10))).cast("int")


def isin_or_false(c: str | Column, values: Iterable) -> Column:
    """``c IN values``; an empty selection matches nothing."""
    vals = list(values)
    if not vals:
        return F.lit(False)
    return _col(c).isin(vals)


def pct_change(new: str | Column, old: str | Column) -> Column:
    """``(new - old) / old * 100`` as double; null when ``old`` is 0 or null."""
    o = _col(old).cast("double")
    return (_col(new).cast("double") - o) / F.nullif(o, F.lit(0.0)) * F.lit(100.0)


def split_list(c: str | Column, sep: str = ",") -> Column:
    """Split a delimited list, keeping empty parts ('Drama,' -> ['Drama', ''])."""
    return F.split(_col(c), sep, -1)
