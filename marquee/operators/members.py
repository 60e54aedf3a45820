"""Dimension members: the distinct values of a column and a default pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_members(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Sorted distinct non-null values of ``col`` (one row per member)."""
    m = df.select(col).where(F.col(col).isNotNull()).distinct()
    return m.orderBy(F.col(col).desc() if descending else F.col(col).asc())


def default_members(df: DataFrame, col: str, preferred: Sequence[str]) -> DataFrame:
    """The preferred members if all of them occur, else the first n sorted.

    ``n = len(preferred)``. Output: ``position`` (1-based, the order a picker
    would list them) and ``col``. One distinct, then one top-2n that holds both
    candidate lists: the preferred members first, then the others in order. The
    windows see these 2n rows at most.
    """
    n = len(preferred)
    members = df.select(col).where(F.col(col).isNotNull()).distinct()
    wanted = F.col(col).isin(list(preferred))
    top = members.withColumn("__pref", wanted).orderBy(F.col("__pref").desc(), col).limit(2 * n)
    pref_pos = F.create_map(*[x for i, p in enumerate(preferred) for x in (F.lit(p), F.lit(i + 1))])
    hits = F.sum(F.col("__pref").cast("int")).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(col))
    position = F.when(F.col("__hits") == n, F.when(F.col("__pref"), pref_pos[F.col(col)])).otherwise(F.col("__place"))
    return (
        top.withColumn("__hits", hits).withColumn("__place", place)
        .select(position.cast("int").alias("position"), col)
        .where(F.col("position") <= n)
    )
