"""Global and per-group top-k with a total order.

Every ranking here is given a complete sort key (measure, then the group key
ascending) so ties resolve the same way on every run and in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows by ``order``.

    ``orderBy().limit()`` plans as ``TakeOrderedAndProject``: each task keeps
    its own k best rows and only k x tasks rows reach the final merge, so the
    cost does not grow with the input beyond one scan.
    """
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str | None = None,
) -> DataFrame:
    """First ``k`` rows of each group by ``order`` (``row_number`` semantics).

    Spark inserts a partial ``WindowGroupLimit`` before the shuffle, so at most
    k rows per group leave each map task; a group holding a third of the data
    ships k rows per task, not a third of the data, to one reducer.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    rn = "__rn" if rank_col is None else rank_col
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out.drop(rn) if rank_col is None else out
