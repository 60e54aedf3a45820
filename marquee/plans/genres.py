"""Genre analyses over the (year, genre, type) rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.config import CELL_MEAN_DIGITS
from marquee.functions import round_half_away
from marquee.operators import default_members, distinct_members, member_filter, non_null_keys, top_k


def top_genres(cells: DataFrame, k: int = 10) -> DataFrame:
    """Genres by number of titles: ``genre, count`` (top k, genre asc on ties)."""
    per = non_null_keys(cells, ["genre"]).groupBy("genre").agg(F.sum("count").cast("bigint").alias("count"))
    return top_k(per, [F.col("count").desc(), F.col("genre").asc()], k)


def top_rated_genres(cells: DataFrame, k: int = 10, digits: int = CELL_MEAN_DIGITS) -> DataFrame:
    """Genres by the unweighted mean of their cells' (already rounded) means.

    The rating floor of the filter applied to the cells, not to titles, and
    each cell weighs the same whatever its title count. ``genre, avg_rating,
    count``; ranked by the reported mean, genre asc on ties.
    """
    mean = F.avg("avg_rating")
    per = non_null_keys(cells, ["genre"]).groupBy("genre").agg(
        round_half_away(mean, digits).alias("avg_rating"),
        F.sum("count").cast("bigint").alias("count"),
    )
    return top_k(per, [F.col("avg_rating").desc(), F.col("genre").asc()], k)


def genre_timeline(cells: DataFrame, selected: Sequence[str] | DataFrame) -> DataFrame:
    """Titles per (year, genre) for the selected genres: ``startYear, genre, count``.

    ``selected`` is a list of genres, or a DataFrame with a ``genre`` column
    such as ``default_genres`` (the picker's default; Spark's size check picks
    the join).
    """
    if isinstance(selected, DataFrame):
        chosen = cells.join(selected.select("genre"), "genre", "left_semi")
    else:
        chosen = member_filter(cells, "genre", selected)
    sel = non_null_keys(chosen, ["startYear", "genre"])
    return sel.groupBy("startYear", "genre").agg(F.sum("count").cast("bigint").alias("count"))


def distinct_genres(cells: DataFrame) -> DataFrame:
    return distinct_members(cells, "genre")


def default_genres(cells: DataFrame, preferred: Sequence[str]) -> DataFrame:
    return default_members(cells, "genre", preferred)
