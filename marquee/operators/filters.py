"""Row filters of the analysis side (the dashboard's global filter family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import TitleFilter
from marquee.functions import isin_or_false


def title_condition(
    f: TitleFilter,
    rating_col: str = "averageRating",
    year_col: str = "startYear",
    type_col: str = "titleType",
    rating_type: str = "float",
) -> Column:
    """``year BETWEEN lo AND hi AND type IN types AND rating >= min``.

    Comparisons with null are false, so rows with a null year, type or rating
    drop, as in the dashboard. The predicate is a plain Catalyst expression and
    reaches the Parquet scan as pushed filters. The floor takes the rating
    column's own type: 7.7 as a double is above the 32-bit 7.7.
    """
    return (
        F.col(year_col).between(f.year_lo, f.year_hi)
        & isin_or_false(type_col, f.types)
        & (F.col(rating_col) >= F.lit(float(f.min_rating)).cast(rating_type))
    )


def title_filter(df: DataFrame, f: TitleFilter, rating_col: str = "averageRating") -> DataFrame:
    """Apply the global filter to titles, genre cells, people or regions."""
    return df.where(title_condition(f, rating_col, rating_type=df.schema[rating_col].dataType.simpleString()))


def episode_filter(episodes: DataFrame, f: TitleFilter) -> DataFrame:
    """Episodes: the series' start year in range and the episode's own rating.

    The content-type selection is deliberately not applied to episodes.
    """
    floor = F.lit(float(f.min_rating)).cast(episodes.schema["episodeRating"].dataType)
    return episodes.where(F.col("seriesStartYear").between(f.year_lo, f.year_hi) & (F.col("episodeRating") >= floor))


def series_filter(filtered_titles: DataFrame, series_types: Sequence[str]) -> DataFrame:
    """The series among already filtered titles."""
    return filtered_titles.where(isin_or_false("titleType", series_types))


def member_filter(df: DataFrame, col: str, selected: Sequence[str]) -> DataFrame:
    """Rows whose ``col`` is one of the selected members (none when empty)."""
    return df.where(isin_or_false(col, selected))


def non_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows with a null grouping key (pandas ``groupby`` semantics)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)
