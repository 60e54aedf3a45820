"""Regional analyses over (title, region) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import reported_mean
from marquee.operators import default_members, distinct_members, member_filter, non_null_keys, top_k


def top_countries(regions: DataFrame, k: int = 20) -> DataFrame:
    """Regions by number of titles: ``region, count`` (region asc on ties)."""
    per = non_null_keys(regions, ["region"]).groupBy("region").agg(F.count(F.lit(1)).alias("count"))
    return top_k(per, [F.col("count").desc(), F.col("region").asc()], k)


def top_rated_countries(regions: DataFrame, min_productions: int = 50, k: int = 20, digits: int | None = None) -> DataFrame:
    """Best mean rating among regions with at least ``min_productions`` titles.

    ``region, avg_rating, count``; ranked by the unrounded mean, region asc.
    """
    per = non_null_keys(regions, ["region"]).groupBy("region").agg(
        F.avg("averageRating").alias("avg_rating"), F.count("tconst").alias("count"))
    per = per.where(F.col("count") >= F.lit(min_productions))
    return reported_mean(top_k(per, [F.col("avg_rating").desc(), F.col("region").asc()], k), digits)


def country_timeline(regions: DataFrame, selected: Sequence[str] | DataFrame) -> DataFrame:
    """Titles per (year, region) for the selected regions: ``startYear, region, count``.

    ``selected`` is a list of regions, or a DataFrame with a ``region`` column
    such as ``default_regions`` (Spark's size check picks the join).
    """
    if isinstance(selected, DataFrame):
        chosen = regions.join(selected.select("region"), "region", "left_semi")
    else:
        chosen = member_filter(regions, "region", selected)
    sel = non_null_keys(chosen, ["startYear", "region"])
    return sel.groupBy("startYear", "region").agg(F.count(F.lit(1)).alias("count"))


def distinct_regions(regions: DataFrame) -> DataFrame:
    return distinct_members(regions, "region")


def default_regions(regions: DataFrame, preferred: Sequence[str]) -> DataFrame:
    return default_members(regions, "region", preferred)
