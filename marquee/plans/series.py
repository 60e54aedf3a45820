"""Series and episode analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import round_half_away
from marquee.operators import top_k


def _mean(c: Column, digits: int | None) -> Column:
    return c if digits is None else round_half_away(c, digits)


def series_kpis(series: DataFrame, episodes: DataFrame, digits: int | None = None) -> DataFrame:
    """One row: ``num_series, num_episodes, avg_episodes_per_series``.

    The mean is over series that have filtered episodes (a mean of group
    sizes). Both inputs are reduced before they meet: episodes to one row per
    series (partial aggregation), series to a marker row each, and a single
    global aggregate reads the union; no join is needed.
    """
    per_series = episodes.groupBy("seriesId").agg(F.count(F.lit(1)).alias("size"))
    marks = series.select(F.lit("series").alias("kind"), F.lit(None).cast("string").alias("seriesId"),
                          F.lit(None).cast("bigint").alias("size"))
    groups = per_series.select(F.lit("group").alias("kind"), "seriesId", "size")
    u = marks.unionByName(groups)
    is_group = F.col("kind") == F.lit("group")
    return u.agg(
        F.count_if(F.col("kind") == F.lit("series")).alias("num_series"),
        F.coalesce(F.sum(F.when(is_group, F.col("size"))), F.lit(0)).cast("bigint").alias("num_episodes"),
        _mean(F.avg(F.when(is_group & F.col("seriesId").isNotNull(), F.col("size"))), digits)
        .alias("avg_episodes_per_series"),
    )


def top_series(series: DataFrame, k: int = 20) -> DataFrame:
    """Best rated series: ``primaryTitle, startYear, averageRating, numVotes``.

    Ties: more votes first, then title id ascending.
    """
    best = top_k(series, [F.col("averageRating").desc(), F.col("numVotes").desc(), F.col("tconst").asc()], k)
    return best.select("primaryTitle", "startYear", "averageRating", "numVotes")


def season_analysis(episodes: DataFrame, series: DataFrame, digits: int | None = None) -> DataFrame:
    """Per series with filtered episodes that is itself a filtered series.

    ``seriesId, num_seasons, num_episodes, avg_rating, tconst, primaryTitle``:
    highest season number, episode count and mean episode rating, joined to
    the series' title (both key columns kept).
    """
    per = episodes.where(F.col("seriesId").isNotNull()).groupBy("seriesId").agg(
        F.max("seasonNumber").alias("num_seasons"),
        F.count("episodeId").alias("num_episodes"),
        _mean(F.avg("episodeRating"), digits).alias("avg_rating"),
    )
    titles = series.select("tconst", "primaryTitle")
    return per.join(titles, per.seriesId == titles.tconst, "inner").select(
        "seriesId", "num_seasons", "num_episodes", "avg_rating", "tconst", "primaryTitle"
    )


def series_most_seasons(analysis: DataFrame, k: int = 15) -> DataFrame:
    return top_k(analysis, [F.col("num_seasons").desc(), F.col("seriesId").asc()], k)


def series_most_episodes(analysis: DataFrame, k: int = 15) -> DataFrame:
    return top_k(analysis, [F.col("num_episodes").desc(), F.col("seriesId").asc()], k)


def _pick_order() -> list[Column]:
    return [F.col("num_seasons").desc(), F.col("seriesId").asc()]


def series_picklist(analysis: DataFrame, k: int = 100) -> DataFrame:
    """Titles of the ``k`` series with most seasons, in pick order: ``position, primaryTitle``."""
    best = top_k(analysis, _pick_order(), k)
    return best.select(
        F.row_number().over(Window.orderBy(*_pick_order())).cast("int").alias("position"), "primaryTitle"
    )


def season_ratings(
    episodes: DataFrame, analysis: DataFrame, series_title: str | None = None, digits: int | None = None
) -> DataFrame:
    """Mean episode rating per season of one series: ``seasonNumber, episodeRating``.

    The series is looked up by title; among homonyms the smallest id wins.
    Without a title, the first entry of the pick list is used. The lookup
    reduces to one row, so joining it to the episodes is a bounded broadcast.

    The default pick reads the season table once: per title, the smallest id
    and the title's best pick key ``(-num_seasons, seriesId)``; then the id of
    the title holding the overall best key. Both steps aggregate partially.
    """
    if series_title is None:
        best = F.struct((-F.col("num_seasons")).alias("k1"), F.col("seriesId").alias("k2"))
        per_title = analysis.groupBy("primaryTitle").agg(
            # a null title matches no lookup
            F.min(F.when(F.col("primaryTitle").isNotNull(), F.col("seriesId"))).alias("first_id"),
            F.min(best).alias("best"),
        )
        target = per_title.agg(F.min_by("first_id", "best").alias("seriesId"))
    else:
        named = analysis.where(F.col("primaryTitle") == F.lit(series_title))
        target = named.agg(F.min("seriesId").alias("seriesId"))
    chosen = episodes.join(F.broadcast(target), "seriesId", "left_semi")
    return chosen.groupBy("seasonNumber").agg(_mean(F.avg("episodeRating"), digits).alias("episodeRating"))
