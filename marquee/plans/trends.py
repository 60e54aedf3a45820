"""Production trends over filtered titles: KPIs, per-year counts, decades, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import decade, pct_change, round_half_away
from marquee.operators import non_null_keys, top_k


def _mean(c: Column, digits: int | None) -> Column:
    return c if digits is None else round_half_away(c, digits)


def year_type_rollup(titles: DataFrame) -> DataFrame:
    """Per (startYear, titleType): ``n, n_tconst, s_rating, n_rating, s_votes``.

    One scan with partial aggregation; the output has one row per year and
    type however large the input is. Every trend below is computed from it,
    so a dashboard that caches it scans the titles once for the whole tab.
    Null years and types are kept here (they count in the KPI totals) and
    dropped where a trend groups by them.
    """
    return titles.groupBy("startYear", "titleType").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("tconst").alias("n_tconst"),
        F.sum(F.col("averageRating").cast("double")).alias("s_rating"),
        F.count("averageRating").alias("n_rating"),
        F.sum("numVotes").alias("s_votes"),
    )


def _mean_of(s: str, n: str) -> Column:
    return F.sum(s) / F.nullif(F.sum(n), F.lit(0))


def kpi_summary(titles: DataFrame | None, digits: int | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """One row: ``total_titles, avg_rating, total_votes, total_votes_millions, top_year``.

    From the year/type rollup: per year (tiny), then one global row.
    ``top_year`` is the year with most titles, the smallest such year on
    ties; null when there are no titles.
    """
    r = rollup if rollup is not None else year_type_rollup(titles)
    per_year = r.groupBy("startYear").agg(
        F.sum("n").alias("n"), F.sum("s_rating").alias("s_rating"),
        F.sum("n_rating").alias("n_rating"), F.sum("s_votes").alias("s_votes"),
    )
    # rows with a null year carry a null ordering value, which max_by skips
    ranked_year = F.max_by(
        F.col("startYear"),
        F.when(F.col("startYear").isNotNull(), F.struct(F.col("n"), -F.col("startYear"))),
    )
    total_votes = F.coalesce(F.sum("s_votes"), F.lit(0)).cast("bigint")
    return per_year.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_titles"),
        _mean(_mean_of("s_rating", "n_rating"), digits).alias("avg_rating"),
        total_votes.alias("total_votes"),
        (total_votes.cast("double") / F.lit(1_000_000.0)).alias("total_votes_millions"),
        ranked_year.cast("int").alias("top_year"),
    )


def titles_by_year_type(titles: DataFrame | None, rollup: DataFrame | None = None) -> DataFrame:
    """Titles per (year, type): ``startYear, titleType, count``."""
    r = rollup if rollup is not None else year_type_rollup(titles)
    return non_null_keys(r, ["startYear", "titleType"]).select(
        "startYear", "titleType", F.col("n").cast("bigint").alias("count")
    )


def with_decade(df: DataFrame, year_col: str = "startYear") -> DataFrame:
    return df.withColumn("decade", decade(year_col))


def titles_by_decade(titles: DataFrame | None, rollup: DataFrame | None = None) -> DataFrame:
    r = rollup if rollup is not None else year_type_rollup(titles)
    return non_null_keys(with_decade(r), ["decade"]).groupBy("decade").agg(
        F.sum("n").cast("bigint").alias("count")
    )


def top_decade(titles: DataFrame | None, rollup: DataFrame | None = None) -> DataFrame:
    """The decade with most titles (smallest on ties): ``decade, count``; empty -> 0 rows."""
    return top_k(titles_by_decade(titles, rollup), [F.col("count").desc(), F.col("decade").asc()], 1)


def production_growth(
    titles: DataFrame | None, year_lo: int, year_hi: int, span: int = 5, rollup: DataFrame | None = None
) -> DataFrame:
    """Growth from the first ``span`` years to the last ``span + 1`` years of the range.

    recent = ``year >= hi - span`` (the input is already capped at ``hi``);
    old = ``lo <= year < lo + span``. The windows may overlap. One row
    ``recent_count, old_count, growth_pct``, or no row when ``old`` is empty.
    """
    r = rollup if rollup is not None else year_type_rollup(titles)
    y = F.col("startYear")
    counts = r.agg(
        F.coalesce(F.sum(F.when(y >= F.lit(year_hi - span), F.col("n"))), F.lit(0))
        .cast("bigint").alias("recent_count"),
        F.coalesce(F.sum(F.when((y >= F.lit(year_lo)) & (y < F.lit(year_lo + span)), F.col("n"))), F.lit(0))
        .cast("bigint").alias("old_count"),
    )
    return counts.where(F.col("old_count") > 0).withColumn(
        "growth_pct", pct_change("recent_count", "old_count")
    )


def rating_by_year(titles: DataFrame | None, digits: int | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Per year: mean rating and number of titles: ``startYear, avg_rating, count``."""
    r = rollup if rollup is not None else year_type_rollup(titles)
    return non_null_keys(r, ["startYear"]).groupBy("startYear").agg(
        _mean(_mean_of("s_rating", "n_rating"), digits).alias("avg_rating"),
        F.sum("n_tconst").cast("bigint").alias("count"),
    )


def year_bounds(titles: DataFrame) -> DataFrame:
    """Smallest and largest start year of the (unfiltered) titles: one row."""
    return titles.agg(
        F.min("startYear").cast("int").alias("min_year"),
        F.max("startYear").cast("int").alias("max_year"),
    )


def movies_by_year(titles: DataFrame, movie_type: str = "movie") -> DataFrame:
    """Titles of one type per year, ordered by year: ``startYear, num_movies``."""
    return (
        titles.where(F.col("titleType") == F.lit(movie_type))
        .groupBy("startYear")
        .agg(F.count(F.lit(1)).alias("num_movies"))
        .orderBy("startYear")
    )


def filtered_title_ids(titles: DataFrame) -> DataFrame:
    """Distinct ids of the filtered titles: ``tconst``."""
    return titles.select("tconst").distinct()
