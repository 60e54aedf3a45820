"""Analyses on hand-made gold rows: ties, empty inputs, windows, defaults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from marquee.config import TitleFilter
from marquee.functions import decade, round_half_away
from marquee.operators import default_members, title_filter
from marquee.plans import genres, geography, people, series, trends
from marquee.schemas import EPISODES, GENRES_BY_YEAR, TITLES_CLEAN


def titles(spark, data):
    """data: (tconst, type, year, rating, votes)"""
    full = [(t, ty, f"T{t}", f"T{t}", y, None, None, "Drama", r, v) for t, ty, y, r, v in data]
    return spark.createDataFrame(full, TITLES_CLEAN)


def test_kpi_summary_and_top_year_ties(spark):
    df = titles(spark, [("a", "movie", 2001, 6.0, 10), ("b", "movie", 2001, 8.0, 20),
                        ("c", "movie", 1999, 7.0, 30), ("d", "movie", 1999, None, 40)])
    r = trends.kpi_summary(df).collect()[0]
    assert r["total_titles"] == 4
    assert r["avg_rating"] == 7.0  # mean of non-null ratings
    assert r["total_votes"] == 100 and r["total_votes_millions"] == 100 / 1e6
    assert r["top_year"] == 1999  # 2 titles each: the smallest year wins


def test_kpi_summary_empty(spark):
    df = titles(spark, [("a", "movie", 2001, 6.0, 10)]).where("false")
    r = trends.kpi_summary(df).collect()
    assert len(r) == 1
    assert r[0]["total_titles"] == 0 and r[0]["total_votes"] == 0
    assert r[0]["avg_rating"] is None and r[0]["top_year"] is None


def test_decade_is_floor(spark):
    got = spark.createDataFrame([(1987,), (1990,), (-1985,), (None,)], "y int").select(decade("y").alias("d"))
    assert [r["d"] for r in got.collect()] == [1980, 1990, -1990, None]


def test_round_half_away_matches_sql_round(spark):
    got = spark.createDataFrame([(1.005,), (0.285,), (2.675,), (-1.005,)], "x double").select(
        round_half_away("x", 2).alias("r"), F.round("x", 2).alias("spark_round"))
    r = got.collect()
    assert [x["r"] for x in r] == [1.0, 0.28, 2.68, -1.0]  # 2.675 * 100 is exactly 267.5
    assert r[0]["spark_round"] == 1.01  # why the plain round is not used


def test_top_decade_tie_takes_smallest(spark):
    df = titles(spark, [("a", "movie", 1995, 6.0, 1), ("b", "movie", 2003, 6.0, 1)])
    assert rows(trends.top_decade(df)) == [(1990, 1)]
    assert trends.top_decade(df.where("false")).count() == 0


def test_growth_windows(spark):
    data = [(str(i), "movie", y, 6.0, 1) for i, y in enumerate([1990, 1991, 1994, 2019, 2020, 2024, 2024])]
    df = titles(spark, data)
    r = trends.production_growth(df, 1990, 2024, 5).collect()[0]
    # recent: year >= 2019 (2019..2024): 4 titles; old: 1990 <= year < 1995: 3 titles
    assert (r["recent_count"], r["old_count"]) == (4, 3)
    assert r["growth_pct"] == pytest.approx((4 - 3) / 3 * 100)
    # lo window empty -> no row
    assert trends.production_growth(df, 1995, 2024, 5).count() == 0
    # overlapping windows (short range): both count the middle years
    r2 = trends.production_growth(df, 2019, 2024, 5).collect()[0]
    assert (r2["recent_count"], r2["old_count"]) == (4, 2)


def test_title_filter_empty_type_list_and_nulls(spark):
    df = titles(spark, [("a", "movie", 2000, 6.0, 1), ("b", "movie", 2000, None, 1), ("c", None, 2000, 9.0, 1)])
    assert title_filter(df, TitleFilter(1990, 2024, (), 0.0)).count() == 0
    assert rows(title_filter(df, TitleFilter(1990, 2024, ("movie",), 5.0)), "tconst") == [("a",)]


def test_people_top_k_ties_and_null_names(spark):
    df = spark.createDataFrame(
        [("t1", "Zed", 2001, 7.0), ("t2", "Amy", 2002, 7.0), ("t3", None, 2003, 9.0), ("t4", None, 2004, 9.0),
         ("t5", "Bob", 1995, 5.0), ("t6", "Bob", 1996, 5.0), ("t7", "Cat", 1997, 6.0)],
        "tconst string, directorName string, startYear int, averageRating float")
    top = people.top_people_by_works(df, "directorName", 2).collect()
    assert [(r["directorName"], r["num_works"]) for r in top] == [("Bob", 2), ("Amy", 1)]
    rated = people.top_people_by_rating(df, "directorName", min_works=1, k=2).collect()
    assert [r["directorName"] for r in rated] == ["Amy", "Zed"]  # tie at 7.0 -> name asc
    per = rows(people.top_people_per_decade(df, "directorName", 1), "decade", "directorName", "count")
    assert per == [(1990, "Bob", 2), (2000, "Amy", 1)]
    latest = rows(people.top_people_in_decade(df, "directorName", 3), "decade", "directorName")
    assert latest == [(2000, "Amy"), (2000, "Zed")]
    assert [r["decade"] for r in people.distinct_decades(df, "directorName").collect()] == [2000, 1990]


def test_default_members_all_present_missing_and_short(spark):
    m = spark.createDataFrame([(g,) for g in ["Action", "Comedy", "Drama", "Thriller", "Anime", "Zoo"]], "genre string")
    pref = ("Drama", "Comedy", "Action", "Thriller")
    assert rows(default_members(m, "genre", pref), "position", "genre") == [
        (1, "Drama"), (2, "Comedy"), (3, "Action"), (4, "Thriller")]
    missing = m.where("genre != 'Thriller'")
    assert rows(default_members(missing, "genre", pref), "position", "genre") == [
        (1, "Action"), (2, "Anime"), (3, "Comedy"), (4, "Drama")]
    short = m.where("genre in ('Zoo', 'Anime')")
    assert rows(default_members(short, "genre", pref), "position", "genre") == [(1, "Anime"), (2, "Zoo")]


def test_genre_analyses_use_cell_means(spark):
    cells = spark.createDataFrame(
        [(2000, "Drama", "movie", 100, 6.0, 1000), (2001, "Drama", "movie", 1, 8.0, 10),
         (2000, "Comedy", "movie", 50, 7.0, 500)], GENRES_BY_YEAR)
    tr = rows(genres.top_rated_genres(cells, 10), "genre", "avg_rating", "count")
    assert tr == [("Comedy", 7.0, 50), ("Drama", 7.0, 101)]  # unweighted mean of cells
    assert rows(genres.top_genres(cells, 1)) == [("Drama", 101)]
    assert rows(genres.genre_timeline(cells, [])) == []
    assert rows(genres.genre_timeline(cells, ["Drama"])) == [(2000, "Drama", 100), (2001, "Drama", 1)]


def test_countries_having(spark):
    df = spark.createDataFrame(
        [("t1", "US", 7.0), ("t2", "US", 9.0), ("t3", "FR", 9.5), ("t4", None, 10.0)],
        "tconst string, region string, averageRating float").withColumn("startYear", F.lit(2000))
    assert rows(geography.top_rated_countries(df, min_productions=2)) == [("US", 8.0, 2)]
    assert [r["region"] for r in geography.top_countries(df, 20).collect()] == ["US", "FR"]


def _episodes(spark, data):
    full = [(e, s, sn, 1, f"E{e}", 2000, r, 100, f"S{s}", 2000) for e, s, sn, r in data]
    return spark.createDataFrame(full, EPISODES)


def test_series_kpis_and_season_lookup_by_title(spark):
    ser = titles(spark, [("s1", "tvSeries", 2000, 8.0, 10), ("s2", "tvSeries", 2000, 7.0, 10),
                         ("s3", "tvSeries", 2000, 6.0, 10)])
    # s1 and s2 share a title -> homonyms; s3 has no episodes
    ser = ser.withColumn("primaryTitle", F.when(F.col("tconst") == "s3", "Other").otherwise("Same"))
    eps = _episodes(spark, [("e1", "s1", 1, 8.0), ("e2", "s1", 2, 6.0), ("e3", "s2", 1, 7.0),
                            ("e4", "s2", 2, 7.0), ("e5", "s2", 3, 9.0)])
    k = series.series_kpis(ser, eps).collect()[0]
    assert (k["num_series"], k["num_episodes"], k["avg_episodes_per_series"]) == (3, 5, 2.5)
    sa = series.season_analysis(eps, ser)
    assert rows(sa, "seriesId", "num_seasons", "num_episodes") == [("s1", 2, 2), ("s2", 3, 3)]
    # default pick = most seasons (s2, title 'Same'); lookup by title picks the smallest id: s1
    got = rows(series.season_ratings(eps, sa), "seasonNumber", "episodeRating")
    assert got == [(1, 8.0), (2, 6.0)]
    assert rows(series.series_picklist(sa, 100)) == [(1, "Same"), (2, "Same")]
    assert rows(series.season_ratings(eps, sa, "Nope")) == []


def test_top_series_ties(spark):
    ser = titles(spark, [("b", "tvSeries", 2000, 8.0, 10), ("a", "tvSeries", 2000, 8.0, 10),
                         ("c", "tvSeries", 2000, 8.0, 50)])
    got = [r["primaryTitle"] for r in series.top_series(ser, 2).collect()]
    assert got == ["Tc", "Ta"]


def test_timelines_default_to_the_pickers_default(spark):
    from marquee.config import AnalysisParams

    cells = spark.createDataFrame(
        [(2000, g, "movie", 1, 7.0, 10) for g in ("Action", "Anime", "Comedy", "Drama", "Zoo")], GENRES_BY_YEAR)
    gold = {"genres_by_year": cells}
    # 'Thriller' is absent: the default selection is the first four genres in order
    a = AnalysisParams(filter=TitleFilter(1990, 2024, ("movie",), 5.0))
    tl = dashboard_frames_subset(gold, a, "genre_timeline")
    assert sorted(r["genre"] for r in tl.collect()) == ["Action", "Anime", "Comedy", "Drama"]
    explicit = AnalysisParams(filter=a.filter, selected_genres=("Zoo",))
    assert [r["genre"] for r in dashboard_frames_subset(gold, explicit, "genre_timeline").collect()] == ["Zoo"]


def dashboard_frames_subset(gold, a, name):
    from marquee.plans.dashboard import analyses

    return analyses(a)[name](gold)
