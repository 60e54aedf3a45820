"""ETL stages on hand-made raw rows covering the catalogue pipeline's edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from conftest import rows
from marquee.config import EtlParams
from marquee.plans import etl
from marquee.schemas import RAW_COLUMNS
from marquee.sources.raw import RawSources

P = EtlParams()


def _raw(spark, name, data):
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS[name]])
    return spark.createDataFrame(data, schema)


def _basics_row(tconst, ttype, year, genres=None, adult="0", title=None):
    return (tconst, ttype, title or f"T {tconst}", title or f"T {tconst}", adult, year, None, "90", genres)


@pytest.fixture(scope="module")
def raw(spark):
    basics = [
        _basics_row("t1", "movie", "1949", "Drama"),
        _basics_row("t2", "movie", "1950", "Drama"),
        _basics_row("t3", "movie", "2024", "Drama,Comedy"),
        _basics_row("t4", "movie", "2025", "Drama"),
        _basics_row("t5", "movie", None, "Drama"),
        _basics_row("t6", "short", "2000", "Drama"),
        _basics_row("t7", "tvSeries", "2000", "Drama,"),
        _basics_row("t8", "tvMovie", "2000", ",Drama"),
        _basics_row("t9", "tvEpisode", "2000", None),
        _basics_row("t10", "tvMiniSeries", "2000", ""),
        _basics_row("t11", "movie", "2000", "Comedy", adult="1"),
        _basics_row("t12", "movie", "2000", "Action"),
        _basics_row("t13", "movie", "2000", "Action"),
        _basics_row("t14", "movie", "2000", "Action"),
        *[_basics_row(f"n{i}", "movie", "2001", "Noir") for i in range(4)],
        *[_basics_row(f"e{i}", "tvEpisode", "2001", "Drama") for i in range(1, 8)],
    ]
    votes = {t: "1000" for t in ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9", "t10", "t11"]}
    votes.update({"t12": "999", "t13": "1001"})
    ratings = [(t, "7.0", v) for t, v in votes.items()]
    ratings += [("n0", "6.5", "1000"), ("n1", "6.5", "1000"), ("n2", "6.5", "1000"), ("n3", "6.6", "1000")]
    ratings += [(f"e{i}", "8.0", "1000") for i in range(1, 7)] + [("e7", "8.0", "10")]
    crew = [("t2", "p1"), ("t3", "p1,p2,p3"), ("t7", None), ("t8", ""), ("t12", "p1"), ("t11", "p9")]
    people = [("p1", "Ann", None, None, None), ("p2", "Bob", "1970", None, None),
              ("p3", "Ann", None, None, None), ("p4", None, None, None, None)]
    principals = [
        ("t2", "1", "p1", "actor"), ("t2", "5", "p2", "actress"), ("t2", "6", "p3", "actor"),
        ("t2", "2", "p4", "director"), ("t3", "1", "p1", "actor"), ("t3", "3", "p1", "actor"),
        ("t7", "1", "p4", "actor"),
    ]
    akas = [("t2", "US"), ("t2", "US"), ("t2", "USA"), ("t2", ""), ("t2", None), ("t3", "GB"), ("t99", "FR")]
    episode = [
        ("e1", "t7", "1", "1"), ("e2", "t7", None, "1"), ("e3", "t10", "2", None),
        ("e4", "tmissing", "1", "1"), ("e5", "t12", "1", "1"), ("e6", "t2", "1", "1"),
        ("e7", "t7", "1", "2"), ("t9", "t10", "1", "2"),
    ]
    return RawSources(
        basics=_raw(spark, "title.basics", basics),
        ratings=_raw(spark, "title.ratings", ratings),
        crew=_raw(spark, "title.crew", crew),
        people=_raw(spark, "name.basics", people),
        principals=_raw(spark, "title.principals", principals),
        akas=_raw(spark, "title.akas", akas),
        episode=_raw(spark, "title.episode", episode),
    )


@pytest.fixture(scope="module")
def st(raw):
    return etl.build_stages(raw, P)


def test_titles_filter_bounds_types_and_votes(st):
    ids = {r[0] for r in rows(st.titles_clean, "tconst")}
    # years 1950 and 2024 inclusive; 1949, 2025, null year dropped; 'short' dropped;
    # 999 votes dropped, 1000 and 1001 kept; a title without a rating row dropped
    assert {"t2", "t3", "t7", "t8", "t9", "t10", "t11", "t13"} <= ids
    assert not ids & {"t1", "t4", "t5", "t6", "t12", "t14"}
    assert st.titles_clean.columns == etl.TITLE_COLUMNS
    types = dict(st.titles_clean.dtypes)
    assert types["averageRating"] == "float" and types["numVotes"] == "int" and types["startYear"] == "int"


def test_adult_titles_kept_unless_asked(raw):
    kept = {r[0] for r in rows(etl.build_stages(raw, P).titles_clean, "tconst")}
    dropped = {r[0] for r in rows(etl.build_stages(raw, EtlParams(exclude_adult=True)).titles_clean, "tconst")}
    assert "t11" in kept and "t11" not in dropped


def test_genre_split_keeps_empty_parts(st):
    got = rows(st.genres_exploded.where("tconst in ('t2','t3','t7','t8','t9','t10')"), "tconst", "genre")
    assert got == [("t2", "Drama"), ("t3", "Comedy"), ("t3", "Drama"),
                   ("t7", ""), ("t7", "Drama"), ("t8", ""), ("t8", "Drama")]


def test_rollup_rounds_like_sql_round(st):
    cell = st.genres_by_year.where("genre = 'Noir'").collect()
    assert len(cell) == 1
    f32 = [float(np.float32(x)) for x in ("6.5", "6.5", "6.5", "6.6")]
    mean = sum(f32) / 4
    expected = math.floor(mean * 100 + 0.5) / 100
    assert cell[0]["avg_rating"] == expected == 6.52
    assert cell[0]["count"] == 4 and cell[0]["total_votes"] == 4000
    assert dict(st.genres_by_year.dtypes)["total_votes"] == "bigint"


def test_directors_explode_join_and_homonyms(st):
    got = rows(st.directors, "tconst", "nconst", "directorName")
    # t7 null list, t8 empty list, t12 not kept, p9 not a person
    assert got == [("t2", "p1", "Ann"), ("t3", "p1", "Ann"), ("t3", "p2", "Bob"), ("t3", "p3", "Ann")]


def test_duplicate_title_ids_multiply_like_inner_joins(spark, raw):
    dup = RawSources(**{**raw.__dict__, "ratings": raw.ratings.unionByName(
        raw.ratings.where("tconst = 't2'"))})
    st = etl.build_stages(dup, P)
    # crew x titles (2 rows) -> explode (2 parts) -> people -> titles (2 rows): 4 copies
    assert st.directors_exploded.where("tconst = 't2'").count() == 2
    assert st.directors.where("tconst = 't2'").count() == 4


def test_actor_credits_filter_is_position_not_rank(st):
    got = rows(st.actors, "tconst", "nconst", "ordering", "actorName")
    assert got == [("t2", "p1", 1, "Ann"), ("t2", "p2", 5, "Bob"),
                   ("t3", "p1", 1, "Ann"), ("t3", "p1", 3, "Ann"), ("t7", "p4", 1, None)]


def test_countries_distinct_two_letter(st):
    assert rows(st.countries_base) == [("t2", "US"), ("t3", "GB"), ("t99", "FR")]
    assert rows(st.countries, "tconst", "region") == [("t2", "US"), ("t3", "GB")]


def test_episodes_need_kept_episode_and_series_parent(st):
    got = rows(st.episodes, "episodeId", "seriesId", "seasonNumber", "episodeNumber", "seriesTitle")
    assert got == [("e1", "t7", 1, 1, "T t7"), ("t9", "t10", 1, 2, "T t10")]


def test_row_counts(st):
    got = dict((r["table"], r["rows"]) for r in etl.etl_row_counts(st).collect())
    assert got["titles_clean"] == st.titles_clean.count()
    assert got["episodes"] == 2 and got["directors"] == 4


def test_bad_number_fails_the_job(spark):
    bad = _raw(spark, "title.basics", [_basics_row("x1", "movie", "abc", "Drama")])
    with pytest.raises(Exception):
        etl.titles_base(bad, P).collect()


def test_rating_floor_in_the_columns_type(spark):
    from marquee.config import TitleFilter
    from marquee.operators.filters import title_filter

    df = spark.sql("SELECT cast(7.7 AS float) AS averageRating, 2000 AS startYear, 'movie' AS titleType")
    assert title_filter(df, TitleFilter(min_rating=7.7)).count() == 1


def test_ranking_by_the_unrounded_mean(spark):
    from marquee.plans.geography import top_rated_countries
    from marquee.plans.people import top_people_by_rating

    df = spark.createDataFrame([("a", "a", 7.0, "t"), ("b", "b", 7.0000004, "t")], "name string, region string, averageRating double, tconst string")
    assert [r[0] for r in top_people_by_rating(df, "name", 1, 2, 6).collect()] == ["b", "a"]
    assert [r[0] for r in top_rated_countries(df, 1, 2, 6).collect()] == ["b", "a"]
