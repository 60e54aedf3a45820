"""Schemas of the raw catalogue files and of the six gold tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, F, D, L = T.StringType(), T.IntegerType(), T.FloatType(), T.DoubleType(), T.LongType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Raw files are read with every column as a string; casts happen in the ETL so
# that a malformed number fails the job (ANSI) instead of turning into null.
RAW_COLUMNS = {
    "title.basics": ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult",
                     "startYear", "endYear", "runtimeMinutes", "genres"],
    "title.ratings": ["tconst", "averageRating", "numVotes"],
    "title.crew": ["tconst", "directors"],
    "name.basics": ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession"],
    "title.principals": ["tconst", "ordering", "nconst", "category"],
    "title.akas": ["titleId", "region"],
    "title.episode": ["tconst", "parentTconst", "seasonNumber", "episodeNumber"],
}

TITLES_CLEAN = _struct(
    ("tconst", S), ("titleType", S), ("primaryTitle", S), ("originalTitle", S),
    ("startYear", I), ("endYear", I), ("runtimeMinutes", I), ("genres", S),
    ("averageRating", F), ("numVotes", I),
)
GENRES_BY_YEAR = _struct(
    ("startYear", I), ("genre", S), ("titleType", S),
    ("count", L), ("avg_rating", D), ("total_votes", L),
)
DIRECTORS = _struct(
    ("tconst", S), ("nconst", S), ("directorName", S), ("primaryTitle", S),
    ("startYear", I), ("titleType", S), ("averageRating", F), ("numVotes", I),
)
ACTORS = _struct(
    ("tconst", S), ("nconst", S), ("actorName", S), ("category", S), ("ordering", I),
    ("primaryTitle", S), ("startYear", I), ("titleType", S), ("averageRating", F), ("numVotes", I),
)
COUNTRIES = _struct(
    ("tconst", S), ("region", S), ("primaryTitle", S), ("startYear", I),
    ("titleType", S), ("genres", S), ("averageRating", F), ("numVotes", I),
)
EPISODES = _struct(
    ("episodeId", S), ("seriesId", S), ("seasonNumber", I), ("episodeNumber", I),
    ("episodeTitle", S), ("episodeYear", I), ("episodeRating", F), ("episodeVotes", I),
    ("seriesTitle", S), ("seriesStartYear", I),
)

GOLD_SCHEMAS = {
    "titles_clean": TITLES_CLEAN,
    "genres_by_year": GENRES_BY_YEAR,
    "directors": DIRECTORS,
    "actors": ACTORS,
    "countries": COUNTRIES,
    "episodes": EPISODES,
}
GOLD_TABLES = tuple(GOLD_SCHEMAS)
