"""Batch ETL: raw catalogue inputs -> six gold tables.

Each stage is a pure function of DataFrames and ``EtlParams``. ``run_etl``
writes the gold tables; ``build_gold`` returns them lazily (used by the
registered queries, which recompute from the raw inputs every time).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.config import EtlParams
from marquee.functions import round_half_away, split_list
from marquee.sinks import publish, write_table
from marquee.sources.bucketed import open_bucketed, table_name, write_bucketed
from marquee.sources.raw import RawSources

TITLE_COLUMNS = [
    "tconst", "titleType", "primaryTitle", "originalTitle",
    "startYear", "endYear", "runtimeMinutes", "genres", "averageRating", "numVotes",
]


def _non_blank(c: str):
    return F.col(c).isNotNull() & (F.col(c) != F.lit(""))


# --- titles ---------------------------------------------------------------

def titles_base(basics: DataFrame, p: EtlParams) -> DataFrame:
    """Kept title types within the year range; casts years and minutes."""
    df = basics.select(
        "tconst", "titleType", "primaryTitle", "originalTitle", "isAdult",
        F.col("startYear").cast("int").alias("startYear"),
        F.col("endYear").cast("int").alias("endYear"),
        F.col("runtimeMinutes").cast("int").alias("runtimeMinutes"),
        "genres",
    )
    cond = F.col("titleType").isin(list(p.title_types)) & F.col("startYear").between(p.year_lo, p.year_hi)
    if p.exclude_adult:
        cond = cond & (F.col("isAdult").cast("int") == F.lit(0))
    return df.where(cond)


def ratings_filtered(ratings: DataFrame, p: EtlParams) -> DataFrame:
    """Ratings with at least ``min_votes`` votes; rating as 32-bit float."""
    return ratings.select(
        "tconst",
        F.col("averageRating").cast("float").alias("averageRating"),
        F.col("numVotes").cast("int").alias("numVotes"),
    ).where(F.col("numVotes") >= F.lit(p.min_votes))


def titles_clean(base: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rated titles: inner join of the filtered titles and ratings on ``tconst``."""
    return base.join(ratings, "tconst", "inner").select(*TITLE_COLUMNS)


# --- genres ---------------------------------------------------------------

def genres_exploded(titles: DataFrame) -> DataFrame:
    """One row per (title, genre part); empty parts of 'Drama,' are kept."""
    return titles.where(_non_blank("genres")).select(
        "tconst", "titleType", "startYear",
        F.explode(split_list("genres")).alias("genre"),
        "averageRating", "numVotes",
    )


def genres_by_year(exploded: DataFrame) -> DataFrame:
    """Rollup per (year, genre, type): titles, mean rating (2 decimals), votes.

    Partial aggregation runs before the shuffle, so a dominant genre or year
    costs one pre-aggregated row per task, not its raw rows.
    """
    return exploded.groupBy("startYear", "genre", "titleType").agg(
        F.count(F.lit(1)).alias("count"),
        round_half_away(F.avg("averageRating"), 2).alias("avg_rating"),
        F.sum("numVotes").cast("bigint").alias("total_votes"),
    )


# --- directors ------------------------------------------------------------

def crew_of_kept_titles(crew: DataFrame, titles: DataFrame) -> DataFrame:
    """Crew rows with a director list, one for each kept title row they match."""
    crew = crew.select("tconst", "directors").where(_non_blank("directors"))
    return crew.join(titles.select("tconst"), "tconst", "inner").select("tconst", "directors")


def directors_exploded(crew_kept: DataFrame) -> DataFrame:
    return crew_kept.select("tconst", F.explode(split_list("directors")).alias("nconst"))


def people_base(people: DataFrame) -> DataFrame:
    return people.select(
        "nconst", "primaryName",
        F.col("birthYear").cast("int").alias("birthYear"),
        F.col("deathYear").cast("int").alias("deathYear"),
        "primaryProfession",
    )


DIRECTOR_COLUMNS = ["tconst", "nconst", "directorName", "primaryTitle", "startYear",
                    "titleType", "averageRating", "numVotes"]


def directors(crew: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """Director credits in two shuffles: crew x titles on ``tconst``, then people.

    Joining the crew rows to the titles before the explode does the existence
    test and fetches the title attributes in one pass; the exploded rows are
    then shuffled once, on ``nconst``. Where a title id occurs k times, a credit
    passes the existence test k times and meets k title rows, so each part is
    repeated k times per title row; k is counted on the partitioning that the
    join needs anyway.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy("tconst"))
    t = titles.select("tconst", "primaryTitle", "startYear", "titleType", "averageRating", "numVotes",
                      copies.cast("int").alias("copies"))
    parts = F.flatten(F.array_repeat(split_list("directors"), F.col("copies")))
    credited = (
        crew.select("tconst", "directors").where(_non_blank("directors"))
        .join(t, "tconst", "inner")
        .withColumn("nconst", F.explode(parts))
        .drop("directors", "copies")
    )
    names = people.select("nconst", F.col("primaryName").alias("directorName"))
    return credited.join(names, "nconst", "inner").select(*DIRECTOR_COLUMNS)


# --- actors ---------------------------------------------------------------

def principals_top_billed(principals: DataFrame, p: EtlParams) -> DataFrame:
    """Actor credits at billing position <= ``max_ordering`` (a filter, not a rank)."""
    return principals.select(
        "tconst", "nconst", "category", F.col("ordering").cast("int").alias("ordering")
    ).where(F.col("category").isin(list(p.actor_categories)) & (F.col("ordering") <= F.lit(p.max_ordering)))


def actors(principals: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """Top-billed credits with names and title attributes.

    The titles join comes first: it is the selective one (vote floor, years,
    types), so the people join sees only surviving credits.
    """
    t = titles.select("tconst", "primaryTitle", "startYear", "titleType", "averageRating", "numVotes")
    names = people.select("nconst", F.col("primaryName").alias("actorName"))
    return principals.join(t, "tconst", "inner").join(names, "nconst", "inner").select(
        "tconst", "nconst", "actorName", "category", "ordering", "primaryTitle",
        "startYear", "titleType", "averageRating", "numVotes",
    )


# --- regions --------------------------------------------------------------

def countries_base(akas: DataFrame, p: EtlParams) -> DataFrame:
    """Distinct (title, region) pairs with a region code of the given length.

    The de-duplication aggregates partially before its (tconst, region)
    shuffle, so even a title holding a third of all region rows leaves each
    task as at most one row per region; only then does the join shuffle on
    ``tconst``. (Shuffling the raw rows on ``tconst`` once would save a
    shuffle but send a hot title's raw rows to a single task.)
    """
    return (
        akas.select(F.col("titleId").alias("tconst"), "region")
        .where(_non_blank("region") & (F.length("region") == F.lit(p.region_length)))
        .distinct()
    )


def countries(base: DataFrame, titles: DataFrame) -> DataFrame:
    t = titles.select("tconst", "primaryTitle", "startYear", "titleType", "genres", "averageRating", "numVotes")
    return base.join(t, "tconst", "inner").select(
        "tconst", "region", "primaryTitle", "startYear", "titleType", "genres", "averageRating", "numVotes",
    )


# --- episodes -------------------------------------------------------------

def episodes_base(episode: DataFrame) -> DataFrame:
    return episode.select(
        "tconst", "parentTconst",
        F.col("seasonNumber").cast("int").alias("seasonNumber"),
        F.col("episodeNumber").cast("int").alias("episodeNumber"),
    ).where(F.col("seasonNumber").isNotNull() & F.col("episodeNumber").isNotNull())


def episodes(base: DataFrame, titles: DataFrame, p: EtlParams) -> DataFrame:
    """Episodes whose own title and whose parent series are both kept.

    Two joins against two projections of the titles: the episode side and the
    series side (type filter applied before the join). A series with very
    many episodes is a hot key of the second join; AQE splits that partition.
    """
    ep = titles.select(
        "tconst",
        F.col("primaryTitle").alias("episodeTitle"),
        F.col("startYear").alias("episodeYear"),
        F.col("averageRating").alias("episodeRating"),
        F.col("numVotes").alias("episodeVotes"),
    )
    series = titles.where(F.col("titleType").isin(list(p.series_types))).select(
        F.col("tconst").alias("parentTconst"),
        F.col("primaryTitle").alias("seriesTitle"),
        F.col("startYear").alias("seriesStartYear"),
    )
    return base.join(ep, "tconst", "inner").join(series, "parentTconst", "inner").select(
        F.col("tconst").alias("episodeId"),
        F.col("parentTconst").alias("seriesId"),
        "seasonNumber", "episodeNumber", "episodeTitle", "episodeYear",
        "episodeRating", "episodeVotes", "seriesTitle", "seriesStartYear",
    )


# --- whole pipeline -------------------------------------------------------

@dataclass(frozen=True)
class EtlStages:
    titles_base: DataFrame
    ratings_filtered: DataFrame
    titles_clean: DataFrame
    genres_exploded: DataFrame
    genres_by_year: DataFrame
    crew_of_kept_titles: DataFrame
    directors_exploded: DataFrame
    directors: DataFrame
    principals_top_billed: DataFrame
    actors: DataFrame
    countries_base: DataFrame
    countries: DataFrame
    episodes: DataFrame

    def gold(self) -> dict[str, DataFrame]:
        return {
            "titles_clean": self.titles_clean,
            "genres_by_year": self.genres_by_year,
            "directors": self.directors,
            "actors": self.actors,
            "countries": self.countries,
            "episodes": self.episodes,
        }


def build_stages(raw: RawSources, p: EtlParams, titles: DataFrame | None = None) -> EtlStages:
    """All ETL stages as lazy DataFrames.

    ``titles`` replaces the computed ``titles_clean`` downstream (``run_etl``
    passes the table it has just written, cutting the lineage there).
    """
    base = titles_base(raw.basics, p)
    rat = ratings_filtered(raw.ratings, p)
    tc = titles_clean(base, rat)
    t = tc if titles is None else titles
    gx = genres_exploded(t)
    crew = crew_of_kept_titles(raw.crew, t)
    pr = principals_top_billed(raw.principals, p)
    cb = countries_base(raw.akas, p)
    return EtlStages(
        titles_base=base,
        ratings_filtered=rat,
        titles_clean=tc,
        genres_exploded=gx,
        genres_by_year=genres_by_year(gx),
        crew_of_kept_titles=crew,
        directors_exploded=directors_exploded(crew),
        directors=directors(raw.crew, people_base(raw.people), t),
        principals_top_billed=pr,
        actors=actors(pr, people_base(raw.people_for_actors), t),
        countries_base=cb,
        countries=countries(cb, t),
        episodes=episodes(episodes_base(raw.episode), t, p),
    )


def build_gold(raw: RawSources, p: EtlParams) -> dict[str, DataFrame]:
    return build_stages(raw, p).gold()


def etl_row_counts(stages: EtlStages) -> DataFrame:
    """Row count of each reported stage: ``table, rows`` (one row per table)."""
    reported = {
        "titles_base": stages.titles_base,
        "ratings_filtered": stages.ratings_filtered,
        "titles_clean": stages.titles_clean,
        "directors": stages.directors,
        "actors": stages.actors,
        "episodes": stages.episodes,
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in reported.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def selected(titles: DataFrame, p: EtlParams) -> DataFrame:
    """``titles_clean``, read back, with its own filter said again. It keeps every
    row; but the optimizer builds a Bloom filter of a join's keys, and applies it
    at the scan of the large side, only where it sees that the small side is a
    selection."""
    return titles.where(F.col("numVotes") >= F.lit(p.min_votes))


#: Range order of the written tables; the id splits a dominant type and year.
GOLD_CLUSTERING = {
    "titles_clean": ["titleType", "startYear", "tconst"],
    "directors": ["titleType", "startYear", "tconst"],
    "actors": ["titleType", "startYear", "tconst"],
    "countries": ["titleType", "startYear", "tconst"],
    "episodes": ["seriesStartYear", "seriesId"],
}


TYPE_PARTITIONED = ("titles_clean", "directors", "actors", "countries")


def run_etl(
    spark: SparkSession,
    raw: RawSources,
    out_dir: str,
    p: EtlParams,
    concurrent_writes: int = 5,
    partition_by_type: bool = False,
    title_buckets: int | None = None,
) -> dict[str, str]:
    """Write the six gold tables under ``out_dir``; return their paths.

    All six are written into a folder of this run below ``out_dir`` and
    published together at the end, so a failed run leaves the last six as they
    were. ``titles_clean`` is written first and read back: the five other tables
    start from it rather than recomputing the title joins, and a lost executor
    is cheap to recover from. The five dependent writes are independent jobs,
    submitted from ``concurrent_writes`` driver threads.

    ``partition_by_type`` lays the title-keyed tables out in ``titleType=``
    folders. ``sources.read_gold`` restores the column order, which Spark
    changes for partition columns.

    ``title_buckets``, for raw tables landed in as many buckets
    (``sources.bucketed``), keeps a copy of the titles in buckets for the run, so
    that the title joins shuffle neither side.
    """
    from concurrent.futures import ThreadPoolExecutor

    root = out_dir.rstrip("/")
    run = f"{root}/_run-{uuid.uuid4().hex}"
    names = ("titles_clean", "genres_by_year", "directors", "actors", "countries", "episodes")

    def write(name: str, df: DataFrame) -> None:
        by_type = partition_by_type and name in TYPE_PARTITIONED
        write_table(df, f"{run}/{name}.parquet", cluster_by=GOLD_CLUSTERING.get(name),
                    sort_by=["startYear", "genre", "titleType"] if name == "genres_by_year" else None,
                    partition_by=["titleType"] if by_type else None)

    write("titles_clean", build_stages(raw, p).titles_clean)
    titles = selected(spark.read.parquet(f"{run}/titles_clean.parquet").select(*TITLE_COLUMNS), p)
    if title_buckets:
        by_id = f"{run}/_titles_by_id"
        write_bucketed(titles, by_id, "tconst", title_buckets)
        titles = selected(open_bucketed(spark, by_id, "tconst", title_buckets).select(*TITLE_COLUMNS), p)
    gold = build_stages(raw, p, titles=titles).gold()
    with ThreadPoolExecutor(max_workers=max(1, concurrent_writes)) as pool:
        for fut in [pool.submit(write, name, gold[name]) for name in names[1:]]:
            fut.result()  # re-raise the first failure
    if title_buckets:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(by_id)}")
    publish(spark, run, root, [f"{name}.parquet" for name in names])
    return {name: f"{root}/{name}.parquet" for name in names}
