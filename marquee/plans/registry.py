"""Registered queries over the driver's test tables.

Two layers:

* ``ANALYSES`` — each analysis as a function of the six gold tables (a dict
  of DataFrames), with the parameters of ``config.DRIVER_ANALYSIS``. The
  bench runs these on gold tables the ETL has written.
* ``QUERIES`` — ``(spark, sf_dir) -> DataFrame``: the ETL stages and every
  analysis computed from the tables in ``sf_dir`` through the catalogue
  mapping (``sources.testdata``) and the ETL (``config.DRIVER_ETL``).

Every query reads whole tables; nothing is sampled or capped except where a
top-k is the feature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from marquee.config import DRIVER_ANALYSIS as A
from marquee.config import DRIVER_ETL as P
from marquee.plans import dashboard, etl, genres, geography
from marquee.session import shared_folder
from marquee.sources.testdata import driver_sources

Gold = dict[str, DataFrame]
Analysis = Callable[[Gold], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def stages(spark: SparkSession, sf_dir: str) -> etl.EtlStages:
    return etl.build_stages(driver_sources(spark, sf_dir), P)


ANALYSES: dict[str, Analysis] = {
    **dashboard.analyses(A),
    # the other branch of the default pick: one preferred genre is absent
    "default_genres_fallback": lambda g: genres.default_genres(
        dashboard.Views(g, A).genre_cells, A.preferred_genres[:3] + ("no-such-genre",)),
    "default_regions_fallback": lambda g: geography.default_regions(
        dashboard.Views(g, A).regions, A.preferred_regions[:3] + ("no-such-region",)),
    # explicit picks, the pickers' default selections and an empty selection
    "directors_in_1990s": lambda g: dashboard.analyses(replace(A, decade=1990))["top_directors_in_decade"](g),
    "actors_in_1990s": lambda g: dashboard.analyses(replace(A, decade=1990))["top_actors_in_decade"](g),
    "season_ratings_of_title": lambda g: dashboard.analyses(replace(A, series_title="Title 228"))["season_ratings"](g),
    "genre_timeline_default": lambda g: dashboard.analyses(replace(A, selected_genres=None))["genre_timeline"](g),
    "country_timeline_default": lambda g: dashboard.analyses(replace(A, selected_regions=None))["country_timeline"](g),
    "genre_timeline_empty": lambda g: dashboard.analyses(replace(A, selected_genres=()))["genre_timeline"](g),
}
#: Analyses that read several gold tables: these share one checkpointed title join.
MANY_TABLES = ("table_profile", "null_profile", "dataset_summary", "season_ratings", "season_ratings_of_title", "series_kpis",
               "season_analysis", "series_most_seasons", "series_most_episodes", "series_picklist", "genre_timeline_default", "country_timeline_default")

ETL_STAGES = (
    "titles_base", "ratings_filtered", "titles_clean", "genres_exploded", "genres_by_year",
    "crew_of_kept_titles", "directors_exploded", "directors", "principals_top_billed", "actors",
    "countries_base", "countries", "episodes",
)


def shared_stages(spark: SparkSession, sf_dir: str) -> etl.EtlStages:
    """Stages that all start from one ``titles_clean``, checkpointed in the
    shared folder, so its joins run once a query. Nothing stays in the session:
    the files go with the last reference, where the cluster cleans checkpoints."""
    shared_folder(spark)
    raw = driver_sources(spark, sf_dir)
    titles = etl.build_stages(raw, P).titles_clean.checkpoint()
    return replace(etl.build_stages(raw, P, titles=titles), titles_clean=titles)


def _stage_query(name: str) -> Query:
    return lambda s, d: getattr(stages(s, d), name)


def _analysis_query(name: str, fn: Analysis) -> Query:
    built = shared_stages if name in MANY_TABLES else stages
    return lambda s, d: fn(built(s, d).gold())


QUERIES: dict[str, Query] = {
    **{name: _stage_query(name) for name in ETL_STAGES},
    "etl_row_counts": lambda s, d: etl.etl_row_counts(shared_stages(s, d)),
    **{name: _analysis_query(name, fn) for name, fn in ANALYSES.items()},
}

FLAGSHIP = "top_directors_per_decade"
