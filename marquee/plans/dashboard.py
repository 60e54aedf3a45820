"""Every analysis of the dashboard as lazy DataFrames, for one set of parameters.

The catalogue dashboard recomputes all of its tabs from six tables whenever a
filter changes. ``dashboard_frames(gold, params)`` is that computation as a
dict of lazy DataFrames; nothing runs until the caller acts on one, and each
then runs as its own Spark job reading only the columns and row groups it
needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from marquee.config import AnalysisParams
from marquee.operators import (
    dataset_summary,
    episode_filter,
    null_profile,
    series_filter,
    table_profile,
    table_sample,
    title_filter,
)
from marquee.plans import genres, geography, people, series, trends
from marquee.schemas import GOLD_TABLES

Gold = Mapping[str, DataFrame]

PEOPLE_KINDS = (("directors", "directorName"), ("actors", "actorName"))


class Views:
    """The filtered views every tab starts from (lazy; built on access).

    With ``cache=True`` each filtered view is built once and persisted
    (memory, spilling to disk) the first time an analysis uses it, so all
    tabs reuse it, as the dashboard keeps its loaded tables between
    interactions. A lost cached block is rebuilt from its lineage, a Parquet
    scan plus a filter. Call ``unpersist()`` when the parameters change.
    """

    def __init__(self, gold: Gold, a: AnalysisParams, cache: bool = False):
        self.gold, self.a, self.cache = gold, a, cache
        self._kept: dict[str, DataFrame] = {}

    def _view(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.cache:
            return build()
        if key not in self._kept:
            self._kept[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[key]

    def unpersist(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    @property
    def titles(self) -> DataFrame:
        return self._view("titles", lambda: title_filter(self.gold["titles_clean"], self.a.filter))

    @property
    def genre_cells(self) -> DataFrame:
        return self._view("genres", lambda: title_filter(
            self.gold["genres_by_year"], self.a.genre_filter, rating_col="avg_rating"))

    def people(self, kind: str) -> DataFrame:
        return self._view(kind, lambda: title_filter(self.gold[kind], self.a.filter))

    @property
    def regions(self) -> DataFrame:
        return self._view("regions", lambda: title_filter(self.gold["countries"], self.a.filter))

    @property
    def episodes(self) -> DataFrame:
        return self._view("episodes", lambda: episode_filter(self.gold["episodes"], self.a.filter))

    @property
    def year_types(self) -> DataFrame:
        """Per (year, type) rollup of the filtered titles; every trend reads it."""
        return self._view("year_types", lambda: trends.year_type_rollup(self.titles))

    @property
    def series(self) -> DataFrame:
        return series_filter(self.titles, self.a.series_types)

    @property
    def seasons(self) -> DataFrame:
        return series.season_analysis(self.episodes, self.series, self.a.rating_digits)


def analyses(a: AnalysisParams, views: Views | None = None) -> dict[str, Callable[[Gold], DataFrame]]:
    """Name -> function of the gold tables, for parameters ``a``.

    ``views``: shared (possibly cached) filtered views to use instead of
    building fresh ones from the gold tables passed to each function.
    """
    d = a.rating_digits

    def v(g: Gold) -> Views:
        return views if views is not None else Views(g, a)

    out: dict[str, Callable[[Gold], DataFrame]] = {
        # filters
        "filtered_titles": lambda g: v(g).titles,
        "filtered_genres": lambda g: v(g).genre_cells,
        "filtered_episodes": lambda g: v(g).episodes,
        "filtered_series": lambda g: v(g).series,
        "filtered_title_ids": lambda g: trends.filtered_title_ids(v(g).titles),
        # trends
        "kpi_summary": lambda g: trends.kpi_summary(None, d, rollup=v(g).year_types),
        "titles_by_year_type": lambda g: trends.titles_by_year_type(None, rollup=v(g).year_types),
        "top_decade": lambda g: trends.top_decade(None, rollup=v(g).year_types),
        "production_growth": lambda g: trends.production_growth(
            None, a.filter.year_lo, a.filter.year_hi, a.growth_span, rollup=v(g).year_types),
        "rating_by_year": lambda g: trends.rating_by_year(None, d, rollup=v(g).year_types),
        "year_bounds": lambda g: trends.year_bounds(g["titles_clean"]),
        "movies_by_year": lambda g: trends.movies_by_year(g["titles_clean"], a.movie_type),
        # genres
        "top_genres": lambda g: genres.top_genres(v(g).genre_cells, 10),
        "top_rated_genres": lambda g: genres.top_rated_genres(v(g).genre_cells, 10),
        "genre_timeline": lambda g: genres.genre_timeline(
            v(g).genre_cells,
            a.selected_genres if a.selected_genres is not None
            else genres.default_genres(v(g).genre_cells, a.preferred_genres)),
        "distinct_genres": lambda g: genres.distinct_genres(v(g).genre_cells),
        "default_genres": lambda g: genres.default_genres(v(g).genre_cells, a.preferred_genres),
    }
    # people (directors and actors)
    for kind, name in PEOPLE_KINDS:
        out.update({
            f"top_{kind}_by_works": lambda g, k=kind, n=name: people.top_people_by_works(v(g).people(k), n, 15),
            f"top_{kind}_by_rating": lambda g, k=kind, n=name: people.top_people_by_rating(
                v(g).people(k), n, a.min_works, 15, d),
            f"{kind}_by_decade": lambda g, k=kind, n=name: people.people_by_decade(v(g).people(k), n),
            f"top_{kind}_per_decade": lambda g, k=kind, n=name: people.top_people_per_decade(v(g).people(k), n, 3),
            f"top_{kind}_in_decade": lambda g, k=kind, n=name: people.top_people_in_decade(
                v(g).people(k), n, 3, a.decade),
            f"{kind}_decades": lambda g, k=kind, n=name: people.distinct_decades(v(g).people(k), n, 3),
        })
    out.update({
        # geography
        "top_countries": lambda g: geography.top_countries(v(g).regions, 20),
        "top_rated_countries": lambda g: geography.top_rated_countries(v(g).regions, a.min_productions, 20, d),
        "country_timeline": lambda g: geography.country_timeline(
            v(g).regions,
            a.selected_regions if a.selected_regions is not None
            else geography.default_regions(v(g).regions, a.preferred_regions)),
        "distinct_regions": lambda g: geography.distinct_regions(v(g).regions),
        "default_regions": lambda g: geography.default_regions(v(g).regions, a.preferred_regions),
        # series
        "series_kpis": lambda g: series.series_kpis(v(g).series, v(g).episodes, d),
        "top_series": lambda g: series.top_series(v(g).series, 20),
        "season_analysis": lambda g: v(g).seasons,
        "series_most_seasons": lambda g: series.series_most_seasons(v(g).seasons, 15),
        "series_most_episodes": lambda g: series.series_most_episodes(v(g).seasons, 15),
        "series_picklist": lambda g: series.series_picklist(v(g).seasons, 100),
        "season_ratings": lambda g: series.season_ratings(v(g).episodes, v(g).seasons, a.series_title, d),
        # profile of the gold tables
        "table_profile": lambda g: table_profile({n: g[n] for n in GOLD_TABLES}),
        "null_profile": lambda g: null_profile({n: g[n] for n in GOLD_TABLES}),
        "table_sample": lambda g: table_sample(g["titles_clean"], ["tconst"], 3),
        "dataset_summary": lambda g: dataset_summary(table_profile({n: g[n] for n in GOLD_TABLES}), GOLD_TABLES),
    })
    return out


def dashboard_frames(gold: Gold, a: AnalysisParams | None = None) -> dict[str, DataFrame]:
    """All dashboard analyses over ``gold`` as lazy DataFrames (nothing cached)."""
    a = a or AnalysisParams()
    return {name: fn(gold) for name, fn in analyses(a).items()}


def dashboard_views(gold: Gold, a: AnalysisParams | None = None) -> tuple[Views, dict[str, DataFrame]]:
    """Cached filtered views plus every analysis built on them.

    Keep the ``Views`` to ``unpersist()`` them when the filter values change.
    """
    a = a or AnalysisParams()
    views = Views(gold, a, cache=True)
    return views, {name: fn(gold) for name, fn in analyses(a, views).items()}
