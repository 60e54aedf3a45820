"""Parameters of the ETL and of the analysis filters.

Every constant of the catalogue pipeline is a field here, so the same plan
functions run on the public catalogue files (``CATALOGUE_*`` defaults) and on
the driver's TPC-H-shaped test tables (``DRIVER_*``, see FIXTURES.md §4).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values of the catalogue pipeline (must match for equal results) ---
CATALOGUE_TITLE_TYPES = ("movie", "tvSeries", "tvMovie", "tvEpisode", "tvMiniSeries")
CATALOGUE_SERIES_TYPES = ("tvSeries", "tvMiniSeries")
CATALOGUE_ACTOR_CATEGORIES = ("actor", "actress")
CATALOGUE_PREFERRED_GENRES = ("Drama", "Comedy", "Action", "Thriller")
CATALOGUE_PREFERRED_REGIONS = ("US", "GB", "FR", "ES")
CELL_MEAN_DIGITS = 6


@dataclass(frozen=True)
class EtlParams:
    """Constants of the batch ETL (title, rating, credit and region filters)."""

    title_types: tuple[str, ...] = CATALOGUE_TITLE_TYPES
    year_lo: int = 1950
    year_hi: int = 2024
    min_votes: int = 1000
    series_types: tuple[str, ...] = CATALOGUE_SERIES_TYPES
    actor_categories: tuple[str, ...] = CATALOGUE_ACTOR_CATEGORIES
    max_ordering: int = 5
    region_length: int = 2
    # The catalogue README promises adult titles are dropped, the code never
    # does it; follow the code by default.
    exclude_adult: bool = False


@dataclass(frozen=True)
class TitleFilter:
    """The dashboard's global filter: year range, content types, rating floor."""

    year_lo: int = 1990
    year_hi: int = 2024
    types: tuple[str, ...] = ("movie", "tvSeries")
    min_rating: float = 5.0


@dataclass(frozen=True)
class AnalysisParams:
    """Everything an analysis needs beyond the global filter."""

    filter: TitleFilter = field(default_factory=TitleFilter)
    genre_min_rating: float | None = None  # rating floor on genre cells; None = filter's
    series_types: tuple[str, ...] = CATALOGUE_SERIES_TYPES
    min_works: int = 5
    min_productions: int = 50
    growth_span: int = 5
    preferred_genres: tuple[str, ...] = CATALOGUE_PREFERRED_GENRES
    preferred_regions: tuple[str, ...] = CATALOGUE_PREFERRED_REGIONS
    # members shown in the timelines; None = the picker's default selection
    selected_genres: tuple[str, ...] | None = None
    selected_regions: tuple[str, ...] | None = None
    # decade of the people tab and series of the season chart; None = the pickers' defaults
    decade: int | None = None
    series_title: str | None = None
    movie_type: str = "movie"
    # Means are reported at this many decimals (None: as they are); rankings use
    # the unrounded means. The mean of rounded genre cells is always rounded, to
    # CELL_MEAN_DIGITS: its last bits depend on the order of summation.
    rating_digits: int | None = None

    @property
    def genre_filter(self) -> TitleFilter:
        if self.genre_min_rating is None:
            return self.filter
        f = self.filter
        return TitleFilter(f.year_lo, f.year_hi, f.types, self.genre_min_rating)


# --- parameters used with the driver's TPC-H-shaped tables (FIXTURES.md §4) ---
DRIVER_ETL = EtlParams(
    title_types=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"),
    year_lo=1996,
    year_hi=2001,
    min_votes=50,
    series_types=("1-URGENT", "2-HIGH"),
    actor_categories=("A", "R"),
    max_ordering=5,
    region_length=9,
)

DRIVER_ANALYSIS = AnalysisParams(
    filter=TitleFilter(year_lo=1997, year_hi=2001, types=("1-URGENT", "3-MEDIUM"), min_rating=5.0),
    genre_min_rating=4.5,
    series_types=("1-URGENT", "2-HIGH"),
    min_works=75,
    min_productions=250,
    growth_span=2,
    preferred_genres=("ring", "gear", "bolt", "anvil"),
    preferred_regions=("NATION_10", "NATION_12", "NATION_17", "NATION_23"),
    selected_genres=("ring", "gear", "bolt", "anvil"),
    selected_regions=("NATION_10", "NATION_12", "NATION_17", "NATION_23"),
    movie_type="3-MEDIUM",
    rating_digits=6,
)
