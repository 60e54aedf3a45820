"""marquee — title-catalogue analytics on Spark.

Batch ETL from raw catalogue files (titles, ratings, crew, credits, people,
regional releases, episodes) to six columnar gold tables, and parameterised
analyses over them (trends, genres, people, geography, series, profiles).

Every public function takes DataFrames and plain parameters and returns a
lazy DataFrame; nothing is collected to the driver.

    from marquee import build_session, read_raw_dir, RawSources, run_etl, read_gold, dashboard_frames
"""

from marquee.config import AnalysisParams, EtlParams, TitleFilter  # noqa: F401
from marquee.plans.dashboard import dashboard_frames, dashboard_views  # noqa: F401
from marquee.plans.etl import build_gold, build_stages, run_etl  # noqa: F401
from marquee.session import build_session  # noqa: F401
from marquee.sources import RawSources, read_gold, read_landed, read_raw_dir  # noqa: F401

__version__ = "0.1.0"
