"""Sources: raw catalogue TSV files, gold Parquet tables, driver test tables."""

from marquee.sources.bucketed import land_bucketed, read_bucketed  # noqa: F401
from marquee.sources.gold import read_gold  # noqa: F401
from marquee.sources.raw import RawSources  # noqa: F401
from marquee.sources.testdata import driver_sources  # noqa: F401
from marquee.sources.tsv import land_raw_as_parquet, read_landed, read_raw, read_raw_dir  # noqa: F401
