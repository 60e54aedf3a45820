"""Column-level helpers built only from ``pyspark.sql.functions`` (JVM side)."""

from marquee.functions.scalar import (  # noqa: F401
    decade,
    isin_or_false,
    pct_change,
    reported_mean,
    round_half_away,
    split_list,
)
