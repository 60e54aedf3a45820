"""People analyses (directors or actors), grouped by display name.

People are grouped by name, so homonyms merge, and every credit row counts,
so a person credited twice on one title counts twice. ``name_col`` is
``directorName`` or ``actorName``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import decade, reported_mean
from marquee.operators import non_null_keys, top_k, top_k_per_group


def top_people_by_works(people: DataFrame, name_col: str, k: int = 15) -> DataFrame:
    """Most credited names: ``<name_col>, num_works`` (name asc on ties)."""
    per = non_null_keys(people, [name_col]).groupBy(name_col).agg(F.count(F.lit(1)).alias("num_works"))
    return top_k(per, [F.col("num_works").desc(), F.col(name_col).asc()], k)


def people_ratings(people: DataFrame, name_col: str) -> DataFrame:
    return non_null_keys(people, [name_col]).groupBy(name_col).agg(
        F.avg("averageRating").alias("avg_rating"), F.count("tconst").alias("num_works"))


def top_people_by_rating(
    people: DataFrame, name_col: str, min_works: int = 5, k: int = 15, digits: int | None = None
) -> DataFrame:
    """Best mean rating among names with at least ``min_works`` credits.

    ``<name_col>, avg_rating, num_works``; ranked by the unrounded mean, name
    asc on ties.
    """
    per = people_ratings(people, name_col).where(F.col("num_works") >= F.lit(min_works))
    return reported_mean(top_k(per, [F.col("avg_rating").desc(), F.col(name_col).asc()], k), digits)


def people_by_decade(people: DataFrame, name_col: str) -> DataFrame:
    """Credits per (decade, name): ``decade, <name_col>, count``."""
    d = non_null_keys(people.withColumn("decade", decade("startYear")), ["decade", name_col])
    return d.groupBy("decade", name_col).agg(F.count(F.lit(1)).alias("count"))


def top_people_per_decade(people: DataFrame, name_col: str, n: int = 3) -> DataFrame:
    """The ``n`` most credited names of each decade (name asc on ties).

    Decades are few and each holds many names; the partial window-group limit
    keeps at most n rows per decade per task before the decade shuffle.
    """
    per = people_by_decade(people, name_col)
    return top_k_per_group(per, ["decade"], [F.col("count").desc(), F.col(name_col).asc()], n)


def top_people_in_decade(people: DataFrame, name_col: str, n: int = 3, decade_value: int | None = None) -> DataFrame:
    """One decade of ``top_people_per_decade``; by default the latest decade.

    A given decade is fixed before anything is aggregated. The latest one is read
    off the per-decade ranking, in the same pass over the credits: the window over
    all rows sees ``n`` rows a decade at most.
    """
    if decade_value is None:
        last = F.max("decade").over(Window.partitionBy())
        return top_people_per_decade(people, name_col, n).withColumn("__last", last).where(F.col("decade") == F.col("__last")).drop("__last")
    credits = non_null_keys(people.withColumn("decade", decade("startYear")), ["decade", name_col])
    per = credits.where(F.col("decade") == F.lit(decade_value)).groupBy("decade", name_col).agg(F.count(F.lit(1)).alias("count"))
    return top_k_per_group(per, ["decade"], [F.col("count").desc(), F.col(name_col).asc()], n)


def distinct_decades(people: DataFrame, name_col: str, n: int = 3) -> DataFrame:
    """Decades offered by the picker, latest first: ``decade``.

    The picker lists the decades of the per-decade top-``n`` table; a decade
    is there exactly when it has any credit, so the window is not needed.
    """
    per = people_by_decade(people, name_col)
    return per.select("decade").distinct().orderBy(F.col("decade").desc())
