"""A key holding a third of the rows: results stay exact and AQE splits the hot join partition."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.config import EtlParams
from marquee.plans import etl
from marquee.schemas import RAW_COLUMNS
from marquee.sources.raw import RawSources

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    df.collect()  # runs this DataFrame's own adaptive plan to its final form
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _raw(spark, name, df):
    cols = RAW_COLUMNS[name]
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*[F.col(c).cast("string") for c in cols])


@pytest.fixture()
def skewed_raw(spark):
    n_titles = 6000
    ids = spark.range(n_titles).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tconst"), "id")
    basics = ids.select(
        "tconst",
        F.when(F.col("id") % 10 == 0, "tvSeries").otherwise("movie").alias("titleType"),
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("primaryTitle"),
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("originalTitle"),
        F.lit("0").alias("isAdult"),
        (F.lit(1990) + F.col("id") % 30).cast("string").alias("startYear"),
        F.lit("Drama").alias("genres"),
    )
    ratings = ids.select("tconst", F.lit("7.0").alias("averageRating"), F.lit("5000").alias("numVotes"))
    # director d0 is credited on a third of all titles
    crew = ids.select("tconst", F.when(F.col("id") % 3 == 0, F.lit("d0"))
                      .otherwise(F.concat(F.lit("d"), (F.col("id") % 500 + 1).cast("string"))).alias("directors"))
    people = spark.range(501).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("nconst"),
                                     F.concat(F.lit("Name "), F.col("id").cast("string")).alias("primaryName"))
    # series t0 is the parent of a third of all episodes
    episode = ids.where(F.col("id") % 10 != 0).select(
        "tconst",
        F.when(F.col("id") % 3 == 0, F.lit("t0"))
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 60 * 10).cast("string"))).alias("parentTconst"),
        F.lit("1").alias("seasonNumber"), F.lit("1").alias("episodeNumber"))
    empty = spark.createDataFrame([], T.StructType([T.StructField("x", T.StringType())]))
    return RawSources(
        basics=_raw(spark, "title.basics", basics),
        ratings=_raw(spark, "title.ratings", ratings),
        crew=_raw(spark, "title.crew", crew),
        people=_raw(spark, "name.basics", people),
        principals=_raw(spark, "title.principals", empty),
        akas=_raw(spark, "title.akas", empty),
        episode=_raw(spark, "title.episode", episode),
    )


def test_hot_director_and_hot_series(spark, skew_conf, skewed_raw, tmp_out):
    p = EtlParams(title_types=("movie", "tvSeries", "tvEpisode"), year_lo=1900, year_hi=2100)
    # as in run_etl: dependent tables start from the written titles table
    etl.build_stages(skewed_raw, p).titles_clean.write.parquet(f"{tmp_out}/titles")
    st = etl.build_stages(skewed_raw, p, titles=spark.read.parquet(f"{tmp_out}/titles"))
    plan = _final_plan(st.directors)
    assert "isFinalPlan=true" in plan and "skew=true" in plan
    per = {r["directorName"]: r["count"] for r in st.directors.groupBy("directorName").count().collect()}
    assert per["Name 0"] == 2000 and sum(per.values()) == 6000

    eplan = _final_plan(st.episodes)
    assert "skew=true" in eplan
    hot = st.episodes.where("seriesId = 't0'").count()
    assert hot == sum(1 for i in range(6000) if i % 10 != 0 and i % 3 == 0)


def test_hot_title_regions_and_hot_actor(spark, skew_conf, skewed_raw, tmp_out):
    n = 6000
    ids = spark.range(n)
    # title t1 carries a third of all region rows (many duplicates of few regions)
    akas = ids.select(
        F.when(F.col("id") % 3 == 0, F.lit("t1"))
        .otherwise(F.concat(F.lit("t"), (F.col("id") % 2000).cast("string"))).alias("titleId"),
        F.concat(F.lit("R"), (F.col("id") % 7).cast("string")).alias("region"),
    )
    # person d0 holds a third of all actor credits
    principals = ids.select(
        F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")).alias("tconst"),
        F.lit("1").alias("ordering"),
        F.when(F.col("id") % 3 == 0, F.lit("d0"))
        .otherwise(F.concat(F.lit("d"), (F.col("id") % 500 + 1).cast("string"))).alias("nconst"),
        F.lit("actor").alias("category"),
    )
    raw = RawSources(**{**skewed_raw.__dict__,
                        "akas": _raw(spark, "title.akas", akas),
                        "principals": _raw(spark, "title.principals", principals)})
    p = EtlParams(title_types=("movie", "tvSeries", "tvEpisode"), year_lo=1900, year_hi=2100)
    etl.build_stages(raw, p).titles_clean.write.parquet(f"{tmp_out}/titles")
    st = etl.build_stages(raw, p, titles=spark.read.parquet(f"{tmp_out}/titles"))

    # the hot title reaches the join as at most one row per region
    assert st.countries_base.where("tconst = 't1'").count() == 7
    got = {(r["tconst"], r["region"]) for r in st.countries.collect()}
    want = {("t1" if i % 3 == 0 else f"t{i % 2000}", f"R{i % 7}") for i in range(n)}
    assert got == want

    plan = _final_plan(st.actors)
    assert "skew=true" in plan
    per = {r["actorName"]: r["count"] for r in st.actors.groupBy("actorName").count().collect()}
    assert per["Name 0"] == 2000 and sum(per.values()) == n
