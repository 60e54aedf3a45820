"""Title joins of the ETL: keys filtered at the scan, and no shuffle on landed buckets."""

from __future__ import annotations

from dataclasses import replace

import pytest
from marquee.config import DRIVER_ETL as P
from marquee.plans import etl
from marquee.sources import driver_sources, land_bucketed, read_bucketed
from marquee.sources.raw import RawSources
from tests.conftest import SF_SMALL, rows

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


@pytest.fixture()
def shuffled(spark):
    old = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('landed')}"
    raw = driver_sources(spark, SF_SMALL)
    land_bucketed(spark, raw, f"{root}/raw", 4)
    etl.run_etl(spark, raw, f"{root}/gold", P)
    etl.build_stages(raw, P).titles_clean.write.parquet(f"{root}/titles")
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_titles_filter_the_large_scans(shuffled, landed):
    """A Bloom filter of the kept ids stands below the shuffle of each large side."""
    titles = etl.selected(shuffled.read.parquet(f"{landed}/titles"), P)
    parquet = {n: shuffled.read.parquet(f"{landed}/raw/{n}") for n in ("principals", "akas", "crew")}
    raw = replace(driver_sources(shuffled, SF_SMALL), **parquet)
    stages = etl.build_stages(raw, P, titles=titles)
    for name in ("crew_of_kept_titles", "actors", "countries"):
        lines = plan(getattr(stages, name)).splitlines()
        at = next(i for i, line in enumerate(lines) if "might_contain" in line)
        assert any("Exchange hashpartitioning" in line for line in lines[:at]), name
    want = shuffled.read.parquet(f"{landed}/gold/countries.parquet")
    assert rows(stages.countries) == rows(want.select(*stages.countries.columns))


def test_bucketed_tables_join_without_a_shuffle(shuffled, landed):
    raw, buckets = read_bucketed(shuffled, f"{landed}/raw")
    assert buckets == 4
    titles = shuffled.read.parquet(f"{landed}/titles")
    etl.write_bucketed(titles, f"{landed}/by_id", "tconst", buckets)
    stages = etl.build_stages(raw, P, titles=etl.selected(etl.open_bucketed(shuffled, f"{landed}/by_id", "tconst", buckets), P))
    for name in ("titles_clean", "crew_of_kept_titles", "countries"):
        df = getattr(stages, name)
        assert "Exchange hashpartitioning" not in plan(df), name
        assert "SortMergeJoin" in plan(df) or "ShuffledHashJoin" in plan(df)
    # Beyond the title join, only the people are shuffled, on their own id.
    for name in ("directors", "actors"):
        assert "hashpartitioning(tconst" not in plan(getattr(stages, name)), name
    for name in ("directors", "actors", "countries", "episodes"):
        want = shuffled.read.parquet(f"{landed}/gold/{name}.parquet")
        got = getattr(stages, name)
        assert rows(got) == rows(want.select(*got.columns)), name


def test_etl_on_buckets_writes_the_same_tables(spark, landed):
    raw, buckets = read_bucketed(spark, f"{landed}/raw")
    tables = len(spark.catalog.listTables())
    paths = etl.run_etl(spark, raw, f"{landed}/gold2", P, title_buckets=buckets)
    assert len(spark.catalog.listTables()) == tables
    for name, path in paths.items():
        got, want = spark.read.parquet(path), spark.read.parquet(f"{landed}/gold/{name}.parquet")
        assert rows(got) == rows(want.select(*got.columns)), name


def test_a_hot_title_keeps_its_table_out_of_the_buckets(spark, landed, tmp_path):
    raw = driver_sources(spark, SF_SMALL)
    n = raw.principals.count()
    one = raw.principals.limit(1).crossJoin(spark.range(n)).drop("id")
    hot: RawSources = replace(raw, principals=raw.principals.unionByName(one))
    root = f"file://{tmp_path}/raw"
    land_bucketed(spark, hot, root, 16)
    got, _ = read_bucketed(spark, root)
    shuffled_on_id = "Exchange hashpartitioning(tconst"
    assert shuffled_on_id not in plan(got.crew.groupBy("tconst").count())
    assert shuffled_on_id in plan(got.principals.groupBy("tconst").count())
    assert got.principals.count() == 2 * n
