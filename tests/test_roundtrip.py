"""gz TSV -> ETL -> ZSTD Parquet -> read -> profile."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from marquee.config import EtlParams
from marquee.operators import dataset_summary, file_sizes, null_profile, open_tables, table_profile, table_sample
from marquee.plans import etl
from marquee.schemas import GOLD_SCHEMAS, GOLD_TABLES
from marquee.sources import RawSources, land_raw_as_parquet, read_gold, read_landed, read_raw_dir

# Raw files carry more columns than the ETL reads; they must be tolerated.
FILES = {
    "title.basics": (
        ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear",
         "runtimeMinutes", "genres"],
        [
            ["tt1", "movie", '"Quoted" title', '"Quoted" title', "0", "2000", "\\N", "100", "Drama,Comedy"],
            ["tt2", "movie", '"open quote', "x", "0", "2001", "\\N", "\\N", "Drama"],
            ["tt3", "tvSeries", "Show", "Show", "0", "2002", "2005", "30", "\\N"],
            ["tt4", "tvEpisode", "Pilot", "Pilot", "0", "2002", "\\N", "30", "Drama"],
            ["tt5", "short", "Short", "Short", "0", "2000", "\\N", "5", "Drama"],
        ],
    ),
    "title.ratings": (["tconst", "averageRating", "numVotes"],
                      [["tt1", "7.5", "2000"], ["tt2", "6.1", "1500"], ["tt3", "8.2", "5000"],
                       ["tt4", "8.8", "1200"], ["tt5", "9.0", "9000"]]),
    "title.crew": (["tconst", "directors", "writers"],
                   [["tt1", "nm1,nm2", "\\N"], ["tt2", "\\N", "nm3"], ["tt3", "nm1", "\\N"]]),
    "name.basics": (["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"],
                    [["nm1", "Ann Lee", "1960", "\\N", "director", "tt1"],
                     ["nm2", "Bo Ray", "\\N", "\\N", "director", "\\N"],
                     ["nm3", "Cy Dee", "1970", "2020", "actor", "\\N"]]),
    "title.principals": (["tconst", "ordering", "nconst", "category", "job", "characters"],
                         [["tt1", "1", "nm3", "actor", "\\N", '["Hero"]'],
                          ["tt1", "6", "nm2", "actress", "\\N", "\\N"]]),
    "title.akas": (["titleId", "ordering", "title", "region", "language", "types", "attributes", "isOriginalTitle"],
                   [["tt1", "1", "A", "US", "\\N", "\\N", "\\N", "0"],
                    ["tt1", "2", "B", "US", "en", "\\N", "\\N", "0"],
                    ["tt1", "3", "C", "XWW", "\\N", "\\N", "\\N", "0"],
                    ["tt2", "1", "D", "\\N", "\\N", "\\N", "\\N", "1"]]),
    "title.episode": (["tconst", "parentTconst", "seasonNumber", "episodeNumber"],
                      [["tt4", "tt3", "1", "1"]]),
}

P = EtlParams(year_lo=1990, year_hi=2024)


def _write_gz(path, header, data):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\t".join(header) + "\n")
        for r in data:
            f.write("\t".join(r) + "\n")


@pytest.fixture(scope="module")
def raw_dir():
    import tempfile

    d = tempfile.mkdtemp(prefix="run-raw-", dir="/tmp")
    for name, (header, data) in FILES.items():
        _write_gz(os.path.join(d, f"{name}.tsv.gz"), header, data)
    return d


def test_tsv_reader_keeps_quotes_and_nulls(spark, raw_dir):
    raw = read_raw_dir(spark, raw_dir, partitions=4)
    b = {r["tconst"]: r for r in raw["title.basics"].collect()}
    assert b["tt1"]["primaryTitle"] == '"Quoted" title'
    assert b["tt2"]["primaryTitle"] == '"open quote' and b["tt2"]["originalTitle"] == "x"
    assert b["tt2"]["runtimeMinutes"] is None and b["tt3"]["genres"] is None
    assert raw["title.basics"].rdd.getNumPartitions() == 4


def test_etl_round_trip_and_profile(spark, raw_dir, tmp_out):
    raw = RawSources.from_raw_dict(read_raw_dir(spark, raw_dir))
    paths = etl.run_etl(spark, raw, f"{tmp_out}/gold", P)
    assert set(paths) == set(GOLD_TABLES)
    gold = read_gold(spark, f"{tmp_out}/gold")
    for name, df in gold.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in GOLD_SCHEMAS[name]]
    assert rows(gold["titles_clean"], "tconst") == [("tt1",), ("tt2",), ("tt3",), ("tt4",)]
    assert rows(gold["directors"], "tconst", "directorName") == [("tt1", "Ann Lee"), ("tt1", "Bo Ray"),
                                                                  ("tt3", "Ann Lee")]
    assert rows(gold["actors"], "tconst", "actorName") == [("tt1", "Cy Dee")]
    assert rows(gold["countries"], "tconst", "region") == [("tt1", "US")]
    assert rows(gold["episodes"], "episodeId", "seriesId") == [("tt4", "tt3")]
    g = gold["genres_by_year"].collect()
    assert [(r["startYear"], r["genre"], r["titleType"]) for r in g] == sorted(
        (r["startYear"], r["genre"], r["titleType"]) for r in g)  # written in key order

    opened = open_tables(spark, f"{tmp_out}/gold", list(GOLD_TABLES) + ["missing_table"])
    assert set(opened) == set(GOLD_TABLES)
    prof = {r["table"]: r for r in table_profile(opened).collect()}
    assert prof["titles_clean"]["rows"] == 4 and prof["titles_clean"]["columns"] == 10
    nulls = {(r["table"], r["column"]): (r["null_count"], r["null_pct"]) for r in null_profile(opened).collect()}
    assert nulls[("titles_clean", "endYear")] == (3, 75.0)
    assert nulls[("titles_clean", "genres")] == (1, 25.0)
    assert ("titles_clean", "tconst") not in nulls
    summary = dataset_summary(table_profile(opened), list(GOLD_TABLES) + ["missing_table"]).collect()[0]
    assert (summary["valid_tables"], summary["total_tables"], summary["all_valid"]) == (6, 7, False)
    assert [r["tconst"] for r in table_sample(gold["titles_clean"], ["tconst"], 3).collect()] == ["tt1", "tt2", "tt3"]

    sizes = {r["dataset"]: r for r in file_sizes(spark, f"{tmp_out}/gold").collect()}
    assert {f"{n}.parquet" for n in GOLD_TABLES} <= set(sizes)
    assert sizes["__total__"]["bytes"] == sum(sizes[f"{n}.parquet"]["bytes"] for n in GOLD_TABLES)
    assert sizes["__total__"]["over_limit"] is False


def test_landed_parquet_gives_same_gold(spark, raw_dir, tmp_out):
    land_raw_as_parquet(spark, raw_dir, f"{tmp_out}/landed")
    a = etl.build_gold(RawSources.from_raw_dict(read_landed(spark, f"{tmp_out}/landed")), P)
    b = etl.build_gold(RawSources.from_raw_dict(read_raw_dir(spark, raw_dir)), P)
    for name in GOLD_TABLES:
        assert rows(a[name]) == rows(b[name]), name


def test_cli_etl_then_verify(spark, raw_dir, tmp_out, capsys):
    from marquee.cli import main

    out = f"{tmp_out}/cli_gold"
    assert main(["etl", "--raw", raw_dir, "--out", out, "--year-lo", "1990"]) == 0
    assert "titles_clean: 4 rows" in capsys.readouterr().out
    assert main(["verify", "--dir", out]) == 0
    assert main(["verify", "--dir", f"{tmp_out}/nowhere"]) == 1


def test_dashboard_with_catalogue_defaults(spark, raw_dir, tmp_out):
    from marquee.config import AnalysisParams
    from marquee.plans.dashboard import dashboard_frames

    etl.run_etl(spark, RawSources.from_raw_dict(read_raw_dir(spark, raw_dir)), f"{tmp_out}/g", P)
    frames = dashboard_frames(read_gold(spark, f"{tmp_out}/g"), AnalysisParams(min_works=1, min_productions=1))
    got = {name: df.collect() for name, df in frames.items()}
    kpi = got["kpi_summary"][0]
    # movie and tvSeries titles from 1990 on with rating >= 5: tt1, tt2, tt3
    assert (kpi["total_titles"], kpi["top_year"]) == (3, 2000)
    assert [r["directorName"] for r in got["top_directors_by_works"]] == ["Ann Lee", "Bo Ray"]
    assert [(r["region"], r["count"]) for r in got["top_countries"]] == [("US", 1)]
    assert [r["primaryTitle"] for r in got["top_series"]] == ["Show"]
    # the only episode is rated 8.8 and its series started in 2002
    assert got["series_kpis"][0]["num_episodes"] == 1
    assert [(r["seasonNumber"], round(r["episodeRating"], 6)) for r in got["season_ratings"]] == [(1, 8.8)]
    # fewer than four genres present: the first ones in sorted order
    assert [r["genre"] for r in sorted(got["default_genres"], key=lambda r: r["position"])] == ["Comedy", "Drama"]


def test_cached_dashboard_views_equal_uncached(spark, raw_dir, tmp_out):
    from marquee.config import AnalysisParams
    from marquee.plans.dashboard import dashboard_frames, dashboard_views

    etl.run_etl(spark, RawSources.from_raw_dict(read_raw_dir(spark, raw_dir)), f"{tmp_out}/g", P)
    gold = read_gold(spark, f"{tmp_out}/g")
    a = AnalysisParams(min_works=1, min_productions=1)
    views, cached = dashboard_views(gold, a)
    plain = dashboard_frames(gold, a)
    for name in ("kpi_summary", "top_directors_per_decade", "season_analysis", "top_countries"):
        assert rows(cached[name]) == rows(plain[name]), name
    assert views.titles.storageLevel.useMemory
    views.unpersist()
    assert not views._kept


def test_open_tables_skips_damaged_files(spark, tmp_out):


    import pyarrow as pa
    import pyarrow.parquet as pq

    spark.range(100).write.parquet(f"{tmp_out}/good.parquet")
    # A file without a Hadoop checksum companion, so only its pages are damaged:
    # the footer opens, the scan fails.
    f = f"{tmp_out}/bad.parquet"
    pq.write_table(pa.table({"id": list(range(100000))}), f)
    size = os.path.getsize(f)
    with open(f, "r+b") as fh:  # keep magic and footer, damage the data pages between
        fh.seek(size - 8)
        footer_len = int.from_bytes(fh.read(4), "little")
        fh.seek(4)
        fh.write(b"\xff" * (size - 8 - footer_len - 4))
    assert set(open_tables(spark, tmp_out, ["good", "bad", "none"], verify_rows=True)) == {"good"}
    assert set(open_tables(spark, tmp_out, ["good", "bad", "none"])) == {"good", "bad"}


def test_type_partitioned_layout(spark, raw_dir, tmp_out):
    import contextlib
    import io

    from marquee.config import TitleFilter
    from marquee.operators import title_filter

    raw = RawSources.from_raw_dict(read_raw_dir(spark, raw_dir))
    etl.run_etl(spark, raw, f"{tmp_out}/plain", P)
    etl.run_etl(spark, raw, f"{tmp_out}/parted", P, partition_by_type=True)
    assert os.path.isdir(f"{tmp_out}/parted/titles_clean.parquet/titleType=movie")
    a, b = read_gold(spark, f"{tmp_out}/plain"), read_gold(spark, f"{tmp_out}/parted")
    for name in GOLD_TABLES:
        assert b[name].schema == a[name].schema, name  # canonical column order restored
        assert rows(b[name]) == rows(a[name]), name
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        title_filter(b["directors"], TitleFilter(1990, 2024, ("movie",), 5.0)).explain("formatted")
    import re

    assert re.search(r"PartitionFilters: \[isnotnull\(titleType#\d+\), \(titleType#\d+ = movie\)\]", buf.getvalue())


def test_cli_dashboard(spark, raw_dir, tmp_out, capsys):
    from marquee.cli import main

    out = f"{tmp_out}/dash_gold"
    assert main(["etl", "--raw", raw_dir, "--out", out, "--year-lo", "1990"]) == 0
    capsys.readouterr()
    assert main(["dashboard", "--dir", out, "--min-works", "1", "--series-title", "Show",
                 "--only", "kpi_summary", "season_ratings", "top_directors_in_decade"]) == 0
    text = capsys.readouterr().out
    assert "total_titles" in text and "Ann Lee" in text and "8.8" in text
    assert main(["dashboard", "--dir", out, "--only", "no_such_table"]) == 2


def test_uncompressed_raw_files(spark, raw_dir, tmp_out):
    import shutil

    plain = f"{tmp_out}/plain_raw"
    os.makedirs(plain)
    for name in FILES:
        src = os.path.join(raw_dir, f"{name}.tsv.gz")
        if name == "title.basics":  # one table uncompressed, the others as gzip
            with gzip.open(src, "rb") as fin, open(f"{plain}/{name}.tsv", "wb") as fout:
                fout.write(fin.read())
        else:
            shutil.copy(src, plain)
    a = etl.build_gold(RawSources.from_raw_dict(read_raw_dir(spark, plain)), P)
    b = etl.build_gold(RawSources.from_raw_dict(read_raw_dir(spark, raw_dir)), P)
    assert rows(a["titles_clean"]) == rows(b["titles_clean"])


def _tsv(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_reader_by_header_and_strict(spark, tmp_out):
    from marquee.sources.tsv import read_raw

    both = f"{tmp_out}/ratings"
    _tsv(both, "a.tsv", ["tconst\taverageRating\tnumVotes", "t1\t7.0\t2000"])
    _tsv(both, "b.tsv", ["numVotes\textra\ttconst\taverageRating", "30\tx\tt2\t\\N"])
    assert rows(read_raw(spark, both, "title.ratings")) == [("t1", "7.0", "2000"), ("t2", None, "30")]
    _tsv(f"{tmp_out}/bad", "c.tsv", ["title_id\taverageRating\tnumVotes", "t1\t7.0\t2000"])
    with pytest.raises(ValueError, match="c.tsv: missing column tconst"):
        read_raw(spark, f"{tmp_out}/bad", "title.ratings")
    _tsv(f"{tmp_out}/short", "d.tsv", ["tconst\taverageRating\tnumVotes", "t1\t7.0"])
    with pytest.raises(Exception, match="not 3 fields"):
        read_raw(spark, f"{tmp_out}/short", "title.ratings").collect()
    _tsv(f"{tmp_out}/blank", "e.tsv", ["titleId\tregion", "t1\t", "t2\t\\N", 't3\t"US'])
    assert rows(read_raw(spark, f"{tmp_out}/blank", "title.akas")) == [("t1", ""), ("t2", None), ("t3", '"US')]


def test_failed_table_leaves_the_old_six(spark, raw_dir, tmp_out):
    from dataclasses import replace

    raw = RawSources.from_raw_dict(read_raw_dir(spark, raw_dir))
    paths = etl.run_etl(spark, raw, tmp_out, EtlParams())
    before = {n: sorted(os.listdir(p)) for n, p in paths.items()}
    broken = replace(raw, akas=raw.akas.withColumn("region", F.when(F.length("region") > 0, F.raise_error(F.concat(F.lit("bad region"), F.col("region"))).cast("string"))))
    with pytest.raises(Exception, match="bad region"):
        etl.run_etl(spark, broken, tmp_out, EtlParams())
    assert {n: sorted(os.listdir(p)) for n, p in paths.items()} == before


def test_type_filter_can_skip_files(spark, tmp_out):
    import glob

    import pyarrow.parquet as pq

    from marquee.sinks import write_table

    df = spark.range(4000).select(F.concat(F.lit("t"), F.col("id") % 4).alias("titleType"), (F.col("id") % 30).alias("startYear"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(df, f"{tmp_out}/t.parquet", cluster_by=["titleType", "startYear", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    spans = [pq.read_metadata(f).row_group(0).column(0).statistics for f in glob.glob(f"{tmp_out}/t.parquet/*.parquet")]
    assert len(spans) > 3
    assert sum(x.min <= "t2" <= x.max for x in spans) <= len(spans) / 2


def test_sizes_under_an_underscore_folder(spark, tmp_out):
    from marquee.operators import file_sizes

    spark.range(5).write.parquet(f"{tmp_out}/_stage/gold/a.parquet")
    got = {r["dataset"]: r["bytes"] for r in file_sizes(spark, f"{tmp_out}/_stage/gold").collect()}
    assert set(got) == {"a.parquet", "__total__"} and got["a.parquet"] == got["__total__"] > 0


def test_verdict_counts_missing_and_damaged(spark, raw_dir, tmp_out):
    import glob

    from marquee.operators import dataset_summary, open_tables, table_profile
    from marquee.schemas import GOLD_TABLES

    paths = etl.run_etl(spark, RawSources.from_raw_dict(read_raw_dir(spark, raw_dir)), tmp_out, EtlParams())
    os.rename(paths["actors"], f"{tmp_out}/elsewhere")
    for f in glob.glob(f"{paths['countries']}/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not parquet")
    reasons = {}
    tables = open_tables(spark, tmp_out, GOLD_TABLES, verify_rows=True, reasons=reasons)
    assert set(reasons) == {"actors", "countries"} and all(reasons.values())
    assert tuple(dataset_summary(table_profile(tables), GOLD_TABLES).first()) == (4, 6, False)
