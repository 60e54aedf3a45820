"""Command line: ``python -m marquee.cli {etl,verify,dashboard,land} ...``.

* ``etl``    raw catalogue folder (``*.tsv.gz`` or landed Parquet) -> six gold tables
* ``verify`` profile of a gold folder: rows, columns, nulls, sample, sizes, verdict
* ``dashboard`` every dashboard table for one set of filter values
* ``land``   convert the raw gz TSV files once to ZSTD Parquet

Reports are printed with ``DataFrame.show``; every number in them is
computed by Spark jobs, the driver only prints the small results.
"""

from __future__ import annotations

import argparse
import sys
import time

from marquee.config import EtlParams
from marquee.schemas import GOLD_TABLES


def _session(args):
    from marquee.session import build_session

    return build_session(args.master, shuffle_partitions=args.shuffle_partitions)


def cmd_etl(args) -> int:
    from marquee.plans import etl
    from marquee.sources import RawSources, land_raw_as_parquet, read_landed, read_raw_dir

    spark = _session(args)
    p = EtlParams(
        year_lo=args.year_lo, year_hi=args.year_hi, min_votes=args.min_votes,
        exclude_adult=args.exclude_adult,
    )
    t0 = time.time()
    if args.landed:
        raw = read_landed(spark, args.raw)
    elif args.raw_partitions or args.no_land:
        raw = read_raw_dir(spark, args.raw, args.raw_partitions)
    else:  # gzip files are one task each: one Parquet copy first, which splits
        land_raw_as_parquet(spark, args.raw, f"{args.out.rstrip('/')}/_landed")
        raw = read_landed(spark, f"{args.out.rstrip('/')}/_landed")
    paths = etl.run_etl(spark, RawSources.from_raw_dict(raw), args.out, p, partition_by_type=args.partition_by_type)
    from marquee.sources import read_gold

    counts = {n: df.count() for n, df in read_gold(spark, args.out).items()}
    for name, path in paths.items():
        print(f"{name}: {counts[name]:,} rows -> {path}")
    print(f"elapsed {time.time() - t0:.1f} s")
    return 0


def cmd_verify(args) -> int:
    from marquee.operators import dataset_summary, file_sizes, null_profile, open_tables, table_profile, table_sample

    spark = _session(args)
    reasons: dict[str, str] = {}
    tables = open_tables(spark, args.dir, GOLD_TABLES, verify_rows=True, reasons=reasons)
    for name, why in reasons.items():
        print(f"{name}: missing or unreadable: {why}")
    if not tables:
        print(f"no table under {args.dir}; run the etl command first")
        return 1
    table_profile(tables).show(truncate=False)
    null_profile(tables).show(100, truncate=False)
    for name, df in tables.items():
        print(name)
        table_sample(df, df.columns[:1], 3).show(truncate=False)
    file_sizes(spark, args.dir, args.limit_mb * 1024 * 1024).show(truncate=False)
    summary = dataset_summary(table_profile(tables), GOLD_TABLES)
    summary.show()
    return 0 if summary.first()["all_valid"] else 2


def cmd_dashboard(args) -> int:
    from marquee.config import AnalysisParams, TitleFilter
    from marquee.plans.dashboard import dashboard_views
    from marquee.sources import read_gold

    spark = _session(args)
    a = AnalysisParams(
        filter=TitleFilter(args.year_lo, args.year_hi, tuple(args.types), args.min_rating),
        min_works=args.min_works,
        min_productions=args.min_productions,
        selected_genres=tuple(args.genres) if args.genres else None,
        selected_regions=tuple(args.regions) if args.regions else None,
        decade=args.decade,
        series_title=args.series_title,
    )
    views, frames = dashboard_views(read_gold(spark, args.dir), a)
    unknown = [n for n in (args.only or []) if n not in frames]
    if unknown:
        print(f"unknown analyses: {', '.join(unknown)}; known: {', '.join(frames)}")
        return 2
    try:
        for name in args.only or frames:
            print(name)
            frames[name].show(args.rows, truncate=False)
    finally:
        views.unpersist()
    return 0


def cmd_land(args) -> int:
    from marquee.sources import land_raw_as_parquet

    spark = _session(args)
    land_raw_as_parquet(spark, args.raw, args.out, args.raw_partitions)
    print(f"landed raw files under {args.out}")
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="marquee")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)

    e = sub.add_parser("etl")
    e.add_argument("--raw", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--landed", action="store_true", help="--raw holds landed Parquet")
    e.add_argument("--raw-partitions", type=int, default=None, help="spread each raw file over so many tasks instead of landing it")
    e.add_argument("--no-land", action="store_true", help="read the raw files directly")
    e.add_argument("--year-lo", type=int, default=1950)
    e.add_argument("--year-hi", type=int, default=2024)
    e.add_argument("--min-votes", type=int, default=1000)
    e.add_argument("--exclude-adult", action="store_true")
    e.add_argument("--partition-by-type", action="store_true",
                   help="titleType= folders for the title-keyed tables (folder pruning on type filters)")
    e.set_defaults(fn=cmd_etl)

    v = sub.add_parser("verify")
    v.add_argument("--dir", required=True)
    v.add_argument("--limit-mb", type=int, default=100)
    v.set_defaults(fn=cmd_verify)

    d = sub.add_parser("dashboard", help="every dashboard table for one set of filter values")
    d.add_argument("--dir", required=True, help="gold tables folder")
    d.add_argument("--year-lo", type=int, default=1990)
    d.add_argument("--year-hi", type=int, default=2024)
    d.add_argument("--types", nargs="+", default=["movie", "tvSeries"])
    d.add_argument("--min-rating", type=float, default=5.0)
    d.add_argument("--min-works", type=int, default=5)
    d.add_argument("--min-productions", type=int, default=50)
    d.add_argument("--genres", nargs="*", help="timeline genres (default: the picker's default)")
    d.add_argument("--regions", nargs="*", help="timeline regions (default: the picker's default)")
    d.add_argument("--decade", type=int, default=None, help="people decade (default: latest)")
    d.add_argument("--series-title", default=None, help="season chart series (default: most seasons)")
    d.add_argument("--only", nargs="*", help="analysis names to show")
    d.add_argument("--rows", type=int, default=20)
    d.set_defaults(fn=cmd_dashboard)

    la = sub.add_parser("land")
    la.add_argument("--raw", required=True)
    la.add_argument("--out", required=True)
    la.add_argument("--raw-partitions", type=int, default=None)
    la.set_defaults(fn=cmd_land)

    args = ap.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
