"""Readers for the raw catalogue files (tab-separated, gzip, header, ``\\N`` = null)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.schemas import RAW_COLUMNS

RAW_FILES = {name: f"{name}.tsv.gz" for name in RAW_COLUMNS}


def read_raw(
    spark: SparkSession,
    path: str,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Read one raw catalogue file, or a folder of them, every column a string.

    * Every file is read by its own header, so files of one folder may order
      their columns differently; a missing column raises, naming file and
      column, and so does a row with more or fewer fields than its header.
    * Fields are cut at tabs only: quotes are literal. ``\\N`` is null, and an
      empty field stays an empty string. Casts happen later in the ETL, so a bad
      number fails the job instead of silently becoming null.
    * A ``.gz`` file is not splittable and arrives as one partition; pass
      ``partitions`` to spread it before the first wide operation, or land the
      files once as Parquet (``land_raw_as_parquet``) and read that instead.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise FileNotFoundError(f"no raw files under {path}")
    df = reduce(DataFrame.unionByName, [_read_file(spark, f, name) for f in files])
    return df.repartition(partitions) if partitions else df


def _read_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    lines = spark.read.text(path)
    head = lines.first()
    if head is None:
        raise ValueError(f"{path}: no header")
    header = head["value"].split("\t")
    missing = [c for c in RAW_COLUMNS[name] if c not in header]
    if missing:
        raise ValueError(f"{path}: missing column {', '.join(missing)}")
    fields = F.split("value", "\t", -1)
    checked = F.when(F.size(fields) == len(header), fields).otherwise(
        F.raise_error(F.concat(F.lit(f"{path}: not {len(header)} fields: "), F.col("value"))))
    rows = lines.where(F.col("value") != head["value"]).select(checked.alias("f"))
    return rows.select(*[F.nullif(F.col("f")[header.index(c)], F.lit("\\N")).alias(c) for c in RAW_COLUMNS[name]])


def read_raw_dir(spark: SparkSession, raw_dir: str, partitions: int | None = None) -> dict[str, DataFrame]:
    """All seven raw files of a catalogue folder, keyed by logical name.

    ``<name>.tsv.gz`` is read when present, else an uncompressed
    ``<name>.tsv`` (which, unlike gzip, Spark splits across tasks).
    """
    from pyspark.errors import AnalysisException

    root = raw_dir.rstrip("/")
    out = {}
    for name, fn in RAW_FILES.items():
        try:
            out[name] = read_raw(spark, f"{root}/{fn}", name, partitions)
        except AnalysisException:  # no gzip file: the uncompressed one
            out[name] = read_raw(spark, f"{root}/{name}.tsv", name, partitions)
    return out


def land_raw_as_parquet(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    partitions: int | None = None,
    concurrent_jobs: int = 7,
) -> None:
    """Convert each raw file once to ZSTD Parquet (splittable, columnar).

    Later ETL runs read the landed copy with full parallelism and column
    pruning instead of decompressing a single gzip stream per file. Each
    gzip file is one task whatever the cluster size, so the seven landings
    (independent jobs) are submitted together from driver threads rather
    than one after another.
    """
    from concurrent.futures import ThreadPoolExecutor

    root = out_dir.rstrip("/")
    frames = read_raw_dir(spark, raw_dir, partitions)

    def land(name: str) -> None:
        frames[name].write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")

    with ThreadPoolExecutor(max_workers=max(1, concurrent_jobs)) as pool:
        for fut in [pool.submit(land, name) for name in frames]:
            fut.result()  # re-raise the first failure


def read_landed(spark: SparkSession, landed_dir: str) -> dict[str, DataFrame]:
    """Raw tables previously written by ``land_raw_as_parquet``."""
    root = landed_dir.rstrip("/")
    return {name: spark.read.parquet(f"{root}/{name}") for name in RAW_COLUMNS}
