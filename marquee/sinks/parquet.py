"""Parquet sink (ZSTD, replace on write)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame,
    path: str,
    sort_by: Sequence[str] | None = None,
    partition_by: Sequence[str] | None = None,
    cluster_by: Sequence[str] | None = None,
) -> None:
    """Write ``df`` as ZSTD Parquet, replacing any previous output.

    ``sort_by`` gives the file a total order (range-partitioned sort; use it
    only for small tables such as the genre rollup). ``partition_by`` lays
    the table out in folders so filters on those columns prune whole folders.
    ``cluster_by`` range-partitions on those columns and sorts inside each
    task, so every file (and row group) covers a narrow range of them and
    pushed-down filters skip files by their statistics; how many files there
    are follows the data size (adaptive coalescing of the range partitions).
    The write is a Spark job with task retries and an atomic commit, so a lost
    executor re-runs its tasks and never leaves a half-written table behind.
    """
    if sort_by:
        df = df.orderBy(*sort_by)
    elif cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def publish(spark: SparkSession, run_dir: str, root: str, names: Sequence[str]) -> None:
    """Move the finished tables of a run below ``root``, replacing the old ones.

    Only renames and deletions within one file system, after every write is
    done; the run folder is removed.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        if fs.exists(path(f"{root}/{name}")):
            fs.rename(path(f"{root}/{name}"), path(f"{run_dir}/_old-{name}"))
        if not fs.rename(path(f"{run_dir}/{name}"), path(f"{root}/{name}")):
            raise OSError(f"cannot publish {name} under {root}")
    fs.delete(path(run_dir), True)
