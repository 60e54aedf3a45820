"""SparkSession construction and the shared checkpoint location."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the package assumes. Adaptive execution re-plans at
# runtime: it coalesces small shuffle partitions, splits skewed join
# partitions, and turns a sort-merge join into a broadcast join only when the
# measured size of one side is under the threshold below (the size check
# behind every broadcast the package does not hint itself).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Bloom filter of the kept title ids at the scans of credits, regions and
    # crew, under their shuffles. By Spark's defaults the kept titles of the
    # public files are too large to build it from (10 MB) and the raw tables too
    # small to apply it to (10 GB).
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "marquee",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package's base settings.

    ``shuffle_partitions`` should follow the data: roughly total shuffle bytes
    / 128 MB on a cluster; AQE coalesces whatever is too small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` wins. Only when it is unset (local
    tests) is ``fallback`` installed, so lineage cuts always land in a folder
    every executor can reach.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback:
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        return fallback
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where the session names none, one machine
    (master ``local``) gets a folder of its own; a cluster is asked to name one,
    as its executors would not see each other's files."""
    found = checkpoint_dir(spark)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
