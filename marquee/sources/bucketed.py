"""Raw tables landed in buckets of the title id.

Every large raw table meets the kept titles on the title id. Landed in the same
number of buckets of that id, sorted within, the tables and the titles join
bucket by bucket: neither side is shuffled, in this run or any later one. The
price is one shuffle at landing, and that adaptive execution cannot split a
bucket: ``bucket_shares`` tells whether some id (a title with a third of all
credits) makes one bucket too large, and ``read_bucketed`` then leaves that
table's buckets unused, so that its joins shuffle and split as before.

The tables are files below one folder; the session's catalogue only names them,
so any session can open them with ``read_bucketed``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.raw import RawSources

#: Title id of every table that is joined on it.
TITLE_KEYS = {"basics": "tconst", "ratings": "tconst", "crew": "tconst", "principals": "tconst", "akas": "titleId", "episode": "tconst"}
#: Joined on the person id, after the titles: landed as they are.
OTHERS = ("people", "actor_people")
#: A bucket may hold this many times the mean of its table.
MAX_SHARE = 4.0


def table_name(path: str) -> str:
    return "landed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``df`` as files in ``buckets`` of ``key``: a file a bucket, sorted."""
    name = table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The files that ``write_bucketed`` wrote, with their buckets."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def land_bucketed(spark: SparkSession, raw: RawSources, root: str, buckets: int) -> None:
    """Writes all raw tables below ``root``; ``buckets`` should make files of
    some 256 MB of the largest table."""
    for name, key in TITLE_KEYS.items():
        write_bucketed(getattr(raw, name), f"{root}/{name}", key, buckets)
    for name in OTHERS:
        if getattr(raw, name) is not None:
            getattr(raw, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
    shares = bucket_shares(spark, root, buckets)
    spark.createDataFrame([(n, k, buckets, s) for (n, k), s in zip(TITLE_KEYS.items(), shares.values(), strict=True)],
                          "name string, key string, buckets int, share double").coalesce(1).write.mode("overwrite").json(f"{root}/_layout")


def bucket_shares(spark: SparkSession, root: str, buckets: int) -> dict[str, float]:
    """Rows of the largest bucket over the mean, by table."""
    out = {}
    for name, key in TITLE_KEYS.items():
        table = open_bucketed(spark, f"{root}/{name}", key, buckets)
        # The bucket function is the shuffle's own hash.
        held = table.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
        most, total = held.agg(F.max("n"), F.sum("n")).first()
        out[name] = most * buckets / total if total else 0.0
    return out


def read_bucketed(spark: SparkSession, root: str, max_share: float = MAX_SHARE) -> tuple[RawSources, int]:
    """The tables below ``root`` and the number of buckets. Tables with a bucket
    of over ``max_share`` times the mean come as plain scans."""
    layout = {r["name"]: r for r in spark.read.schema("name string, key string, buckets int, share double").json(f"{root}/_layout").collect()}
    tables: dict[str, DataFrame | None] = {}
    for name, r in layout.items():
        path = f"{root}/{name}"
        tables[name] = open_bucketed(spark, path, r["key"], r["buckets"]) if r["share"] <= max_share else spark.read.parquet(path)
    for name in OTHERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        tables[name] = spark.read.parquet(f"{root}/{name}") if there else None
    return RawSources(**tables), next(iter(layout.values()))["buckets"]
