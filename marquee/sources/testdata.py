"""Catalogue-shaped view of the driver's TPC-H-style tables (FIXTURES.md §4).

The driver ships ``orders lineitem part supplier nation`` (plus tables with no
catalogue counterpart). This module derives the seven raw catalogue inputs
from them with DataFrame operations only (numbers as strings, as in raw files), so every query built on top reads
the driver tables and its work grows with them:

* basics     one row per order; type = order priority; year = order year;
             genres = name of the order's smallest part key, space -> comma
* ratings    per order: mean discount in percent points, votes = sum(quantity)
* crew       per order and block of 64 supplier keys: the distinct keys,
             comma-joined
* people     suppliers (directors) and parts (actors, homonyms by design)
* principals line items: part as person, return flag as category,
             line number as billing position
* akas       line item -> supplier -> nation name as region
* episode    orders: parent = customer key, season = quarter, episode = month
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.raw import RawSources

DRIVER_TABLES = ("orders", "lineitem", "part", "supplier", "nation")


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(c: str):
    return F.col(c).cast("string")


def _no_value(dtype: str):
    return F.lit(None).cast(dtype)


def driver_sources(spark: SparkSession, sf_dir: str) -> RawSources:
    """Raw catalogue inputs derived lazily from the tables in ``sf_dir``."""
    orders = read_driver_table(spark, sf_dir, "orders")
    lineitem = read_driver_table(spark, sf_dir, "lineitem")
    part = read_driver_table(spark, sf_dir, "part")
    supplier = read_driver_table(spark, sf_dir, "supplier")
    # No hint: Spark's size check broadcasts the (tiny) nation table by itself.
    nation = read_driver_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    first_part = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_partkey"))
    genre_of_part = part.select(
        F.col("p_partkey").alias("first_partkey"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(",")).alias("genres"),
    )
    title = F.concat(F.lit("Title "), (F.col("o_orderkey") % 500).cast("string"))
    basics = (
        orders.join(first_part, orders.o_orderkey == first_part.l_orderkey, "left")
        .join(genre_of_part, "first_partkey", "left")
        .select(
            _id("o_orderkey").alias("tconst"),
            F.col("o_orderpriority").alias("titleType"),
            title.alias("primaryTitle"),
            title.alias("originalTitle"),
            F.lit("0").alias("isAdult"),
            F.year("o_orderdate").cast("string").alias("startYear"),
            _no_value("int").alias("endYear"),
            _no_value("int").alias("runtimeMinutes"),
            "genres",
        )
    )

    ratings = lineitem.groupBy("l_orderkey").agg(
        (
            F.sum(F.round(F.col("l_discount") * F.lit(100.0)).cast("int")).cast("double")
            / F.count(F.lit(1))
        ).cast("float").alias("averageRating"),
        F.sum("l_quantity").cast("int").alias("numVotes"),
    ).select(_id("l_orderkey").alias("tconst"), _id("averageRating").alias("averageRating"), _id("numVotes").alias("numVotes"))

    # Director credits as comma lists, one crew row per (order, block of 64
    # supplier keys): a list has 64 ids at most, whatever the order's size.
    crew = lineitem.groupBy("l_orderkey", F.expr("l_suppkey div 64").alias("block")).agg(
        F.array_join(F.array_sort(F.collect_set(_id("l_suppkey"))), ",").alias("directors")
    ).select(_id("l_orderkey").alias("tconst"), "directors")

    def people_of(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(
            _id(key).alias("nconst"),
            F.col(name).alias("primaryName"),
            _no_value("string").alias("birthYear"),
            _no_value("string").alias("deathYear"),
            _no_value("string").alias("primaryProfession"),
        )

    principals = lineitem.select(
        _id("l_orderkey").alias("tconst"),
        F.col("l_linenumber").cast("string").alias("ordering"),
        _id("l_partkey").alias("nconst"),
        F.col("l_returnflag").alias("category"),
    )

    akas = (
        lineitem.select("l_orderkey", "l_suppkey")
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(_id("l_orderkey").alias("titleId"), F.col("n_name").alias("region"))
    )

    episode = orders.select(
        _id("o_orderkey").alias("tconst"),
        _id("o_custkey").alias("parentTconst"),
        F.quarter("o_orderdate").cast("string").alias("seasonNumber"),
        F.month("o_orderdate").cast("string").alias("episodeNumber"),
    )

    return RawSources(
        basics=basics,
        ratings=ratings,
        crew=crew,
        people=people_of(supplier, "s_suppkey", "s_name"),
        principals=principals,
        akas=akas,
        episode=episode,
        actor_people=people_of(part, "p_partkey", "p_name"),
    )
