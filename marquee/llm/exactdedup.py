"""Exact dedup over an extendible-hash index on shared files. DataFrame only.

A key is the 64-bit hash of the normalised text (every ``[\\x20\\x09-\\x0D]``
deleted). The directory has 2^d cells, by the first d bits of the key. While a
bucket holds more distinct keys than ``bucket_keys`` it is split, which doubles
the directory when the bucket's local depth is the global one; the depths that
this doubling ends at are read off the counts of the cells. A bucket owns one
range of keys.

1. One pass makes narrow members (row key, id, key, digest). Only keys that two
   rows or more share can hold copies; their rows are marked (``Marks``) and read
   where they stand, so that no other text ever moves.
2. Owners: the marked rows' texts go to their bucket, combined before the shuffle
   by (bucket, key, bytes of the text), so a text with a third of all rows crosses
   the network once per task. Different texts of one key are a chain. The index
   (bucket, key, chain place and length, survivor, size; the text where the chain
   is longer than one) is written to the shared folder in ranges of buckets.
3. Lookup: a member finds its bucket through the directory and its entry by bucket
   and key. Members of longer chains are marked in turn and find their place by
   comparing bytes.

Defined cases: null text counts as empty; an empty table gives an empty result;
a null id ranks behind every id; rows that repeat an id with equal text are one
document written twice, and each of them carries the same mark. Other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Marks, Rows, scratch, written

#: The characters deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: The directory has 2^16 cells at most: the bound of what is broadcast.
MAX_DEPTH = 16
_TOP = "9223372036854775807"
_WORD = "18446744073709551616"


def _norm(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANKS, "")


def _key(norm: Column, key_bits: int) -> Column:
    """The first key_bits bits of the hash, kept unsigned in a long below 64."""
    key = F.xxhash64(norm)
    return key if key_bits == 64 else F.shiftrightunsigned(key, 64 - key_bits)


def directory(keys: DataFrame, bucket_keys: int, key_bits: int) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) for every used cell, and the directory's bits.
    ``bucket`` is the first cell of the bucket's range."""
    n = keys.count()
    bits = min(MAX_DEPTH, key_bits, max(0, math.ceil(math.log2(max(1, n / bucket_keys)))) + 4)
    cells = (keys.select(F.shiftrightunsigned("key", key_bits - bits).alias("cell") if bits else F.lit(0).cast("long").alias("cell"))
             .groupBy("cell").agg(F.count("*").alias("n")))
    prefix = F.expr(f"shiftrightunsigned(cell, {bits} - depth)")
    held = (cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
            .withColumn("prefix", prefix))
    full = held.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = held.join(full, ["depth", "prefix"]).where((F.col("held") <= bucket_keys) | (F.col("depth") == bits))
    chosen = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
    start = F.expr(f"shiftleft(shiftrightunsigned(cell, {bits} - depth), {bits} - depth)")
    return chosen.withColumn("bucket", start), bits


@dataclass(frozen=True)
class Index:
    """The directory (cell, depth, bucket; ``bits`` of a key name the cell) and
    the entries of keys that rows share."""
    cells: DataFrame
    bits: int
    entries: DataFrame
    key_bits: int

    def bucketed(self, members: DataFrame) -> DataFrame:
        """``members`` with the bucket that the directory names for their key."""
        cell = F.shiftrightunsigned("key", self.key_bits - self.bits) if self.bits else F.lit(0).cast("long")
        cells = F.broadcast(self.cells.select(F.col("cell").alias("_cell"), "bucket"))
        return members.join(cells, cell == F.col("_cell")).drop("_cell")


def _members(rows: Rows, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = rows.frame().select(F.col(rows.name).alias("row"), F.col(id_col).alias("id"), F.length(text).alias("points"), _norm(text_col).alias("norm"))
    return written(found.select("row", "id", "points", _key(F.col("norm"), key_bits).alias("key"),
                                F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")), "exact-members")


def _texts(rows: Rows, marked: DataFrame, id_col: str, text_col: str, key_bits: int, entries: int) -> list[DataFrame]:
    """(row, id, points, norm, key) of the marked rows, read in place, by passes."""
    marks = Marks(rows, marked.select(F.col("row").alias(rows.name), F.lit(1).alias("y")), entries)
    return [marks.read(runs).select(F.col(rows.name).alias("row"), F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
                                    _norm(text_col).alias("norm")).withColumn("key", _key(F.col("norm"), key_bits)) for runs in marks.passes]


def build(rows: Rows, members: DataFrame, id_col: str, text_col: str, bucket_keys: int, key_bits: int, entries: int) -> Index:
    """The index over ``members`` (as written by the first pass)."""
    held = written(members.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    cells, bits = directory(held.select("key"), bucket_keys, key_bits)
    index = Index(written(cells, "exact-directory"), bits, held, key_bits)
    shared = members.join(held.where("n > 1").select("key"), "key", "left_semi")

    # (code points, smaller id first) as one number, so that a plain max finds
    # the survivor and the aggregation stays hash-based.
    wide = F.lit(_WORD).cast("decimal(20,0)")
    place = (F.col("points").cast("decimal(10,0)") * wide
             + (F.lit(_TOP).cast("decimal(20,0)") - F.coalesce(F.col("id"), F.lit(_TOP).cast("long")).cast("decimal(20,0)")))
    owned = scratch(members.sparkSession, "exact-owned")
    schema = "bucket long, key long, norm string, place decimal(38,0), size long"
    texts = _texts(rows, shared, id_col, text_col, key_bits, entries)
    for some in texts:
        (index.bucketed(some).withColumn("place", place.cast("decimal(38,0)")).groupBy("bucket", "key", "norm")
         .agg(F.max("place").alias("place"), F.count("*").alias("size")).write.mode("append").parquet(owned))
    found = members.sparkSession.read.schema(schema).parquet(owned) if texts else members.sparkSession.createDataFrame([], schema)
    if len(texts) > 1:
        found = found.groupBy("bucket", "key", "norm").agg(F.max("place").alias("place"), F.sum("size").alias("size"))
    chain = Window.partitionBy("bucket", "key")
    chained = found.select("*", F.row_number().over(chain.orderBy("norm")).alias("chain"), F.count("*").over(chain).alias("length"))
    keep = (F.lit(_TOP).cast("decimal(20,0)") - F.col("place") % wide).cast("long")
    return Index(index.cells, bits, written(
        chained.select("bucket", "key", "chain", "length", F.when(keep != F.lit(_TOP).cast("long"), keep).alias("keep"), "size", F.when(F.col("length") > 1, F.col("norm")).alias("text"))
        .repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "exact-index"), key_bits)


def lookup(index: Index, rows: Rows, members: DataFrame, id_col: str, text_col: str, entries: int) -> DataFrame:
    """``members`` with keep and size: by bucket and key, and in chains by the
    text; null where the index has no entry."""
    at = ["bucket", "key"]
    alone = index.entries.where("length = 1").select(*at, "keep", "size")
    found = index.bucketed(members).join(alone, at, "left")
    chains = index.entries.where("length > 1")
    if chains.isEmpty():
        return found
    several = written(index.bucketed(members).join(chains.where("chain = 1").select(*at), at, "left_semi"), "exact-chained")
    placed = scratch(members.sparkSession, "exact-places")
    texts = _texts(rows, several, id_col, text_col, index.key_bits, entries)
    if not texts:
        return found
    for some in texts:
        met = index.bucketed(some).join(chains.select(*at, "text", F.col("keep").alias("keep_"), F.col("size").alias("size_")), at)
        met.where(F.col("norm") == F.col("text")).select("row", "keep_", "size_").write.mode("append").parquet(placed)
    there = members.sparkSession.read.parquet(placed)
    return (found.join(there, "row", "left")
            .select(*[c for c in found.columns if c not in ("keep", "size")], F.when(F.col("size_").isNull(), F.col("keep")).otherwise(F.col("keep_")).alias("keep"),
                    F.coalesce("size_", "size").alias("size")))


def exact_dedup(docs: DataFrame | Rows, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 20_000,
                key_bits: int = 64, entries: int = 1_000_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The survivor of a group has the most code points in its original text, then
    the smallest id. ``key_bits`` narrows the key (tests make collisions so);
    ``entries`` bounds a pass over marked rows. ``docs`` as ``Rows`` may be
    asked for by row key.
    """
    rows = docs if isinstance(docs, Rows) else Rows(docs)
    members = _members(rows, id_col, text_col, key_bits)
    index = build(rows, members, id_col, text_col, bucket_keys, key_bits, entries)
    found = lookup(index, rows, members, id_col, text_col, entries)
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep").cast(members.schema["id"].dataType))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
