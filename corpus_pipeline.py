"""Training-corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's input; all but the last return
the columns of ``documents``. The stages decide per row: a row is named by its
place in the files of the stage's input, so rows that repeat a doc_id (the null
id, too) stay or go each by itself. Extra columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontam, exactdedup, langid, packing, simhash
from marquee.llm.common import Rows, fold, free_name, table, written
from marquee.llm.queries import PACK_TOKENIZER, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: null and letterless texts go, and texts
    of which no n-gram belongs to any learned language."""
    learnt = docs.select("doc_id", "text", "lang")
    model = langid.learn(learnt, F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    name = free_name(docs, "_found")
    found = docs.select("*", langid.predictor(spark, model)(F.col("text")).alias(name))
    return found.where((F.col(f"{name}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{name}.score") > 0)).drop(name)


#: Row keys (8 bytes each) that may be broadcast; more of them meet the
#: documents in a shuffle join.
BROADCAST_ROWS = 4_000_000


def _without(docs: DataFrame, dropped: DataFrame, row: str, name: str) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``dropped`` (keys only), without
    the key. The keys are counted first, so that whole texts are shuffled only
    if need be."""
    keys = written(dropped, f"dropped-{name}")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, row, "left_anti").drop(row)


def _first_of_groups(docs: DataFrame, found: DataFrame, row: str, group: str, name: str, *order: Column) -> DataFrame:
    """The rows of ``docs`` that come first in their group of ``found`` (row
    key, ``group``), by ``order``, then doc_id (null last), then the row key."""
    found = written(found.select(row, group), f"groups-{name}")
    rank = F.struct(*order, F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row"))
    first = (found.join(docs.select(row, rank.alias("rank")), row).groupBy(group).agg(F.min("rank").alias("first"))
             .select(F.col("first.row").alias(row)))
    return _without(docs, found.select(row).join(first, row, "left_anti"), row, name)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of equal texts: the most code points, then
    the smallest id."""
    rows = Rows(docs)
    points = F.length(F.coalesce(F.col("text"), F.lit("")))
    return _first_of_groups(rows.frame(), exactdedup.exact_dedup(rows, id_col=rows.name), rows.name, "keep_id", "exact", -points)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component: the smallest id."""
    rows = Rows(docs)
    found = simhash.near_dedup(rows.frame(), shingle=4, radius=4, id_col=rows.name)
    return _first_of_groups(rows.frame(), found, rows.name, "component_id", "simhash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a word inside an occurrence of a benchmark window."""
    rows = Rows(docs)
    found = decontam.digest(decontam.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col=rows.name))
    return _without(rows.frame(), found.where("contaminated").select(rows.name), rows.name, "leaks")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row per piece."""
    packed = packing.pack_documents(docs, tokenizer_path(PACK_TOKENIZER), end_id=2, seq_len=4096)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language ID, SimHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
