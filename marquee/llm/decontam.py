"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words: texts are lower-cased in A-Z and cut at every byte that is
neither a digit, a letter a-z nor part of a non-ASCII character. Patterns are
the windows of ``window`` words of every benchmark item (an item of fewer words
is one window). Patterns of one length form a search of their own: a block is
the last two words at a position, the shift table says how far the search may
skip, blocks with shift 0 open a bucket of patterns by suffix block and first
word, and a direct comparison of the words confirms an occurrence.

The search runs in one pass over the documents, without a shuffle. The texts of
the items reach the executors in blocks of ``block_bytes`` at most (plus one
item). A larger benchmark takes as many passes over the same texts, one after the
other: each writes the finds of its block by row key and lets the block go, so a
worker never holds two; then the finds of a row meet. The tables are built on the
executors.

Defined cases: null or wordless texts have no words and no hits; null or empty
items have no window; a null item id is reported as the empty string; items
that repeat an id count once; an empty benchmark leaves every document clean;
an empty table gives an empty result. Rows that repeat a document are kept as
they are. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, hold, python_batches, scratch

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i:i + window])


class WuManber:
    """Search tables for patterns (tuples of words) of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.buckets.setdefault(pattern[-self.block:], {}).setdefault(pattern[0], []).append((pattern, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of every occurrence."""
        length, shift, default, block = self.length, self.shift.get, self.default, self.block
        end, n = length, len(words)
        while end <= n:
            last = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            skip = shift(last, default)
            if skip:
                end += skip
                continue
            start = end - length
            seen = None
            for pattern, items in self.buckets[last].get(words[start], ()):
                seen = seen or tuple(words[start:end])
                if pattern == seen:
                    yield start, items
            end += 1


def tables_of(items: list[tuple[str, str]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            by_length.setdefault(len(pattern), {}).setdefault(pattern, set()).add(item)
    return [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(items, token: str, window: int, all_rows: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Finds of a block's items per row; of ``all_rows`` or of those with finds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = hold(("leaks", token), lambda: tables_of(items.value, window))
        for batch in batches:
            kept, n_words, starts, ends, found = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                words = words_of(text)
                spans, hit = [], set()
                for t in tables:
                    for start, ids in t.find(words):
                        spans.append((start, start + t.length))
                        hit |= ids
                if all_rows or spans:
                    spans = merged(spans)
                    kept.append(i)
                    n_words.append(len(words))
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    found.append(sorted(hit))
            lists = {c: pd.Series(v, dtype=object) for c, v in (("starts", starts), ("ends", ends), ("items", found))}
            yield batch.drop(columns="text").iloc[kept].reset_index(drop=True).assign(n_words=pd.Series(n_words, dtype="int64"), **lists)
    return run


_FINDS = "n_words long, starts array<long>, ends array<long>, items array<string>"


def find_leaks(docs: DataFrame | Rows, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
               block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: id, n_words, starts and ends (merged word spans
    [start, end) inside occurrences), items (sorted ids as strings). ``docs`` as
    ``Rows`` may be asked for by row key."""
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    spark = tests.sparkSession
    python_batches(spark)

    def search(b: int, all_rows: bool):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.toLocalIterator()])
        return shared, _search(shared, uuid.uuid4().hex, window, all_rows)

    if blocks == 1:
        frame = docs.frame() if isinstance(docs, Rows) else docs
        out = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return out.mapInPandas(search(0, True)[1], f"id {out.schema['id'].dataType.simpleString()}, {_FINDS}").withColumnRenamed("id", id_col)

    # One pass after the other over the texts, each with its block alone; they
    # meet on the row keys.
    rows = docs if isinstance(docs, Rows) else Rows(docs)
    texts = rows.frame().select(F.col(id_col).alias("id"), F.col(rows.name).alias("row"), F.col(text_col).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, row long, {_FINDS}"
    path = scratch(spark, "leaks")
    for b in range(blocks):
        shared, run = search(b, b == 0)
        texts.mapInPandas(run, schema).write.mode("append").parquet(path)
        shared.destroy()

    @F.pandas_udf("struct<starts: array<long>, ends: array<long>>")
    def one(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        spans = [merged(list(zip(s, e, strict=True))) for s, e in zip(starts, ends, strict=True)]
        return pd.DataFrame({"starts": [[int(a) for a, _ in x] for x in spans], "ends": [[int(b) for _, b in x] for x in spans]})

    together = (spark.read.schema(schema).parquet(path).groupBy("row")
                .agg(F.any_value("id", True).alias("id"), F.max("n_words").alias("n_words"),
                     *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    spans = together.withColumn("spans", one("starts", "ends"))
    return spans.select(F.col("id").alias(id_col), "n_words", "spans.starts", "spans.ends", "items")


def digest(leaks: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    ids = [c for c in leaks.columns if c not in ("n_words", "starts", "ends", "items")]
    return leaks.select(*ids, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

