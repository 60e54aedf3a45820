"""Packing into sequences of a fixed length by cutting-stock column generation.

Token counts first: texts go through the tokenizer once, on the executors. A
document longer than a sequence gives whole sequences and a rest, so the rests
are what is packed. Their lengths, rounded up to ``grain``, form a histogram of
``seq_len / grain`` classes at most, whatever the corpus; that is all the driver
sees. It solves the linear program over cutting patterns (Gilmore-Gomory): the
simplex prices new columns with a knapsack dynamic program over the duals.
Rounded-down pattern counts are taken as they are, and what demand remains is
packed first-fit by decreasing class. The rests of a class are ranked (counts
per slice of the class, then a rank within the slice), and rank r of a class
takes the r-th place that the patterns have for it. Offsets are running sums of
the true lengths, so sequences are gapless; only the rounding and the last few
patterns leave padding.

Defined cases: null text is empty, and an empty text is its end id alone;
repeated rows are documents of their own; an empty table gives an empty result;
ties between equal lengths go by a hash of the id and the piece's checksum.
Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, hold, python_batches, written

#: Rows of one slice of a class, about.
SLICE = 50_000
#: A run of letters that lower-case and compose to themselves, then ASCII marks:
#: both halves are tokens of their own for a pre-tokenizer that cuts there.
_PLAIN = re.compile(r"([A-Za-zß-öø-ÿ]*)([!-&(-/:;=>?@\[-`{}~]*)")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, through a cache by word.

    For a tokenizer that drops white space and never merges across it. Words
    of letters, or of marks, are looked up by themselves; every other word goes
    whole through the tokenizer, and so does a text with a control character
    that Python takes for a blank and the tokenizer does not.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Recent(self.word, 72 << 20)
        self.model = self.tokenizer.model
        self.mapped = str.maketrans(_byte_letters())

    def encoded(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, s: str) -> bytes:
        """Of one pre-token: the model alone, past normalizer and cutter."""
        # Printable ASCII stands for itself.
        units = s if s.isascii() else s.encode("utf-8").decode("latin-1").translate(self.mapped)
        return pack_ids([t.id for t in self.model.tokenize(units)])

    def word(self, w: str) -> bytes:
        m = _PLAIN.fullmatch(w)
        if not m:
            return self.encoded(w)
        letters, marks = m[1].lower(), m[2]
        if w in (letters, marks):
            return self.part(w)
        return (self.words[letters] if letters else b"") + (self.words[marks] if marks else b"")

    def __call__(self, text: str) -> bytes:
        if _CONTROL.search(text):
            return self.encoded(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level models: printable bytes stand for
    themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ids(path: str) -> WordIds:
    return hold(("word ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = 4096, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) per piece, cut at
    every ``seq_len`` tokens of a document."""
    python_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _ids(tokenizer)
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                data = (encode(text) if text else b"") + end
                for a in range(0, len(data), 4 * seq_len):
                    part = data[a:a + 4 * seq_len]
                    row = (key, a // 4, len(part) // 4, zlib.crc32(part), len(data) // 4)
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int64)) if with_ids else row)
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: copies of class i (size i + 1) worth values[i] each."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        worth = values[:n] + best[c - 1:c - n - 1 if c > n else None:-1]
        i = int(np.argmax(worth))
        best[c], take[c] = (worth[i], i + 1) if worth[i] > best[c - 1] else (best[c - 1], 0)
    pattern = np.zeros(len(values), np.int64)
    c = capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


@dataclass
class _Basis:
    """The simplex basis of the cutting program: a pattern for each used size."""
    used: np.ndarray
    columns: np.ndarray
    inverse: np.ndarray
    amount: np.ndarray


def _priced(demand: np.ndarray, rounds: int) -> tuple[_Basis, np.ndarray]:
    """The basis after column generation, and the duals by size."""
    capacity, used = len(demand), np.flatnonzero(demand)
    need = demand[used].astype(float)
    columns = np.diag((capacity // (used + 1)).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    basis = _Basis(used, columns, inverse, inverse @ need)
    duals = np.zeros(capacity)
    for _ in range(rounds):
        duals[used] = np.maximum(basis.inverse.sum(axis=0), 0)
        worth, pattern = _knapsack(duals, capacity)
        if worth <= 1 + 1e-7:
            break
        column = pattern[used].astype(float)
        move = basis.inverse @ column
        able = move > 1e-9
        ratio = np.where(able, basis.amount / np.where(able, move, 1), np.inf)
        out = int(np.argmin(ratio))
        basis.columns[:, out] = column
        basis.inverse[out] /= move[out]
        others = np.arange(len(used)) != out
        basis.inverse[others] -= np.outer(move[others], basis.inverse[out])
        basis.amount = basis.inverse @ need
    return basis, duals


def pattern_duals(demand: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Duals of the cutting program by size: demand @ duals bounds the stock of
    every plan from below once no pattern is worth more than 1."""
    return _priced(demand, rounds)[1] if demand.any() else np.zeros(len(demand))


def cutting_plan(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is cut, covering ``demand[i]`` pieces of size
    i + 1 out of stock of size len(demand)."""
    capacity = len(demand)
    plan: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if demand.any():
        basis, _ = _priced(demand, rounds)
        for j in range(len(basis.used)):
            times = int(np.floor(basis.amount[j] + 1e-7))
            pattern = np.zeros(capacity, np.int64)
            pattern[basis.used] = basis.columns[:, j].astype(np.int64)
            over = pattern > 0
            times = min(times, int((left[over] // pattern[over]).min())) if over.any() else 0
            if times > 0:
                plan.append((pattern, times))
                left -= pattern * times
    while left.any():  # first fit, largest class first, a whole pattern at a time
        pattern, room = np.zeros(capacity, np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            n = min(room // (i + 1), left[i])
            pattern[i], room = n, room - n * (i + 1)
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def pack(parts: DataFrame, seq_len: int = 4096, grain: int = 16) -> DataFrame:
    """``parts`` (as from ``pieces``, read twice: a written table) with
    sequence_id and offset."""
    spark = parts.sparkSession
    python_batches(spark)
    capacity = seq_len // grain
    size = F.ceil(F.col("length") / grain).cast("int")
    tie = F.xxhash64("id", "start", "ids_crc32")
    n_rows = max(1, parts.count())
    slices = n_rows // SLICE + 1
    rows = parts.withColumn("size", size).withColumn("slice", F.pmod(tie, F.lit(slices))).withColumn("tie", tie)
    # (class, slice) counts, and from them where a slice's ranks begin.
    counts = rows.groupBy("size", "slice").agg(F.count("*").alias("n"))
    demand = np.zeros(capacity, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # a row a class at most
        demand[r["size"] - 1] = r["n"]
    before = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).select("size", "slice", "begin")
    within = Window.partitionBy("size", "slice").orderBy("tie", "id", "start")
    ranked = (rows.withColumn("at", F.row_number().over(within)).join(begins, ["size", "slice"])
              .withColumn("rank", F.col("begin") + F.col("at") - 1))

    # Per class: the ranks at which a pattern's places begin, its first sequence
    # and its copies of the class.
    places: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity)]
    taken, first = np.zeros(capacity, np.int64), 0
    for pattern, times in cutting_plan(demand):
        for i in np.flatnonzero(pattern):
            places[i].append((int(taken[i]), first, int(pattern[i])))
            taken[i] += pattern[i] * times
        first += times
    shared = spark.sparkContext.broadcast([np.array(p, np.int64).reshape(-1, 3) for p in places])

    @F.pandas_udf("long")
    def sequence(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        size, rank = size.to_numpy(), rank.to_numpy()
        for s in np.unique(size):
            mine = size == s
            p, r = shared.value[s - 1], rank[mine]
            at = p[np.searchsorted(p[:, 0], r, "right") - 1]
            out[mine] = at[:, 1] + (r - at[:, 0]) // at[:, 2]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence("size", "rank"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "tie", "id", "start", "rank")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).drop("size", "slice", "tie", "at", "begin", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = 4096, grain: int = 16,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    parts = written(pieces(docs, tokenizer, end_id, seq_len, id_col, text_col, with_ids), "packing-pieces")
    return pack(parts, seq_len, grain).withColumnRenamed("id", id_col)
