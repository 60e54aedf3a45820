"""Language ID by language-bitmask n-gram filters.

A model is one bit-sliced Bloom filter per n: an array of positions, each
holding one bit per language. An n-gram is looked up at ``hashes`` positions,
and the AND of the words found there is the set of all languages that contain
it. Per language a document's n-grams with that bit are counted (the popcount
of the language's slice of the masks); a filter of fill p lets a foreign n-gram
through with probability p^hashes, so the count h of n is corrected to
(h - n p^k) / (1 - p^k). The language with the highest corrected share is
predicted; the score is its part of all corrected shares.

n-grams are runs of 3 and 4 characters of words with a blank on each side:
letters lower-cased, everything else a blank, blanks merged; an n-gram has no
blank inside. Counts cover all learning rows and are summed by Spark; a
language contains an n-gram if its relative frequency there is at least
``min_freq`` and ``min_ratio`` times the highest of any language. Up to 63
languages; filters have a fixed number of positions, so the model's size is
fixed (8 bytes a position, 2 filters).

Defined cases: null or letterless text gives 'und' with score 0; a text with
letters but no known n-gram gets the most frequent learned language with score
0; ties go to the language learned from more rows, then by name; without any
learning row every text is 'und'; repeated rows each get a row; an empty table
gives an empty result. Other columns are never read for a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, release, text_runs, written

UNDETERMINED = "und"
SIZES = (3, 4)
_RUN = 1 << 19
#: n-grams that a worker holds before it hands them to Spark.
_HELD = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def folded() -> np.ndarray:
    """Code point -> lower-cased code point if a letter, else a blank."""
    low = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            x = ch.lower()
            low[c] = ord(x) if len(x) == 1 else c
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def grams_of(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(has a letter, per text) and, for every n of SIZES, (n-gram hashes, text
    numbers) over the texts in order."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    low = folded()[points]
    blank = low == 32
    letters = np.bincount(owner[~blank], minlength=len(texts)) > 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank behind each word
    low, owner = low[keep].astype(np.uint64), owner[keep]
    low = np.concatenate([[np.uint64(32)], low])
    owner = np.concatenate([owner[:1], owner])
    blank = low == 32
    out = []
    for n in SIZES:
        m = len(low) - n + 1
        if m <= 0:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        h = np.full(m, n, np.uint64)
        inner = np.zeros(m, bool)
        for i in range(n):
            h = h * np.uint64(1099511628211) + low[i:i + m]
            if 0 < i < n - 1:
                inner |= blank[i:i + m]
        ok = ~inner
        out.append((_mixed(h[ok]), owner[n - 1:][ok]))
    return letters, out


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # by learning rows, most first
    filters: tuple[np.ndarray, ...]  # per n: positions -> language bits
    passing: np.ndarray  # (n, language): probability that a foreign n-gram passes
    hashes: int


def _positions(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(20 * i)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    n_langs = len(model.langs)
    known = [t or "" for t in texts]
    langs: list[str] = []
    scores: list[float] = []
    for i, j in text_runs(known, _RUN):
        letters, grams = grams_of(known[i:j])
        total = np.zeros((j - i, n_langs))
        seen = np.zeros(j - i)
        for k, (h, owner) in enumerate(grams):
            bits = int(model.filters[k].size).bit_length() - 1
            mask = model.filters[k][_positions(h, 0, bits)]
            for p in range(1, model.hashes):
                mask = mask & model.filters[k][_positions(h, p, bits)]
            n = np.bincount(owner, minlength=j - i)
            seen += n
            for lang in range(n_langs):
                hits = np.bincount(owner[(mask >> lang) & 1 == 1], minlength=j - i)
                p = model.passing[k, lang]
                total[:, lang] += np.maximum(0, (hits - n * p) / (1 - p))
        for row in range(j - i):
            if not letters[row] or not n_langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmax(total[row]))
            langs.append(model.langs[best])
            scores.append(float(total[row, best] / total[row].sum()) if total[row].any() else 0.0)
    return langs, np.array(scores)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)


def learn(docs: DataFrame, use: Column, lang_col: str = "lang", text_col: str = "text", bits: int = 18, hashes: int = 2,
          min_freq: float = 2e-6, min_ratio: float = 0.05) -> Model:
    """The model from the rows where ``use`` holds and text and language are not
    null. The driver receives the filters: 2^bits positions for each n."""
    python_batches(docs.sparkSession)
    rows = docs.where(use).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0
        for batch in batches:
            for lang, part in batch.groupby("lang")["text"]:
                texts = part.tolist()
                for i, j in text_runs(texts, _RUN):
                    for n, (h, _) in zip(SIZES, grams_of(texts[i:j])[1], strict=True):
                        found = np.unique(h, return_counts=True)
                        held.setdefault((lang, n), []).append(found)
                        waiting += len(found[0])
                    if waiting > _HELD:
                        held = {k: [summed(v)] for k, v in held.items()}
                        waiting = sum(len(v[0][0]) for v in held.values())
                        if waiting > _HELD // 2:
                            yield from flush(held)
                            held, waiting = {}, 0
        yield from flush(held)

    def flush(held) -> Iterator[pd.DataFrame]:
        for (lang, n), parts in held.items():
            gram, c = summed(parts)
            yield pd.DataFrame({"lang": lang, "size": n, "gram": gram.view(np.int64), "n": c})

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes, key=lambda x: (-sizes[x], x)))
    if len(langs) > 63:
        raise ValueError(f"{len(langs)} languages; a position holds 63 bits")
    if not langs:
        return Model((), tuple(np.zeros(1 << bits, np.int64) for _ in SIZES), np.zeros((len(SIZES), 0)), hashes)
    counts = written(rows.mapInPandas(count, "lang string, size int, gram long, n long")
                     .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    whole = counts.groupBy("lang", "size").agg(F.sum("n").alias("whole"))  # languages x sizes
    freq = counts.join(F.broadcast(whole), ["lang", "size"]).withColumn("freq", F.col("n") / F.col("whole"))
    bit = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, 1 << i)])
    highest = freq.groupBy("size", "gram").agg(F.max("freq").alias("high"), F.collect_list(F.struct("lang", "freq")).alias("by"))
    inside = F.filter("by", lambda x: (x["freq"] >= min_freq) & (x["freq"] >= F.col("high") * min_ratio))
    masks = highest.select("size", "gram", F.aggregate(inside, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit[x["lang"]].cast("long"))).alias("mask"))
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(hashes)]))
    slots = masks.where("mask <> 0").select("size", at.alias("at"), "mask").groupBy("size", "at").agg(F.bit_or("mask").alias("mask"))
    filters = {n: np.zeros(1 << bits, np.int64) for n in SIZES}
    found = slots.toPandas()
    for n in SIZES:
        part = found[found["size"] == n]
        filters[n][part["at"].to_numpy(np.int64)] = part["mask"].to_numpy(np.int64)
    passing = np.array([[min(0.999, ((filters[n] >> i) & 1).mean() ** hashes) for i in range(len(langs))] for n in SIZES])
    return Model(langs, tuple(filters[n] for n in SIZES), passing, hashes)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The function of a text column that gives struct<lang_pred, score>."""
    python_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        release()
        langs, scores = predict(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return of


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (replacing columns of that name)."""
    of = predictor(docs.sparkSession, model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, of(F.col(text_col)).alias("_found")).select(*kept, "_found.lang_pred", "_found.score")
