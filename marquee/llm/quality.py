"""Quality classifier: a factorisation machine.

A row's features are hashed into ``2**BITS`` places: its words, weighted by
1 + log(count); statistics of its structure (shares of marks, capitals, digits,
repeated words, word and line lengths and the like), each cut into steps; and
metadata columns the caller names, cut into steps or taken as categories. The
score is the logistic of w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j, where
the pair term is 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2): linear in
the number of features.

The machine is fitted on at most ``max_rows`` labelled rows (about; those with
the smallest hash of their id), in one task, by AdaGrad. Scoring reads every
text whole, in one pass without a shuffle.

Defined cases: null and empty texts score by their structure alone; null
metadata is a value of its own; null labels are not learned from; repeated label
rows of one id count once, the larger mark winning; a null id is held out;
without any learning row every score is 0.5; repeated rows each get a row; an
empty table gives an empty result. Columns not named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_batches, written

BITS = 16
FACTORS = 4
#: Rows that the fit may use, about.
MAX_ROWS = 6_000
_CACHE = 400_000
_MARKS = re.compile(r"[^\w\s]")
_places: dict[str, int] = {}


def _place(s: str) -> int:
    got = _places.get(s)
    if got is None:
        if len(_places) > _CACHE:
            _places.clear()
        got = _places[s] = crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
    return got


def _step(x: float, per: float) -> int:
    return int(min(x * per, 50))


def structure(text: str, words: list[str], counts: Counter) -> list[str]:
    """Names of the structure features that hold for a text."""
    n, k = max(1, len(text)), max(1, len(words))
    marks = len(_MARKS.findall(text))
    upper, digits = sum(map(str.isupper, words)), sum(map(text.count, "0123456789"))
    lines = text.split("\n")
    most = max(counts.values(), default=0)
    stats = {
        "size": _step(np.log2(n + 1), 1), "marks": _step(marks / n, 40), "upper": _step(upper / k, 20), "digits": _step(digits / n, 40),
        "distinct": _step(len(counts) / k, 20), "most": _step(most / k, 20), "word": _step(len(text) / k, 2),
        "line": _step(np.log2(k / len(lines) + 1), 2), "bars": _step(text.count("|") / k, 20), "bangs": _step(text.count("!") / k, 10),
        "symbols": _step(sum(map(text.count, "$%#&*@^~<>={}")) / k, 10), "lines": _step(len(set(lines)) / len(lines), 10),
        "hyper": _step(sum(map(text.count, ("http", "www", "@"))) / k, 100),
    }
    return [f"\0{name}={v}" for name, v in stats.items()]


def features(text: str | None, extra: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): words scaled to length 1, structure and metadata 1 each."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    names = structure(text, words, counts)
    names += [f"\1{i}={_step(np.log2(abs(v) + 1), 2) if isinstance(v, (int, float)) and v == v else v}" for i, v in enumerate(extra)]
    c = np.fromiter(counts.values(), float, len(counts))
    values = 1 + np.log(c)
    values /= np.sqrt((values ** 2).sum()) or 1
    places = np.fromiter(map(_place, chain(counts, names)), np.int64, len(counts) + len(names))
    return places, np.concatenate([values, np.full(len(names), 0.5)])


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, places: np.ndarray, values: np.ndarray) -> float:
        vx = self.factors[places] * values[:, None]
        pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx ** 2).sum(axis=0)).sum())
        return self.bias + float(self.weights[places] @ values) + pairs


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, rate: float = 0.1,
        shrink: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, both labels weighted alike by half."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(1 << BITS), rng.normal(0, 0.02, (1 << BITS, FACTORS))
    gw, gv, bias, gb = np.full(1 << BITS, 1e-2), np.full((1 << BITS, FACTORS), 1e-2), 0.0, 1e-2
    share = labels.mean() if len(labels) else 0.5
    weight = {1: 0.5 + 0.25 / max(share, 0.01), 0: 0.5 + 0.25 / max(1 - share, 0.01)}
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            p, x = rows[i]
            vp = v[p]
            vx = vp * x[:, None]
            total = vx.sum(axis=0)
            z = bias + w[p] @ x + 0.5 * (total ** 2 - (vx ** 2).sum(axis=0)).sum()
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[int(labels[i])]
            g = d * x + shrink * w[p]
            gw[p] += g * g
            w[p] -= rate * g / np.sqrt(gw[p])
            h = d * x[:, None] * (total - vx) + shrink * vp
            gv[p] += h * h
            v[p] -= rate * h / np.sqrt(gv[p])
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
    return Machine(float(bias), w, v)


def learn(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", metadata: tuple[str, ...] = (), max_rows: int = MAX_ROWS) -> Machine:
    """A machine from the labelled rows where ``use`` (over the id) holds."""
    spark = docs.sparkSession
    python_batches(spark)
    marks = labels.where(use).where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20))
    n = marks.count()
    # A bound on the hash that about max_rows rows fall under.
    chosen = marks.where(order < F.lit(min(1 << 20, int((1 << 20) * max_rows / max(1, n)) + 1)))
    rows = docs.select(id_col, F.col(text_col).alias("text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(metadata)])
    extra = [f"_m{i}" for i in range(len(metadata))]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t, m) for t, m in zip(batch["text"], _extra(batch, extra), strict=True)]
            yield pd.DataFrame({"y": batch["y"], "p": [p.astype(np.int32) for p, _ in got], "x": [x.astype(np.float32) for _, x in got]})

    train = written(rows.where(use).join(chosen, id_col).drop(id_col).select("text", *extra, (F.col("y") > 0).cast("int").alias("y"))
                    .mapInPandas(vectors, "y int, p array<int>, x array<float>"), "quality-train")

    def fitted(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(key=[crc32(np.asarray(p).tobytes()) for p in batch["p"]]).sort_values("key")
        got = [(np.asarray(p, np.int64), np.asarray(x, float)) for p, x in zip(batch["p"], batch["x"], strict=True)]
        m = fit(got, batch["y"].to_numpy())
        return pd.DataFrame({"bias": [m.bias], "w": [m.weights.astype("<f4").tobytes()], "v": [m.factors.astype("<f4").tobytes()]})

    found = train.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fitted, "bias double, w binary, v binary").first()
    if found is None:
        return Machine(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS)))
    return Machine(found["bias"], np.frombuffer(found["w"], "<f4").astype(float), np.frombuffer(found["v"], "<f4").astype(float).reshape(-1, FACTORS))


def _extra(batch: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return list(zip(*[batch[c] for c in columns], strict=True)) if columns else [()] * len(batch)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score and predicted added (replacing columns so named)."""
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    n = len(metadata)

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for text, *rest in batches:
            extra = list(zip(*rest, strict=True)) if n else [()] * len(text)
            z = np.array([m.logit(*features(t, e)) for t, e in zip(text, extra, strict=True)], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return (docs.select(*kept, of(F.col(text_col), *map(F.col, metadata), *[F.lit(0)] * (not n)).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
