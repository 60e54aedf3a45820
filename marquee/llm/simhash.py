"""SimHash near-dedup: tiled exact comparison of fingerprints.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words joined by one space, repeats included; a bit is 1 if it is set
in over half of the shingles' XXH64 (seed 42). One pass, no shuffle.

Links: rows with one fingerprint collapse to one point before anything is
compared. A tile holds points of one class, the population counts of the upper
and the lower 32 bits; classes too large for one tile are split by a hash. Two
points within ``radius`` bits have counts whose differences add up to
``radius`` at most, so a tile meets only the tiles of such classes, each pair
once; every other pair of tiles is skipped unread. A pair of tiles is compared
in numpy by exclusive-or and bit counts, and yields a spanning forest of its
links (not all of them): at most as many rows as it has points. Components of
the forests are those of all links.

The comparison is exact and therefore quadratic in the different fingerprints;
skipping divides that by about three. Work is dealt by pairs of tiles of
bounded size.

Defined cases: null and wordless texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; repeated rows each get a
row; rows with a null id never name a component (it is null only if all its ids
are); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, python_batches, release, written

#: Points of a tile, about.
TILE = 4096
_BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    spans = zip(starts[:len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    python_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links between two tiles (points as uint64) as a spanning forest: rows
    (point, root), the root being some point of the same component."""
    points = np.concatenate([a, b])
    label = np.arange(len(points))
    step = max(1, _BLOCK // max(1, len(b)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i:i + step, None] ^ b[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + len(a)
        while len(x):  # hook the larger root below the smaller one, then shorten
            lx, ly = label[x], label[y]
            open_ = lx != ly
            x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
            np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
            while (label[label] != label).any():
                label = label[label]
    linked = np.flatnonzero(points[label] != points)
    return np.stack([points[linked], points[label[linked]]], axis=1)


def _compare(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["left"], batch["right"], strict=True):
                found = forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
                if len(found):
                    yield pd.DataFrame({"a": found[:, 0].view(np.int64), "b": found[:, 1].view(np.int64)})
    return run


def near_links(points: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Forests (a, b) of the links among distinct fingerprints ``fp``."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    classed = points.select("fp", high.alias("high"), low.alias("low"))
    # 33 x 33 classes at most: small enough to broadcast.
    parts = classed.groupBy("high", "low").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = (classed.join(F.broadcast(parts), ["high", "low"])
             .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
             .groupBy("high", "low", "part").agg(F.collect_list("fp").alias("fps")))
    tiles = written(tiles, "simhash-tiles")
    # Each pair of classes once: the half plane of differences, and (0, 0).
    reach = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1)
             if abs(x) + abs(y) <= radius and (x > 0 or y >= 0)]
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in reach]))
    left = (tiles.withColumn("to", offsets)
            .select((F.col("high") + F.col("to.x")).alias("high"), (F.col("low") + F.col("to.y")).alias("low"),
                    F.when((F.col("to.x") == 0) & (F.col("to.y") == 0), F.col("part")).otherwise(-1).alias("after"),
                    F.col("fps").alias("left")))
    # Within a class, the later tiles and the tile itself.
    pairs = (left.join(tiles.withColumnRenamed("fps", "right"), ["high", "low"])
             .where("part >= after").select("left", "right"))
    return pairs.mapInPandas(_compare(radius), "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the
    smallest id reachable over links)."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    points = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-points")
    roots = connected_components(near_links(points, radius))
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return (rows.join(member, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
