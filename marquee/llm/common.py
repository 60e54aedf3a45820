"""Helpers the operators share: shared scratch tables, components, batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import shared_folder

#: Rows of one Arrow batch handed to Python: whole texts may be long.
ARROW_ROWS = 500
#: Bytes of one, about; a single row may be longer.
ARROW_BYTES = 4 << 20

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python by rows and by bytes, unless
    the session has lower bounds. Frames are lazy, so the settings have to hold
    until the caller's action and stay in the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * 1024 ** " kmg".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


class Recent(dict):
    """What ``make`` gives for a text key, remembered by a worker. Memory is
    bounded by bytes (about: a key, a value of its order, and their place): when
    the entries since the last change of generation exceed ``most``, they become
    the old generation and the old one goes; entries asked for again move up."""

    def __init__(self, make: Callable, most: int = 12 << 20):
        super().__init__()
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self.size += 220 + 3 * len(key)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


_held: dict = {}


def hold(key, make: Callable):
    """What ``make`` gives, remembered by a worker for the key it was asked for
    last. Workers outlive a stage: what one operator keeps goes when the next
    asks, so that an executor never holds the tables of both."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """For an operator that keeps nothing itself."""
    _held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def text_runs(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into runs [i, j) of about ``limit`` characters, one
    text at least, so that temporary arrays stay small."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of (a, b) edges: rows (node, root) for
    every node but the roots; the root is the smallest node of a component.

    Alternating large-star and small-star steps; every step is a min per node
    (combined before the shuffle) and a join, never a list of neighbours.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    if now[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u").select("u", "v", "m")
        e = (met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(met.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        last, now = now, state(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Rows that may be broadcast; beyond them a join shuffles.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (written before) with a broadcast hint if it is counted to have
    ``rows`` rows or fewer; results are the same either way."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of one file stay below 2^this in a row key.
FILE_ROW_BITS = 40


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


class Rows:
    """A table with a key (long, never null) for every row: the number of the
    file, in order of the paths, and the row's place in it, so every scan gives a
    row the same key. What is not a plain scan of files is written first."""

    def __init__(self, docs: DataFrame):
        if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
            docs = written(docs, "rows")
        self.docs = docs
        #: The key's column.
        self.name = free_name(docs, "_row")
        # As many as the driver lists to plan the scan.
        self.paths = sorted(r[0] for r in docs.select(docs.metadataColumn("_metadata")["file_path"]).distinct().collect())

    def frame(self, only: range | None = None) -> DataFrame:
        """The table with its keys; of the files of these numbers alone."""
        docs, name = self.docs, self.name
        place = docs.metadataColumn("_metadata")
        numbers = range(len(self.paths)) if only is None else only
        # From Arrow it is a local table; from Python rows, every scan would run a
        # Python job on the executors, with a daemon and workers of its own.
        files = docs.sparkSession.createDataFrame(pa.table({
            f"{name}path": pa.array([self.paths[i] for i in numbers], pa.string()),
            f"{name}base": pa.array([i << FILE_ROW_BITS for i in numbers], pa.int64())}))
        placed = docs.select("*", place["file_path"].alias(f"{name}file"), place["row_index"].alias(f"{name}at"))
        if only is not None:
            placed = placed.where(place["file_path"].isin([self.paths[i] for i in numbers]))
        joined = placed.join(F.broadcast(files), placed[f"{name}file"] == files[f"{name}path"])
        return joined.select(*[docs[c] for c in docs.columns], (F.col(f"{name}base") + F.col(f"{name}at")).alias(name))


#: 2^this rows share an entry of ``Marks``; a file has 2^that of them at most.
_ENTRY_BITS, _FILE_BITS = 6, FILE_ROW_BITS - 6


class Marks:
    """A 0/1 mark for some rows of a table, which meets the rows where they are
    read: no other column of the table is shuffled.

    Row keys and marks become, per 64 rows of a file, two words of 64 bits: which
    rows have a mark, and which mark. These entries are dealt to passes of
    ``entries`` at most (24 bytes each; a pass broadcasts its own) by runs of
    files. A pass reads only its files, so all passes together read the table
    once; only a file of more entries than that is read by several.
    """

    def __init__(self, rows: Rows, marked: DataFrame, entries: int = 1_000_000):
        """``marked``: (row key, y), a key once at most."""
        self.rows = rows
        row = rows.name
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(row).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        self.bits = written(marked.groupBy(F.shiftright(row, _ENTRY_BITS).alias("run"))
                            .agg(F.bit_or(bit).alias("has"), F.coalesce(F.bit_or(F.when(F.col("y") > 0, bit)), F.lit(0).cast("long")).alias("yes")), "marks")
        sizes = (self.bits.groupBy(F.shiftright("run", _FILE_BITS).alias("file")).agg(F.count("*").alias("n"), F.max("run").alias("last"))
                 .orderBy("file").collect())  # a row a file
        self.passes: list[range] = []  # of entries' runs
        held = entries
        for file, n, last in sizes:
            first = file << _FILE_BITS
            if held + n <= entries:
                self.passes[-1] = range(self.passes[-1].start, last + 1)
                held += n
            else:
                self.passes += [range(r, min(r + entries, last + 1)) for r in range(first, last + 1, entries)]
                held = n if n <= entries else entries

    @classmethod
    def by_id(cls, docs: DataFrame, marks: DataFrame, id_col: str, use: Column, entries: int = 1_000_000) -> Marks:
        """Marks (id_col, y), an id once at most, for the rows of ``docs`` where
        ``use`` (over the id) holds; ids meet marks on narrow rows."""
        rows = Rows(docs)
        return cls(rows, rows.frame().where(use).select(id_col, rows.name).join(marks, id_col).select(rows.name, "y"), entries)

    def read(self, runs: range) -> DataFrame:
        """The rows of a pass that have a mark: the table's columns, the row key,
        and y (instead of a column of that name)."""
        row = self.rows.name
        rows = self.rows.frame(range(runs.start >> _FILE_BITS, (runs.stop - 1 >> _FILE_BITS) + 1))
        run, has, yes = (free_name(rows, f"_{n}") for n in ("run", "has", "yes"))
        here = F.broadcast(self.bits.where((F.col("run") >= runs.start) & (F.col("run") < runs.stop)).toDF(run, has, yes))
        at = F.col(row).bitwiseAND(F.lit(63).cast("long")).cast("int")
        met = rows.join(here, F.shiftright(row, _ENTRY_BITS) == F.col(run)).where(F.getbit(F.col(has), at) == 1)
        return met.select(*[rows[c] for c in rows.columns if c != "y"], F.getbit(F.col(yes), at).cast("int").alias("y"))
