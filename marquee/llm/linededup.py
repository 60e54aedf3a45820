"""Line dedup by a segment-partition edit join. DataFrame only.

Lines are what stands between line feeds; blank ones (nothing but
``[\\x20\\x09-\\x0D]``) are left alone. Equal lines collapse first, combined
before the shuffle, so a line with a third of all rows is one row from there on.
Different lines link at ``threshold`` edits or fewer, in code points.

A line is split into segments. At threshold 1 there are four, and two linked lines
agree outside one of them, the window: every line shows what stands outside each
window to lines of its own length, and with a window one longer to lines one
shorter. Lines that show the same are a group. Of a small group, pairs are the
candidates, verified by banded bit-parallel edit distance: per level of edits, one
word holds which of the 2 threshold + 1 diagonals are reachable. In a group of more
than ``CROWD`` lines, a window is split again, until groups are small or windows one
code point; lines that agree outside one code point all link, so they are counted
and tied to the smallest, not paired. So rows grow with the lines and their lengths,
never with the square of a group. Lines of one length and one edit differ at one
place, so they meet in one group only; a line has no more links to shorter lines
than code points, so those are pairs everywhere.

Above threshold 1 there are threshold + 1 segments; two linked lines share one, at a
place that the difference in length and the number of the segment bound. Every line
indexes its segments under (length, number, text) and probes the places that lines
of its length or up to threshold less may share; all that meet are candidates.

Lines of one component form a class; of a class, the first occurrence (smallest
doc_id, then place) stays; it is found among the lines, each of which knows its
own first. Line ids are given when the table of different lines is written, so
ids do not collide; occurrences find their line by 96 bits of hash, and only
lines that occur again or link are looked up. What is picked from the lines is
dealt anew before it is written, so that its files follow its own size, not the
number of tasks that read the lines: on a local path Hadoop forks the executor
for every file.

Defined cases: null or empty texts have no lines; lines shorter than their
segments work as any (empty segments agree); a null id sorts first; rows that
repeat a document count as more occurrences of its lines under one id and give
one result row; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import connected_components, if_small, written

BLANKS = " \t\x0b\x0c\r"
#: Lines of a group that are paired with each other; more are told apart by
#: narrower windows.
CROWD = 16
#: Windows that a line is cut into, and that the window of a crowd is.
WINDOWS, NARROWER = 4, 16


def shared_places(threshold: int) -> list[tuple[int, int, int]]:
    """(less, number, shift): where lines of a length and of ``less`` below it may
    share segment ``number`` of the shorter one."""
    return [(less, k, shift) for less in range(threshold + 1) for k in range(threshold + 1)
            for shift in range(max(-k, less - (threshold - k)), min(k, less + threshold - k) + 1)]


def entries(lines: DataFrame, places: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """(id, key, shorter) for the lines (id, line, n): the key of the text that a
    line shows at a place to lines of ``n - less`` points. Places come as rows, so
    that one short expression serves them all: spelt out for each, the generated
    code is too long for the JVM to compile, and four times as slow."""
    parts = threshold + 1
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("less", "k", "shift"), p, strict=True)]) for p in places])
    shown = (lines.select("id", "line", "n", F.explode(rows).alias("p"))
             .select("id", "line", "n", "p.*", (F.col("n") - F.col("p.less")).alias("size")).where("size >= 0")
             # The last ``size % parts`` segments are one longer.
             .withColumn("longer", F.col("k") - (parts - F.col("size") % parts))
             .withColumn("base", F.expr(f"cast(size div {parts} as int)"))
             .withColumn("start", F.col("base") * F.col("k") + F.greatest(F.lit(0), "longer") + F.col("shift"))
             .withColumn("length", F.col("base") + (F.col("longer") >= 0).cast("int"))
             .where("start >= 0 and start + length <= n"))
    key = F.xxhash64("size", "k", F.substr("line", F.col("start") + 1, F.col("length")))
    return shown.select("id", key.alias("key"), (F.col("less") > 0).alias("shorter"))


def around(rows: DataFrame) -> tuple[Column, Column]:
    """What stands before and behind the window [b, e) of a line of ``size`` points;
    of a line of one more (``long`` 1), the window is one longer."""
    return F.substr("line", F.lit(1), rows["b"]), F.substr("line", rows["e"] + rows["long"] + 1)


def narrowed(rows: DataFrame, ways: int) -> DataFrame:
    """(id, long, size, b, e, key) for the rows (id, line, long, size, b, e): the
    window cut into ``ways`` windows, empty ones left out, and the key of what
    stands outside each."""
    cut = (rows.select("id", "line", "long", "size", F.col("b").alias("from"), (F.col("e") - F.col("b")).cast("long").alias("width"),
                       F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("i"))
           .withColumn("b", F.expr(f"cast(from + width * i div {ways} as int)"))
           .withColumn("e", F.expr(f"cast(from + width * (i + 1) div {ways} as int)")).where("e > b"))
    return cut.select("id", "long", "size", "b", "e", F.xxhash64("size", "b", "e", *around(cut)).alias("key"))


def grouped(shown: DataFrame) -> DataFrame:
    """The rows whose key another line shows too, to be met by one of ``size``
    points at least, with the number of rows of their key (n). Keys are counted
    alone, combined before the shuffle; nothing of a line moves with them."""
    keys = written(shown.groupBy("key").agg(F.count("*").alias("n"), F.min("long").alias("least"))
                   .where("n > 1 and least = 0").select("key", "n"), "line-keys")
    return written(shown.join(if_small(keys), "key").hint("rebalance", "key"), "line-groups")


def _if_equal(bit: int):
    return lambda p, q: F.when(p == q, bit).otherwise(0)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two texts are within ``threshold`` edits: bit d of the word of
    level e says that diagonal d - threshold is reachable with e edits."""
    width = (1 << (2 * threshold + 1)) - 1
    chars = F.split(a, "")
    other = F.split(b, "")
    mask: Column | None = None
    for d in range(-threshold, threshold + 1):
        moved = F.concat(F.array_repeat(F.lit(None).cast("string"), -d), other) if d <= 0 else F.slice(other, d + 1, F.greatest(F.lit(1), F.length(b)))
        bit = F.zip_with(chars, moved, _if_equal(1 << (d + threshold)))
        mask = bit if mask is None else F.zip_with(mask, bit, lambda p, q: F.coalesce(p, F.lit(0)).bitwiseOR(F.coalesce(q, F.lit(0))))
    levels = [1 << threshold]
    for _ in range(threshold):
        levels.append((levels[-1] | levels[-1] << 1) & width)

    def step(now: Column, m: Column) -> Column:
        out: list[Column] = []
        for e in range(threshold + 1):
            w = now[f"e{e}"].bitwiseAND(m)
            if e:
                old = now[f"e{e - 1}"]
                w = w.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(width))
            out.append(w)
        return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(out)])

    begin = F.struct(*[F.lit(w).alias(f"e{e}") for e, w in enumerate(levels)])
    last = F.aggregate(F.slice(mask, 1, F.length(a)), begin, step, lambda s: s[f"e{threshold}"])
    gap = F.length(b) - F.length(a)
    reached = [(gap == d) & (last.bitwiseAND(F.lit(1 << (d + threshold))) != 0) for d in range(-threshold, threshold + 1)]
    return reduce(or_, reached)


def picked(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the lines of these ids alone, so that no other text is shuffled."""
    return written(lines.select("id", "line").join(if_small(ids), "id", "left_semi").hint("rebalance", "id"), "line-texts")


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    return (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("left")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("right")), "b")
            .where(within(F.col("left"), F.col("right"), threshold)).select("a", "b"))


def similar_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) among different lines (id, line, n)."""
    places = shared_places(threshold)
    own = [p for p in places if p[0] == p[2] == 0]
    index = entries(lines, own, threshold).select(F.col("id").alias("a"), "key")
    probe = entries(lines, places, threshold).select(F.col("id").alias("b"), "key", "shorter")
    met = index.join(probe, (index.key == probe.key) & (F.col("shorter") | (F.col("a") < F.col("b"))))
    pairs = written(met.select("a", "b").distinct(), "line-pairs")
    # The ids are not written: read off the pairs again, they cost no more than a table.
    return verified(pairs, picked(lines, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), threshold)


def one_edit(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links at one edit among different lines (id, line, n), none empty: pairs
    (a, b), and crowds (id, first, others), a row for each crowd of a line: it links
    to the ``others`` lines of the crowd, of which ``first`` is the smallest. No link
    is in both, or in two crowds."""
    sizes = (lines.select("id", "line", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("long"))
             .select("id", "line", "long", (F.col("n") - F.col("long")).alias("size"), F.lit(0).alias("b"), (F.col("n") - F.col("long")).alias("e")))
    members = grouped(narrowed(sizes, WINDOWS))
    texts = picked(lines, members.select("id").distinct())
    few, places = [], []
    while True:
        few.append(members.where(F.col("n") <= CROWD))
        crowd = members.where(F.col("n") > CROWD)
        places.append(crowd.where("e - b = 1"))
        wide = crowd.where("e - b > 1")
        if wide.isEmpty():
            break
        members = grouped(narrowed(wide.join(texts, "id"), NARROWER))
    small = reduce(DataFrame.unionByName, few)
    met = (small.where("long = 0").select("key", F.col("id").alias("a"))
           .join(small.select("key", F.col("id").alias("b"), "long"), "key").where("long = 1 or a < b"))
    pairs = written(met.select("a", "b").distinct(), "line-pairs")
    # Of the crowds whose window is one code point: a digest stands for the text
    # outside. A line of one more shows both its points there; it links to the
    # lines that have one of them.
    at = reduce(DataFrame.unionByName, places).join(texts, "id")
    shown = [F.substr("line", at["b"] + k, F.lit(1)) for k in (1, 2)]
    at = written(at.select("id", "long", "size", "b", F.sha2(F.concat(*around(at)), 256).alias("rest"),
                           F.explode(F.array_distinct(F.array(shown[0], F.when(F.col("long") == 1, shown[1]).otherwise(shown[0])))).alias("point")), "line-places")
    place = ["size", "b", "rest"]
    own = at.where("long = 0")
    crowds = own.join(own.groupBy(*place).agg(F.count("*").alias("all"), F.min("id").alias("first")).where("all > 1"), place)
    longer = (own.select(*place, "point", F.col("id").alias("short")).join(at.where("long = 1").select(*place, "point", F.col("id").alias("longer")), [*place, "point"])
              .select(F.col("short").alias("a"), F.col("longer").alias("b")))
    return (verified(pairs, texts, 1).union(longer).distinct(),
            crowds.select("id", "first", (F.col("all") - 1).alias("others")))


def line_dedup(docs: DataFrame, threshold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a line: id, n_lines, n_linked (lines that link
    to a different line), n_links (links of its lines), n_dropped (lines that
    are not the first of their class), first_docs (sorted ids of the documents
    where the dropped lines stand first)."""
    found = (docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
             # Only leading blanks are looked at: translate() would make a JVM string of every code point.
             .where(F.ltrim("line", F.lit(BLANKS)) != ""))
    hashed = [F.xxhash64("line").alias("h"), F.hash("line").alias("g")]
    place, doc_of = _place(found)
    lines = written(found.select("line", place.alias("place")).groupBy("line").agg(F.count("*").alias("times"), F.min("place").alias("place"))
                    .select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("n"), "times", "place", *hashed), "lines")
    texts = lines.select("id", "line", "n")
    links, crowds = one_edit(texts) if threshold == 1 else (similar_lines(texts, threshold), None)
    links = edges = written(links, "line-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("others"))
    if crowds is not None:
        crowds = written(crowds, "line-crowds")
        ends = ends.union(crowds.select("id", "others"))
        edges = links.union(crowds.select("id", "first"))
    ends = ends.groupBy("id").agg(F.sum("others").alias("links"))
    roots = connected_components(edges)
    named = (lines.select("id", "h", "g", "times", "place").join(ends, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .select("id", "h", "g", "times", "place", "root", F.coalesce("links", F.lit(0)).alias("links")))
    # The first occurrence of a class, among its lines; a line alone is its class.
    linked = named.where("links > 0").withColumn("class", F.coalesce("root", "id"))
    first = linked.groupBy("class").agg(F.min("place").alias("first"), F.sum("times").alias("all"))
    marks = (linked.join(first, "class").select("h", "g", "links", "first", "all")
             .unionByName(named.where("links = 0").select("h", "g", "links", F.col("place").alias("first"), F.col("times").alias("all"))))
    marks = written(marks.where("all > 1").drop("all").hint("rebalance", "h"), "line-marks")
    placed = found.select("doc", place.alias("place"), *hashed).join(marks, ["h", "g"], "left")
    dropped = F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    return (placed.groupBy("doc").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("links") > 0).alias("n_linked"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"),
        F.count_if(dropped).alias("n_dropped"),
        F.sort_array(F.collect_set(F.when(dropped, doc_of(F.col("first"))))).alias("first_docs"))
        .withColumnRenamed("doc", id_col))


def _place(found: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """An occurrence's place in the order of (doc, at), nulls first, and how to
    read the document off it. Of whole-number ids it is one number, of which a
    minimum is kept in place while rows are hashed."""
    if not isinstance(found.schema["doc"].dataType, IntegralType):
        return F.struct("doc", "at"), lambda p: p["doc"]
    low, lines = (F.lit(str(1 << b)).cast("decimal(20,0)") for b in (63, 31))
    place = F.coalesce(F.col("doc").cast("decimal(19,0)") + low + 1, F.lit(0).cast("decimal(21,0)")) * lines + F.col("at")

    def doc(p: Column) -> Column:
        number = F.floor(p / lines) - low - 1
        return F.when(p >= lines, number.cast(found.schema["doc"].dataType))

    return place.cast("decimal(38,0)"), doc
