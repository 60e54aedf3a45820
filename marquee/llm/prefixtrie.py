"""Conversation prefix trie with subtree totals by parallel tree contraction.

Trie: a turn's digest is half the SHA-256 of its role and text; a prefix is
named by two exclusive-or sums of its turns' digests hashed with their place
(128 bits), which running windows give without ever moving a text. Windows run
over slices of ``SLICE`` places, with the sums of the slices before added, so a
conversation of any length is spread over tasks. Rows of one prefix are one node,
combined before the shuffle; nodes get plain numbers when they are written.

Contraction, in join rounds until the root is alone:
* rake: every leaf goes, and adds its total to its parent (summed before the
  shuffle, so a parent of a third of all nodes is one row a task);
* compress: of each two neighbours of a unary chain the one of lower rank stays a
  candidate, so no two neighbours win; a winner is spliced out: its only child
  now hangs below its parent and carries the winner's sum for the ancestors.
  Ranks prefer nodes with bit r of their depth set, which halves plain chains,
  and fall back on a hash of the round, which removes a third of any chain.
All joins of a round are on unique keys on both sides: node, or only child.

Re-expansion: a raked node's total is known when it goes; a spliced node's is the
total of the child it had plus a known amount. The spliced nodes' pointers are
doubled until they reach raked nodes, then one join gives every total.

Defined cases: null role or text is empty; null turns come first, rows of one
turn go by digest; repeated rows are turns of their own; rows without a
conversation id belong to no conversation and are left out; an empty table has
no conversation and so no node (the result is empty); other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_batches, scratch, written

#: Places of one slice of a conversation.
SLICE = 1024
ROOT = -1
#: Ids of one piece of text on its way into a digest.
PIECE = 20_000


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, size): the turns in order, place from 1, size the
    UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    # The role's length keeps ("a", "b") and ("ab", "") apart.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = (turns.where(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.octet_length(text).cast("long").alias("size"),
                    F.substring(F.sha2(whole.cast("binary"), 256), 1, 32).alias("digest"))
            .withColumn("slice", F.floor(F.col("turn") / SLICE)))
    held = rows.groupBy("conv", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "slice").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return (rows.join(held, (F.col("conv") == F.col("c")) & F.col("slice").eqNullSafe(F.col("s")))
            .select("conv", (F.col("before") + inside).alias("place"), "digest", "size"))


def shared_heads(rows: DataFrame, group: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share beginnings: the first ``head`` (over
    ``conv``; ``most`` or fewer) turns come from the first of their ``group``
    ids. Gives (conv, length) and rows as ``turn_rows``."""
    rows = written(rows, "trie-turns")
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n")).withColumn("head", head.cast("long"))
    first = F.col("conv") - F.pmod("conv", F.lit(group))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = (sizes.withColumn("first", first).join(bases, F.col("first") == F.col("base"), "left")
             .withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
             .select(F.col("conv").alias("c"), "head", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("length")))
    convs = written(convs, "trie-convs")
    own = (rows.join(convs, F.col("conv") == F.col("c")).where("place > head")
           .select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("place"), "digest", "size"))
    taken = (rows.where((F.pmod("conv", F.lit(group)) == 0) & (F.col("place") <= most))
             .withColumn("to", F.explode(F.sequence(F.col("conv"), F.col("conv") + (group - 1))))
             .join(convs, F.col("to") == F.col("c")).where("place <= taken")
             .select(F.col("to").alias("conv"), "place", "digest", "size"))
    return convs.select(F.col("c").alias("conv"), "length"), own.unionByName(taken)


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with x, y (the prefix that ends here) and px, py (the one before)."""
    salted = rows.select("*", F.xxhash64(F.lit(1), "place", "digest").alias("hx"), F.xxhash64(F.lit(2), "digest", "place").alias("hy"),
                         F.floor(F.col("place") / SLICE).alias("slice"))
    held = salted.groupBy("conv", "slice").agg(F.bit_xor("hx").alias("hx"), F.bit_xor("hy").alias("hy"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv").alias("c"), F.col("slice").alias("s"), *[F.coalesce(F.bit_xor(h).over(before), F.lit(0)).alias(f"{h}0") for h in ("hx", "hy")])
    upto = Window.partitionBy("conv", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = salted.join(held, (F.col("conv") == F.col("c")) & (F.col("slice") == F.col("s")))
    placed = placed.select("conv", "place", "size", "hx", "hy", *[F.bit_xor(h).over(upto).bitwiseXOR(F.col(f"{h}0")).alias(k) for h, k in (("hx", "x"), ("hy", "y"))])
    return placed.select("conv", "place", "size", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"))


@dataclass(frozen=True)
class Trie:
    #: node, parent (its node; null for the root), depth, conv_id (smallest
    #: member), n_convs, size (bytes of the last text), parent_conv_id
    nodes: DataFrame
    #: node, conv: the conversations that end at a node
    ends: DataFrame


def build(convs: DataFrame, rows: DataFrame) -> Trie:
    """The trie of (conv, length) conversations and their rows (``turn_rows``)."""
    marks = written(prefixes(rows), "trie-prefixes")
    grouped = (marks.groupBy(F.col("place").alias("depth"), "x", "y")
               .agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("px").alias("px"), F.max("py").alias("py")))
    named = written(grouped.withColumn("node", F.monotonically_increasing_id()), "trie-names")
    whole = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.select(F.lit(ROOT).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"),
                        "conv_id", "n_convs", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("parent_conv_id"))
    # One row at most: the root's smallest member.
    top = F.broadcast(whole.select(F.col("conv_id").alias("parent_conv_id")))
    first = named.where("depth = 1").crossJoin(top).withColumn("parent", F.lit(ROOT).cast("long"))
    above = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("d"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    rest = named.where("depth > 1").join(above, (F.col("depth") == F.col("d")) & (F.col("px") == F.col("ux")) & (F.col("py") == F.col("uy")))
    cols = ("node", "parent", "depth", "conv_id", "n_convs", "size", "parent_conv_id")
    nodes = written(first.select(*cols).unionByName(rest.select(*cols)).unionByName(root.select(*cols)), "trie-nodes")
    last = marks.join(convs.withColumnRenamed("conv", "c"), (F.col("conv") == F.col("c")) & (F.col("place") == F.col("length")))
    at = named.select("node", F.col("depth").alias("d"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    ends = (last.join(at, (F.col("place") == F.col("d")) & (F.col("x") == F.col("ux")) & (F.col("y") == F.col("uy"))).select("node", "conv")
            .unionByName(convs.where("length = 0").select(F.lit(ROOT).cast("long").alias("node"), "conv")))
    return Trie(nodes, ends)


def subtree_totals(nodes: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(node, total_<s>...) over the subtree of every node, by contraction.
    ``nodes``: node, parent (null for the root), depth and the columns ``sums``
    (long). Any tree or forest will do; depth only ranks nodes."""
    up = {s: f"up_{s}" for s in sums}
    zero = F.lit(0).cast("long")
    base = scratch(nodes.sparkSession, "trie-rounds")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("inner"))
    state = ["node", "parent", "depth", "inner", *sums, *up.values()]
    # A round's table: what is left, by nodes with and without children left;
    # v: the node that was spliced out above this one, and w: what it adds to it.
    alive = (nodes.join(kids, F.col("node") == F.col("k"), "left").withColumn("inner", F.coalesce("inner", zero))
             .select("node", "parent", "depth", "inner", *sums, *[zero.alias(u) for u in up.values()],
                     F.lit(None).cast("long").alias("v"), *[zero.alias(f"w_{s}") for s in sums]))
    schema, turn = alive.schema, 0
    while True:
        alive.write.parquet(f"{base}/round={turn}")
        alive = nodes.sparkSession.read.schema(schema).parquet(f"{base}/round={turn}").select(*state)
        # Rake.
        inner = F.col("inner") > 0
        given = (alive.where("parent is not null").groupBy(F.col("parent").alias("k"))
                 .agg(*[F.coalesce(F.sum(F.when(~inner, F.col(s) + F.col(u))), zero).alias(f"in_{s}") for s, u in up.items()],
                      F.count_if(inner).alias("now"), F.min(F.when(inner, F.col("node"))).alias("child")))
        rest = written(alive.where(inner).join(given, F.col("node") == F.col("k"))
                       .select("node", "parent", "depth", F.col("now").alias("inner"), *[(F.col(s) + F.col(f"in_{s}")).alias(s) for s in sums], *up.values(), "child"),
                       f"trie-rest-{turn}")
        if rest.isEmpty():
            break
        # Compress.
        rank = F.struct(F.shiftright("depth", turn % 16).bitwiseAND(F.lit(1).cast("long")) == 0, F.xxhash64(F.lit(turn), "node"), "node")
        unary = rest.where("inner = 1 and parent is not null").select("node", "child", "parent", rank.alias("rank"), *sums, *up.values())
        over = unary.select(F.col("node").alias("above"), F.col("child").alias("below"), F.col("rank").alias("rank_above"))
        pairs = over.join(unary.select("node", F.col("rank").alias("rank_below")), F.col("below") == F.col("node"))
        lost = pairs.select(F.when(F.col("rank_above") < F.col("rank_below"), F.col("below")).otherwise(F.col("above")).alias("node")).distinct()
        out = written(unary.join(lost, "node", "left_anti"), f"trie-out-{turn}")
        gone = out.select(F.col("node").alias("v"), F.col("child").alias("c"), F.col("parent").alias("p"),
                          *[F.col(s).alias(f"v_{s}") for s in sums], *[F.col(u).alias(f"v_{u}") for u in up.values()])
        moved = rest.join(out.select("node"), "node", "left_anti").join(gone, F.col("node") == F.col("c"), "left")
        alive = moved.select("node", F.coalesce("p", "parent").alias("parent"), "depth", "inner", *sums,
                             *[(F.col(u) + F.coalesce(f"v_{s}", zero) + F.coalesce(f"v_{u}", zero)).alias(u) for s, u in up.items()],
                             "v", *[(F.col(u) + F.coalesce(f"v_{s}", zero)).alias(f"w_{s}") for s, u in up.items()])
        turn += 1

    rounds = nodes.sparkSession.read.schema(schema).parquet(*[f"{base}/round={r}" for r in range(turn + 1)])
    totals = rounds.where("inner = 0").select("node", *[F.col(s).alias(f"total_{s}") for s in sums])
    open_ = rounds.where("v is not null").select("v", F.col("node").alias("c"), *[f"w_{s}" for s in sums])
    # Chains of spliced nodes are no longer than there were rounds.
    for step in range(turn.bit_length()):
        open_ = written(open_, f"trie-open-{step}")
        on = open_.select(F.col("v").alias("c"), F.col("c").alias("c2"), *[F.col(f"w_{s}").alias(f"w2_{s}") for s in sums])
        open_ = open_.join(on, "c", "left").select("v", F.coalesce("c2", "c").alias("c"), *[(F.col(f"w_{s}") + F.coalesce(f"w2_{s}", zero)).alias(f"w_{s}") for s in sums])
    grown = (open_.join(totals.withColumnRenamed("node", "c"), "c")
             .select(F.col("v").alias("node"), *[(F.col(f"total_{s}") + F.col(f"w_{s}")).alias(f"total_{s}") for s in sums]))
    return totals.unionByName(grown)


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, sha256) of the ascending ids ``conv`` of a node, comma-joined. Ids
    are ordered and joined to pieces of text in ranges, wherever a node's ids
    fall; one task then only runs a node's pieces through the hash."""
    python_batches(ends.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, held, least = None, [], 0
        for batch in batches:
            done = []
            for n, c in zip(batch["node"], batch["conv"], strict=True):
                if held and (n != node or len(held) == PIECE):
                    done.append((node, least, ",".join(held)))
                    held = []
                if not held:
                    node, least = n, c
                held.append(str(c))
            yield pd.DataFrame(done, columns=["node", "least", "ids"])
        if held:
            yield pd.DataFrame([(node, least, ",".join(held))], columns=["node", "least", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch["node"], batch["ids"], strict=True):
                if sha is not None and n == node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["node", "sha256"])
        if sha is not None:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "sha256"])

    cut = (ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
           .mapInPandas(pieces, "node long, least long, ids string"))
    return cut.repartition("node").sortWithinPartitions("node", "least").mapInPandas(hashed, "node long, sha256 string")


def node_report(trie: Trie) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that sharing saves in the subtree) and the
    digest of the conversations that end there."""
    nodes = trie.nodes
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.count("*").alias("n_children"))
    counted = written(nodes.join(kids, F.col("node") == F.col("k"), "left").drop("k").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                      .withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-counted")
    totals = subtree_totals(counted, ("leaves", "saved")).withColumnRenamed("node", "t")
    shas = id_digests(trie.ends).withColumnRenamed("node", "e")
    return (counted.join(totals, F.col("node") == F.col("t")).join(shas, F.col("node") == F.col("e"), "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("total_leaves").alias("n_leaves"),
                    F.col("total_saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
