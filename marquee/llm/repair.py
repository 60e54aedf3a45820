"""Conversation structure repair by a shortest path over big-integer weights.

1. Rows are put in order (turn, null first, then role and text) and each gets
   its first fault: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role and text
   stood before in the conversation) or truncated (the last such character is
   none of ``.!?``).
2. A conversation becomes a short string, one letter a row: what its role begins
   with and whether it is sound, truncated or has to go. Only these strings go
   to Python; texts stay in the JVM.
3. The edits are the edges of a layered graph, one layer a row, whose nodes are
   what the conversation so far ends with (nothing, system, user, assistant):
   Delete 2, Insert an empty user or assistant turn 5, Keep 0, Rerole to user or
   assistant 1, kept truncated rows 5 more. A path's weight is one integer: its
   high digits are the cost; below stand ``width`` digits of three bits, one for
   each edit in order (D, I, K, R as 1 to 4), and zeros up to the end. So a plain
   integer minimum takes the cheapest path and, of those, the one whose letters
   are least in ASCII. Paths of one node and one cost have met the same rows, so
   none of them begins with all of another; what follows cannot turn their order.
   At most two Inserts stand together: a third would be undone for less.
4. The winning integer is read back digit by digit: it is the audit. The grammar
   allows one of user and assistant at every place, so the audit fixes the
   repaired rows.

``damage`` breaks rows by a checksum of their id and turn, for tests of recall.

Defined cases: a null role or text is one space (such a text is blank); null
turns come first and do not count in gaps; a null conversation id is one
conversation; conversations left without rows keep a row of zeros; an empty
table gives an empty result; other columns are not read. The result holds one
row per conversation, made of all its texts, so a conversation has to fit in a
task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_batches

#: What an edit costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The edits' letters in ASCII order; a letter's digit is its place, from 1.
LETTERS = "DIKR"
BITS = 3
#: What a conversation ends with so far.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The speaker that comes next, and what a role's initial leads to from there.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Codes of a row: initial (system, user, assistant, other) times 3, plus this.
SOUND, CUT, GONE = range(3)
INITIALS = "sua"
_FIRST = ord("a")
_SPACES = "\\x20\\x09-\\x0D"


def repair_codes(codes: str) -> tuple[int, str, list[int]]:
    """Cost, audit and plan for the row codes of a conversation. The plan has an
    entry for every repaired row: 3 * row + (0 kept, 1 user, 2 assistant), or -1
    and -2 for an inserted user and assistant."""
    width = len(codes) + len(codes) * DELETE // INSERT + 6
    unit = 1 << BITS * width
    digit = {letter: i + 1 for i, letter in enumerate(LETTERS)}
    price = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}

    def by(path: tuple[int, int], letter: str, more: int = 0) -> tuple[int, int]:
        weight, place = path  # place: letters so far
        return weight + (price[letter] + more) * unit + (digit[letter] << BITS * (width - 1 - place)), place + 1

    def offer(layer: dict, state: int, path: tuple[int, int]) -> None:
        if state not in layer or path < layer[state]:
            layer[state] = path

    def inserted(layer: dict) -> dict:
        for _ in range(2):
            wider = dict(layer)
            for state, path in layer.items():
                offer(wider, NEXT[state], by(path, "I"))
            layer = wider
        return layer

    layer = inserted({NOTHING: (0, 0)})
    for code in codes:
        initial, fault = divmod(ord(code) - _FIRST, 3)
        step: dict[int, tuple[int, int]] = {}
        for state, path in layer.items():
            offer(step, state, by(path, "D"))
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                offer(step, NEXT[state], by(path, "R", more))
                if initial + 1 == NEXT[state] or (initial + 1, state) == (SYSTEM, NOTHING):
                    offer(step, initial + 1, by(path, "K", more))
        layer = inserted(step)
    weight, length = min(layer[s] for s in (NOTHING, ASSISTANT) if s in layer)
    digits = [weight >> BITS * (width - 1 - i) & 7 for i in range(length)]
    audit = "".join(LETTERS[d - 1] for d in digits)
    plan, state, row = [], NOTHING, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            plan.append(-1 if state == USER else -2)
            continue
        if letter == "R":
            state = NEXT[state]
            plan.append(3 * row + (1 if state == USER else 2))
        elif letter == "K":
            state = (ord(codes[row]) - _FIRST) // 3 + 1
            plan.append(3 * row)
        row += 1
    return weight >> BITS * width, audit, plan


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text), by crc32(``conv_id:turn``) modulo 20: 0 drops
    a row, 1 empties its text, 2 strikes its ``.!?``, 3 repeats it, 4 makes it
    the user's. Nulls are one space, in the checksum, too."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"),
                        spaced(text_col).alias("text"),
                        (F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1)
    return (rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times)))
            .select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def marked(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with place (from 1), fault, code and
    ``illegal`` (their initial does not follow the one before)."""
    spaced = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = spaced.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (F.when(solid == "", "blank").when(seen, "duplicate")
             .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(Window.partitionBy("conv_id").orderBy("place"))
    illegal = before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")
    out = placed.withColumn("fault", fault).withColumn("illegal", illegal)
    kind = F.when(F.col("fault") == "", SOUND).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
    known = F.when(initial.isin(*INITIALS), F.instr(F.lit(INITIALS), initial) - 1).otherwise(len(INITIALS))
    return out.withColumn("code", F.char(_FIRST + 3 * known + kind))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows: conv_id,
    gaps, counts of faults, illegal, cost, audit, and ``turns``, the repaired
    rows (role, text) in order."""
    python_batches(rows.sparkSession)

    @F.pandas_udf("struct<cost: long, audit: string, plan: array<int>>")
    def best(codes: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        found = []
        for c in codes:
            if c not in known:
                known[c] = repair_codes(c)
            found.append(known[c])
        return pd.DataFrame(found, columns=["cost", "audit", "plan"])

    def of(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    convs = marked(rows).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "code"))).alias("rows"),
        of("blank"), of("duplicate"), of("truncated"), F.count_if("illegal").alias("illegal"))
    counted = rows.groupBy("conv_id").agg(gaps.alias("gaps")).withColumnRenamed("conv_id", "conv")
    found = convs.withColumn("best", best(F.array_join(F.transform("rows", lambda r: r["code"]), "")))

    def entry(p: Column) -> Column:
        row = F.get("rows", F.floor(F.greatest(p, F.lit(0)) / 3).cast("int"))
        role = F.when((p == -1) | ((p >= 0) & (p % 3 == 1)), "user").when((p == -2) | ((p >= 0) & (p % 3 == 2)), "assistant").otherwise(row["role"])
        return F.struct(role.alias("role"), F.when(p < 0, "").otherwise(row["text"]).alias("text"))

    return (found.join(counted, found.conv_id.eqNullSafe(F.col("conv")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit",
                    F.transform("best.plan", entry).alias("turns")))


def digest(repaired: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row for every id of ``conv_ids``; the repaired rows as a digest."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = conv_ids.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    text = F.coalesce(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), F.lit(""))
    return (ids.join(repaired, ids.id.eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(text.cast("binary"), 256).alias("repaired_sha256")))
