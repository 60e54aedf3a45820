"""Chat formatting by a finite-state machine over roles. DataFrame only.

A template is plain data: the strings around a turn, the roles under the loss
mask, and the machine's arcs. Turns are ordered by (turn, role, text). The
machine walks the roles; a turn without an arc makes the conversation invalid,
which is reported (``valid``, ``bad_turn``), and it is formatted all the same.
Control strings inside a text are escaped: each backslash is doubled, then
``<|`` becomes ``<\\|``; no escaped text holds ``<|``, and the reverse is exact.

Defined cases: null text is empty; null role is the empty role, which no arc
accepts; null turns sort first; repeated rows are turns of their own; a null
conversation id is one conversation. An empty table gives an empty result.
Extra columns are not read. One conversation is one output row by contract, so
a conversation has to fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    #: (state, role) -> state
    arcs: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("begin", "system"): "system",
        ("begin", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    })
    accepting: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    """As texts, and a line feed becomes ``<\\n``: the role ends at the first."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss) in
    order whose texts make up ``formatted``, valid, bad_turn (place of the first
    turn without an arc, from 0; null if none)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        loss = F.array_contains(F.array(*map(F.lit, template.loss_roles)), t["role"])
        head = F.concat(F.lit(template.start), _escape_role(t["role"]), F.lit(template.after_role))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"]).alias("text"), loss.alias("loss")),
                       F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))

    arcs = F.create_map(*[F.lit(x) for (state, role), to in template.arcs.items() for x in (f"{state}\0{role}", to)])
    begin = F.struct(F.lit(template.first).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(arcs, F.concat(acc["state"], F.lit("\0"), t["role"]))
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"), (acc["at"] + 1).alias("at"),
                        F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"))

    ended = F.aggregate("ts", begin, step)
    return (convs.select("conv_id", F.flatten(F.transform("ts", segments)).alias("segments"), ended.alias("ended"))
            .select("conv_id", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), "segments",
                    F.col("ended.state").isin(*template.accepting).alias("valid"), F.col("ended.bad").alias("bad_turn")))


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turns (role, text) parsed from ``formatted``, and loss_texts,
    the unescaped texts under the loss mask, from the segments' flags."""
    pattern = "".join("\\" + c if not c.isalnum() else c for c in template.start)
    parts = F.slice(F.split("formatted", pattern), 2, 1_000_000_000)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.after_role, 1)
        skip = F.length(role) + len(template.after_role)
        body = F.substr(part, skip + 1, F.length(part) - skip - len(template.end))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    masked = F.filter("segments", lambda s: s["loss"])
    return chats.select("conv_id", F.transform(parts, turn).alias("turns"),
                        F.transform(masked, lambda s: unescape(s["text"])).alias("loss_texts"), "formatted", "valid", "bad_turn")


def digest(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """The read-back of the output as counts and digests."""
    loss = F.concat_ws("", "loss_texts")
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read_back(chats, template).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
