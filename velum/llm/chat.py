"""Chat formatting from event logs, with DataFrame functions only.

A log row is (conversation, turn, seq, kind, role, text). Events of a turn are sorted by seq and folded: `message` and
`edit` replace the text, `open` and `regenerate` start it anew, `delta` appends. Folded turns are rendered by a template
whose control strings are escaped inside roles and texts, so that the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common templates without their first character, as patterns.
CONTROL = r"\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|<</SYS>>|</SYS>>"
RESETS, KINDS = ("message", "edit", "open", "regenerate"), ("message", "edit", "open", "regenerate", "delta")


def escape(text: Column) -> Column:
    r"""Puts one more backslash behind the first character of every control string, also of those already escaped."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undoes escape()."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    role = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): the final message of every (conv_id, turn, part) of the log.

    `events` has conv_id, turn, part, seq, kind, role, text (part tells messages of the same turn apart). Grouped by
    message, so a conversation with very many turns is spread; one message's events are sorted in one row. Null texts
    count as empty, a role is the last that isn't null (none: empty), rows of other kinds are ignored, equal seq are
    taken in the order of kind, text. Null conversations form one of their own. Extra columns are dropped.
    """
    log = events.where(F.col("kind").isin(*KINDS)).select("conv_id", "turn", "part", F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    got = log.groupBy("conv_id", "turn", "part").agg(F.array_sort(F.collect_list("e")).alias("e"))
    last = F.array_max(F.transform("e", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(0)))
    tail = F.slice("e", last + 1, F.size("e"))
    roles = F.filter(F.transform("e", lambda e: e["role"]), lambda r: r.isNotNull())
    return got.select(
        "conv_id", "turn", "part",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss has (turn, start, chars) of each assistant text.

    `turn` counts rendered turns from 0, `start` counts code points from the start of that turn. The rendered text of a
    conversation is one value, so one conversation must fit in a row; conversations are spread over tasks.
    """
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = messages.select("conv_id", "turn", "part", "role", head.alias("head"), body.alias("body"))
    turn = F.struct(
        "turn", "part", F.concat("head", "body", F.lit(END + "\n")).alias("out"),
        (F.col("role") == "assistant").alias("learn"), F.char_length("head").alias("start"), F.char_length("body").alias("chars"),
    )
    got = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    spans = F.transform("t", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["chars"].alias("chars"), t["learn"].alias("learn")))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["out"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: s.dropFields("learn")).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, learned array<string>): parsed from `formatted` and `loss`."""
    pieces = F.split("formatted", r"\Q" + END + r"\E\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = len(START) + 1
    role = lambda p: F.substring_index(F.substring(p, F.lit(cut), F.char_length(p)), "\n", 1)
    rest = lambda p: F.substring(p, F.char_length(role(p)) + cut + 1, F.char_length(p))
    return rendered.withColumn("_p", pieces).select(
        "conv_id", "formatted",
        F.transform("_p", lambda p: F.struct(_role_in(role(p)).alias("role"), unescape(rest(p)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.get(F.col("_p"), s["turn"]), s["start"] + 1, s["chars"]))).alias("learned"),
    )


def log_of(conversations: DataFrame, chunk: int = 512) -> DataFrame:
    """The event log of finished conversations (conv_id, turn, role, text): assistant texts arrive as streamed deltas.

    Rows of the same turn stay separate messages (part), in the order of role and text; repeated rows stay repeated.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    event = lambda seq, kind, text: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / chunk).cast("int")),
        lambda i: event(i + 1, "delta", F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))),
    )
    streamed = F.concat(F.array(event(F.lit(0), "open", F.lit(""))), deltas)
    whole = F.array(event(F.lit(0), "message", F.col("text")))
    rows = rows.select("conv_id", "turn", "part", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(whole)).alias("e"))
    return rows.select("conv_id", "turn", "part", "role", "e.*")
