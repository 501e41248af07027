"""Chat formatting: fold a conversation's event log into messages and render them.

An event is (conversation, message, seq, kind, role, text):

* ``message`` sets a message's text, ``delta`` appends to it, ``edit`` replaces it;
* ``regenerate`` replaces it too and drops what later messages had logged before that.

``fold_events`` sorts each conversation's log once and gives one row per message. ``render``
writes each message as

    <|im_start|>ROLE
    TEXT<|im_end|>

and names the spans a loss is taken on (texts of ``assistant``). Control strings inside a text
get a backslash after their first character, those that already have backslashes one more, so
``unescape`` is exact. Roles are percent-coded where they hold ``%``, ``<``, ``[`` or a line
break. All of it is SQL functions; one shuffle by conversation serves every step.

Defined results: NULL text or role is the empty text; a NULL conversation id is a conversation
like any other; equal ``seq`` is ordered by kind, role and text; events of an unknown kind act as
``message``; an empty log gives no rows. A conversation is one value, so it must fit Spark's limit
for a value (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableloom.llm.text import text_of

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of this template and of others in common use.
CONTROL = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|\|endoftext\|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def _coded_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _plain_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def fold_events(events: DataFrame) -> DataFrame:
    """One row per message: conversation, message, role, text. ``message`` is a number."""
    earlier = W.partitionBy("conversation").orderBy("message").rangeBetween(W.unboundedPreceding, -1)
    live = (
        events.select(
            "conversation",
            F.col("message").cast("long").alias("message"),
            F.col("seq").cast("long").alias("seq"),
            F.coalesce("kind", F.lit("message")).alias("kind"),
            text_of("role").alias("role"),
            text_of("text").alias("text"),
        )
        .withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .where("cut IS NULL OR seq >= cut")
    )
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    folded = live.groupBy("conversation", "message").agg(log.alias("log"))
    resets = F.filter("log", lambda e: e["kind"] != "delta")
    kept = F.when(
        F.size(resets) > 0,
        F.concat(
            F.slice(resets, -1, 1),
            F.filter("log", lambda e: (e["kind"] == "delta") & (e["seq"] > F.element_at(resets, -1)["seq"])),
        ),
    ).otherwise(F.col("log"))
    return folded.withColumn("kept", kept).select(
        "conversation",
        "message",
        F.element_at("kept", 1)["role"].alias("role"),
        F.array_join(F.transform("kept", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted text, number of turns, spans under the loss mask.

    Spans are (start, end) in code points of the formatted text, end exclusive.
    """
    head = F.concat(F.lit(START), _coded_role(text_of("role")), F.lit("\n"))
    pieces = messages.select(
        "conversation", "message", text_of("role").alias("role"), head.alias("head"), escape(text_of("text")).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = W.partitionBy("conversation").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("start", start).select(
        "conversation",
        F.struct(
            "message",
            "piece",
            (F.col("role") == LOSS_ROLE).alias("loss"),
            "start",
            (F.col("start") + F.length("body")).alias("end"),
        ).alias("turn"),
    )
    return placed.groupBy("conversation").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conversation",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: the turns and the texts under the loss mask, unescaped."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            _plain_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"\A[^\n]*\n", "")).alias("text"),
        ),
    )
    losses = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.select("*", turns.alias("turns"), losses.alias("loss_texts"))
