r"""Chat formatting from an event log, with DataFrame operations only.

Events ``(conv_id, seq, msg_id, kind, role, text)``, with ``part`` where several have one seq,
rebuild each conversation:

* ``message`` begins or replaces a message with its whole text;
* ``delta`` appends a streamed piece to what is there;
* ``edit`` replaces the text (and, where given, the role);
* ``regenerate`` discards the text so far; later deltas fill it again;
* ``delete`` removes the message.

The log is grouped by message first, so that a long stream of deltas is folded before the
conversations are put together. A message stands where its first event stood; messages that
began at one seq are ordered by role, text and id.

Template: ``### <role>: <text> </turn>`` and a newline for each message. Inside roles and
texts a backslash is written ``\b``, ``###`` is ``\h``, ``</turn>`` is ``\t`` and, in roles
alone, a colon is ``\c``; so control strings never occur there, and reading back is exact.

Defined results: null texts and roles are empty; a null kind is ``message``; unknown kinds
raise; each row of a null msg_id is a message of its own at its seq; ties of seq and part are
ordered by kind, role and text, so the result doesn't depend on the order of rows; an event
of a message that is delivered again in full, seq and part included, counts once; rows of
conversations that are repeated in full are as many turns; null seqs come first; an empty log
gives an empty table. A null conv_id is a conversation like any other. All messages of one
conversation meet in one row, since its formatted text is one value.
Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of events, and the control strings with what stands for them.
KINDS = ("message", "delta", "edit", "regenerate", "delete")
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TURN = r"(?s)### ([^:]*): (.*?) </turn>\n"


def escape(col: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in pairs:
        col = F.replace(col, F.lit(plain), F.lit(coded))
    return col


def unescape(col: Column, pairs: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        col = F.replace(col, F.lit(coded), F.lit(plain))
    return col


def fold_messages(events: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: the messages that stand after all events."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    part = F.col("part").cast("int") if "part" in events.columns else F.lit(0)
    rows = events.select(
        "conv_id",
        F.col("seq").alias("seq"),
        part.alias("part"),
        F.col("msg_id").cast("string").alias("msg"),
        F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kind))).alias("kind"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Summed before it is shuffled: once for a named message's event, and as often as it comes for a message without a name.
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    alone = F.concat(F.lit("seq "), F.coalesce(F.col("seq").cast("string"), F.lit("")), F.lit(" "), F.sha2(F.concat_ws("\n", "part", "kind", F.coalesce("role", F.lit("")), "text"), 256))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("msg").isNull(), F.col("times")).otherwise(F.lit(1)).cast("int")))
    rows = counted.withColumn("copy", copies).withColumn("msg", F.coalesce("msg", F.concat(alone, F.lit(" "), F.lpad(F.col("copy").cast("string"), 10, "0")))).drop("times", "copy")
    start = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(False).alias("there"))

    def step(state: Column, e: Column) -> Column:
        kept = e["kind"].isin("delta")
        parts = F.when(kept, F.concat(state["parts"], F.array(e["text"]))).when(e["kind"].isin("regenerate", "delete"), F.array().cast("array<string>")).otherwise(F.array(e["text"]))
        return F.struct(F.coalesce(e["role"], state["role"]).alias("role"), parts.alias("parts"), (e["kind"] != "delete").alias("there"))

    folded = rows.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("seq", "part", "kind", "role", "text"))).alias("log"))
    final = folded.select("conv_id", F.col("log")[0]["seq"].alias("at"), "msg", F.aggregate("log", start, step).alias("m"))
    return final.where("m.there").select("conv_id", "at", "msg", F.coalesce("m.role", F.lit("")).alias("role"), F.array_join("m.parts", "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text of each conversation and, in code points from 0, end exclusive, the spans to learn from.

    A span covers the escaped text of a message whose role is in ``learn``.
    """
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "msg"))).alias("told"))
    told = lambda t: F.struct(F.concat(F.lit("### "), escape(t["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn"))
    whole = whole.select("conv_id", F.transform("told", told).alias("turns"))
    tail = " </turn>\n"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(tail)).cast("long").alias("at"), F.when(t["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted``: roles and texts parsed from the formatted text, and all text under the loss mask, unescaped."""
    heads = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    turns = F.transform(F.arrays_zip(heads.alias("role"), bodies.alias("text")), lambda t: F.struct(unescape(t["role"], ROLE_ESCAPES).alias("role"), unescape(t["text"]).alias("text")))
    # Substrings of a long text by code points start from its beginning each time; one pass over character arrays isn't better in Spark, and conversations are bounded by what a model reads.
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def format_conversations(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold the events and render each conversation."""
    return render(fold_messages(events), learn)


def as_events(conversations: DataFrame, streamed: bool = False) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as an event log: each row is a message, also where turns or whole rows repeat.

    ``streamed`` logs each message as it might have come about: a draft that is regenerated and
    streamed in two pieces, or, of every other length, edited and then carried on.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    named = copies.withColumn("msg_id", F.concat_ws(" ", turn, F.sha2(F.concat_ws("\n", turn, "role", "text"), 256), F.lpad(F.col("copy").cast("string"), 10, "0")))
    event = lambda k, kind, text, role=None: F.struct(F.lit(k).alias("part"), F.lit(kind).alias("kind"), F.col("role").alias("role") if role else F.lit(None).cast("string").alias("role"), text.alias("text"))
    text, n = F.col("text"), F.length("text")
    half, draft = F.floor(n / 2).cast("int"), F.substring("text", 1, 20)
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, n)
    none = F.lit(None).cast("string")
    if streamed:
        again = F.array(event(0, "message", draft, True), event(1, "regenerate", none), event(2, "delta", first), event(3, "delta", rest))
        edited = F.array(event(0, "message", draft, True), event(1, "edit", first), event(2, "delta", rest))
        log = F.when(n % 2 == 0, again).otherwise(edited)
    else:
        log = F.array(event(0, "message", text, True))
    return named.select("conv_id", F.col("turn").alias("seq"), "msg_id", F.explode(log).alias("e")).select("conv_id", "seq", "msg_id", "e.*")
