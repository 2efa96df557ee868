"""Operator 3: chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: ``open`` starts a message with a role, ``delta`` appends text, ``edit``
replaces a message's text, ``regenerate`` voids a message's text and all later messages. The log is
partitioned by conversation, sorted by sequence and folded into final messages; those are rendered with a
template whose control strings cannot occur inside a text, as ``%``, ``<`` and ``[`` are escaped.

A rendered conversation is one cell of the output, so its messages meet in one task by definition; everything
before that (folding) is keyed by conversation and message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.llm.common import table

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What is escaped inside roles and texts, in this order; undone in reverse.
ESCAPES = [("%", "%25"), ("<", "%3C"), ("[", "%5B")]
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, kind, role, text).

    Within a conversation, events apply in the order of seq (ties: kind, role, text). A message exists if an
    ``open`` of it survives the last ``regenerate`` of an earlier message; a ``regenerate`` of the message itself
    keeps its role. Null texts and roles are empty; events of unknown kinds, or with a null kind, do nothing. A
    null conversation or message is a key of its own, sorted first. Repeated events apply twice. No events give
    no messages. Other columns are dropped.
    """
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    event = F.struct(
        "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("log"), regenerated.alias("redone")
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("void", F.max("redone").over(earlier))
    live = F.filter("log", lambda e: F.col("void").isNull() | (e.seq > F.col("void")))
    turns = turns.withColumn("log", live)
    known = F.filter("log", lambda e: F.coalesce(e.kind.isin("open", "edit", "regenerate", "delta"), F.lit(False)))
    turns = turns.select("conv_id", "message", known.alias("log"))
    # What follows the last event that sets or voids the text, that event included, is the text.
    last = F.array_max(F.transform("log", lambda e, i: F.when(e.kind != "delta", i)))
    opens = F.filter("log", lambda e: e.kind == "open")
    turns = turns.withColumns({"last": last, "opens": opens}).filter(F.size("opens") > 0)
    parts = F.filter("log", lambda e, i: (i >= F.col("last")) & (e.kind != "regenerate"))
    text = F.array_join(F.transform(parts, lambda e: e.text), "")
    return turns.select("conv_id", "message", F.element_at("opens", -1)["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted``, and ``loss_spans`` (begin, length in code points of formatted).

    Messages are rendered in the order of ``message``. The spans cover the escaped texts of assistant messages.
    Null roles and texts are empty. No messages give no rows.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    rows = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    rows = rows.select(
        "conv_id",
        F.struct(
            "message",
            "piece",
            F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False)).alias("trained"),
            F.struct(begin.cast("long").alias("begin"), F.char_length("body").alias("length")).alias("span"),
        ).alias("m"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m")).select(
        "conv_id",
        F.array_join(F.col("m.piece"), "").alias("formatted"),
        F.transform(F.filter("m", lambda m: m.trained), lambda m: m.span).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations with ``messages`` (role, text) and ``loss_text`` parsed from ``formatted`` and ``loss_spans``."""
    pieces = F.split("formatted", r"<\|turn\|>", -1)
    pieces = F.filter(pieces, lambda p, i: i > 0)

    def message(p: Column) -> Column:
        body = F.substring_index(F.substring_index(p, BODY, -1), END, 1)
        return F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(body).alias("text"))

    def trained(s: Column) -> Column:
        return unescape(F.substring("formatted", (s.begin + 1).cast("int"), s.length))

    return formatted.withColumn("messages", F.transform(pieces, message)).withColumn(
        "loss_text", F.array_join(F.transform("loss_spans", trained), "")
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """The conversations table as the log of a chat in which each message is drafted, discarded and written again.

    Rows of a conversation are ordered by turn (nulls first; ties by role and text), each a message of its own. It opens, gets a
    draft that an edit replaces, is followed by a message that its regeneration discards, and then gets its text in two
    deltas; every other message gets a wrong end instead, which an edit mends. Only the fold tells what was said.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    none = F.lit(None).cast("string")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    mended = F.col("message") % 2 == 0
    steps: list[tuple[int, str, Column, Column]] = [
        (0, "open", F.col("role"), none),
        (0, "delta", none, F.concat(F.lit("draft "), first)),
        (0, "edit", none, F.concat(second, F.lit(" superseded"))),
        (1, "open", F.lit("user"), F.lit("discarded ")),
        (1, "delta", none, first),
        (0, "regenerate", none, none),
        (0, "delta", none, first),
        (0, "delta", none, F.when(mended, F.lit(" wrong")).otherwise(second)),
        (0, "edit", none, F.when(mended, F.col("text"))),
    ]
    events = F.array(
        *(
            F.struct(
                (F.col("message") + later).alias("message"), (F.col("message") * len(steps) + k).alias("seq"),
                (F.when(mended, F.lit(kind)) if k == len(steps) - 1 else F.lit(kind)).alias("kind"), role.alias("role"), text.alias("text"),
            )
            for k, (later, kind, role, text) in enumerate(steps)
        )
    )
    return rows.select("conv_id", F.inline(events))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's conversation -1, formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    added = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select(*columns).unionByName(added)
    read = read_back(render(fold_events(log_of(rows))))
    whole = F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit("\n"), m.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)
), e AS (
  SELECT *, length(replace(replace(replace(role || text, '%', '%25'), '<', '%3C'), '[', '%5B')) + 24 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
