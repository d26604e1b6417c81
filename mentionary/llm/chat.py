"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: a message starts, grows by streamed deltas, is
edited, generated again or deleted. The log of each conversation is sorted by its
sequence numbers and folded into the final messages, which are then rendered with a
chat template. Events are first partitioned by conversation, and everything after
happens inside that partitioning: one shuffle in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, DELTA, EDIT, REGENERATE, DELETE = "start", "delta", "edit", "regenerate", "delete"
ROLES = ("system", "user", "assistant", "tool")


def events_of(conversations: DataFrame, delta_chars: int = 256) -> DataFrame:
    """The event log that finished turns stand for: (conv_id, seq, msg, kind, role, text).

    Each row of (conv_id, turn, role, text) is a start and the deltas of its text, in
    pieces of ``delta_chars``. Where a turn has several rows, they are attempts at it, in
    the order of their role and text: each regenerates the one before.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("msg"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null and msg is not null")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / delta_chars)).cast("int")), lambda i: F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars)))
    attempts = rows.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(F.struct("role", "text"))).alias("tries"))
    each = attempts.select("conv_id", "msg", F.posexplode("tries").alias("attempt", "try")).select("conv_id", "msg", "attempt", "try.role", "try.text")
    head = F.struct(F.lit(0).alias("k"), F.when(F.col("attempt") == 0, START).otherwise(REGENERATE).alias("kind"), F.lit("").alias("text"))
    body = F.zip_with(F.sequence(F.lit(1), F.size("pieces")), F.col("pieces"), lambda k, p: F.struct(k.alias("k"), F.lit(DELTA).alias("kind"), p.alias("text")))
    log = each.withColumn("pieces", pieces).select("conv_id", "msg", "attempt", "role", F.explode(F.concat(F.array(head), body)).alias("e"))
    return log.select("conv_id", ((F.col("msg") * 1_000 + F.col("attempt")) * 1_000_000 + F.col("e.k")).alias("seq"), "msg", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of each conversation: (conv_id, msg, first_seq, role, text).

    In order of seq (ties: by kind and text; repeated equal events count once), a start,
    an edit or a regenerate sets the text that later deltas add to, and a delete leaves
    nothing until a later one of these. The role is the last one given. Events with a
    null conversation, message or seq are left out; a null text is empty; deltas of a
    message that never started make a message.
    """
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("msg").cast("long").alias("msg"), F.col("seq").cast("long").alias("seq"), F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    e = e.where("conv_id is not null and msg is not null and seq is not null").repartition("conv_id")
    log = e.groupBy("conv_id", "msg").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("seq", "kind", "text", "role")))).alias("log"))
    sets: Column = F.transform("log", lambda x: x["kind"] != DELTA)
    last = F.array_max(F.transform(sets, lambda s, i: F.when(s, i).otherwise(-1)))
    base = F.when(F.col("last") < 0, F.lit("")).otherwise(F.get("log", F.col("last"))["text"])
    gone = (F.col("last") >= 0) & (F.get("log", F.col("last"))["kind"] == DELETE)
    tail = F.slice("log", F.col("last") + 2, F.size("log"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return (
        log.withColumn("last", last)
        .where(~gone)
        .select("conv_id", "msg", F.get("log", F.lit(0))["seq"].alias("first_seq"), F.get(roles, F.size(roles) - 1).alias("role"), F.concat(base, F.array_join(F.transform(tail, lambda x: x["text"]), "")).alias("text"))
    )


def render(messages: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_messages, chat): messages in order of their first event, each as ``begin`` role, line feed, text, ``end``, line feed.

    Marks inside a text are broken up with a space, so that a text can't end its own
    message; an unknown or null role is rendered as user.
    """
    safe = F.replace(F.replace(F.col("text"), F.lit(begin), F.lit(begin[:1] + " " + begin[1:])), F.lit(end), F.lit(end[:1] + " " + end[1:]))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    lines = messages.select("conv_id", F.struct("first_seq", "msg", F.concat(F.lit(begin), role, F.lit("\n"), safe, F.lit(end), F.lit("\n")).alias("line")).alias("m"))
    return lines.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "").alias("chat"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Whole conversations, rebuilt from their events and rendered: (conv_id, n_messages, chat).

    Null conversations and turns are left out, null texts are empty messages, repeated
    equal rows change nothing, of different rows for one turn the last attempt stays; an
    empty table gives no rows; texts are rendered whole; other columns are not read.
    """
    own = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return render(fold_events(events_of(own)))


#: The same from the turns themselves.
CHAT_SQL = r"""
WITH attempts AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC NULLS LAST, coalesce(text, '') DESC) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
)
SELECT conv_id, count(*)::BIGINT AS n_messages,
       string_agg('<|im_start|>' || CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE 'user' END || chr(10)
         || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat
FROM attempts WHERE k = 1 GROUP BY conv_id
"""
