"""Problem 3: rebuild conversations from message rows and find the broken ones.

Rows are partitioned by conversation key and ordered by turn; a finite-state
automaton reads their symbols.  Its transition function is composed block by
block (``BLOCK`` turns), so a conversation that holds a third of all rows is
spread over many groups of bounded size and only the blocks' results meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import first_arrival

BLOCK = 1024
# States are sets of these facts about the turns read so far.
SYSTEM, USER_TEXT, REPLY_TEXT, ENDS_WITH_REPLY, BROKEN = 1, 2, 4, 8, 16
COMPLETE = SYSTEM | USER_TEXT | REPLY_TEXT | ENDS_WITH_REPLY
# Unicode white space
_BLANK = r"^[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"
_EDGES = _BLANK[1:-2] + "+"


def clean_role(role: Column) -> Column:
    """Role without surrounding white space and case; null for what is none of the three roles."""
    plain = F.lower(F.regexp_replace(role, f"^{_EDGES}|{_EDGES}$", ""))
    return F.when(plain.isin("system", "user", "assistant"), plain)


def has_text(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(_BLANK)


def _symbol(role: Column, text: Column) -> Column:
    """Facts a row adds; the ENDS_WITH_REPLY bit is set or cleared by every row."""
    return (
        F.when(role.isNull(), F.lit(BROKEN))
        .when(role == "system", F.lit(SYSTEM))
        .when(role == "user", F.when(has_text(text), F.lit(USER_TEXT)).otherwise(F.lit(0)))
        .otherwise(F.when(has_text(text), F.lit(REPLY_TEXT | ENDS_WITH_REPLY)).otherwise(F.lit(ENDS_WITH_REPLY)))
    )


def _step(state: Column, symbol: Column) -> Column:
    """The automaton's transition: facts accumulate, only the last row decides how the conversation ends."""
    return state.bitwiseAND(F.lit(~ENDS_WITH_REPLY)).bitwiseOR(symbol)


def conversation_states(messages: DataFrame) -> DataFrame:
    """One row per (run_id, session): final ``state``, ``turns``, ``keep``.

    Repeated arrivals (same ``msg_id``) count once; rows without ``msg_id`` all count.  Null, repeated or missing
    turns, turns that don't run 1..n and unknown or null roles break a conversation.  Null run or session form keys of
    their own.  No rows, no conversations.
    """
    slim = messages.select("msg_id", "run_id", "session", "turn", "logged_at", _symbol(clean_role(F.col("role")), F.col("text")).alias("sym"))
    rows = first_arrival(slim, "msg_id", "logged_at")  # texts stay where they are
    keys = ["run_id", "session"]
    turns = rows.groupBy(*keys, "turn").agg(F.count("*").alias("n"), F.min("sym").alias("sym"))
    bad = (F.col("n") > 1) | F.col("turn").isNull() | (F.col("turn") < 1)
    turns = turns.select(
        *keys, F.coalesce("turn", F.lit(0)).alias("turn"), "n",
        F.when(bad, F.col("sym").bitwiseOR(F.lit(BROKEN))).otherwise(F.col("sym")).alias("sym"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "sym")))  # at most BLOCK entries: turns are distinct here
    blocks = turns.groupBy(*keys, F.floor((F.col("turn") - 1) / BLOCK).alias("block")).agg(
        F.aggregate(ordered, F.lit(0), lambda s, x: _step(s, x["sym"])).alias("fold"),
        F.max("turn").alias("last"), F.min("turn").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("steps"),
    )
    whole = blocks.groupBy(*keys).agg(
        F.bit_or(F.col("fold").bitwiseAND(F.lit(~ENDS_WITH_REPLY))).alias("facts"),
        F.max_by("fold", "block").bitwiseAND(F.lit(ENDS_WITH_REPLY)).alias("end"),
        F.max("last").alias("last"), F.min("first").alias("first"), F.sum("steps").alias("steps"), F.sum("rows").alias("turns"),
    )
    gap = (F.col("first") != 1) | (F.col("last") != F.col("steps"))
    state = F.col("facts").bitwiseOR(F.col("end")).bitwiseOR(F.when(gap, F.lit(BROKEN)).otherwise(F.lit(0)))
    return whole.select(*keys, "turns", state.alias("state")).withColumn("keep", F.col("state") == COMPLETE)


def broken_conversations(messages: DataFrame) -> DataFrame:
    """(run_id, session) of the conversations to drop."""
    return conversation_states(messages).filter(~F.col("keep")).select("run_id", "session")


def kept_rows(messages: DataFrame) -> DataFrame:
    """Rows of the conversations that are kept, each turn once, with their ``block``, ``speaker`` and whether there are ``many`` blocks.

    Hash-partitioned by run, session and block of turns, which later windows reuse: texts are moved once, and a
    conversation that holds a third of all rows lies in many partitions.  In a kept conversation two rows of one turn
    are arrivals of one message; the first by ``logged_at`` stays.
    """
    blocks = conversation_states(messages).filter("keep").select(
        F.col("run_id").alias("__r"), F.col("session").alias("__s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("turns") - 1) / BLOCK).cast("bigint"))).alias("__b"), (F.col("turns") > BLOCK).alias("many")
    )
    rows = messages.select("msg_id", "run_id", "session", "turn", "role", "text", "prompt_key", "logged_at").withColumn("block", F.floor((F.col("turn") - 1) / BLOCK).cast("bigint"))
    same = F.col("run_id").eqNullSafe(F.col("__r")) & F.col("session").eqNullSafe(F.col("__s")) & F.col("block").eqNullSafe(F.col("__b"))
    w = W.partitionBy("run_id", "session", "block").orderBy("turn", F.col("logged_at").isNull(), "logged_at")
    first = rows.join(blocks, same).drop("__r", "__s", "__b").withColumn("__before", F.lag("turn").over(w)).filter("__before is null or __before <> turn")
    return first.drop("__before", "logged_at").withColumn("speaker", clean_role(F.col("role"))).drop("role")


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """The rows of the conversations that are kept: run_id, session, turn, msg_id, speaker, prompt_key, text.

    In order of turns within each block of a conversation; every column of a row comes from its first arrival.
    """
    return kept_rows(messages).select("run_id", "session", "turn", "msg_id", "speaker", "prompt_key", "text")
