"""Message logs: sessions, estimates, what replies ask for and what they get."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import replies as R, text as X

FORCE = 500  # estimated tokens; small, as messages here are short


#: Keys that arrive more than once are broadcast up to this number (some 16 MB); beyond it whole rows are shuffled by key.
FEW_KEYS = 1_000_000


def first_arrivals(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row per ``key``: the earliest by ``time``, nulls last; rows without a key count as one.

    Only keys are counted over all rows; those that arrive once, nearly all, stay where they are, so that later
    projections reach the scan.
    """
    again = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n")).filter("n > 1").select("__k")
    cols = [c for c in rows.columns if c != key]
    first = lambda df: df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(F.col(time).isNull(), time)).alias("m")).select(key, "m.*").select(*rows.columns)
    if again.limit(FEW_KEYS + 1).count() > FEW_KEYS:
        return first(rows)
    same = F.col(key).eqNullSafe(F.col("__k"))
    return rows.join(F.broadcast(again), same, "left_anti").unionByName(first(rows.join(F.broadcast(again), same, "left_semi")))


def unique_messages(messages: DataFrame) -> DataFrame:
    """Each ``msg_id`` once, its first arrival; speaker without case and surrounding space."""
    return first_arrivals(messages, "msg_id", "logged_at").withColumn("speaker", F.lower(X.strip(F.col("role"))))


def session_totals(messages: DataFrame) -> DataFrame:
    """(run_id, session, messages, turns, chars, tokens): size of each session and its estimate, rounded once."""
    per = messages.groupBy("run_id", "session").agg(
        F.count("*").cast("bigint").alias("messages"), F.sum((F.col("speaker") == "assistant").cast("bigint")).cast("bigint").alias("turns"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"),
    )
    return per.withColumn("tokens", X.estimated_tokens(F.col("chars")))


def last_sessions(messages: DataFrame) -> DataFrame:
    """(run_id, sessions): highest session of each run, 0 if it has none."""
    return messages.groupBy("run_id").agg(F.coalesce(F.max("session"), F.lit(0)).cast("bigint").alias("sessions"))


def prompt_counts(messages: DataFrame) -> DataFrame:
    """(run_id, prompt_key, n) of the requests."""
    return messages.filter("prompt_key is not null").groupBy("run_id", "prompt_key").agg(F.count("*").cast("bigint").alias("n"))


def watermark_sessions(messages: DataFrame, force: int = FORCE) -> DataFrame:
    """(run_id, session, msg_id, part): a session rolls on once its estimate has reached ``force`` tokens.

    The fold depends on the message before, so rows are read in order, hash-partitioned by session and sorted within
    the partition; the state is two numbers however long a session is.
    """
    rows = messages.select("run_id", "session", "turn", "msg_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chars, part = None, 0, 1
        for b in batches:
            parts = []
            for run, session, n in zip(b["run_id"], b["session"], b["n"]):
                if (run, session) != key:
                    key, chars, part = (run, session), 0, 1
                elif chars // 4 >= force:
                    chars, part = 0, part + 1
                chars += n
                parts.append(part)
            yield b[["run_id", "session", "msg_id"]].assign(part=parts)

    return rows.repartition("run_id", "session").sortWithinPartitions("run_id", "session", "turn", "msg_id").mapInPandas(roll, "run_id string, session long, msg_id long, part long")


def raw_bodies(messages: DataFrame) -> DataFrame:
    """(run_id, session, body): ``role: content`` lines of a session in order, as filed when it rolls without a summary.

    A body is one value, so a whole session is gathered in one task and nothing limits it: a session of more than
    2 GB of text fails.
    """
    line = F.concat(F.col("speaker"), F.lit(": "), F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("turn", "msg_id", line.alias("line"))))
    return messages.groupBy("run_id", "session").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"))


def parsed_replies(messages: DataFrame) -> DataFrame:
    """Replies with the object they hold (``doc``, null if none), its ``action``, page number and branch."""
    doc = messages.filter("speaker = 'assistant'").withColumn("doc", R.reply_json(F.col("text")))
    return doc.select("msg_id", "run_id", "session", "turn", "doc", F.get_json_object("doc", "$.action").alias("action"), R.page_number(F.col("doc")).alias("page"), R.branch(F.col("doc")).alias("branch"))


def page_requests(replies: DataFrame, context: DataFrame) -> DataFrame:
    """(msg_id, run_id, page, verdict) of replies that read a page: ``deliver`` the first time, else ``stall``.

    Out-of-range and non-integer pages stall.  The first request of a page is a grouped minimum and a join, no window,
    so a page asked for very often is no hot group.
    """
    total = context.groupBy("run_id").agg(F.max("page_no").alias("pages"))
    asked = replies.filter("branch = 'read_page'").join(total, "run_id", "left").withColumn("ok", F.coalesce(F.col("page").between(1, F.col("pages")), F.lit(False)))
    first = asked.filter("ok").groupBy("run_id", "page").agg(F.min(F.struct("session", "turn", "msg_id")).alias("f")).select(F.col("run_id").alias("r"), F.col("page").alias("p"), F.col("f.msg_id").alias("first_id"))
    both = asked.join(first, (F.col("run_id") == F.col("r")) & (F.col("page") == F.col("p")), "left")
    return both.select("msg_id", "run_id", "page", F.when(F.col("ok") & (F.col("msg_id") == F.col("first_id")), "deliver").otherwise("stall").alias("verdict"))


def delivered_pages(replies: DataFrame, context: DataFrame) -> DataFrame:
    """(msg_id, page_id, chars) of the context page each reply reads, also again."""
    asked = replies.filter("branch = 'read_page' and page is not null").select("msg_id", F.col("run_id").alias("r"), F.col("page").alias("p"))
    return asked.join(context, (F.col("r") == F.col("run_id")) & (F.col("p") == F.col("page_no"))).select("msg_id", "page_id", F.length("text").cast("bigint").alias("chars"))


def pages_read(requests: DataFrame) -> DataFrame:
    """(run_id, n_read, read): distinct delivered pages of each run, as a sorted list in text."""
    got = requests.filter("verdict = 'deliver'").groupBy("run_id").agg(F.array_sort(F.collect_set("page")).alias("p"))
    return got.select("run_id", F.size("p").cast("bigint").alias("n_read"), F.array_join(F.transform("p", lambda x: x.cast("string")), ", ").alias("read"))


def _memo_events(replies: DataFrame, page_chars: int, ratio: float) -> DataFrame:
    """(run_id, msg_id, branch, section, pages, tail) after each note, and as each request for a memo page finds the memo.

    Adding a section only fills on from the last page, so the state per run is that page and two counts.
    """
    rows = replies.filter("branch in ('write_memo', 'read_memo')").select("run_id", "session", "turn", "msg_id", "branch", R.text_field(F.col("doc"), "memo").alias("memo")).filter("branch = 'read_memo' or memo is not null")
    parts = F.filter(X.sentences(F.col("memo")), lambda s: F.length(s) <= X.longest_sentence(page_chars, ratio))
    rows = rows.withColumn("parts", F.when(F.col("branch") == "write_memo", parts)).drop("memo")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, section, done, page = None, 0, 0, ""
        for b in batches:
            out = []
            for run, msg, branch, parts in zip(b["run_id"], b["msg_id"], b["branch"], b["parts"]):
                if run != key:
                    key, section, done, page = run, 0, 0, ""
                section += branch == "write_memo"
                for s in parts if branch == "write_memo" else ():
                    if page and len(page) + 1 + len(s) > page_chars:
                        done, page = done + 1, s
                    else:
                        page = f"{page}\n{s}" if page else s
                out.append((run, msg, branch, section, done + (page != ""), page if branch == "write_memo" else None))
            yield pd.DataFrame(out, columns=["run_id", "msg_id", "branch", "section", "pages", "tail"])

    return rows.repartition("run_id").sortWithinPartitions("run_id", "session", "turn", "msg_id").mapInPandas(fill, "run_id string, msg_id long, branch string, section long, pages long, tail string")


def memo_pages(replies: DataFrame, page_chars: int = 500, ratio: float = 0.5) -> DataFrame:
    """(run_id, msg_id, section, pages, tail): the memo of a run after each note, re-paged as it grows.

    ``tail`` is the page shown when a session opens.
    """
    return _memo_events(replies, page_chars, ratio).filter("branch = 'write_memo'").drop("branch")


def last_memos(memos: DataFrame) -> DataFrame:
    """(run_id, sections, pages, tail) of each run's memo after its last note: what a new session opens with."""
    last = memos.groupBy("run_id").agg(F.max_by(F.struct("section", "pages", "tail"), "section").alias("m"))
    return last.select("run_id", F.col("m.section").alias("sections"), "m.pages", "m.tail")


def memo_verdicts(replies: DataFrame, page_chars: int = 500, ratio: float = 0.5) -> DataFrame:
    """(msg_id, branch, verdict) of notes and of requests for pages of notes or history.

    A note that isn't text is rejected; a page must be a whole number from 1, a memo page one the memo has by then, and
    may be read again.
    """
    rows = replies.filter("branch in ('write_memo', 'read_memo', 'read_chatlog')")
    memo = _memo_events(replies, page_chars, ratio).filter("branch = 'read_memo'").select(F.col("msg_id").alias("m"), "pages")
    asked = rows.join(memo, F.col("msg_id") == F.col("m"), "left")
    note = F.when(R.text_field(F.col("doc"), "memo").isNull(), "memo_reject").otherwise("memo_saved")
    there = (F.col("page") >= 1) & ((F.col("branch") != "read_memo") | (F.col("page") <= F.col("pages")))
    page = F.when(F.coalesce(there, F.lit(False)), "deliver").otherwise("stall")
    return asked.select("msg_id", "branch", F.when(F.col("branch") == "write_memo", note).otherwise(page).alias("verdict"))


def summary_replies(messages: DataFrame) -> DataFrame:
    """(msg_id, valid): whether a reply to a summary request is an object with nothing but a text ``summary``."""
    rows = messages.filter("prompt_key = 'chatlog_summarize_reply'").select("msg_id", R.reply_json(F.col("text")).alias("doc"))
    good = (F.size(R.check_template(F.col("doc"), R.CONTRACTS["chatlog_summary"]["template"])) == 0) & ~X.is_blank(F.get_json_object("doc", "$.summary"))
    return rows.select("msg_id", F.coalesce(good, F.lit(False)).alias("valid"))


def retries(messages: DataFrame, budget: int = 3) -> DataFrame:
    """(run_id, session, asked, left): retries asked for after a forced tail began, which renews the budget, and what is left."""
    mark = messages.filter("prompt_key in ('force_publish', 'stall_to_publish')").groupBy("run_id", "session").agg(F.max("turn").alias("since"))
    asked = messages.filter("prompt_key = 'publish_retry'").select("run_id", "session", "turn")
    counted = asked.join(mark, ["run_id", "session"], "left").filter("since is null or turn > since").groupBy("run_id", "session").agg(F.count("*").cast("bigint").alias("asked"))
    return counted.withColumn("left", F.greatest(F.lit(0), F.lit(budget) - F.col("asked")).cast("bigint"))
