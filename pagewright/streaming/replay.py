"""Conversations as keyed state: what each reply of a run brings about."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.replies import IDENTITY

ACTIONS = ("help", "publish", "write_memo", "read_memo", "read_chatlog")
DIGEST = "n long, object boolean, action string, page long, memo boolean, fits boolean"
SCHEMA = "run_id string, msg_id long, answer string, forced boolean, retry_left long, read long, rolls long"


@dataclass
class Limits:
    force: int = 60_000
    remind: int = 32_000
    rolls: int = -1
    retries: int = 3
    chunk: int = 4


@dataclass
class State:
    """What a run remembers between replies; small, whatever its length."""

    pages: int
    retry_left: int
    forced: bool = False
    reminded: bool = False
    rolls: int = 0
    chars: int = 0
    chatlog: int = 0
    memo: int = 0
    over: str = ""
    read: set[int] = field(default_factory=set)


def parse(reply: str | None) -> dict | None:
    m = re.search(r"\{.*\}", reply or "", re.S)
    try:
        value = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _fits(identity: object) -> bool:
    if not isinstance(identity, dict) or set(identity) != set(IDENTITY):
        return False
    kinds = {str: str, list: list, float: (int, float)}
    return all(isinstance(identity[k], kinds[type(v)]) and not isinstance(identity[k], bool) for k, v in IDENTITY.items())


def digest(reply: str | None) -> tuple:
    """What a step needs to know of a reply, the columns of DIGEST without ``n``: few bytes whatever its length."""
    obj = parse(reply)
    if obj is None:
        return False, None, None, False, False
    action, page = obj.get("action"), obj.get("page")
    whole = isinstance(page, int) and not isinstance(page, bool) and 0 < page < 1 << 62  # others are out of range anyway
    return True, action if isinstance(action, str) and action in ACTIONS else None, page if whole else None, isinstance(obj.get("memo"), str), _fits(obj.get("identity"))


def guard(s: State, lim: Limits) -> list[str]:
    """What happens before a request because of the tokens used so far."""
    used, may_roll = s.chars // lim.chunk, lim.rolls < 0 or s.rolls < lim.rolls
    if used >= lim.force and may_roll:
        s.rolls, s.chars, s.reminded, s.chatlog = s.rolls + 1, 0, False, s.chatlog + 1
        return ["roll"]
    if used >= lim.force and not s.forced:
        s.forced, s.retry_left = True, lim.retries
        return ["force_publish", "help"]
    if lim.remind <= used < lim.force and not may_roll and not s.reminded:
        s.reminded = True
        return ["remind"]
    return []


def _refuse(s: State) -> str:
    if s.retry_left <= 0:
        s.over = "gave up"
        return "gave up"
    s.retry_left -= 1
    return "publish_retry"


def _stall(s: State, lim: Limits) -> str:
    s.forced, s.retry_left = True, lim.retries
    return "stall_to_publish"


def step(s: State, reply: str | None, lim: Limits) -> str:
    """The engine's answer to one reply; changes the state."""
    return answer(s, digest(reply), lim)


def answer(s: State, told: tuple, lim: Limits) -> str:
    """The engine's answer to one reply, by its digest; changes the state."""
    known, action, page, memo, fits = told
    if s.forced and action != "publish":
        return _refuse(s)
    if not known:
        return "bad_json_retry"
    if action == "help":
        return "help"
    if action == "publish":
        if fits:
            s.over = "published"
            return "published"
        return _refuse(s)
    if action == "write_memo":
        if not memo:
            return "memo_reject"
        s.memo += 1
        return "memo_saved"
    if action in ("read_memo", "read_chatlog"):
        most = s.memo if action == "read_memo" else s.chatlog
        return action.replace("read_", "") + "_deliver" if page is not None and page <= most else _stall(s, lim)
    if page is None or page > s.pages or page in s.read:
        return _stall(s, lim)
    s.read.add(page)
    return "page_deliver"


def answers(s: State, rows: Iterator[tuple[int, tuple, int]], lim: Limits) -> Iterator[tuple]:
    """(msg_id, answer, forced, retry_left, read, rolls) per reply of one run; rows are (msg_id, digest, characters sent)."""
    for msg_id, told, chars in rows:
        if s.over:
            yield msg_id, "after the end", s.forced, s.retry_left, len(s.read), s.rolls
            continue
        before = guard(s, lim)  # by what the request before had used, so the first one is always made
        s.chars += chars
        got = answer(s, told, lim)
        yield msg_id, " ".join([*before, got]), s.forced, s.retry_left, len(s.read), s.rolls


def replay(messages: DataFrame, context: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per reply: what a run under the protocol would answer to it.

    Rows of a run lie in one partition in order and stream through with their run's state, so no run is gathered.
    Texts stay where they are read: only digests of replies and lengths of requests meet in a run's partition.
    Runs without pages have zero of them.
    """
    lim = limits or Limits(rolls=0, force=3_000, remind=1_500)
    total = context.groupBy("run_id").agg(F.max("page_no").alias("pages"))

    def brief(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for speakers, texts in cols:
            out = [(len(t or ""), *(digest(t) if s == "assistant" else digest(None))) for s, t in zip(speakers, texts)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"page": "Int64"})

    told = F.pandas_udf(brief, DIGEST)("speaker", "text")
    rows = messages.select("run_id", "session", "turn", "msg_id", "speaker", told.alias("told")).select("run_id", "session", "turn", "msg_id", "speaker", "told.*").join(total, "run_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, sent = object(), None, 0
        for b in batches:
            out = []
            told = zip(b["object"], b["action"], [None if pd.isna(p) else int(p) for p in b["page"]], b["memo"], b["fits"])
            for r, msg, speaker, n, seen, pages in zip(b["run_id"], b["msg_id"], b["speaker"], b["n"], told, b["pages"]):
                if r != key:
                    key, sent, state = r, 0, State(0 if pd.isna(pages) else int(pages), lim.retries)
                if speaker != "assistant":
                    sent += int(n)
                    continue
                out += [(r, *a) for a in answers(state, iter([(msg, seen, sent)]), lim)]
                sent = 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.repartition("run_id").sortWithinPartitions("run_id", "session", "turn", "msg_id").mapInPandas(run, SCHEMA)
