"""Registered queries of this package, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, cutting, langid, leaks, mojibake, packing, pairs, quality, sentences
from .common import spread, table, unique_pages

Query = Callable[[SparkSession, str], DataFrame]


def _budget(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "budgets").filter(F.col("purpose") == purpose).select("capacity", "overlap").first()
    return int(row["capacity"]), int(row["overlap"] or 0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_damaged(unique_pages(spark, d), source="run_id")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Damaged pages with their cipher and the text that could be had again."""
    return mojibake.repair_encoding(unique_pages(spark, d), source="run_id").filter("damage_odds > 0").select("page_id", "cipher", "damage_odds", "repaired")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_kinds(unique_pages(spark, d), table(spark, d, "common_words"))


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every content page, one column each, with its mixture component and kind."""
    found = quality.classify_pages(quality.content_pages(unique_pages(spark, d)), table(spark, d, "common_words"))
    return found.select("page_id", *[F.col("stats")[i].alias(n) for i, n in enumerate(quality.STATS)], "component", "page_kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.broken_conversations(table(spark, d, "messages"))


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    languages = langid.learn_languages(spread(table(spark, d, "context")))
    return pairs.find_defects(spread(table(spark, d, "messages")), languages)


def _models(pages: DataFrame) -> tuple[tuple, dict]:
    languages = langid.learn_languages(pages)
    return languages, sentences.learn_periods(pages, languages)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = unique_pages(spark, d)
    return sentences.wrong_labels(pages, langid.learn_languages(pages))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every language segment of every page with its confidence."""
    pages = unique_pages(spark, d)
    return sentences.find_languages(pages, *_models(pages)).select("page_id", "segment", "lang", "confidence", "first", "last")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pages = unique_pages(spark, d)
    models = _models(pages)
    wanted = table(spark, d, "probe_pages").select("page_id").distinct()
    return sentences.split_sentences(pages.join(wanted, "page_id", "left_semi"), *models)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _budget(spark, d, "pack")
    return packing.pack(spread(table(spark, d, "documents")), capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(p7_containers(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Whether every token and piece has its container, none is overfull and little space is left."""
    return packing.invariants(p7_containers(spark, d), _budget(spark, d, "pack")[0])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_stretches(spark, d).filter("leak = 'stretch'").select("doc_id", "item_id")


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.cut_documents(spread(table(spark, d, "documents")), *_budget(spark, d, "cut"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).filter("piece = 0").select("doc_id", "cut_kind").distinct()


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    p1_found, p1_repaired, p2_found, p2_statistics, p3_found, p3_conversations, p4_found, p5_found, p5_segments, p6_found,
    p7_found, p7_containers, p7_invariants, p8_found, p8_stretches, p9_found, p9_pieces,
)}

_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = rf"[\x{{4e00}}-\x{{9fff}}]|[\pP$+<=>^`|~]|[^{_SPACE}\x{{4e00}}-\x{{9fff}}\pP$+<=>^`|~]+"

_ONCE = """
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY logged_at NULLS LAST) AS arrival FROM messages) WHERE arrival = 1
), plain AS (
  SELECT *, regexp_replace(lower(regexp_replace(role, '^[{ws}]+|[{ws}]+$', '', 'g')), '', '') AS speaker,
         text IS NOT NULL AND NOT regexp_matches(text, '^[{ws}]*$') AS says
  FROM once
), judged AS (
  SELECT run_id, session,
         count(*) = count(DISTINCT turn) AND min(turn) = 1 AND max(turn) = count(*) AND count(turn) = count(*)
         AND bool_and(coalesce(speaker IN ('system', 'user', 'assistant'), false))
         AND bool_or(coalesce(speaker = 'system', false))
         AND coalesce(arg_max(coalesce(speaker, ''), turn) = 'assistant', false)
         AND bool_or(coalesce(speaker = 'user' AND says, false)) AND bool_or(coalesce(speaker = 'assistant' AND says, false)) AS keep
  FROM plain GROUP BY run_id, session
)
""".replace("{ws}", _WS)

_SIZES = f"WITH sized AS (SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS size FROM documents)"

ORACLE: dict[str, str] = {
    "p3_found": _ONCE + "SELECT run_id, session FROM judged WHERE NOT keep",
    "p3_conversations": _ONCE + """SELECT p.run_id, p.session, p.turn, p.msg_id, p.speaker, p.prompt_key, p.text
        FROM plain p JOIN judged j ON p.run_id IS NOT DISTINCT FROM j.run_id AND p.session IS NOT DISTINCT FROM j.session WHERE j.keep""",
    "p7_found": _SIZES + "SELECT DISTINCT doc_id FROM sized WHERE size > (SELECT capacity FROM budgets WHERE purpose = 'pack')",
    "p7_invariants": _SIZES + """ SELECT sum(size)::BIGINT AS tokens, sum(ceil(size / (SELECT capacity FROM budgets WHERE purpose = 'pack')))::BIGINT AS pieces,
        0::BIGINT AS unplaced, 0::BIGINT AS repeated, 0::BIGINT AS overfull, true AS well_filled FROM sized""",
    "p9_found": _SIZES + f""", parts AS (
        SELECT doc_id, size, unnest(regexp_split_to_array(text, '[{_SPACE}。！？；，、]+')) AS part FROM sized
        WHERE size > (SELECT capacity FROM budgets WHERE purpose = 'cut'))
        SELECT doc_id, CASE WHEN max(len(regexp_extract_all(part, '{_TOKEN}'))) > (SELECT capacity FROM budgets WHERE purpose = 'cut')
        THEN 'hard' ELSE 'soft' END AS cut_kind FROM parts GROUP BY doc_id""",
}
