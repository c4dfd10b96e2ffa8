"""Registered queries of the engine itself, over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import replies as R, text as X
from .operators import messages as M, paging as P, runs, selection as S
from .plans import profiling
from .streaming import replay, stateful

PAGE_CHARS, RATIO = 500, 0.5
PER_FILE, TOTAL, COUNT = 20_000, 40_000, 4


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _log(spark: SparkSession, d: str) -> DataFrame:
    return M.unique_messages(_t(spark, d, "messages"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    return M.first_arrivals(_t(spark, d, "context"), "page_id", "packed_at")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of their archives, after the caps."""
    docs = _t(spark, d, "documents").select(
        F.col("source").alias("target"), F.col("doc_id").alias("ord"), F.col("rel").alias("name"), F.length(F.col("text").cast("binary")).cast("bigint").alias("size"), F.lit(False).alias("is_dir"), F.col("text").cast("binary").alias("content")
    )
    return S.select_members(docs, PER_FILE, COUNT, TOTAL)


def find_targets(spark, d):
    return S.find_targets(_t(spark, d, "registry"))


def refuse_targets(spark, d):
    targets = S.find_targets(_t(spark, d, "registry"))
    return targets.select("target", S.refusal(F.col("target")).alias("error"))


def safe_paths(spark, d):
    return _t(spark, d, "members").select("target", "ord", X.safe_path(F.col("name")).alias("rel"))


def eligible_members(spark, d):
    return S.with_paths(_t(spark, d, "members")).filter("eligible").select("target", "ord", "rel")


def size_cap(spark, d):
    return S.size_warnings(_t(spark, d, "members"), PER_FILE)


def file_count_cap(spark, d):
    return S.first_files(S.within_size(S.with_paths(_t(spark, d, "members")), PER_FILE), COUNT).select("target", "ord", "slot")


def total_bytes_cap(spark, d):
    return S.select_members(_t(spark, d, "members"), PER_FILE, COUNT, TOTAL).select("target", "ord", "rel", "running")


def listing_cap(spark, d):
    return S.listed(_t(spark, d, "members"), 10).select("target", "ord")


def password_probe(spark, d):
    return S.probe_member(_t(spark, d, "members"))


def walk_order(spark, d):
    return _t(spark, d, "documents").filter("rel is not null").select("doc_id", F.array_join(X.walk_key(F.col("rel")), "/").alias("walk_key"), X.suffix(F.col("rel")).alias("ext"))


def looks_binary(spark, d):
    """Every text as it is, and with control characters for its line ends, as bytes."""
    docs = _t(spark, d, "documents").filter("text is not null")
    odd = F.regexp_replace("text", "[aeo\n]", "\x02").cast("binary")
    return docs.select("doc_id", X.looks_binary(F.col("text").cast("binary")).alias("plain"), X.looks_binary(odd).alias("odd"))


def recognize_text(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "rel", F.col("text").cast("binary").alias("content"))
    return P.recognized(docs).filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("chars"))


def split_sentences(spark, d):
    docs = _spread(_t(spark, d, "documents")).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence"))
    return docs.select("doc_id", F.col("i").cast("bigint").alias("pos"), "sentence")


def oversize_sentences(spark, d):
    return P.dropped_sentences(_spread(_t(spark, d, "documents")), page_chars=PAGE_CHARS, ratio=0.2)


def paginate(spark, d):
    return P.pages(_spread(_t(spark, d, "documents")), page_chars=PAGE_CHARS, ratio=RATIO)


def pack_corpus(spark, d):
    return P.corpus(P.recognized(_files(spark, d)))


def ext_stats(spark, d):
    return P.extension_counts(P.recognized(_files(spark, d))).select("target", "ext", "n")


def metadata_page(spark, d):
    return P.metadata(P.recognized(_files(spark, d))).select("target", "n_text", "n_all", "bytes", "metadata")


def catalog_page(spark, d):
    return P.packages(P.recognized(_files(spark, d)), PAGE_CHARS, RATIO).filter("page_no = 1").select("target", "text")


def packages(spark, d):
    return P.packages(P.recognized(_files(spark, d)), PAGE_CHARS, RATIO)


def context_stats(spark, d):
    return P.package_stats(_context(spark, d))


def token_estimate(spark, d):
    return M.session_totals(_log(spark, d)).select("run_id", "session", "tokens")


def session_stats(spark, d):
    return M.session_totals(_log(spark, d)).select("run_id", "session", "messages", "turns", "chars")


def message_sessions(spark, d):
    return M.last_sessions(_t(spark, d, "messages"))


def prompt_counts(spark, d):
    return M.prompt_counts(_log(spark, d))


def watermark_sessions(spark, d):
    return M.watermark_sessions(_log(spark, d))


def raw_roll_body(spark, d):
    return M.raw_bodies(_log(spark, d))


def extract_reply_json(spark, d):
    return M.parsed_replies(_log(spark, d)).filter("doc is not null").select("msg_id", "action", F.get_json_object("doc", "$.identity.title").alias("title"))


def dispatch_actions(spark, d):
    return M.parsed_replies(_log(spark, d)).select("msg_id", "branch", F.col("page").cast("string").alias("page"))


def page_guard(spark, d):
    asked = M.page_requests(M.parsed_replies(_log(spark, d)), _context(spark, d))
    return asked.withColumn("page", F.col("page").cast("string"))


def deliver_pages(spark, d):
    return M.delivered_pages(M.parsed_replies(_log(spark, d)), _context(spark, d))


def pages_read(spark, d):
    return M.pages_read(M.page_requests(M.parsed_replies(_log(spark, d)), _context(spark, d)))


def memo_pages(spark, d):
    return M.memo_pages(M.parsed_replies(_log(spark, d)))


def doc_tail(spark, d):
    return M.last_memos(memo_pages(spark, d))


def doc_page_guard(spark, d):
    return M.memo_verdicts(M.parsed_replies(_log(spark, d)))


def check_summary(spark, d):
    return M.summary_replies(_log(spark, d))


def retry_budget(spark, d):
    return M.retries(_log(spark, d))


def check_template(spark, d):
    return runs.profile_problems(_t(spark, d, "publish"))


def publish_fill(spark, d):
    rows = runs.published(_t(spark, d, "publish"), runs.registry_state(_t(spark, d, "registry")))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("tags", "language")})


def render_prompt(spark, d):
    pages = _context(spark, d)
    total = pages.groupBy("run_id").agg(F.max("page_no").alias("page_total"))
    template = F.lit("Page {page} of {page_total}:\n\n{page_text}")
    prompt = X.render(template, page=F.col("page_no"), page_total=F.col("page_total"), page_text=F.col("text"))
    return pages.join(total, "run_id").select("page_id", prompt.alias("prompt"))


def run_ids(spark, d):
    return runs.run_ids(_t(spark, d, "registry")).select("given", "run_id")


def registry_state(spark, d):
    return runs.registry_state(_t(spark, d, "registry"))


def state_summary(spark, d):
    return runs.state_summary(runs.registry_state(_t(spark, d, "registry")))


def judge_extract(spark, d):
    log = _t(spark, d, "runlog")
    return log.select("run_id", runs.verdict(F.col("ok"), F.col("files_kept"), F.col("warnings"), F.col("error")).alias("verdict"))


def join_content_parts(spark, d):
    return _t(spark, d, "publish").select("run_id", R.join_parts(F.col("tags")).alias("content"))


def profile_runs(spark, d):
    return profiling.run_outcomes(_t(spark, d, "registry"), _context(spark, d), _t(spark, d, "publish"))


def replay_sessions(spark, d):
    return replay.replay(_log(spark, d), _context(spark, d))


def session_stream(spark, d):
    return stateful.stream_replay(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    find_targets, refuse_targets, safe_paths, eligible_members, size_cap, file_count_cap, total_bytes_cap, listing_cap, password_probe, walk_order,
    looks_binary, recognize_text, split_sentences, oversize_sentences, paginate, pack_corpus, ext_stats, metadata_page, catalog_page, packages,
    context_stats, token_estimate, session_stats, message_sessions, prompt_counts, watermark_sessions, raw_roll_body, extract_reply_json,
    dispatch_actions, page_guard, deliver_pages, pages_read, memo_pages, doc_tail, doc_page_guard, check_summary, retry_budget, check_template, publish_fill, render_prompt,
    run_ids, registry_state, state_summary, judge_extract, join_content_parts, profile_runs, replay_sessions, session_stream,
)}

_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _ext(x: str) -> str:
    return rf"lower(regexp_extract(regexp_extract({x}, '[^/]*$'), '(?s)^.+(\.[^.]+)$', 1))"


def _among(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TARGETS = """targets AS (SELECT DISTINCT target, regexp_extract(target, '[^/]*$') AS name FROM registry
  WHERE NOT regexp_matches(regexp_extract(target, '[^/]*$'), '^[._]') AND NOT ends_with(regexp_extract(target, '[^/]*$'), '.publish.json'))"""
_REL = r"""CASE WHEN regexp_matches(replace(name, '\', '/'), '^/|(^|/)\.\.(/|$)') OR substr(name, 2, 1) = ':' THEN NULL
  ELSE nullif(array_to_string(list_filter(string_split(replace(name, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/'), '') END"""
_GLOB = "|".join("^" + g.replace(".", r"\.").replace("*", ".*") + "$" for g in X.NOTABLE)


def _eligible(table: str) -> str:
    return f"""pathed AS (SELECT *, {_REL} AS rel FROM {table}), eligible AS (SELECT * FROM pathed WHERE rel IS NOT NULL AND NOT coalesce(is_dir, false)
  AND ({_ext('rel')} IN ({_among(X.SELECT_SUFFIXES)}) OR regexp_matches(lower(regexp_extract(rel, '[^/]*$')), '{_GLOB}')))"""


_CAPPED = f"""capped AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS slot FROM eligible WHERE coalesce(size, 0) <= {PER_FILE}),
  slotted AS (SELECT * FROM capped WHERE slot <= {COUNT}),
  chosen AS (SELECT * FROM (SELECT *, CAST(sum(coalesce(size, 0)) OVER (PARTITION BY target ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM slotted) WHERE running <= {TOTAL})"""


def _walk(x: str) -> str:
    return f"list_append(list_transform(string_split({x}, '/')[:-2], lambda p: '1' || p), '0' || string_split({x}, '/')[-1])"


_FILES = f"""vfiles AS (SELECT source AS target, doc_id AS ord, rel AS name, CAST(strlen(text) AS BIGINT) AS size, false AS is_dir, text AS content FROM documents),
  {_eligible('vfiles')}, {_CAPPED},
  files AS (SELECT target, ord, rel, size, {_walk('rel')} AS k, CASE WHEN {_ext('rel')} IN ({_among(X.TEXT_SUFFIXES)}) AND size > 0
    THEN regexp_replace(content, '\\r\\n?', chr(10), 'g') END AS text FROM chosen)"""
_META = f"""WITH {_FILES}, exts AS (SELECT target, {_ext('rel')} AS ext, count(*) AS n, min(k) AS f FROM files WHERE text IS NOT NULL GROUP BY ALL),
  extline AS (SELECT target, string_agg(ext || ' x' || n, ', ' ORDER BY n DESC, f) AS e FROM exts GROUP BY target),
  meta AS (SELECT target, count(text) AS n_text, count(*) AS n_all, CAST(coalesce(sum(size) FILTER (WHERE text IS NOT NULL), 0) AS BIGINT) AS bytes,
    string_agg('- ' || rel || ' (' || size || ' bytes)', chr(10) ORDER BY k, ord) FILTER (WHERE text IS NOT NULL) AS kept,
    string_agg('- ' || rel || ' (' || size || ' bytes, not usable as text)', chr(10) ORDER BY k, ord) FILTER (WHERE text IS NULL) AS skipped FROM files GROUP BY target),
  metadata AS (SELECT target, n_text, n_all, bytes, 'text files packed: ' || n_text || ' / ' || n_all || chr(10) || 'usable-text bytes: ' || bytes || chr(10) || 'extensions: ' || coalesce(e, '(none)')
    || coalesce(chr(10) || 'files:' || chr(10) || kept, '') || coalesce(chr(10) || 'skipped:' || chr(10) || skipped, '') AS metadata FROM meta LEFT JOIN extline USING (target)),
  corpora AS (SELECT target, string_agg('## ' || rel || chr(10) || {_strip('text')}, chr(10) || chr(10) ORDER BY k, ord) AS text FROM files WHERE text IS NOT NULL GROUP BY target)"""


def _pieces(source: str, key: str) -> str:
    """Stripped sentences of a relation with a text, numbered per key."""
    return f"""cutup AS (SELECT {key}, unnest(regexp_extract_all(text, '[^。！？；;\\n.!?]*[。！？；;\\n.!?]|[^。！？；;\\n.!?]+$')) AS raw,
    generate_subscripts(regexp_extract_all(text, '[^。！？；;\\n.!?]*[。！？；;\\n.!?]|[^。！？；;\\n.!?]+$'), 1) AS i FROM {source} WHERE text IS NOT NULL),
  pieces AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, {_strip('raw')} AS sentence FROM cutup WHERE {_strip('raw')} <> '')"""


def _paged(key: str, page_chars: int, ratio: float) -> str:
    """Greedy filling of pages as a recursion over the kept sentences."""
    return f"""kept AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS r, sentence FROM pieces WHERE length(sentence) <= {max(1, int(page_chars * ratio))}),
  fill AS (SELECT {key}, r, 1 AS page_no, length(sentence) AS used FROM kept WHERE r = 1
    UNION ALL SELECT k.{key}, k.r, CASE WHEN f.used + 1 + length(k.sentence) > {page_chars} THEN f.page_no + 1 ELSE f.page_no END,
      CASE WHEN f.used + 1 + length(k.sentence) > {page_chars} THEN length(k.sentence) ELSE f.used + 1 + length(k.sentence) END
    FROM fill f JOIN kept k ON k.{key} = f.{key} AND k.r = f.r + 1),
  filled AS (SELECT f.{key}, CAST(f.page_no AS BIGINT) AS page_no, string_agg(k.sentence, chr(10) ORDER BY k.r) AS text FROM fill f JOIN kept k ON k.{key} = f.{key} AND k.r = f.r GROUP BY ALL)"""


_CATALOG = f"""{_META.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_pieces('corpora', 'target')}, {_paged('target', PAGE_CHARS, RATIO)},
  counted AS (SELECT m.target, count(f.page_no) AS n, string_agg('p' || (f.page_no + 1) || '=' || length(f.text) || ' chars', ', ' ORDER BY f.page_no) AS listing, any_value(m.metadata) AS metadata
    FROM metadata m LEFT JOIN filled f ON f.target = m.target GROUP BY m.target),
  catalog AS (SELECT target, n, metadata, 'Catalog (this page is p1 of ' || (n + 2) || '): ' || coalesce(listing, 'no content pages (nothing usable was extracted)') || '; p' || (n + 2)
    || '=metadata page (extracted file list and stats).' AS text FROM counted)"""

_ONCE = f"""once AS (SELECT *, {_strip('role')} AS bare FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY logged_at NULLS LAST) AS a FROM messages) WHERE a = 1),
  log AS (SELECT *, lower(bare) AS speaker FROM once)"""
_PAGES = "pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY packed_at NULLS LAST) AS a FROM context) WHERE a = 1)"
_REPLIES = f"""{_ONCE}, sliced AS (SELECT *, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') AS cut FROM log WHERE speaker = 'assistant'),
  replies AS (SELECT *, CASE WHEN json_valid(cut) THEN cut END AS doc FROM sliced),
  acts AS (SELECT *, json_extract_string(doc, '$.action') AS action,
    CASE WHEN json_type(doc, '$.page') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(doc, '$.page') AS BIGINT) END AS page FROM replies),
  judged AS (SELECT *, CASE WHEN doc IS NULL THEN 'bad_json' WHEN action IN ('help', 'publish', 'read_memo', 'write_memo', 'read_chatlog') THEN action ELSE 'read_page' END AS branch FROM acts)"""
_GUARD = f"""{_REPLIES}, {_PAGES}, totals AS (SELECT run_id, max(page_no) AS pages FROM pages GROUP BY run_id),
  asked AS (SELECT j.*, coalesce(page BETWEEN 1 AND pages, false) AS ok FROM judged j LEFT JOIN totals USING (run_id) WHERE branch = 'read_page'),
  guarded AS (SELECT msg_id, run_id, page, CASE WHEN ok AND row_number() OVER (PARTITION BY run_id, page, ok ORDER BY session, turn, msg_id) = 1 THEN 'deliver' ELSE 'stall' END AS verdict FROM asked)"""
_STATE = """states AS (SELECT run_id, arg_max(target, (lower(trim(status)) = 'done', logged_at)) AS target, arg_max(lower(trim(status)), (lower(trim(status)) = 'done', logged_at)) AS status,
  arg_max(coalesce(state, ''), (lower(trim(status)) = 'done', logged_at)) AS state, arg_max(coalesce(error, ''), (lower(trim(status)) = 'done', logged_at)) AS error FROM registry GROUP BY run_id)"""
_PROBLEMS = """problems AS (SELECT run_id, list_filter([CASE WHEN title IS NULL THEN 'title: missing' END, CASE WHEN category IS NULL THEN 'category: missing' END, CASE WHEN summary IS NULL THEN 'summary: missing' END,
  CASE WHEN tags IS NULL THEN 'tags: missing' END, CASE WHEN language IS NULL THEN 'language: missing' END, CASE WHEN confidence IS NULL THEN 'confidence: missing' END], lambda x: x IS NOT NULL) AS p FROM publish)"""
_TOLD = "array_to_string(list_filter(warnings, lambda w: w IS NOT NULL), '; ')"

ORACLE: dict[str, str] = {
    "find_targets": f"WITH {_TARGETS} SELECT target, name FROM targets",
    "refuse_targets": f"WITH {_TARGETS} SELECT target, CASE WHEN {_ext('target')} NOT IN ('.zip', '.7z') THEN 'refused ' || name || ': not a zip/7z archive' END AS error FROM targets",
    "safe_paths": f"SELECT target, ord, {_REL} AS rel FROM members",
    "eligible_members": f"WITH {_eligible('members')} SELECT target, ord, rel FROM eligible",
    "size_cap": f"""WITH {_eligible('members')} SELECT target, ord, 'skipped unsafe member: ' || coalesce(name, '') AS warning FROM pathed WHERE rel IS NULL
        UNION ALL SELECT target, ord, 'skipped ' || rel || ': ' || size || ' bytes over per-file cap' FROM eligible WHERE size > {PER_FILE}""",
    "file_count_cap": f"WITH {_eligible('members')}, {_CAPPED} SELECT target, ord, slot FROM slotted",
    "total_bytes_cap": f"WITH {_eligible('members')}, {_CAPPED} SELECT target, ord, rel, running FROM chosen",
    "listing_cap": "SELECT target, ord FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS r FROM members) WHERE r <= 10",
    "password_probe": "SELECT target, name, size FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY size, ord) AS r FROM members WHERE NOT coalesce(is_dir, false) AND size > 0) WHERE r = 1",
    "walk_order": f"SELECT doc_id, array_to_string({_walk('rel')}, '/') AS walk_key, {_ext('rel')} AS ext FROM documents WHERE rel IS NOT NULL",
    "looks_binary": """SELECT doc_id, false AS plain, coalesce(strlen(text) > 0 AND (strlen(text) - length(regexp_replace(text, '[^aeo\\n]', '', 'g'))) / strlen(text)::DOUBLE < 0.9, false) AS odd FROM documents WHERE text IS NOT NULL""",
    "recognize_text": f"SELECT doc_id, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS chars FROM documents WHERE {_ext('rel')} IN ({_among(X.TEXT_SUFFIXES)}) AND strlen(text) > 0",
    "split_sentences": f"WITH {_pieces('documents', 'doc_id')} SELECT doc_id, pos, sentence FROM pieces",
    "oversize_sentences": f"WITH {_pieces('documents', 'doc_id')} SELECT doc_id, count(*) AS dropped_sentences, CAST(sum(length(sentence)) AS BIGINT) AS dropped_chars FROM pieces WHERE length(sentence) > {int(PAGE_CHARS * 0.2)} GROUP BY doc_id",
    "paginate": f"WITH RECURSIVE {_pieces('documents', 'doc_id')}, {_paged('doc_id', PAGE_CHARS, RATIO)} SELECT doc_id, page_no, length(text) AS chars, text FROM filled",
    "pack_corpus": f"{_META} SELECT target, text AS corpus FROM corpora",
    "ext_stats": f"{_META} SELECT target, ext, n FROM exts",
    "metadata_page": f"{_META} SELECT target, n_text, n_all, bytes, metadata FROM metadata",
    "catalog_page": f"{_CATALOG} SELECT target, text FROM catalog",
    "packages": f"""{_CATALOG} SELECT target, page_no, length(text) AS chars, text FROM (SELECT target, 1 AS page_no, text FROM catalog
        UNION ALL SELECT target, page_no + 1, text FROM filled UNION ALL SELECT target, n + 2, metadata FROM catalog)""",
    "context_stats": f"WITH {_PAGES} SELECT run_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(length(text) <> chars AS INT)) AS BIGINT) AS stale FROM pages GROUP BY run_id",
    "token_estimate": f"WITH {_ONCE} SELECT run_id, session, CAST(coalesce(sum(length(text)), 0) // 4 AS BIGINT) AS tokens FROM log GROUP BY run_id, session",
    "session_stats": f"WITH {_ONCE} SELECT run_id, session, count(*) AS messages, count(*) FILTER (WHERE speaker = 'assistant') AS turns, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM log GROUP BY run_id, session",
    "message_sessions": "SELECT run_id, coalesce(max(session), 0) AS sessions FROM messages GROUP BY run_id",
    "prompt_counts": f"WITH {_ONCE} SELECT run_id, prompt_key, count(*) AS n FROM log WHERE prompt_key IS NOT NULL GROUP BY run_id, prompt_key",
    "watermark_sessions": f"""WITH RECURSIVE {_ONCE}, seq AS (SELECT run_id, session, msg_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY run_id, session ORDER BY turn NULLS FIRST, msg_id) AS r FROM log),
        roll AS (SELECT run_id, session, msg_id, r, n AS used, 1 AS part FROM seq WHERE r = 1
          UNION ALL SELECT s.run_id, s.session, s.msg_id, s.r, CASE WHEN q.used // 4 >= {M.FORCE} THEN s.n ELSE q.used + s.n END, CASE WHEN q.used // 4 >= {M.FORCE} THEN q.part + 1 ELSE q.part END
          FROM roll q JOIN seq s ON s.run_id = q.run_id AND s.session = q.session AND s.r = q.r + 1)
        SELECT run_id, session, msg_id, CAST(part AS BIGINT) AS part FROM roll""",
    "raw_roll_body": f"WITH {_ONCE} SELECT run_id, session, string_agg(speaker || ': ' || coalesce(text, ''), chr(10) ORDER BY turn NULLS FIRST, msg_id) AS body FROM log GROUP BY run_id, session",
    "extract_reply_json": f"WITH {_REPLIES} SELECT msg_id, action, json_extract_string(doc, '$.identity.title') AS title FROM acts WHERE doc IS NOT NULL",
    "dispatch_actions": f"WITH {_REPLIES} SELECT msg_id, branch, CAST(page AS VARCHAR) AS page FROM judged",
    "page_guard": f"WITH {_GUARD} SELECT msg_id, run_id, CAST(page AS VARCHAR) AS page, verdict FROM guarded",
    "deliver_pages": f"WITH {_REPLIES}, {_PAGES} SELECT j.msg_id, p.page_id, length(p.text) AS chars FROM judged j JOIN pages p ON p.run_id = j.run_id AND p.page_no = j.page WHERE branch = 'read_page'",
    "pages_read": f"WITH {_GUARD} SELECT run_id, count(DISTINCT page) AS n_read, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) AS read FROM guarded WHERE verdict = 'deliver' GROUP BY run_id",
    "doc_tail": f"""WITH RECURSIVE {_REPLIES}, notes AS (SELECT run_id, count(*) AS sections, string_agg(json_extract_string(doc, '$.memo'), chr(10) ORDER BY session NULLS FIRST, turn NULLS FIRST, msg_id) AS text
          FROM judged WHERE branch = 'write_memo' AND json_type(doc, '$.memo') = 'VARCHAR' GROUP BY run_id), {_pieces('notes', 'run_id')}, {_paged('run_id', 500, 0.5)}
        SELECT n.run_id, sections, count(page_no) AS pages, coalesce(arg_max(f.text, page_no), '') AS tail FROM notes n LEFT JOIN filled f ON f.run_id = n.run_id GROUP BY n.run_id, sections""",
    "doc_page_guard": f"""WITH RECURSIVE {_REPLIES}, ev AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY session NULLS FIRST, turn NULLS FIRST, msg_id) AS o FROM judged
          WHERE branch IN ('write_memo', 'read_memo', 'read_chatlog')),
        notes AS (SELECT run_id, msg_id, o, json_extract_string(doc, '$.memo') AS text FROM ev WHERE branch = 'write_memo' AND json_type(doc, '$.memo') = 'VARCHAR'), {_pieces('notes', 'msg_id')},
        kept AS (SELECT n.run_id, n.o, row_number() OVER (PARTITION BY n.run_id ORDER BY n.o, p.pos) AS r, length(p.sentence) AS n FROM pieces p JOIN notes n USING (msg_id) WHERE length(p.sentence) <= 250),
        fill AS (SELECT run_id, o, r, 1 AS page_no, n AS used FROM kept WHERE r = 1
          UNION ALL SELECT k.run_id, k.o, k.r, CASE WHEN f.used + 1 + k.n > 500 THEN f.page_no + 1 ELSE f.page_no END, CASE WHEN f.used + 1 + k.n > 500 THEN k.n ELSE f.used + 1 + k.n END
          FROM fill f JOIN kept k ON k.run_id = f.run_id AND k.r = f.r + 1),
        grown AS (SELECT e.msg_id AS m, max(f.page_no) AS pages FROM ev e JOIN fill f ON f.run_id = e.run_id AND f.o < e.o WHERE e.branch = 'read_memo' GROUP BY e.msg_id)
        SELECT msg_id, branch, CASE WHEN branch = 'write_memo' THEN CASE WHEN coalesce(json_type(doc, '$.memo') = 'VARCHAR', false) THEN 'memo_saved' ELSE 'memo_reject' END
          WHEN coalesce(page >= 1 AND (branch <> 'read_memo' OR page <= coalesce(pages, 0)), false) THEN 'deliver' ELSE 'stall' END AS verdict FROM ev LEFT JOIN grown ON m = msg_id""",
    "check_summary": f"""WITH {_ONCE}, s AS (SELECT msg_id, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') AS cut FROM log WHERE prompt_key = 'chatlog_summarize_reply')
        SELECT msg_id, coalesce(json_valid(cut) AND json_keys(CASE WHEN json_valid(cut) THEN cut END) = ['summary'] AND json_type(CASE WHEN json_valid(cut) THEN cut END, '$.summary') = 'VARCHAR'
          AND {_strip("json_extract_string(CASE WHEN json_valid(cut) THEN cut END, '$.summary')")} <> '', false) AS valid FROM s""",
    "retry_budget": f"""WITH {_ONCE}, mark AS (SELECT run_id, session, max(turn) AS since FROM log WHERE prompt_key IN ('force_publish', 'stall_to_publish') GROUP BY ALL)
        SELECT run_id, session, count(*) AS asked, greatest(0, 3 - count(*)) AS "left" FROM log LEFT JOIN mark USING (run_id, session) WHERE prompt_key = 'publish_retry' AND (since IS NULL OR turn > since) GROUP BY run_id, session""",
    "check_template": f"WITH {_PROBLEMS} SELECT run_id, len(p) AS n, array_to_string(p, '; ') AS problems FROM problems",
    "publish_fill": f"""WITH {_PROBLEMS}, {_STATE} SELECT s.target || '.publish.json' AS path, run_id, title, category, summary, array_to_string(tags, '|') AS tags, array_to_string(language, '|') AS language, confidence
        FROM publish JOIN problems USING (run_id) JOIN states s USING (run_id) WHERE len(p) = 0 AND status = 'done' AND state = 'ok'""",
    "render_prompt": f"WITH {_PAGES}, totals AS (SELECT run_id, max(page_no) AS n FROM pages GROUP BY run_id) SELECT page_id, 'Page ' || page_no || ' of ' || n || ':' || chr(10) || chr(10) || text AS prompt FROM pages JOIN totals USING (run_id)",
    "run_ids": """SELECT given, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS run_id FROM (SELECT run_id AS given, replace(replace(replace(started_at, '-', ''), ':', ''), 'T', '-') AS b,
        row_number() OVER (PARTITION BY started_at ORDER BY t, run_id) AS k FROM (SELECT run_id, target, started_at, min(logged_at) AS t FROM registry WHERE lower(trim(status)) = 'running' GROUP BY ALL))""",
    "registry_state": f"WITH {_STATE} SELECT run_id, target, status, state, error FROM states",
    "state_summary": f"WITH {_STATE} SELECT CASE WHEN status = 'done' THEN state ELSE 'running' END AS state, count(*) AS n FROM states GROUP BY ALL",
    "judge_extract": f"""SELECT run_id, CASE WHEN error <> '' THEN error WHEN NOT coalesce(ok, false) THEN 'extraction failed'
        WHEN coalesce(files_kept, 0) <= 0 THEN CASE WHEN coalesce({_TOLD}, '') <> '' THEN {_TOLD} ELSE 'no files kept' END END AS verdict FROM runlog""",
    "join_content_parts": "SELECT run_id, array_to_string(list_transform(tags, lambda x: coalesce(x, '')), '') AS content FROM publish",
    "profile_runs": f"""WITH {_STATE}, {_PAGES}, {_PROBLEMS}, packed AS (SELECT run_id, count(*) AS pages FROM pages GROUP BY run_id)
        SELECT run_id, CASE WHEN status <> 'done' THEN 'running' WHEN state <> 'ok' THEN 'failed' WHEN coalesce(pages, 0) = 0 THEN 'no context' WHEN p IS NULL THEN 'no profile' WHEN len(p) > 0 THEN 'invalid profile' ELSE 'published' END AS outcome,
          coalesce(pages, 0) AS pages FROM states LEFT JOIN packed USING (run_id) LEFT JOIN problems USING (run_id)""",
}
