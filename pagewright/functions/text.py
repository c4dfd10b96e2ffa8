"""Text as Column expressions: stripping, decoding, sentences, pages, paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, SparkSession, functions as F

# fixed values: Unicode white space as Python strips it; sentence ends; extensions read as text; the packing defaults
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ENDS = r"。！？；;\n.!?"
TEXT_SUFFIXES = (
    ".txt .md .markdown .rst .log .csv .tsv .json .yaml .yml .xml .html .htm .ini .cfg .conf .py .js .ts .jsx .tsx .java .c .h .cpp .hpp .cs .go .rs .rb .php .sh .bat .ps1 .sql .tex .srt .ass .sub .vtt .nfo .info"
).split()
SELECT_SUFFIXES = ".txt .md .csv .json .xml .html .htm .ini .log .py .js .srt .nfo .url .cfg .yaml .yml".split()
NOTABLE = "readme* *.exe *.msi *.dll *.bat *.cmd *.ps1 *.url *.lnk password* auth* *.key license*".split()


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def sentences(text: Column) -> Column:
    """Array of stripped, non-empty pieces, each ending behind a sentence end; the rest without one comes last."""
    return F.filter(F.transform(F.split(text, f"(?<=[{ENDS}])", -1), strip), lambda s: s != "")


def longest_sentence(page_chars: int, ratio: float) -> int:
    return max(1, int(page_chars * ratio))


def fill_pages(parts: Column, page_chars: int, ratio: float) -> Column:
    """Array of page texts: sentences greedily joined by line breaks, none split; overlong ones are left out.

    A fold in the JVM; its state is the pages done and the one being filled, so it serves texts of bounded size.
    """
    most = longest_sentence(page_chars, ratio)
    kept = F.filter(parts, lambda s: F.length(s) <= most)
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("page"))

    def add(acc: Column, s: Column) -> Column:
        page = acc["page"]
        fits = (page != "") & (F.length(page) + 1 + F.length(s) <= page_chars)
        full = (page != "") & ~fits
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(page))).otherwise(acc["done"]).alias("done"),
            F.when(fits, F.concat(page, F.lit("\n"), s)).otherwise(s).alias("page"),
        )

    return F.aggregate(kept, state, add, lambda acc: F.when(acc["page"] != "", F.concat(acc["done"], F.array(acc["page"]))).otherwise(acc["done"]))


def paginate(text: Column, page_chars: int, ratio: float) -> Column:
    return fill_pages(sentences(text), page_chars, ratio)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 with replacement characters and line feeds for all line ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def looks_binary(content: Column, head: int = 8192) -> Column:
    """Whether the first ``head`` bytes hold a NUL or fewer than nine in ten printable ones; empty content doesn't."""
    chars = F.decode(F.substring(content, 1, head), "ISO-8859-1")
    size = F.length(chars)
    odd = size - F.length(F.regexp_replace(chars, r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.coalesce(F.contains(chars, F.lit("\x00")) | ((size > 0) & ((size - odd) / size < 0.9)), F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, '' if there is none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def safe_path(name: Column) -> Column:
    """Relative path with forward slashes; null for absolute names, drive letters, ``..`` and names without a part."""
    path = F.translate(name, "\\", "/")
    unsafe = path.rlike(r"^/|(^|/)\.\.(/|$)") | (F.substring(name, 2, 1) == ":")
    clean = F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")
    return F.when(~unsafe & (clean != ""), clean)


def notable(name: Column, patterns: list[str] = NOTABLE) -> Column:
    """Whether a base name matches one of the glob patterns; compiled to one regular expression when planned."""
    return F.lower(name).rlike("|".join(fnmatch.translate(p).replace(r"(?s:", "(?s:^").replace(r"\z", "$").replace(r"\Z", "$") for p in patterns))


def walk_key(path: Column) -> Column:
    """Array that sorts like a walk through folders: a folder's own files first, then its folders, each by name.

    Names are compared part by part; joined to one text, a folder would sort behind longer names that go on with a
    character below the slash.
    """
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p))


def estimated_tokens(chars: Column, chunk: int = 4) -> Column:
    """Whole tokens of a number of characters; rounds down after summing."""
    return F.floor(chars / chunk).cast("bigint")


def render(template: Column, **values: Column) -> Column:
    """Replaces ``{name}`` by the values, in their order; unknown names stay, later names also fill earlier values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def register(spark: SparkSession) -> None:
    """SQL functions: split_sentences(text), paginate(text, page_chars, longest), looks_binary(bytes), safe_path(name), strip_text(text).

    They are the same rules as the Columns of these names; ``longest`` is the longest sentence a page keeps.
    """
    made = {
        "strip_text(t STRING) RETURNS STRING": f"regexp_replace(t, r'^[{SPACE}]+|[{SPACE}]+$', '')",
        "split_sentences(t STRING) RETURNS ARRAY<STRING>": "filter(transform(split(t, r'(?<=[" + ENDS + "])', -1), x -> regexp_replace(x, r'^[" + SPACE + "]+|[" + SPACE + "]+$', '')), x -> x <> '')",
        "looks_binary(b BINARY) RETURNS BOOLEAN": r"""(SELECT coalesce(contains(c, chr(0)) OR length(c) > 0 AND length(regexp_replace(c, r'[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]', '')) / length(c) < 0.9, false)
            FROM (SELECT decode(substring(b, 1, 8192), 'ISO-8859-1') AS c))""",
        "safe_path(n STRING) RETURNS STRING": r"""(SELECT CASE WHEN NOT (p RLIKE r'^/|(^|/)\.\.(/|$)' OR substring(n, 2, 1) = ':') THEN nullif(array_join(filter(split(p, '/'), x -> x NOT IN ('', '.')), '/'), '') END
            FROM (SELECT translate(n, chr(92), '/') AS p))""",
        "paginate(t STRING, page_chars INT, longest INT) RETURNS ARRAY<STRING>": """aggregate(filter(split_sentences(t), x -> length(x) <= longest), CAST(array() AS ARRAY<STRING>),
            (a, x) -> CASE WHEN size(a) > 0 AND length(element_at(a, -1)) + 1 + length(x) <= page_chars THEN concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), chr(10), x))) ELSE concat(a, array(x)) END)""",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
