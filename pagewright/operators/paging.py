"""Texts into pages: recognition, packing under caps, catalog and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

PAGE_CHARS, RATIO = 3000, 0.1
# fixed value: what the catalog of a package without content says
NO_CONTENT = "no content pages (nothing usable was extracted)"


def recognized(files: DataFrame, path: str = "rel", content: str = "content", head: int = 8192) -> DataFrame:
    """Adds ``text``: decoded content of files with a text suffix that aren't empty or binary, else null."""
    usable = X.suffix(F.col(path)).isin(X.TEXT_SUFFIXES) & (F.length(content) > 0) & ~X.looks_binary(F.col(content), head)
    return files.withColumn("text", F.when(usable, X.decode_text(F.col(content))))


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text", page_chars: int = PAGE_CHARS, ratio: float = RATIO) -> DataFrame:
    """(key, page_no, chars, text) of every text; null and blank ones have no pages."""
    found = docs.select(F.col(key), F.posexplode(X.paginate(F.col(text), page_chars, ratio)).alias("i", "page"))
    return found.select(key, (F.col("i") + 1).cast("bigint").alias("page_no"), F.length("page").cast("bigint").alias("chars"), F.col("page").alias("text"))


def dropped_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", page_chars: int = PAGE_CHARS, ratio: float = RATIO) -> DataFrame:
    """(key, dropped_sentences, dropped_chars): what paging leaves out as overlong."""
    long = F.filter(X.sentences(F.col(text)), lambda s: F.length(s) > X.longest_sentence(page_chars, ratio))
    rows = docs.select(F.col(key), long.alias("long")).filter(F.size("long") > 0)
    return rows.select(key, F.size("long").cast("bigint").alias("dropped_sentences"), F.aggregate("long", F.lit(0), lambda n, s: n + F.length(s)).cast("bigint").alias("dropped_chars"))


def corpus(files: DataFrame, target: str = "target") -> DataFrame:
    """(target, corpus): chunks ``## rel`` and stripped text of each file, in walk order, parted by blank lines.

    Call it on files selected under caps: they bound what one target gathers.
    """
    chunk = F.concat(F.lit("## "), F.col("rel"), F.lit("\n"), X.strip(F.col("text")))
    usable = files.filter("text is not null")
    return usable.groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(X.walk_key(F.col("rel")).alias("k"), F.col("ord").alias("o"), chunk.alias("c")))), lambda s: s["c"]), "\n\n").alias("corpus"))


def extension_counts(files: DataFrame, target: str = "target") -> DataFrame:
    """(target, ext, n, first_key) of the usable files; ``first_key`` orders ties by first sight."""
    return files.filter("text is not null").groupBy(target, X.suffix(F.col("rel")).alias("ext")).agg(F.count("*").cast("bigint").alias("n"), F.min(X.walk_key(F.col("rel"))).alias("first_key"))


def metadata(files: DataFrame, target: str = "target") -> DataFrame:
    """(target, metadata): the last page of each target: counts, bytes, extensions, files and skipped ones."""
    line = F.concat(F.lit("- "), F.col("rel"), F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes"))
    rows = files.withColumn("k", X.walk_key(F.col("rel"))).withColumn("ok", F.col("text").isNotNull()).withColumn("line", F.when(F.col("text").isNotNull(), F.concat(line, F.lit(")"))).otherwise(F.concat(line, F.lit(", not usable as text)"))))
    ordered = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("k", "ord", "line")))), lambda s: s["line"]), "\n")
    per = rows.groupBy(target).agg(
        F.sum(F.col("ok").cast("bigint")).alias("n_text"), F.count("*").cast("bigint").alias("n_all"), F.sum(F.when(F.col("ok"), F.col("size")).otherwise(0)).cast("bigint").alias("bytes"),
        ordered(F.col("ok")).alias("kept"), ordered(~F.col("ok")).alias("skipped"),
    )
    ext = extension_counts(files, target).groupBy(target).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_key", "ext", "n"))), lambda s: F.concat(s["ext"], F.lit(" x"), s["n"].cast("string"))), ", ").alias("exts")
    )
    text = F.concat(
        F.lit("text files packed: "), F.col("n_text"), F.lit(" / "), F.col("n_all"), F.lit("\nusable-text bytes: "), F.col("bytes"), F.lit("\nextensions: "), F.coalesce("exts", F.lit("(none)")),
        F.when(F.col("kept") != "", F.concat(F.lit("\nfiles:\n"), F.col("kept"))).otherwise(""), F.when(F.col("skipped") != "", F.concat(F.lit("\nskipped:\n"), F.col("skipped"))).otherwise(""),
    )
    return per.join(ext, target, "left").select(target, "n_text", "n_all", "bytes", text.alias("metadata"))


def packages(files: DataFrame, page_chars: int = PAGE_CHARS, ratio: float = RATIO, target: str = "target") -> DataFrame:
    """(target, page_no, chars, text): catalog first, content pages, metadata last."""
    made = metadata(files, target).join(corpus(files, target), target, "left").withColumn("content", F.coalesce(X.paginate(F.col("corpus"), page_chars, ratio), F.array().cast("array<string>")))
    total = (F.size("content") + 2).cast("string")
    listing = F.array_join(F.transform("content", lambda p, i: F.concat(F.lit("p"), (i + 2).cast("string"), F.lit("="), F.length(p).cast("string"), F.lit(" chars"))), ", ")
    catalog = F.concat(
        F.lit("Catalog (this page is p1 of "), total, F.lit("): "), F.when(F.size("content") > 0, listing).otherwise(F.lit(NO_CONTENT)),
        F.lit("; p"), total, F.lit("=metadata page (extracted file list and stats)."),
    )
    every = made.select(target, F.posexplode(F.concat(F.array(catalog), F.col("content"), F.array("metadata"))).alias("i", "page"))
    return every.select(target, (F.col("i") + 1).cast("bigint").alias("page_no"), F.length("page").cast("bigint").alias("chars"), F.col("page").alias("text"))


def package_stats(context: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, pages, chars, stale): pages and recounted characters of each run; ``stale`` counts wrong recorded ones."""
    n = F.length("text").cast("bigint")
    return context.groupBy(run).agg(F.count("*").cast("bigint").alias("pages"), F.sum(n).cast("bigint").alias("chars"), F.sum((n != F.col("chars")).cast("bigint")).cast("bigint").alias("stale"))
