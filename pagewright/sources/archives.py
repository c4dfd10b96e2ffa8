"""Archives as rows: members without their content first, content of the selected ones after."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import selection

LISTED = "target string, ord long, name string, size long, is_dir boolean, locked boolean, error string"
READ = "target string, ord long, content binary, error string"


def read_inbox(spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """(target, size, content) of the archives directly in a folder; bigger ones come without content, which isn't read."""
    files = spark.read.format("binaryFile").load(folder)
    cols = [F.regexp_replace("path", "^file:", "").alias("target"), F.col("length").alias("size")]
    large = files.filter(F.col("length") > most_bytes).select(*cols, F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= most_bytes).select(*cols, "content").unionByName(large)


def list_members(archives: DataFrame) -> DataFrame:
    """One row per member in the archive's order, read from the directory alone; broken or foreign archives give one row with an error.

    7z needs a library that may be missing; such targets say so in ``error``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, content in zip(b["target"], b["content"]):
                if target.lower().endswith(".7z"):
                    rows.append((target, None, None, None, None, None, "7z support is missing"))
                    continue
                if content is None:
                    rows.append((target, None, None, None, None, None, "archive over the size limit"))
                    continue
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append((target, None, None, None, None, None, f"listing failed: {type(e).__name__}"))
                    continue
                rows += [(target, i, x.filename, x.file_size, x.is_dir(), bool(x.flag_bits & 1), None) for i, x in enumerate(infos)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LISTED.split(", ")])

    good = archives.filter(selection.refusal(F.col("target")).isNull()).select("target", "content")
    refused = archives.select("target", selection.refusal(F.col("target")).alias("error")).filter("error is not null")
    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in LISTED.split(", ")[1:6]]
    return good.mapInPandas(run, LISTED).unionByName(refused.select("target", *empty, "error"))


def read_members(archives: DataFrame, chosen: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """(target, ord, content, error) of the chosen members; passwords are tried on the smallest one with content.

    ``chosen`` comes behind the caps, so a target's list of members is short.
    """
    wanted = chosen.groupBy("target").agg(F.array_sort(F.collect_list("ord")).alias("ords"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, content, ords in zip(b["target"], b["content"], b["ords"]):
                z = zipfile.ZipFile(io.BytesIO(content))
                infos = z.infolist()
                key, error = None, None
                if any(x.flag_bits & 1 for x in infos):
                    key = _password(z, [x for x in infos if x.file_size and not x.is_dir()], passwords)
                    error = None if key else "password not found"
                for i in map(int, ords):
                    try:
                        rows.append((target, i, None if error else z.read(infos[i], pwd=key), error))
                    except (RuntimeError, zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                        rows.append((target, i, None, f"reading failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return archives.join(wanted, "target").select("target", "content", "ords").mapInPandas(run, READ)


def _password(z: zipfile.ZipFile, infos: list[zipfile.ZipInfo], passwords: tuple[str, ...]) -> bytes | None:
    probe = min(infos, key=lambda x: x.file_size, default=None)
    for word in passwords if probe else ():
        try:
            z.read(probe, pwd=word.encode())
            return word.encode()
        except (RuntimeError, zipfile.BadZipFile):
            continue
    return None


def scan_folder(spark: SparkSession, folder: str, passwords: tuple[str, ...] = (), page_chars: int = 3000, ratio: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(packages, errors) of all archives of a folder: list, select under caps, read what was selected, pack into pages."""
    from ..operators import paging

    archives = read_inbox(spark, folder).filter(~X.base_name(F.col("target")).rlike("^[._]") & ~F.col("target").endswith(".publish.json"))
    listed = list_members(archives)
    chosen = selection.select_members(listed.filter("error is null"))
    content = read_members(archives, chosen.select("target", "ord"), passwords)
    files = paging.recognized(chosen.drop("error").join(content.filter("error is null"), ["target", "ord"]))
    errors = listed.filter("error is not null").select("target", "error").unionByName(content.filter("error is not null").select("target", "error")).distinct()
    return paging.packages(files, page_chars, ratio), errors
