"""Targets and the members kept of each, under caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X

PER_FILE, TOTAL, COUNT, LISTING = 262_144, 4_194_304, 8, 30_000


def find_targets(entries: DataFrame, path: str = "target") -> DataFrame:
    """Distinct entries of the inbox by name, without hidden ones, sidecars and names with a leading underscore."""
    name = X.base_name(F.col(path))
    return entries.select(F.col(path).alias("target"), name.alias("name")).filter(~F.col("name").rlike(r"^[._]") & ~F.col("name").endswith(".publish.json")).distinct()


def refusal(target: Column) -> Column:
    """Why a target is no archive; null for zip and 7z."""
    return F.when(~X.suffix(target).isin(".zip", ".7z") | target.isNull(), F.concat(F.lit("refused "), F.coalesce(X.base_name(target), F.lit("(none)")), F.lit(": not a zip/7z archive")))


def listed(members: DataFrame, most: int = LISTING) -> DataFrame:
    """The first ``most`` members of each target."""
    rank = F.row_number().over(W.partitionBy("target").orderBy("ord"))
    return members.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def with_paths(members: DataFrame) -> DataFrame:
    """Adds ``rel`` (null: unsafe) and ``eligible``: a text suffix or a notable name; directories never are."""
    rel = X.safe_path(F.col("name"))
    ok = X.suffix(rel).isin(X.SELECT_SUFFIXES) | X.notable(X.base_name(rel))
    return members.withColumn("rel", rel).withColumn("eligible", F.coalesce(ok & ~F.coalesce("is_dir", F.lit(False)), F.lit(False)))


def within_size(members: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Eligible members up to the cap for one file; members of unknown size count as empty."""
    return members.filter(F.col("eligible") & (F.coalesce("size", F.lit(0)) <= per_file))


def first_files(members: DataFrame, most: int = COUNT) -> DataFrame:
    """The first ``most`` of each target, with their ``slot``; a rank limit, which Spark also applies before the shuffle."""
    slot = F.row_number().over(W.partitionBy("target").orderBy("ord"))
    return members.withColumn("slot", slot.cast("bigint")).filter(F.col("slot") <= most)


def under_total(members: DataFrame, total: int = TOTAL) -> DataFrame:
    """Members before the first one that would overflow the target's total, with the ``running`` sum.

    Comes behind the count cap, so a target has a bounded number of rows here.
    """
    w = W.partitionBy("target").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return members.withColumn("running", F.sum(F.coalesce("size", F.lit(0))).over(w).cast("bigint")).filter(F.col("running") <= total)


def select_members(members: DataFrame, per_file: int = PER_FILE, count: int = COUNT, total: int = TOTAL, listing: int = LISTING) -> DataFrame:
    return under_total(first_files(within_size(with_paths(listed(members, listing)), per_file), count), total)


def probe_member(members: DataFrame) -> DataFrame:
    """Per target the smallest member with content, the one passwords are tried on; ties by listing order."""
    files = members.filter(~F.coalesce("is_dir", F.lit(False)) & (F.col("size") > 0))
    return files.groupBy("target").agg(F.min_by(F.struct("name", "size"), F.struct("size", "ord")).alias("m")).select("target", "m.name", "m.size")


def size_warnings(members: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(target, ord, warning) of unsafe and oversized members."""
    unsafe = F.when(F.col("rel").isNull(), F.concat(F.lit("skipped unsafe member: "), F.coalesce("name", F.lit(""))))
    large = F.when(F.col("eligible") & (F.col("size") > per_file), F.concat(F.lit("skipped "), F.col("rel"), F.lit(": "), F.col("size").cast("string"), F.lit(" bytes over per-file cap")))
    return with_paths(members).select("target", "ord", F.coalesce(unsafe, large).alias("warning")).filter("warning is not null")
