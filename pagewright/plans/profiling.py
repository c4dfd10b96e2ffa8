"""The whole flow: targets, members, pages, replies, profiles; errors are data of their row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import paging, runs, selection


def scan(targets: DataFrame, members: DataFrame, contents: DataFrame, page_chars: int = paging.PAGE_CHARS, ratio: float = paging.RATIO) -> tuple[DataFrame, DataFrame]:
    """(packages, refused): pages of every archive, and (target, error) of what is none or kept no file.

    ``contents`` has (target, ord, content); only selected members are joined with it.
    """
    named = selection.find_targets(targets).withColumn("error", selection.refusal(F.col("target")))
    good = named.filter("error is null").select("target")
    chosen = selection.select_members(members.join(good, "target", "left_semi"))
    files = paging.recognized(chosen.join(contents, ["target", "ord"]))
    packed = paging.packages(files, page_chars, ratio)
    empty = good.join(chosen, "target", "left_anti").select("target", F.lit("no files kept").alias("error"))
    return packed, named.filter("error is not null").select("target", "error").unionByName(empty)


def run_outcomes(registry: DataFrame, context: DataFrame, profiles: DataFrame) -> DataFrame:
    """(run_id, outcome, pages): how far every registered run came; one row per run, whatever is missing elsewhere."""
    states = runs.registry_state(registry)
    packed = context.groupBy("run_id").agg(F.count("*").cast("bigint").alias("pages"))
    problems = runs.profile_problems(profiles).select("run_id", "n")
    all_ = states.join(packed, "run_id", "left").join(problems, "run_id", "left")
    outcome = (
        F.when(F.col("status") != "done", "running").when(F.col("state") != "ok", "failed").when(F.coalesce("pages", F.lit(0)) == 0, "no context")
        .when(F.col("n").isNull(), "no profile").when(F.col("n") > 0, "invalid profile").otherwise("published")
    )
    return all_.select("run_id", outcome.alias("outcome"), F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"))
