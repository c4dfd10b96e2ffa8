"""Runs: ids, the registry's last word, verdicts on extraction, profiles to publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import replies as R


def run_ids(starts: DataFrame) -> DataFrame:
    """(target, started_at, given, run_id): id from the second of the start, the k-th run of a second gets ``-k``.

    A second holds a bounded number of starts, so its window does too.
    """
    rows = starts.filter("lower(trim(status)) = 'running'").groupBy("run_id", "target", "started_at").agg(F.min("logged_at").alias("logged_at"))
    k = F.row_number().over(W.partitionBy("started_at").orderBy("logged_at", "run_id"))
    base = F.regexp_replace(F.regexp_replace("started_at", "[-:]", ""), "T", "-")
    return rows.select("target", "started_at", F.col("run_id").alias("given"), F.when(k == 1, base).otherwise(F.concat(base, F.lit("-"), k.cast("string"))).alias("run_id"))


def registry_state(log: DataFrame) -> DataFrame:
    """(run_id, target, status, state, error): finishing row of each run if it has one, else its start.

    Status spelling doesn't count; of several finishing rows the latest holds.  Null errors read as ''.
    """
    status = F.lower(F.trim("status"))
    last = log.groupBy("run_id").agg(F.max_by(F.struct("target", status.alias("status"), F.coalesce("state", F.lit("")).alias("state"), F.coalesce("error", F.lit("")).alias("error")), F.struct(status == "done", "logged_at")).alias("r"))
    return last.select("run_id", "r.*")


def state_summary(states: DataFrame) -> DataFrame:
    """(state, n): runs by state; those without a finishing row count as ``running``."""
    return states.groupBy(F.when(F.col("status") == "done", F.col("state")).otherwise("running").alias("state")).agg(F.count("*").cast("bigint").alias("n"))


def verdict(ok: Column, files: Column, warnings: Column, error: Column) -> Column:
    """Why an extraction failed, null if it went well: its error, else its warnings, else that nothing was kept."""
    told = F.array_join(F.filter(warnings, lambda w: w.isNotNull()), "; ")
    return F.when(error.isNotNull() & (error != ""), error).when(~F.coalesce(ok, F.lit(False)), F.lit("extraction failed")).when(F.coalesce(files, F.lit(0)) <= 0, F.when(F.coalesce(told, F.lit("")) != "", told).otherwise("no files kept"))


def identities(profiles: DataFrame) -> DataFrame:
    """(run_id, doc): identity of each profile as JSON; null fields are left out."""
    return profiles.select("run_id", F.to_json(F.struct("title", "category", "summary", "tags", "language", "confidence")).alias("doc"))


def profile_problems(profiles: DataFrame) -> DataFrame:
    """(run_id, n, problems) of each profile against the publish template."""
    found = identities(profiles).select("run_id", R.check_template(F.col("doc"), R.IDENTITY).alias("p"))
    return found.select("run_id", F.size("p").cast("bigint").alias("n"), F.array_join("p", "; ").alias("problems"))


def published(profiles: DataFrame, states: DataFrame) -> DataFrame:
    """(path, run_id, title, category, summary, tags, language, confidence) of valid profiles of runs that went well.

    One row is the sidecar of one target; columns follow the template's order.
    """
    good = profile_problems(profiles).filter("n = 0").select("run_id")
    runs = states.filter("status = 'done' and state = 'ok'").select("run_id", F.concat("target", F.lit(".publish.json")).alias("path"))
    rows = profiles.join(good, "run_id", "left_semi").join(runs, "run_id")
    return rows.select("path", "run_id", "title", "category", "summary", "tags", "language", "confidence")


def write_sidecars(rows: DataFrame, folder: str) -> None:
    """One JSON document per row under ``folder``; Spark's commit protocol replaces temporary names."""
    doc = F.to_json(F.struct(F.struct("title", "category", "summary", "tags", "language", "confidence").alias("identity")))
    rows.select("path", doc.alias("value")).write.mode("overwrite").json(folder)
