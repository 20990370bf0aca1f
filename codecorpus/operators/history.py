"""Aggregates of the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.session import stored
from codecorpus.sources.corpus import per_repo_facts
from codecorpus.sources.history import newest_commits


def file_history(commit_files: DataFrame) -> DataFrame:
    """Commits, authors, last change and churn (share of the most changed file) per path.

    The aggregate per path is stored, so the log is read once for it and for the largest value.
    """
    per_file = commit_files.groupBy("repo", "path").agg(
        F.count_distinct("sha").alias("commit_count"),
        F.array_sort(F.collect_set("author")).alias("contributors"),
        F.max("ts").alias("last_modified"),
    )
    per_file = stored(per_file)
    most = per_file.groupBy("repo").agg(F.max("commit_count").alias("max_commits"))
    return per_repo_facts(per_file, most, "inner").withColumn(
        "churn_score", F.col("commit_count") / F.col("max_commits") * 100
    )


def contributors(commit_files: DataFrame, limit: int = dims.CONTRIBUTOR_COMMITS) -> DataFrame:
    """Commits per author among the newest commits."""
    return (
        newest_commits(commit_files, limit)
        .groupBy("repo", "author")
        .agg(F.count(F.lit(1)).alias("commits"))
    )


def recent_files(commit_files: DataFrame, limit: int = dims.RECENT_COMMITS) -> DataFrame:
    """Paths that were modified in the newest commits that modified anything.

    What was modified is stored, and so are the newest commits, so the log is read once and the disk of
    one step's shuffles is free before the next.
    """
    modified = commit_files.where(F.col("change_type") == "M")
    modified = stored(modified.select("repo", "sha", "author", "ts", "path"))
    newest = stored(newest_commits(modified, limit).select("repo", "sha"))
    return modified.join(newest, ["repo", "sha"], "left_semi").select("repo", "path").distinct()


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, deleted and modified paths between two snapshots (repo, path, content_sha).

    A renamed file shows as one deleted and one added path.
    """
    old = before.select("repo", "path", F.col("content_sha").alias("old_sha"))
    new = after.select("repo", "path", F.col("content_sha").alias("new_sha"))
    change = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull(), "deleted")
        .when(F.col("old_sha") != F.col("new_sha"), "modified")
    )
    return (
        old.join(new, ["repo", "path"], "full_outer")
        .select("repo", "path", change.alias("change"))
        .where(F.col("change").isNotNull())
    )


def diff_summary(changes: DataFrame, listed: int = 20) -> DataFrame:
    """Counts per kind of change and the first paths of each."""
    counts = changes.groupBy("repo", "change").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("repo", "change").orderBy("path")
    first = (
        changes.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= listed)
        .groupBy("repo", "change")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
    )
    return counts.join(first, ["repo", "change"])
