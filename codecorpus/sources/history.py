"""Commit logs: (repo, sha, author, ts, path, change_type), one row per touched file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.functions import dims

SCHEMA = "repo string, sha string, author string, ts timestamp, path string, change_type string"


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An exported commit log in any batch format of Spark."""
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def newest_commits(commit_files: DataFrame, limit: int) -> DataFrame:
    """The newest commits of every repository: repo, sha, author, ts.

    Commits are reduced to one row each before ranking, and Spark cuts every partition to
    ``limit`` rows per repository before the shuffle.
    """
    commits = commit_files.groupBy("repo", "sha").agg(
        F.max("ts").alias("ts"), F.max("author").alias("author")
    )
    order = Window.partitionBy("repo").orderBy(F.col("ts").desc(), "sha")
    return (
        commits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("repo", "sha", "author", "ts")
    )


def load_commits(
    commit_files: DataFrame,
    as_of: Column | None = None,
    days: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Touched files of the newest ``limit`` commits of at most ``days`` before ``as_of``.

    Without a number of days, or without a limit, all commits count.
    """
    recent = commit_files
    if days is not None:
        recent = recent.where(F.col("ts") >= as_of - F.expr(f"interval {days} days"))
    if limit is None:
        return recent
    newest = newest_commits(recent, limit).select("repo", "sha")
    return recent.join(newest, ["repo", "sha"], "left_semi")


def no_commits(spark: SparkSession) -> DataFrame:
    """The log of repositories that have none."""
    return spark.createDataFrame([], SCHEMA)
