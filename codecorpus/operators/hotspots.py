"""Hotspots and complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import paths
from codecorpus.operators.rank import top_k
from codecorpus.session import stored
from codecorpus.sources.corpus import per_repo_facts


def file_complexity(modules: DataFrame) -> DataFrame:
    """Summed complexity of functions and methods per file; files without any are left out.

    A module row already holds all functions of its file, so no grouping is needed.
    """
    total = F.aggregate("functions", F.lit(0).cast("long"), lambda acc, f: acc + f["complexity"])
    return modules.select("repo", "path", total.alias("complexity")).where("complexity > 0")


def complexity_summary(functions: DataFrame) -> DataFrame:
    return functions.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.sum("complexity").alias("sum_complexity"),
        F.avg("complexity").alias("avg_complexity"),
        F.max("complexity").alias("max_complexity"),
    )


def complex_functions(functions: DataFrame, threshold: int = 10, k: int = 20) -> DataFrame:
    """Most complex functions above the threshold; methods are named ``Class.method``."""
    named = functions.where(F.col("complexity") > threshold).select(
        "repo",
        "path",
        F.concat_ws(".", "owner_class", "name").alias("function"),
        "line_no",
        "complexity",
    )
    return top_k(
        named,
        k,
        F.col("complexity").desc(),
        paths.path_order(F.col("path")),
        "line_no",
        "function",
    )


def hotspot_features(files: DataFrame, history: DataFrame, complexity: DataFrame) -> DataFrame:
    """Per file: commits (default 0), complexity (default 1) and code lines."""
    return (
        files.select("repo", "path", "code_lines")
        .join(history.select("repo", "path", "commit_count"), ["repo", "path"], "left")
        .join(complexity.select("repo", "path", "complexity"), ["repo", "path"], "left")
        .select(
            "repo",
            "path",
            F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
            F.coalesce("complexity", F.lit(1)).alias("complexity"),
            "code_lines",
        )
    )


def hotspot_scores(files: DataFrame, history: DataFrame, complexity: DataFrame) -> DataFrame:
    """Score of every file: 0.4 churn + 0.35 complexity + 0.25 size, each as a share of the
    largest value in the repository.

    The inputs are joined once and stored.  The largest values are aggregated per repository from
    that, also over files that only the log knows, and joined back, which keeps one huge repository
    spread over many tasks; a window over ``repo`` would not.
    """
    keys = ["repo", "path"]
    known = files.select(*keys, "code_lines", F.lit(True).alias("_known"))
    every = stored(
        known.join(history.select(*keys, "commit_count"), keys, "full")
        .join(complexity.select(*keys, "complexity"), keys, "left")
    )
    largest = every.groupBy("repo").agg(
        F.max("code_lines").alias("max_lines"),
        F.max("commit_count").alias("max_commits"),
        F.max("complexity").alias("max_complexity"),
    )
    features = every.where("_known").select(
        *keys,
        F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
        F.coalesce("complexity", F.lit(1)).alias("complexity"),
        "code_lines",
    )

    def share(value: str, most: str):
        denominator = F.greatest(F.coalesce(most, F.lit(1)), F.lit(1))
        return F.col(value) / denominator * 100

    scored = per_repo_facts(features, largest).select(
        "repo",
        "path",
        share("commit_count", "max_commits").alias("change_frequency"),
        share("complexity", "max_complexity").alias("complexity"),
        share("code_lines", "max_lines").alias("size_factor"),
    )
    churn, complex_, size = (F.col(c) for c in ("change_frequency", "complexity", "size_factor"))
    raw = churn * 0.4 + complex_ * 0.35 + size * 0.25
    return scored.withColumn("raw_score", raw).select(
        "*",
        F.round("raw_score", 1).alias("score"),
        ((F.col("raw_score") > 70) & (churn > 50) & (complex_ > 50)).alias("is_danger_zone"),
    )


def hotspots(scores: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest of ``hotspot_scores`` per repository, by rounded score, then path order."""
    return top_k(
        scores,
        k,
        F.col("score").desc(),
        paths.path_order(F.col("path")),
    )
