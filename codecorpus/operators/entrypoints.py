"""Entry points: files where execution starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.operators.rank import numbered, top_k


def entry_points(modules: DataFrame, scripts: DataFrame) -> DataFrame:
    """(repo, path, origin, ordinal): flagged, well-named or routing files, then script targets.

    ``origin`` is 0 for files and 1 for targets that only the project manifest names; within an
    origin the order is path order or manifest order.
    """
    routing = F.exists(
        "functions",
        lambda f: ~f["is_method"]
        & F.exists(f["decorators"], lambda d: F.lower(d).rlike("|".join(dims.ROUTE_WORDS))),
    )
    name = paths.file_name(F.col("path"))
    found = modules.where(
        F.col("entry_point") | name.isin(*dims.ENTRY_POINT_NAMES) | routing
    ).select("repo", "path", F.lit(0).alias("origin"), F.lit(0).alias("ordinal"))
    targets = scripts.groupBy("repo", "path").agg(F.min("ordinal").alias("ordinal"))
    named = targets.join(found.select("repo", "path"), ["repo", "path"], "left_anti").select(
        "repo", "path", F.lit(1).alias("origin"), "ordinal"
    )
    return found.unionByName(named)


def entry_order() -> list:
    return [F.col("origin"), F.col("ordinal"), paths.path_order(F.col("path"))]


def entry_point_types(points: DataFrame) -> DataFrame:
    return points.groupBy("repo", paths.entry_point_type(F.col("path")).alias("type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def annotate_file_tree(
    files: DataFrame, points: DataFrame, scores: DataFrame, k: int | None = None
) -> DataFrame:
    """Files of every repository in path order with their entry and danger flags.

    With ``k`` only the first ``k`` per repository; they are cut before they meet the flags, which
    come from all ``hotspot_scores``.
    """
    rows = files.select("repo", "path", "code_lines")
    first = numbered(rows, F.col("path")) if k is None else top_k(rows, k, F.col("path"))
    entries = points.select("repo", "path").distinct().withColumn("is_entry", F.lit(True))
    danger = (
        scores.where("is_danger_zone")
        .select("repo", "path")
        .distinct()
        .withColumn("is_danger", F.lit(True))
    )
    return (
        first.join(entries, ["repo", "path"], "left")
        .join(danger, ["repo", "path"], "left")
        .fillna(False, ["is_entry", "is_danger"])
    )
