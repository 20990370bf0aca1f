"""Project statistics and size breakdowns over the ``files`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import paths


def project_stats(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Files, lines and mean size per repository; zeros for repositories without files."""
    stats = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("line_count").alias("total_lines"),
        F.sum("code_lines").alias("code_lines"),
        F.sum("blank_lines").alias("blank_lines"),
        F.sum("comment_lines").alias("comment_lines"),
        F.sum("size_bytes").alias("total_bytes"),
        F.avg("size_bytes").alias("avg_file_size"),
    )
    if repos is None:
        return stats
    return repos.select("repo").distinct().join(stats, "repo", "left").fillna(0)


def language_breakdown(files: DataFrame) -> DataFrame:
    """Code lines, files, first path and share of code lines per language.

    The share is a window over the aggregate, which has a few rows per repository, so the files are
    read once.
    """
    per_language = files.groupBy("repo", "language").agg(
        F.sum("code_lines").alias("code_lines"),
        F.count(F.lit(1)).alias("files"),
        F.min(paths.path_order(F.col("path"))).alias("first_path"),
    )
    total = F.sum("code_lines").over(Window.partitionBy("repo"))
    with_total = per_language.withColumn("repo_code_lines", F.greatest(total, F.lit(1)))
    return with_total.withColumn("share", F.col("code_lines") / F.col("repo_code_lines") * 100)


def size_breakdown(files: DataFrame) -> DataFrame:
    """Bytes, files, code lines and share of bytes by top directory, language and extension."""
    keyed = files.select(
        "repo",
        paths.top_level_dir(F.col("path")).alias("directory"),
        "language",
        paths.extension_label(F.col("path")).alias("extension"),
        "size_bytes",
        "code_lines",
    )
    dims_ = ["directory", "language", "extension"]
    sets = [[F.col("repo")]] + [[F.col("repo"), F.col(d)] for d in dims_]
    grouped = keyed.groupingSets(sets, F.col("repo"), *[F.col(d) for d in dims_]).agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("file_count"),
        F.sum("code_lines").alias("code_lines"),
        *[F.grouping(d).alias(f"_{d}") for d in dims_],
    )
    dim, name = F.lit("total"), F.lit("")
    for d in dims_:
        dim = F.when(F.col(f"_{d}") == 0, d).otherwise(dim)
        name = F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(name)
    rows = grouped.select("repo", dim.alias("dim"), name.alias("name"), "size_bytes", "file_count",
                          "code_lines")
    # The totals are part of the same small aggregate: one window over it gives the shares.
    total = F.max(F.when(F.col("dim") == "total", F.col("size_bytes")))
    rows = rows.withColumn("repo_bytes", total.over(Window.partitionBy("repo")))
    percentage = F.when(
        F.col("repo_bytes") > 0, F.col("size_bytes") / F.col("repo_bytes") * 100
    ).otherwise(0.0)
    return rows.where(F.col("dim") != "total").withColumn("percentage", percentage)


def directory_roles(files: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """Files, bytes and code lines per repository and usual role of the top-level directory.

    Repositories whose files all lie in the root take their directories from entry points.
    """
    role = paths.directory_role(F.col("path"))
    measured = files.select("repo", role.alias("role"), "size_bytes", "code_lines").where(
        "role is not null"
    )
    result = measured.groupBy("repo", "role").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sum("code_lines").alias("code_lines"),
    )
    if entry_points is None:
        return result
    named = entry_points.select("repo", role.alias("role")).where("role is not null").distinct()
    missing = named.join(result.select("repo").distinct(), "repo", "left_anti")
    zero = F.lit(0).cast("long")
    return result.unionByName(
        missing.select(
            "repo",
            "role",
            zero.alias("files"),
            zero.alias("size_bytes"),
            zero.alias("code_lines"),
        )
    )
