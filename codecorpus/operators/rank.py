"""Top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.functions import paths
from codecorpus.session import stored


def top_k(
    rows: DataFrame, k: int | None, *order: Column, by: tuple[str, ...] = ("repo",), where=None
) -> DataFrame:
    """The first ``k`` rows of every group (all rows if None), numbered by ``rank``.

    Spark turns the filter on ``row_number`` into a limit per group that runs before the shuffle,
    so a group that holds most rows still sends at most ``k`` rows per partition.
    """
    if where is not None:
        rows = rows.where(where)
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


#: Rows that one task numbers.
TASK_ROWS = 250_000


def numbered(
    rows: DataFrame, *order: Column, by: tuple[str, ...] = ("repo",), task_rows: int = TASK_ROWS
) -> DataFrame:
    """All rows of every group, numbered by ``rank`` like ``top_k`` without a limit.

    A window needs a task per group, and one group may hold most rows.  Above ``task_rows`` rows are
    therefore cut into ranges of group and order and stored; a row's number is its place among the
    rows of its group in its range, after those that earlier ranges hold.
    """
    ranges = -(-rows.count() // task_rows)
    if ranges <= 1:
        return top_k(rows, None, *order, by=by)
    # Rows that are equal in group and order are in one range.
    cut = rows.repartitionByRange(ranges, *[F.col(c) for c in by], *order)
    cut = stored(cut.withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    return (
        cut.withColumn("_within", within)
        .join(before, same)
        .select(*rows.columns, (F.col("_within") + F.col("_before")).cast("int").alias("rank"))
    )


def largest_files(files: DataFrame, k: int = 10) -> DataFrame:
    """Biggest files per repository; equal sizes in path order."""
    narrow = files.select("repo", "path", "size_bytes")
    return top_k(narrow, k, F.col("size_bytes").desc(), paths.path_order(F.col("path")))
