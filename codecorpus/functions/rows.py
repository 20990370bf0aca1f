"""From arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose values are computed exactly once per row.

    The optimizer is free to copy the expression of a plain column into every place that uses it,
    filters below included.  That is a loss when the expression scans a whole text.  The result of
    a generator is never copied, and filters on it stay above.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    bound = rows.select("*", F.explode_outer(F.array(values)).alias("_row"))
    return bound.select(*rows.columns, "_row.*")


def unnest(
    rows: DataFrame, keep: list, array: Column | str, alias: str, pos: str = "_pos"
) -> DataFrame:
    """Kept columns and one row per array element, with its position from 0.

    A plain explode makes the optimizer add a filter on the size of the array, and computing the
    array for that filter doubles the work when the array is the result of scanning text.  The
    outer form computes it once; the row it makes for an empty array is dropped here.
    """
    exploded = rows.select(*keep, F.posexplode_outer(array).alias(pos, alias))
    exploded = exploded.where(F.col(pos).isNotNull())
    return exploded.drop(pos) if pos == "_pos" else exploded
