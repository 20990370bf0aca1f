"""Columns by their exact names, whatever else a table holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(rows: DataFrame, name: str) -> int:
    """Where a column stands; of several matches the exact one counts, then the first."""
    for same in (name.__eq__, lambda other: other.lower() == name.lower()):
        places = [i for i, other in enumerate(rows.columns) if same(other)]
        if places:
            return places[0]
    raise ValueError(f"no column {name!r} among {rows.columns}")


def numbered(rows: DataFrame) -> DataFrame:
    """The same rows with columns ``_in0``, ``_in1``, ..., which no name of an operator clashes with."""
    return rows.toDF(*[f"_in{i}" for i in range(len(rows.columns))])


def restored(rows: DataFrame, results: list[str]) -> list[Column]:
    """The columns of ``rows`` out of ``numbered(rows)``, but for names of results in any case."""
    taken = {name.lower() for name in results}
    return [
        F.col(f"_in{i}").alias(name) for i, name in enumerate(rows.columns) if name.lower() not in taken
    ]


def only(rows: DataFrame, **columns: str) -> DataFrame:
    """The given columns of a table under new names: ``only(docs, _id="doc_id")``.

    Columns are found by position, so other columns of any name, repeated names and names that
    differ in case only do not matter.  Of several matches the exact one counts, then the first.
    """
    return numbered(rows).selectExpr(*[f"_in{place(rows, old)} as {new}" for new, old in columns.items()])
