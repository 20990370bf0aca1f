"""The line table, and markers (TODO, FIXME, …) in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.functions.rows import unnest
from codecorpus.functions.text import (
    WORD_END,
    WORD_START,
    is_blank,
    is_comment,
    let,
    split_lines,
)

MARKER = rf"(?iu){WORD_START}({'|'.join(dims.MARKER_SEVERITY)}){WORD_END}"


def explode_lines(files: DataFrame) -> DataFrame:
    """files → (repo, path, line_no, text), numbered from 1, without a shuffle."""
    lines = unnest(files, ["repo", "path"], split_lines(F.col("content")), "text", "pos")
    return lines.select("repo", "path", (F.col("pos") + 1).alias("line_no"), "text")


def classify_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {"is_blank": is_blank(F.col("text")), "is_comment": is_comment(F.col("text"))}
    )


def marker_severity(marker_type: Column) -> Column:
    return F.coalesce(paths.lookup(dims.MARKER_SEVERITY, marker_type), F.lit("info"))


def scan_markers(files: DataFrame) -> DataFrame:
    """First marker of every line that has one, with the line before and after as context.

    Neighbours come from the array of lines of the same file, so no window is needed; files
    without any marker are dropped by one search over their text before they are split.
    """

    def hits(lines: Column) -> Column:
        found = F.transform(
            lines,
            lambda text, i: F.struct(
                (i + 1).alias("line_no"),
                F.upper(F.regexp_extract(text, MARKER, 1)).alias("marker_type"),
                text.alias("text"),
            ),
        )
        return F.transform(
            F.filter(found, lambda h: h["marker_type"] != ""),
            lambda h: F.struct(
                h["line_no"],
                h["marker_type"],
                h["text"],
                F.concat_ws(
                    "\n",
                    F.get(lines, h["line_no"] - 2),
                    h["text"],
                    F.get(lines, h["line_no"]),
                ).alias("context"),
            ),
        )

    marked = unnest(
        files.where(F.col("content").rlike(MARKER)),
        ["repo", "path"],
        let(split_lines(F.col("content")), hits),
        "m",
    )
    kind = F.col("m.marker_type")
    return marked.select(
        "repo",
        "path",
        "m.line_no",
        kind.alias("marker_type"),
        marker_severity(kind).alias("severity"),
        "m.text",
        "m.context",
    )


def marker_counts(markers: DataFrame) -> DataFrame:
    """Counts per repository: in total, by severity, by type and by file, in one pass."""
    return grouped_counts(markers, {"severity": "severity", "type": "marker_type", "file": "path"})


def grouped_counts(rows: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """(repo, dim, name, n) for the total and for each given column, by grouping sets."""
    columns = list(dimensions.values())
    sets = [[F.col("repo")]] + [[F.col("repo"), F.col(c)] for c in columns]
    counted = rows.groupingSets(sets, F.col("repo"), *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.grouping(c).alias(f"_{c}") for c in columns],
    )
    dim, name = F.lit("total"), F.lit("")
    for label, column in dimensions.items():
        dim = F.when(F.col(f"_{column}") == 0, label).otherwise(dim)
        name = F.when(F.col(f"_{column}") == 0, F.col(column)).otherwise(name)
    return counted.select("repo", dim.alias("dim"), name.alias("name"), "n")


def markers_by_severity(markers: DataFrame, severity: str = "all") -> DataFrame:
    return markers if severity == "all" else markers.where(F.col("severity") == severity)
