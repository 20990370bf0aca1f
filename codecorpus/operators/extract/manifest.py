"""Packages and scripts declared in the manifest files at the root of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import unnest
from codecorpus.functions.text import SPACE, let, split_lines, strip

MANIFESTS = ["pyproject.toml", "requirements.txt", "package.json", "go.mod", "Cargo.toml"]
NPM = "dependencies map<string,string>, devDependencies map<string,string>"


def _package_name(line: Column) -> Column:
    """Text before the first version bound or extra."""
    return strip(F.split(line, r">=|<=|==|\[", 2)[0])


def _between(lines: Column, first: str, last: str) -> Column:
    """Stripped lines after the first one equal to ``first``, up to the next equal to ``last``."""

    def up_to_last(rest: Column) -> Column:
        end = F.array_position(rest, last)
        return F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)

    def after_first(stripped: Column) -> Column:
        start = F.array_position(stripped, first).cast("int")
        rest = F.slice(stripped, start + 1, F.size(stripped))
        return F.when(start > 0, let(rest, up_to_last)).otherwise(
            F.array().cast("array<string>")
        )

    inner = let(F.transform(lines, strip), after_first)
    return F.filter(inner, lambda x: x != first)


def _names(path: Column, content: Column) -> Column:
    lines = split_lines(content)
    pyproject = F.transform(
        _between(lines, "dependencies = [", "]"),
        lambda x: _package_name(F.regexp_replace(x, r'^[",]+|[",]+$', "")),
    )
    requirements = F.transform(
        F.filter(F.transform(lines, strip), lambda x: ~x.rlike("^[#-]")), _package_name
    )
    npm = F.from_json(content, NPM)
    none = F.array().cast("array<string>")
    package_json = F.concat(
        F.coalesce(F.map_keys(npm["dependencies"]), none),
        F.coalesce(F.map_keys(npm["devDependencies"]), none),
    )
    go_mod = F.transform(
        _between(lines, "require (", ")"), lambda x: F.regexp_extract(x, rf"^([^{SPACE}]*)", 1)
    )
    # Lines of the dependency tables: everything up to the next line that opens a table.
    tables = F.regexp_extract_all(
        F.array_join(F.transform(lines, strip), "\n"),
        F.lit(r"(?<![^\n])\[(?:dev-)?dependencies\](?=\n)((?:\n(?!\[)[^\n]*+)*+)"),
        F.lit(1),
    )
    cargo = F.transform(
        F.filter(
            F.flatten(F.transform(tables, lambda t: F.split(t, "\n"))), lambda x: x.contains("=")
        ),
        lambda x: strip(F.split_part(x, F.lit("="), F.lit(1))),
    )
    found = (
        F.when(path == "pyproject.toml", pyproject)
        .when(path == "requirements.txt", requirements)
        .when(path == "package.json", package_json)
        .when(path == "go.mod", go_mod)
        .when(path == "Cargo.toml", cargo)
    )
    return F.filter(found, lambda x: x != "")


def manifest_deps(raw_files: DataFrame) -> DataFrame:
    """One row per declared package: repo, manifest, package.

    Reads the unfiltered corpus: a manifest counts even when an ignore rule hides it.
    """
    return unnest(
        raw_files.where(F.col("path").isin(*MANIFESTS)),
        ["repo", F.col("path").alias("manifest")],
        _names(F.col("path"), F.col("content").cast("string")),
        "package",
    ).distinct()


def script_targets(raw_files: DataFrame) -> DataFrame:
    """Modules named by the scripts table of pyproject.toml: repo, ordinal, path."""
    lines = F.array_join(split_lines(F.col("content").cast("string")), "\n")
    table = F.regexp_extract(
        lines, rf"\[project\.scripts\][^\n]*((?:\n(?![{SPACE}]*\[)[^\n]*+)*+)", 1
    )
    assigned = F.filter(F.split(table, "\n"), lambda x: x.contains("="))

    def module_path(line: Column) -> Column:
        value = strip(F.split_part(line, F.lit("="), F.lit(2)))
        target = F.split_part(F.regexp_replace(value, '^"+|"+$', ""), F.lit(":"), F.lit(1))
        return F.concat(F.replace(target, F.lit("."), F.lit("/")), F.lit(".py"))

    manifests = raw_files.where(F.col("path") == "pyproject.toml")
    return unnest(manifests, ["repo"], F.transform(assigned, module_path), "path", "ordinal")
