"""Path rules: names, suffixes, languages, test predicates, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions import dims


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """Last ``.x`` of a name, empty for dot files and names ending in a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(name)))


def path_order(path: Column) -> Column:
    """Depth-first order of a sorted directory walk; the tie-break of every ranking."""
    return F.split(path, "/")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL when the key is missing."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.create_map(*pairs)[key]


def language_of(name: Column) -> Column:
    return F.coalesce(
        lookup(dims.LANGUAGE_BY_NAME, name),
        lookup(dims.LANGUAGE_BY_EXTENSION, F.lower(suffix(name))),
        F.lit("Other"),
    )


def top_level_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("./")


def extension_label(path: Column) -> Column:
    ext = suffix(file_name(path))
    return F.when(ext == "", "(no ext)").otherwise(ext)


def is_test_for_health(path: Column) -> Column:
    return path.rlike(
        r"(^|/)(tests|test|__tests__|spec)(/|$)"
        r"|(^|/)test_[^/]*$|_test\.py$|\.(test|spec)\.(js|ts)$"
    )


def is_test_for_security(path: Column) -> Column:
    return F.lower(path).rlike("test|spec")


def is_test_for_search(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.contains("test_") | name.contains("_test.") | name.startswith("test")


def default_ignored(path: Column) -> Column:
    """Any component of the relative path is one of the names that are always skipped."""
    names = [
        glob.replace(".", r"\.").replace("*", "[^/]*") for glob in dims.DEFAULT_IGNORES
    ]
    return path.rlike(rf"(^|/)({'|'.join(names)})(/|$)")


def directory_role(path: Column) -> Column:
    """What the top-level directory is usually for; NULL for files in the root."""
    role = F.coalesce(
        lookup(dims.DIRECTORY_ROLES, F.lower(F.split_part(path, F.lit("/"), F.lit(1)))),
        F.lit(dims.DEFAULT_ROLE),
    )
    return F.when(path.contains("/"), role)


def entry_point_type(path: Column) -> Column:
    name = F.lower(file_name(path))
    return (
        F.when(name.rlike("cli|command"), "CLI")
        .when(name.contains("main"), "Main")
        .when(name.rlike("app|server"), "Application")
        .when(name.rlike("route|api"), "API")
        .when(name.contains("index"), "Index")
        .when(name.contains("manage"), "Management")
        .otherwise("Entry")
    )
