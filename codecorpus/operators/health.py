"""Health report: five weighted category scores per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.functions.rows import unnest


def health_facts(
    files: DataFrame, functions: DataFrame, projects: DataFrame, cycles: DataFrame
) -> DataFrame:
    """One row per repository with everything the scores need.

    ``files`` and ``functions`` are reduced to one row per repository by map-side aggregates
    before anything is joined; ``projects`` and ``cycles`` are small already.
    """
    test = paths.is_test_for_health(F.col("path"))
    python = F.col("path").endswith(".py")
    per_files = files.groupBy("repo").agg(
        F.sum("code_lines").alias("code_lines"),
        F.sum("comment_lines").alias("comment_lines"),
        F.count_if(F.col("line_count") > 0).alias("sized_files"),
        F.stddev_pop(F.when(F.col("line_count") > 0, F.col("line_count"))).alias("line_sigma"),
        F.count_if(F.col("line_count") > 500).alias("large_files"),
        F.count_if(test).alias("test_files"),
        F.count_if(~test).alias("code_files"),
        F.count_if(python).alias("py_files"),
        F.count_if(python & (F.col("comment_lines") > 0)).alias("py_commented"),
    )
    per_functions = functions.groupBy("repo").agg(
        F.count(F.lit(1)).alias("functions"), F.sum("complexity").alias("complexity")
    )
    per_cycles = cycles.groupBy("repo").agg(F.count(F.lit(1)).alias("cycles"))
    roots = projects.select(
        "repo", F.col("files").alias("root_files"), "dirs", "has_tests", "has_ci", "has_docker"
    )
    joined = (
        roots.join(per_files, "repo", "left")
        .join(per_functions, "repo", "left")
        .join(per_cycles, "repo", "left")
    )
    counted = [c for c in joined.columns if c not in ("repo", "root_files", "dirs", "line_sigma")]
    return joined.fillna(0, [c for c in counted if not c.startswith("has_")])


def _mean(*scores: Column) -> Column:
    total = scores[0]
    for score in scores[1:]:
        total = total + score
    return F.least(F.greatest(total / len(scores), F.lit(0.0)), F.lit(100.0))


def _percent(test: Column) -> Column:
    return F.when(test, 100.0).otherwise(0.0)


def _root_names(names: list[str]) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.filter(wanted, lambda n: F.array_contains("root_files", n))


def _category(name: str, score: Column, *details: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        score.alias("score"),
        (F.lit(dict(dims.HEALTH_WEIGHTS)[name]) / 100).alias("weight"),
        F.array(*details).alias("details"),
    )


def code_quality() -> Column:
    code = F.greatest("code_lines", F.lit(1))
    ratio = F.col("comment_lines") / code
    ratio_score = (
        F.when(ratio.between(0.10, 0.30), 100.0)
        .when(ratio < 0.10, F.greatest(F.lit(0.0), ratio / 0.10 * 100))
        .otherwise(F.greatest(F.lit(0.0), 100 - (ratio - 0.30) / 0.30 * 100))
    )
    known = F.col("functions") > 0
    average = F.col("complexity") / F.col("functions")
    complexity_score = (
        F.when(~known, 50.0)
        .when(average <= 5, 100.0)
        .when(average <= 10, 100 - (average - 5) / 5 * 50)
        .otherwise(F.greatest(F.lit(0.0), 50 - (average - 10) / 10 * 50))
    )
    length = code / F.col("functions")
    length_score = (
        F.when(~known, 50.0)
        .when(length <= 50, 100.0)
        .otherwise(F.greatest(F.lit(0.0), 100 - (length - 50) / 50 * 100))
    )
    return _category(
        "Code Quality",
        _mean(ratio_score, complexity_score, length_score),
        F.format_string("Comment ratio: %.0f%% (target 10-30%%)", ratio * 100),
        F.when(known, F.format_string("Avg function complexity: %.1f", average)).otherwise(
            "No functions detected for complexity analysis"
        ),
        F.when(
            known, F.format_string("Avg lines per function: %.0f (target <=50)", length)
        ).otherwise("No functions detected for length analysis"),
    )


def organization() -> Column:
    enough = F.col("sized_files") >= 2
    sigma_score = F.when(
        enough, F.greatest(F.lit(0.0), 100 - F.col("line_sigma") / 500 * 100)
    ).otherwise(50.0)
    standard = F.array_sort(
        F.array_intersect("dirs", F.array(*[F.lit(d) for d in dims.STANDARD_DIRS]))
    )
    matched = F.size(standard)
    structure_score = F.when(
        matched > 0, F.least(F.lit(100.0), matched * 50.0)
    ).otherwise(20.0)
    large = F.col("large_files")
    large_score = 100 - F.least(F.lit(100.0), large * 20.0)
    return _category(
        "Organization",
        _mean(sigma_score, structure_score, large_score),
        F.when(
            enough, F.format_string("File size std deviation: %.0f lines", "line_sigma")
        ).otherwise("Not enough files to assess size consistency"),
        F.when(
            matched > 0,
            F.concat(F.lit("Standard directories found: "), F.array_join(standard, ", ")),
        ).otherwise("No standard directories (src/, tests/, docs/) found"),
        F.when(large == 0, "No files over 500 lines").otherwise(
            F.format_string("%d file(s) over 500 lines", large)
        ),
    )


def testing() -> Column:
    has = F.col("has_tests")
    measurable = F.col("code_files") > 0
    ratio = F.col("test_files") / F.col("code_files")
    ratio_score = (
        F.when(~measurable, 0.0).when(ratio >= 0.5, 100.0).otherwise(ratio / 0.5 * 100)
    )
    return _category(
        "Testing",
        _mean(_percent(has), ratio_score),
        F.when(has, "Test directory/files detected").otherwise(
            "No test directory or files detected"
        ),
        F.when(
            measurable, F.format_string("Test-to-code file ratio: %.2f (target 0.5-1.0)", ratio)
        ).otherwise("No code files to compute test ratio"),
    )


def documentation() -> Column:
    readme = F.size(_root_names(dims.README_NAMES)) > 0
    configs = _root_names(dims.CONFIG_FILES)
    python = F.col("py_files")
    commented_score = F.when(python > 0, F.col("py_commented") / python * 100).otherwise(50.0)
    return _category(
        "Documentation",
        _mean(_percent(readme), commented_score, _percent(F.size(configs) > 0)),
        F.when(readme, "README found").otherwise("No README found"),
        F.when(
            python > 0,
            F.format_string("%d/%d Python files have docstrings/comments", "py_commented", python),
        ).otherwise("No Python files to check for docstrings"),
        F.when(
            F.size(configs) > 0,
            F.concat(F.lit("Config files: "), F.array_join(configs, ", ")),
        ).otherwise("No project config files found"),
    )


def maintenance() -> Column:
    ci, docker = F.col("has_ci"), F.col("has_docker")
    gitignore = F.array_contains("root_files", ".gitignore")
    cycles = F.col("cycles")
    cycle_score = 100 - F.least(F.lit(100.0), cycles * 25.0)
    return _category(
        "Maintenance",
        _mean(_percent(ci), _percent(gitignore), _percent(docker), cycle_score),
        F.when(ci, "CI/CD configuration detected").otherwise("No CI/CD configuration detected"),
        F.when(gitignore, ".gitignore found").otherwise("No .gitignore found"),
        F.when(docker, "Docker setup detected").otherwise("No Docker setup detected"),
        F.when(cycles == 0, "No circular dependencies detected").otherwise(
            F.format_string("%d circular dependency chain(s) found", cycles)
        ),
    )


def health_categories(facts: DataFrame) -> DataFrame:
    """(repo, ordinal, name, score, weight, details): five rows per repository."""
    categories = F.array(
        code_quality(), organization(), testing(), documentation(), maintenance()
    )
    rows = unnest(facts, ["repo"], categories, "c", "ordinal")
    return rows.select("repo", "ordinal", "c.*")


def _grade(score: Column) -> Column:
    grade = None
    for least, letter in dims.GRADES:
        test = score >= least
        grade = F.when(test, letter) if grade is None else grade.when(test, letter)
    return grade.otherwise("F")


def health_report(categories: DataFrame) -> DataFrame:
    """Overall score, grade and advice per repository.

    The five categories of a repository are gathered and added in order, so the sum does not
    depend on how rows arrive.
    """
    row = F.struct("ordinal", "name", "score", "weight")
    gathered = categories.groupBy("repo").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    overall = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + r["score"] * r["weight"])
    overall = F.least(F.greatest(overall, F.lit(0.0)), F.lit(100.0))
    return gathered.select(
        "repo",
        F.round(overall, 1).alias("overall_score"),
        _grade(overall).alias("grade"),
        F.flatten(F.transform("rows", lambda r: _advice(r["name"], r["score"]))).alias(
            "recommendations"
        ),
    )


def _advice(name: Column, score: Column) -> Column:
    given = [
        F.when((name == category) & (score >= low) & (score < high), text)
        for category, low, high, text in dims.HEALTH_ADVICE
    ]
    return F.array_compact(F.array(*given))


