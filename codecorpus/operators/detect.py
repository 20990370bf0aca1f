"""What kind of project a repository is, from its root files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.operators.extract.manifest import NPM

# --- fixed values: files and directories the rules below ask for -----------------------------
ROOT_FILES = sorted(
    {
        *[name for name, _ in dims.LANGUAGE_MARKERS],
        *[name for name, _ in dims.FRAMEWORK_MARKERS],
        *[name for name, _ in dims.PACKAGE_MANAGERS],
        *dims.TEST_CONFIGS,
        *dims.CI_FILES,
        *dims.DOCKER_FILES,
        *dims.README_NAMES,
        *dims.CONFIG_FILES,
        *dims.STATIC_SITE_FILES,
        ".gitignore", "lerna.json", "pnpm-workspace.yaml", "nx.json", "serverless.yml",
        "serverless.yaml", "sam.yaml", "template.yaml", "netlify.toml", "vercel.json",
        # names that a rule accepts as a file or as a directory
        *dims.CI_DIRS,
    }
)
ROOT_DIRS = sorted(
    {
        *dims.TEST_DIRS,
        *dims.CI_DIRS,
        *dims.STANDARD_DIRS,
        *dims.FRONTEND_DIRS,
        *dims.BACKEND_DIRS,
        *dims.MVC_DIRS,
        "packages", "apps", "services", "microservices", "bin", "src/lib", "app",
    }
)


def root_markers(raw_files: DataFrame) -> DataFrame:
    """Per repository, which known root files and directories exist, and services with a config.

    Works on paths alone and before any ignore rule.  A directory exists when a file lies below
    it.  The sets are bounded by the lists above, so they are small whatever the repository size.
    """
    path = F.col("path")
    parts = F.split(path, "/")
    one = F.when(F.size(parts) > 1, parts[0])
    two = F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1]))
    per_file = raw_files.select(
        "repo",
        F.when(path.isin(*ROOT_FILES), path).alias("file"),
        F.when(one.isin(*ROOT_DIRS), one).alias("dir1"),
        F.when(two.isin(*ROOT_DIRS), two).alias("dir2"),
        F.when(
            path.rlike(rf"^services/[^/]+/({'|'.join(dims.SERVICE_CONFIGS)})$"), parts[1]
        ).alias("service"),
    )
    # Existence only asks for two services with a configuration, so the first and last name do.
    return per_file.groupBy("repo").agg(
        F.collect_set("file").alias("files"),
        F.array_union(F.collect_set("dir1"), F.collect_set("dir2")).alias("dirs"),
        (F.coalesce(F.min("service") < F.max("service"), F.lit(False))).alias("many_services"),
    )


def any_file(names: list[str]) -> Column:
    return F.arrays_overlap(F.col("files"), F.array(*[F.lit(n) for n in names]))


def any_dir(names: list[str]) -> Column:
    return F.arrays_overlap(F.col("dirs"), F.array(*[F.lit(n) for n in names]))


def manifest_texts(raw_files: DataFrame) -> DataFrame:
    """One row per repository with the text of the manifests that rules look into."""

    def text_of(name: str) -> Column:
        return F.max(F.when(F.col("path") == name, F.col("content").cast("string")))

    names = ["pyproject.toml", "requirements.txt", "package.json"]
    return (
        raw_files.where(F.col("path").isin(*names))
        .groupBy("repo")
        .agg(
            text_of("pyproject.toml").alias("pyproject"),
            text_of("requirements.txt").alias("requirements"),
            text_of("package.json").alias("package_json"),
        )
    )


def project_facts(raw_files: DataFrame) -> DataFrame:
    """Root markers and manifest texts per repository; the input of all detections."""
    return root_markers(raw_files).join(manifest_texts(raw_files), "repo", "left")


def frameworks() -> Column:
    """Ordered distinct frameworks: marker files, then npm packages, then Python packages."""
    npm = F.from_json("package_json", NPM)
    none = F.array().cast("array<string>")
    named = F.array_union(
        F.coalesce(F.map_keys(npm["dependencies"]), none),
        F.coalesce(F.map_keys(npm["devDependencies"]), none),
    )
    found = [F.when(any_file([f]), framework) for f, framework in dims.FRAMEWORK_MARKERS]
    found += [
        F.when(F.array_contains(named, package), framework)
        for package, framework in dims.FRAMEWORK_PACKAGES_JS
    ]
    for text in ("pyproject", "requirements"):
        found += [
            F.when(F.lower(text).contains(package), framework)
            for package, framework in dims.FRAMEWORK_PACKAGES_PYTHON
        ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def _first_marker(table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(any_file([name]), value) for name, value in table])


def language_counts(files: DataFrame) -> DataFrame:
    """Files per programming language, with the first path of each."""
    return (
        files.where(~F.col("language").isin(*dims.NON_CODE_LANGUAGES))
        .groupBy("repo", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min(paths.path_order(F.col("path"))).alias("first_path"),
        )
    )


def main_language(counts: DataFrame) -> DataFrame:
    """Language with most files per repository; between equals the one that appears first."""
    best = F.min(F.struct((-F.col("files")).alias("n"), "first_path", "language"))
    return counts.groupBy("repo").agg(best["language"].alias("counted_language"))


def has_script_section() -> Column:
    return F.coalesce(
        F.col("pyproject").contains("[project.scripts]")
        | F.col("pyproject").contains("console_scripts"),
        F.lit(False),
    )


def detect_projects(raw_files: DataFrame, files: DataFrame) -> DataFrame:
    """One row per repository: languages, frameworks, package manager, features, architecture."""
    language = main_language(language_counts(files))
    facts = project_facts(raw_files).join(language, "repo", "left")
    detected = facts.select(
        "*",
        F.coalesce(
            "counted_language", _first_marker(dims.LANGUAGE_MARKERS), F.lit("Other")
        ).alias("primary_language"),
        frameworks().alias("frameworks"),
        _first_marker(dims.PACKAGE_MANAGERS).alias("package_manager"),
        (any_dir(dims.TEST_DIRS) | any_file(dims.TEST_CONFIGS)).alias("has_tests"),
        (any_dir(dims.CI_DIRS) | any_file(dims.CI_FILES + dims.CI_DIRS)).alias("has_ci"),
        any_file(dims.DOCKER_FILES).alias("has_docker"),
        (any_dir(["docs"]) | any_file(["README.md"])).alias("has_docs"),
    )
    return detected.select(
        "*",
        architecture_by_score().alias("architecture"),
        architecture_by_first_match().alias("first_match_architecture"),
    )


def architecture_scores() -> dict[str, Column]:
    """Points per pattern from directories, files and frameworks."""
    frontend, backend = any_dir(dims.FRONTEND_DIRS), any_dir(dims.BACKEND_DIRS)

    def uses(*names: str) -> Column:
        return F.arrays_overlap(F.col("frameworks"), F.array(*[F.lit(n) for n in names]))

    mvc_dirs = F.size(F.array_intersect("dirs", F.array(*[F.lit(d) for d in dims.MVC_DIRS])))
    # --- fixed values: points per signal ---
    signals = {
        "Monorepo": [
            (any_dir(["packages"]), 3), (any_dir(["apps"]), 3), (any_file(["lerna.json"]), 5),
            (any_file(["pnpm-workspace.yaml"]), 5), (any_file(["nx.json"]), 5),
        ],
        "Microservices": [
            (any_dir(["services"]), 3), (F.col("many_services"), 4),
            (any_file(["docker-compose.yml"]), 1),
        ],
        "Serverless": [
            (any_file(["serverless.yml", "serverless.yaml"]), 5),
            (any_file(["sam.yaml", "template.yaml"]), 5),
            (any_file(["netlify.toml", "vercel.json"]), 2),
        ],
        "Fullstack": [(frontend & backend, 4), (uses("Next.js"), 3)],
        "MVC": [(uses("Django"), 3), (uses("Rails"), 3)],
        "API Service": [(backend & ~frontend, 3), (uses("FastAPI", "Express"), 2)],
        "CLI Tool": [(has_script_section(), 4), (any_dir(["bin"]), 2)],
        "Library": [(any_dir(["src/lib", "lib"]), 2), (any_file(["setup.py"]), 2)],
        "Static Site": [(any_file(dims.STATIC_SITE_FILES), 5)],
    }
    scores = {}
    for pattern, rows in signals.items():
        total = F.lit(0)
        for test, points in rows:
            total = total + F.when(test, points).otherwise(0)
        scores[pattern] = total
    scores["MVC"] = scores["MVC"] + F.when(mvc_dirs >= 2, mvc_dirs * 2).otherwise(0)
    return scores


def architecture_by_score() -> Column:
    """Pattern with most points; between equals the one named first; no points: Unknown."""
    scores = architecture_scores()
    rows = [
        F.struct((-scores[p]).alias("s"), F.lit(i).alias("i"), F.lit(p).alias("p"))
        for i, p in enumerate(dims.ARCHITECTURES)
        if p in scores
    ]
    best = F.array_min(F.array(*rows))
    return F.when(best["s"] == 0, "Unknown").otherwise(best["p"])


def architecture_by_first_match() -> Column:
    frontend = any_dir([*dims.FRONTEND_DIRS, "app"])
    backend = any_dir(dims.BACKEND_DIRS)
    return (
        F.when(
            any_dir(["packages", "apps"]) | any_file(["lerna.json", "pnpm-workspace.yaml"]),
            "Monorepo",
        )
        .when(any_dir(["services", "microservices"]), "Microservices")
        .when(any_file(["serverless.yml", "sam.yaml"]), "Serverless")
        .when(frontend & backend, "Fullstack")
        .when(any_dir(dims.MVC_DIRS), "MVC")
        .when(backend & ~frontend, "API Service")
        .when((F.col("primary_language") == "Python") & has_script_section(), "CLI Tool")
        .when(any_dir(["src"]) & ~frontend, "Library")
        .otherwise("Unknown")
    )


def percent_text(share: Column) -> Column:
    """A percentage with one decimal, as shown in texts."""
    return F.format_string("%.1f", share)


def explain_projects(
    projects: DataFrame,
    stats: DataFrame,
    languages: DataFrame,
    entry_points: DataFrame,
    dependencies: DataFrame,
) -> DataFrame:
    """A paragraph per repository; sentences without content are left out.

    Every input is aggregated to one row per repository first.  The first entry point and the
    three top languages are found by aggregates, so no list of a repository is collected whole.
    """
    first = F.min(F.struct("origin", "ordinal", paths.path_order(F.col("path")).alias("parts")))
    entries = entry_points.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_entries"), F.element_at(first["parts"], -1).alias("first_entry")
    )
    packages = dependencies.groupBy("repo").agg(F.count(F.lit(1)).alias("n_packages"))
    # At most one row per known language.
    shares = languages.groupBy("repo").agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("code_lines")).alias("n"), "first_path", "language", "share")
            )
        ).alias("shares")
    )
    joined = (
        projects.join(stats, "repo", "left")
        .join(shares, "repo", "left")
        .join(entries, "repo", "left")
        .join(packages, "repo", "left")
    )
    used = F.array_join(F.slice("frameworks", 1, 2), " and ")
    kind = F.concat_ws(" ", F.lit("This is a"), "primary_language", F.lower("architecture"))
    opening = F.when(
        F.size("frameworks") > 0, F.concat(kind, F.lit(" using "), used, F.lit("."))
    ).otherwise(F.concat(kind, F.lit(".")))
    size = F.when(
        F.col("code_lines") > 0,
        F.format_string(
            "It contains %s files with %s lines of code across %d language(s).",
            F.format_number("total_files", 0),
            F.format_number("code_lines", 0),
            F.size("shares"),
        ),
    )
    top = F.transform(
        F.slice("shares", 1, 3),
        lambda s: F.concat(s["language"], F.lit(" ("), percent_text(s["share"]), F.lit("%)")),
    )
    top_languages = F.when(
        F.size("shares") > 1,
        F.concat(F.lit("Primary languages: "), F.array_join(top, ", "), F.lit(".")),
    )
    starts = F.when(
        F.col("n_entries") > 0,
        F.format_string(
            "There are %d entry point(s), starting from %s.", "n_entries", "first_entry"
        ),
    )
    depends = F.when(
        F.col("n_packages") > 0,
        F.format_string("The project depends on %d external package(s).", "n_packages"),
    )
    features = F.concat_ws(
        ", ",
        F.when(F.col("has_tests"), "tests"),
        F.when(F.col("has_ci"), "CI/CD"),
        F.when(F.col("has_docker"), "Docker"),
    )
    includes = F.when(features != "", F.concat(F.lit("It includes "), features, F.lit(".")))
    text = F.concat_ws(" ", opening, size, top_languages, starts, depends, includes)
    return joined.select("repo", text.alias("explanation"))
