"""Exports: one JSON or Markdown document per repository.

A JSON document lists every file of its repository, so it can be far larger than a row should be.
It is therefore a table of lines: (repo, section, item, line), where the lines of a repository in
the order of ``section`` and ``item`` are its document.  A huge repository is spread over as many
tasks as its size asks for.  Markdown documents only hold bounded top lists and are single rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.functions.rows import unnest
from codecorpus.operators.entrypoints import entry_order
from codecorpus.operators.rank import top_k
from codecorpus.sources.corpus import SALTS

FORMAT_VERSION = "0.1.0"


@dataclass(frozen=True)
class Analysis:
    """The result tables that a report is made from."""

    files: DataFrame
    projects: DataFrame
    stats: DataFrame
    languages: DataFrame
    largest: DataFrame
    edges: DataFrame
    dependencies: DataFrame
    cycles: DataFrame
    hotspots: DataFrame
    scores: DataFrame
    entry_points: DataFrame
    explanations: DataFrame
    history: DataFrame


def _language_maps(languages: DataFrame) -> DataFrame:
    """Per repository: languages in order of code lines, as arrays (at most one row each)."""
    row = F.struct(
        (-F.col("code_lines")).alias("n"),
        "first_path",
        "language",
        "code_lines",
        "files",
        F.round("share", 1).alias("share"),
    )
    return languages.groupBy("repo").agg(F.array_sort(F.collect_list(row)).alias("langs"))


def _map_of(rows: str, value: str) -> Column:
    return F.map_from_entries(
        F.transform(rows, lambda r: F.struct(r["language"].alias("k"), r[value].alias("v")))
    )


def _largest_lists(largest: DataFrame) -> DataFrame:
    """The (at most ten) largest files per repository as one array."""
    row = F.struct("rank", "path", "size_bytes")
    return largest.groupBy("repo").agg(F.array_sort(F.collect_list(row)).alias("largest"))


def _head_facts(a: Analysis) -> DataFrame:
    return (
        a.projects.join(a.stats, "repo", "left")
        .join(_language_maps(a.languages), "repo", "left")
        .join(_largest_lists(a.largest), "repo", "left")
        .join(a.explanations, "repo", "left")
    )


def _open_object(fields: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.regexp_replace(F.to_json(fields, {"ignoreNullFields": "false"}), r"\}$", "")


def _items(rows: DataFrame, section: int, order: Column, value: Column) -> DataFrame:
    """Rows of one JSON array: ``order`` is an array of strings that sorts as text."""
    return rows.select(
        "repo", F.lit(section).alias("section"), order.alias("item"), value.alias("line")
    )


def _numbered(column: str) -> Column:
    return F.array(F.lpad(F.col(column).cast("string"), 10, "0"))


def _json(fields: Column) -> Column:
    return F.to_json(fields, {"ignoreNullFields": "false"})


def _text_item(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def _assemble(facts: DataFrame, fixed: list[Column], arrays: list[DataFrame]) -> DataFrame:
    """Fixed lines (sections 0, 2, 4, …) around arrays (sections 1, 3, …), with commas."""
    no_item = F.array().cast("array<string>")
    lines = [
        F.struct(F.lit(2 * i).alias("section"), no_item.alias("item"), text.alias("line"))
        for i, text in enumerate(fixed)
    ]
    frame = unnest(facts, ["repo"], F.array(*lines), "l").select("repo", "l.*")
    items = arrays[0]
    for more in arrays[1:]:
        items = items.unionByName(more)
    # The first item of an array gets no comma.  It is found by an aggregate that starts map-side
    # and joined back on a salted key, since one repository may hold most items.
    first = (
        items.groupBy("repo", "section")
        .agg(F.min("item").alias("first_item"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["repo", "section", "_salt"])
    comma = F.when(F.col("item") == F.col("first_item"), "").otherwise(",")
    return frame.unionByName(
        joined.select("repo", "section", "item", F.concat(comma, "line").alias("line"))
    )


def _stats_fields(*extra: Column) -> Column:
    return F.struct(
        F.col("total_files").alias("totalFiles"),
        F.col("total_lines").alias("totalLines"),
        F.col("code_lines").alias("codeLines"),
        F.col("blank_lines").alias("blankLines"),
        F.col("comment_lines").alias("commentLines"),
        _map_of("langs", "code_lines").alias("languageBreakdown"),
        _map_of("langs", "share").alias("languagePercentages"),
        *extra,
    )


def _file_order() -> Column:
    return paths.path_order(F.col("path"))


def _edge_items(a: Analysis, section: int) -> DataFrame:
    order = F.array("source", F.lpad(F.col("pos").cast("string"), 10, "0"))
    return _items(a.edges, section, order, _json(F.struct("source", "target", "names")))


def _package_items(a: Analysis, section: int) -> DataFrame:
    return _items(a.dependencies, section, F.array("package"), _text_item(F.col("package")))


def _cycle_items(a: Analysis, section: int) -> DataFrame:
    return _items(a.cycles, section, _numbered("rank"), F.to_json("cycle"))


def _entry_items(a: Analysis, section: int) -> DataFrame:
    order = F.concat(
        F.array(F.col("origin").cast("string"), F.lpad(F.col("ordinal").cast("string"), 10, "0")),
        _file_order(),
    )
    return _items(a.entry_points, section, order, _text_item(F.col("path")))


def export_json(a: Analysis) -> DataFrame:
    """Lines of one JSON document per repository."""
    features = F.struct(
        F.col("has_tests").alias("tests"),
        F.col("has_ci").alias("ci"),
        F.col("has_docker").alias("docker"),
        F.col("has_docs").alias("docs"),
    )
    project = F.struct(
        F.col("repo").alias("root"),
        F.col("primary_language").alias("primaryLanguage"),
        _map_of("code_langs", "files").alias("languages"),
        "frameworks",
        "architecture",
        F.col("package_manager").alias("packageManager"),
        features.alias("features"),
    )
    largest = F.transform(
        "largest",
        lambda r: F.struct(r["path"].alias("path"), r["size_bytes"].alias("sizeBytes")),
    )
    stats = _stats_fields(
        F.col("avg_file_size").alias("avgFileSize"), largest.alias("largestFiles")
    )
    head = F.struct(
        F.lit(FORMAT_VERSION).alias("version"), project.alias("project"), stats.alias("stats")
    )
    facts = _head_facts(a).withColumn(
        "code_langs", F.filter("langs", lambda r: ~r["language"].isin(*dims.NON_CODE_LANGUAGES))
    )
    fixed = [
        F.concat(_open_object(head), F.lit(',"files":[')),
        F.lit('],"dependencies":{"internal":['),
        F.lit('],"external":['),
        F.lit('],"circular":['),
        F.lit(']},"hotspots":['),
        F.lit('],"entryPoints":['),
        F.concat(F.lit('],"explanation":'), _text_item(F.col("explanation")), F.lit("}")),
    ]
    lines = F.struct(
        F.col("line_count").alias("total"),
        F.col("code_lines").alias("code"),
        F.col("blank_lines").alias("blank"),
        F.col("comment_lines").alias("comment"),
    )
    file_item = F.struct(
        "path", "language", F.col("size_bytes").alias("sizeBytes"), lines.alias("lines")
    )
    hotspot_item = F.struct(
        "path",
        "score",
        F.round("change_frequency", 1).alias("changeFrequency"),
        F.round("complexity", 1).alias("complexity"),
        F.round("size_factor", 1).alias("sizeFactor"),
        F.col("is_danger_zone").alias("isDangerZone"),
    )
    arrays = [
        _items(a.files, 1, _file_order(), _json(file_item)),
        _edge_items(a, 3),
        _package_items(a, 5),
        _cycle_items(a, 7),
        _items(a.hotspots, 9, _numbered("rank"), _json(hotspot_item)),
        _entry_items(a, 11),
    ]
    return _assemble(facts, fixed, arrays)


def export_report_payload(a: Analysis) -> DataFrame:
    """Lines of the data behind an interactive report, one document per repository.

    Adds files per language, the history of every file, and the graph: its nodes are all sources
    and targets of edges with their entry and danger flags.
    """
    project = F.struct(
        F.col("repo").alias("name"),
        F.col("primary_language").alias("language"),
        "frameworks",
        "architecture",
        F.col("package_manager").alias("packageManager"),
        F.col("has_tests").alias("hasTests"),
        F.col("has_ci").alias("hasCi"),
        F.col("has_docker").alias("hasDocker"),
    )
    largest = F.transform(
        "largest", lambda r: F.struct(r["path"].alias("path"), r["size_bytes"].alias("size"))
    )
    stats = _stats_fields(
        _map_of("langs", "files").alias("fileCountByLanguage"), largest.alias("largestFiles")
    )
    fixed = [
        F.concat(
            _open_object(F.struct(project.alias("project"), stats.alias("stats"))),
            F.lit(',"files":['),
        ),
        F.lit('],"dependencies":['),
        F.lit('],"externalDeps":['),
        F.lit('],"circularDeps":['),
        F.lit('],"hotspots":['),
        F.lit('],"entryPoints":['),
        F.lit('],"gitHistory":['),
        F.lit('],"graphNodes":['),
        F.concat(F.lit('],"explanation":'), _text_item(F.col("explanation")), F.lit("}")),
    ]
    file_item = F.struct(
        "path",
        "language",
        F.col("code_lines").alias("lines"),
        F.col("size_bytes").alias("size"),
    )
    hotspot_item = F.struct(
        "path",
        "score",
        F.round("change_frequency", 1).alias("churn"),
        F.round("complexity", 1).alias("complexity"),
        F.col("is_danger_zone").alias("danger"),
    )
    history_item = F.struct(
        "path",
        F.col("commit_count").alias("commits"),
        "contributors",
        F.col("last_modified").cast("string").alias("lastModified"),
    )
    nodes = (
        a.edges.select("repo", F.explode(F.array("source", "target")).alias("path"))
        .distinct()
        .join(
            a.entry_points.select("repo", "path").distinct().withColumn("entry", F.lit(True)),
            ["repo", "path"],
            "left",
        )
        .join(
            a.scores.where("is_danger_zone")
            .select("repo", "path")
            .withColumn("danger", F.lit(True)),
            ["repo", "path"],
            "left",
        )
        .fillna(False, ["entry", "danger"])
    )
    arrays = [
        _items(a.files, 1, _file_order(), _json(file_item)),
        _edge_items(a, 3),
        _package_items(a, 5),
        _cycle_items(a, 7),
        _items(a.hotspots, 9, _numbered("rank"), _json(hotspot_item)),
        _entry_items(a, 11),
        _items(a.history, 13, F.array("path"), _json(history_item)),
        _items(
            nodes, 15, F.array("path"), _json(F.struct(F.col("path").alias("id"), "entry", "danger"))
        ),
    ]
    return _assemble(_head_facts(a), fixed, arrays)


def write_report(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """Report lines as JSON rows, range-partitioned so that order survives and no task is hot."""
    (
        lines.withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int"))
        .repartitionByRange("bucket", "repo", "section", "item")
        .sortWithinPartitions("bucket", "repo", "section", "item")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .json(path)
    )


def read_report(spark: SparkSession, path: str, repos: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Report lines written by ``write_report``; with ``repos`` only their folders are read."""
    schema = "repo string, section int, item array<string>, line string, bucket int"
    lines = spark.read.schema(schema).json(path)
    if repos is not None:
        names = spark.createDataFrame([(repo,) for repo in repos], "repo string")
        numbers = names.select(F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")).collect()
        lines = lines.where(F.col("bucket").isin([n[0] for n in numbers]))
        lines = lines.where(F.col("repo").isin(repos))
    return lines.drop("bucket")


def report_documents(lines: DataFrame) -> DataFrame:
    """(repo, document): lines joined to whole documents, for repositories whose document fits a row."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "item", "line")))
    text = F.array_join(F.transform(ordered, lambda r: r["line"]), "")
    return lines.groupBy("repo").agg(text.alias("document"))


def _list_of(rows: DataFrame, alias: str, order: Column, text: Column) -> DataFrame:
    """Bounded top lists as one array of texts per repository."""
    gathered = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.groupBy("repo").agg(F.transform(gathered, lambda r: r["t"]).alias(alias))


def _mermaid_name(path: Column) -> Column:
    return F.translate(path, "/.", "__")


def _bullet_section(title: str, column: str, between: str = "\n") -> Column:
    return F.when(
        F.size(column) > 0,
        F.concat(
            F.lit(f"## {title}\n\n"), F.array_join(column, between), F.lit("\n")
        ),
    )


def export_markdown(a: Analysis) -> DataFrame:
    """(repo, markdown): every list is cut to its length before it is gathered."""
    top_edges = top_k(
        a.edges.select("repo", "source", "pos", "target"),
        30,
        paths.path_order(F.col("source")),
        "pos",
    )
    source, target = F.col("source"), F.col("target")
    edge_text = F.format_string(
        "    %s[%s] --> %s[%s]", _mermaid_name(source), source, _mermaid_name(target), target
    )
    pair = F.struct(_mermaid_name(source).alias("a"), _mermaid_name(target).alias("b"))
    edges = (
        top_edges.groupBy("repo", pair.alias("pair"))
        .agg(F.min(F.struct("rank", edge_text.alias("t"))).alias("m"))
        .select("repo", "m.rank", "m.t")
    )
    edge_list = _list_of(edges, "edge_lines", F.col("rank"), F.col("t"))
    entry_list = _list_of(
        top_k(a.entry_points, 10, *entry_order()),
        "entry_lines",
        F.col("rank"),
        F.concat(F.lit("- `"), "path", F.lit("`")),
    )
    package_list = _list_of(
        top_k(a.dependencies, 30, F.col("package")),
        "package_names",
        F.col("rank"),
        F.concat(F.lit("`"), "package", F.lit("`")),
    )
    hotspot_list = _list_of(
        a.hotspots.where("rank <= 10"),
        "hotspot_lines",
        F.col("rank"),
        F.format_string(
            "| `%s` | %.1f | %s |",
            "path",
            "score",
            F.when(F.col("is_danger_zone"), "DANGER").otherwise("OK"),
        ),
    )
    facts = _head_facts(a)
    for more in (edge_list, entry_list, package_list, hotspot_list):
        facts = facts.join(more, "repo", "left")
    shown = F.filter("langs", lambda r: r["share"] >= 1)
    language_lines = F.transform(
        shown,
        lambda r: F.concat(
            F.lit("- **"),
            r["language"],
            F.lit("** ("),
            F.format_string("%.1f", r["share"]),
            F.lit("%) "),
            F.repeat(F.lit("█"), F.floor(r["share"] / 2).cast("int")),
        ),
    )
    statistics = F.format_string(
        "## Statistics\n\n| Metric | Value |\n|--------|-------|\n| Files | %s |\n"
        "| Lines of Code | %s |\n| Languages | %d |\n| Architecture | %s |\n",
        F.format_number(F.coalesce("total_files", F.lit(0)), 0),
        F.format_number(F.coalesce("code_lines", F.lit(0)), 0),
        F.greatest(F.size("langs"), F.lit(0)),
        "architecture",
    )
    languages = F.concat(
        F.lit("## Languages\n\n"),
        F.coalesce(F.array_join(language_lines, "\n"), F.lit("")),
        F.when(F.size(shown) > 0, "\n").otherwise(""),
    )
    graph = F.when(
        F.size("edge_lines") > 0,
        F.concat(
            F.lit("## Dependency Graph\n\n```mermaid\ngraph LR\n"),
            F.array_join("edge_lines", "\n"),
            F.lit("\n```\n"),
        ),
    )
    hot = F.when(
        F.size("hotspot_lines") > 0,
        F.concat(
            F.lit("## Hotspots\n\n| File | Score | Status |\n|------|-------|--------|\n"),
            F.array_join("hotspot_lines", "\n"),
            F.lit("\n"),
        ),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "repo", F.lit("\n")),
        F.concat("explanation", F.lit("\n")),
        statistics,
        languages,
        _bullet_section("Entry Points", "entry_lines"),
        graph,
        _bullet_section("External Dependencies", "package_names", ", "),
        hot,
    )
    return facts.select("repo", text.alias("markdown"))
