"""Registered queries: one per operator, each over the whole of the tables it reads.

Names start with the item they cover.  Results hold plain numbers and texts, so that they can be
compared with SQL: lists are joined to text and ratios are scaled to whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import paths
from codecorpus.functions.text import strip
from codecorpus.operators import (
    detect,
    entrypoints,
    graph,
    history,
    hotspots,
    lines,
    rank,
    report,
    rules,
    search,
    stats,
)
from codecorpus.plans.adapters import Tables
from codecorpus.session import stored
from codecorpus.sources import corpus
from codecorpus.sources.history import load_commits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(_tables(spark, folder))
    return build


@lru_cache(maxsize=4)
def _tables(spark: SparkSession, folder: str) -> Tables:
    """Lazy tables of one folder, shared by the queries of a session."""
    return Tables(spark, folder)


def listed(column: str) -> Column:
    return F.concat_ws("|", F.col(column)).alias(column)


def scaled(value: Column, by: int = 1000) -> Column:
    """A ratio as a whole number."""
    return F.floor(value * by + 0.5).cast("long")


# --- sources ------------------------------------------------------------------------------


@query
def src2_filter_depth(t: Tables) -> DataFrame:
    return corpus.filter_depth(t.raw(), 1).select("repo", "path")


@query
def src3_filter_default_ignores(t: Tables) -> DataFrame:
    return corpus.filter_default_ignores(t.raw()).select("repo", "path")


@query
def src4_filter_gitignore(t: Tables) -> DataFrame:
    return corpus.filter_gitignore(t.raw(), ["deep/", "doc_1?.md"]).select("repo", "path")


@query
def src5_filter_binary(t: Tables) -> DataFrame:
    """Files of which some, by size, get a binary signature or a zero byte in front."""
    head = F.expr(
        "case size_bytes % 10 when 0 then '7F454C46' when 1 then '4D5A' when 2 then '89504E47' "
        "when 3 then 'FFD8FF' when 4 then '1F8B' when 5 then '610062' else '' end"
    )
    raw = t.raw().select(
        "repo", "path", F.unhex(F.concat(head, F.hex(F.col("content")))).alias("content")
    )
    return corpus.filter_binary(raw).select("repo", "path")


@query
def src6_decode_text(t: Tables) -> DataFrame:
    """Length of every text after damaged bytes became replacement characters."""
    raw = t.raw().withColumn("content", F.concat("content", F.unhex(F.lit("FF"))))
    text = corpus.decode_text(F.col("content"), F.col("size_bytes"))
    return raw.select("repo", "path", F.length(text).alias("n_chars"))


@query
def src7_load_commits(t: Tables) -> DataFrame:
    return load_commits(t.commits(), t.as_of(), 400, 50).select("repo", "sha", "author", "path")


@query
def src8_incremental_scan(t: Tables) -> DataFrame:
    """Line counts by content hash, where the hashes of files of even size are known already."""
    known_texts = t.raw().where("size_bytes % 2 = 0").select(
        F.sha2("content", 256).alias("content_sha"), "content"
    )

    def analyse(texts: DataFrame) -> DataFrame:
        counted = corpus.count_lines(F.col("content").cast("string"))["total"]
        return texts.select("content_sha", counted.alias("line_count"))

    known = analyse(known_texts).distinct()
    return corpus.incremental_scan(t.raw().select("repo", "path", "content"), known, analyse)


# --- paths and lines ----------------------------------------------------------------------


@query
def prj1_detect_language(t: Tables) -> DataFrame:
    return t.raw().select(
        "repo", "path", paths.language_of(paths.file_name(F.col("path"))).alias("language")
    )


@query
def prj2_explode_lines(t: Tables) -> DataFrame:
    found = lines.explode_lines(t.corpus())
    return found.select("repo", "path", "line_no", F.md5(F.col("text")).alias("text_md5"))


@query
def prj3_classify_lines(t: Tables) -> DataFrame:
    found = lines.classify_lines(lines.explode_lines(t.corpus()))
    return found.groupBy("repo", "path", "is_blank", "is_comment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_sum")
    )


@query
def prj4_count_lines(t: Tables) -> DataFrame:
    return t.whole().files.select(
        "repo", "path", "line_count", "blank_lines", "comment_lines", "code_lines"
    )


@query
def prj5_top_level_dir(t: Tables) -> DataFrame:
    return t.raw().select("repo", "path", paths.top_level_dir(F.col("path")).alias("directory"))


@query
def prj6_file_extension(t: Tables) -> DataFrame:
    return t.raw().select("repo", "path", paths.extension_label(F.col("path")).alias("extension"))


@query
def prj7_is_test_file_health(t: Tables) -> DataFrame:
    return t.raw().select("repo", "path", paths.is_test_for_health(F.col("path")).alias("is_test"))


@query
def prj8_is_test_path_security(t: Tables) -> DataFrame:
    return t.raw().select(
        "repo", "path", paths.is_test_for_security(F.col("path")).alias("is_test")
    )


@query
def prj9_is_test_name_search(t: Tables) -> DataFrame:
    return t.raw().select("repo", "path", paths.is_test_for_search(F.col("path")).alias("is_test"))


@query
def prj10_classify_entry_point(t: Tables) -> DataFrame:
    return entrypoints.entry_point_types(t.whole_stored().entry_points)


@query
def prj11_directory_roles(t: Tables) -> DataFrame:
    return stats.directory_roles(t.whole_stored().files, t.whole_stored().entry_points)


# --- filters ------------------------------------------------------------------------------


@query
def flt1_markers_by_severity(t: Tables) -> DataFrame:
    return lines.markers_by_severity(t.whole().markers, "critical").select(
        "repo", "path", "line_no"
    )


@query
def flt2_findings_min_severity(t: Tables) -> DataFrame:
    return rules.findings_min_severity(t.whole().findings, "medium").select(
        "repo", "path", "line_no", "rule_id"
    )


@query
def flt3_search_filters(t: Tables) -> DataFrame:
    """Postings of the keywords that pass the filters of their query."""
    found = search.lookup_postings(t.index(), _terms(t).where(F.col("pass") == search.PRIMARY))
    kept = search.search_filters(search.single_postings(found))
    return kept.select("query_id", "repo", "path", "line_no", "token", "kind").distinct()


@query
def flt4_find_files(t: Tables) -> DataFrame:
    return search.find_files(t.raw(), "M1").select("repo", "path", "rank")


# --- structure ----------------------------------------------------------------------------


def _imports(t: Tables, *languages: str) -> DataFrame:
    rows = t.whole().imports.where(F.col("language").isin(*languages))
    return rows.select("repo", "path", "module", listed("names"), "is_relative", "is_external")


def _functions(t: Tables, *languages: str) -> DataFrame:
    return t.whole().functions.where(F.col("language").isin(*languages))


def _entry_flags(t: Tables, *languages: str) -> DataFrame:
    rows = t.whole().modules("entry_point").where(F.col("language").isin(*languages))
    return rows.select("repo", "path", "entry_point")


def _exports(t: Tables, *languages: str) -> DataFrame:
    rows = t.whole().exports.where(F.col("language").isin(*languages))
    return rows.select("repo", "path", "pos", "export_name")


JS = ("JavaScript", "TypeScript")
PARSED = ("Python", *JS, "Go", "Rust")


@query
def ext1_py_imports(t: Tables) -> DataFrame:
    return _imports(t, "Python")


@query
def ext2_py_functions(t: Tables) -> DataFrame:
    return _functions(t, "Python").where(~F.col("is_method")).select(
        "repo", "path", "name", "line_no", "is_async", listed("decorators"), listed("parameters")
    )


@query
def ext3_py_classes(t: Tables) -> DataFrame:
    rows = t.whole().classes.where(F.col("language") == "Python")
    return rows.select("repo", "path", "name", "line_no", listed("bases"), listed("decorators"))


@query
def ext4_py_methods(t: Tables) -> DataFrame:
    return _functions(t, "Python").where("is_method").select(
        "repo", "path", "owner_class", "name", "line_no", "is_async", listed("decorators"),
        listed("parameters"),
    )


@query
def ext5_py_complexity(t: Tables) -> DataFrame:
    return _functions(t, "Python").select("repo", "path", "owner_class", "name", "complexity")


@query
def ext6_py_entry_flag(t: Tables) -> DataFrame:
    return _entry_flags(t, "Python")


@query
def ext7_js_imports(t: Tables) -> DataFrame:
    return _imports(t, *JS)


@query
def ext8_js_functions(t: Tables) -> DataFrame:
    return _functions(t, *JS).select(
        "repo", "path", "name", "line_no", "is_async", listed("parameters")
    )


@query
def ext9_js_classes(t: Tables) -> DataFrame:
    rows = t.whole().classes.where(F.col("language").isin(*JS))
    return rows.select("repo", "path", "name", "line_no", listed("bases"))


@query
def ext10_js_exports(t: Tables) -> DataFrame:
    return _exports(t, *JS)


@query
def ext11_js_entry_flag(t: Tables) -> DataFrame:
    return _entry_flags(t, *JS)


@query
def ext12_go_imports(t: Tables) -> DataFrame:
    return _imports(t, "Go")


@query
def ext13_go_functions(t: Tables) -> DataFrame:
    return _functions(t, "Go").select(
        "repo", "path", "name", "line_no", "is_method", listed("parameters")
    )


@query
def ext14_go_exports(t: Tables) -> DataFrame:
    return _exports(t, "Go")


@query
def ext15_go_entry_flag(t: Tables) -> DataFrame:
    return _entry_flags(t, "Go")


@query
def ext16_rust_imports(t: Tables) -> DataFrame:
    return _imports(t, "Rust")


@query
def ext17_rust_functions(t: Tables) -> DataFrame:
    return _functions(t, "Rust").select(
        "repo", "path", "name", "line_no", "is_async", listed("parameters")
    )


@query
def ext18_rust_exports(t: Tables) -> DataFrame:
    return _exports(t, "Rust")


@query
def ext19_rust_entry_flag(t: Tables) -> DataFrame:
    return _entry_flags(t, "Rust")


@query
def ext20_generic_imports(t: Tables) -> DataFrame:
    rows = t.whole().imports.where(~F.col("language").isin(*PARSED))
    return rows.select("repo", "path", "module", "is_external")


@query
def ext21_generic_functions(t: Tables) -> DataFrame:
    rows = t.whole().functions.where(~F.col("language").isin(*PARSED))
    return rows.select("repo", "path", "name", "line_no")


@query
def ext22_manifest_deps(t: Tables) -> DataFrame:
    return t.whole().manifest_deps


@query
def ext23_script_targets(t: Tables) -> DataFrame:
    return t.whole().scripts


# --- joins --------------------------------------------------------------------------------


@query
def jn1_resolve_imports(t: Tables) -> DataFrame:
    return t.whole_stored().edges.select("repo", "source", "target", listed("names"))


@query
def jn2_hotspot_features(t: Tables) -> DataFrame:
    a = t.whole_stored()
    return hotspots.hotspot_features(a.files, a.history, a.complexity)


@query
def jn3_match_rules(t: Tables) -> DataFrame:
    return t.whole().findings.select(
        "repo", "path", "line_no", "rule_id", "severity", "category", "title", "description",
        F.md5("line_text").alias("line_md5"),
    )


@query
def jn3_match_rule_table(t: Tables) -> DataFrame:
    """The built-in rules as a table, and one rule per first word of the names of parts."""
    table = rules.rule_table(t.spark).unionByName(t.name_rules())
    return rules.match_rule_table(t.whole().files, table).select(
        "repo", "path", "line_no", "rule_id", "severity", "category", "title", "description",
        F.md5("line_text").alias("line_md5"),
    )


@query
def jn4_expand_synonyms(t: Tables) -> DataFrame:
    return search.expand_synonyms(
        search.prepare_searches(t.searches()), search.synonym_table(t.spark)
    )


def _terms(t: Tables) -> DataFrame:
    return search.query_terms(
        search.prepare_searches(t.searches()), search.synonym_table(t.spark)
    )


def _entries() -> Column:
    """The postings of a block as one text, in an order that needs no positions."""
    one = F.transform("entries", lambda e: F.concat(e["line_no"].cast("string"), F.lit(":"), e["kind"]))
    return F.md5(F.array_join(F.sort_array(one), "|"))


@query
def jn5_lookup_postings(t: Tables) -> DataFrame:
    return search.lookup_postings(t.index(), _terms(t)).select(
        "query_id", "pass", "term_no", "token", "repo", "path",
        F.size("entries").cast("long").alias("postings"), _entries().alias("entries_md5"),
    )


@query
def jn6_recent_file_boost(t: Tables) -> DataFrame:
    recent = history.recent_files(t.commits()).withColumn("is_recent", F.lit(True))
    files = t.whole_stored().files.select("repo", "path").join(recent, ["repo", "path"], "left")
    return files.fillna(False, ["is_recent"])


@query
def jn7_annotate_file_tree(t: Tables) -> DataFrame:
    a = t.whole_stored()
    return entrypoints.annotate_file_tree(a.files, a.entry_points, a.hotspot_scores)


@query
def jn8_root_markers(t: Tables) -> DataFrame:
    marked = detect.root_markers(t.raw())
    return marked.select(
        "repo",
        F.concat_ws("|", F.array_sort("files")).alias("files"),
        F.concat_ws("|", F.array_sort("dirs")).alias("dirs"),
        "many_services",
    )


@query
def jn9_diff_snapshots(t: Tables) -> DataFrame:
    """Two snapshots of all files, with some, by size, missing or changed in either."""
    hashed = corpus.content_hash(t.raw()).withColumn("k", F.octet_length("content"))
    changed = F.when(F.col("k") % 7 == 0, F.md5("content")).otherwise(F.col("content_sha"))
    before = hashed.where("k % 5 <> 0").select("repo", "path", "content_sha")
    after = hashed.where("k % 3 <> 0").select("repo", "path", changed.alias("content_sha"))
    summary = history.diff_summary(history.diff_snapshots(before, after))
    return summary.select("repo", "change", "n", listed("paths"))


# --- aggregates ---------------------------------------------------------------------------


@query
def agg1_project_stats(t: Tables) -> DataFrame:
    rows = stats.project_stats(t.whole().files, t.raw())
    return rows.select(
        "repo", "total_files", "total_lines", "code_lines", "blank_lines", "comment_lines",
        F.floor("avg_file_size").alias("avg_file_size"),
    )


@query
def agg2_language_breakdown(t: Tables) -> DataFrame:
    return t.whole().languages.select(
        "repo", "language", "code_lines", "files", scaled(F.col("share"), 10).alias("share_tenths")
    )


@query
def agg3_size_breakdown(t: Tables) -> DataFrame:
    rows = stats.size_breakdown(t.whole().files)
    return rows.select(
        "repo", "dim", "name", "size_bytes", "file_count", "code_lines",
        scaled(F.col("percentage"), 10).alias("tenths"),
    )


@query
def agg4_file_history(t: Tables) -> DataFrame:
    return t.whole_stored().history.select(
        "repo", "path", "commit_count", listed("contributors"),
        F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"),
        scaled(F.col("churn_score"), 10).alias("churn_tenths"),
    )


@query
def agg5_contributors(t: Tables) -> DataFrame:
    return history.contributors(t.commits(), 100)


@query
def agg6_file_complexity(t: Tables) -> DataFrame:
    return t.whole().complexity


@query
def agg7_complexity_summary(t: Tables) -> DataFrame:
    rows = hotspots.complexity_summary(t.whole().functions)
    return rows.select(
        "repo", "total_functions", "max_complexity",
        scaled(F.col("avg_complexity"), 100).alias("avg_hundredths"),
    )


@query
def agg8_marker_counts(t: Tables) -> DataFrame:
    return lines.marker_counts(t.whole().markers)


@query
def agg9_finding_counts(t: Tables) -> DataFrame:
    return rules.finding_counts(t.whole().findings)


@query
def agg10_risk_score(t: Tables) -> DataFrame:
    return t.whole().risk.select("repo", "findings", "risk_score")


@query
def agg11_risk_summary(t: Tables) -> DataFrame:
    return t.whole().risk.select("repo", "summary")


@query
def agg12_external_deps(t: Tables) -> DataFrame:
    return graph.package_usage(t.whole_stored().dependencies)


@query
def agg13_import_fan_in(t: Tables) -> DataFrame:
    return graph.import_fan_in(t.whole_stored().edges)


@query
def agg14_language_counts(t: Tables) -> DataFrame:
    counts = detect.language_counts(t.whole_stored().files)
    main = t.whole_stored().projects.select("repo", "primary_language")
    return main.join(counts.select("repo", "language", "files"), "repo", "left")


def _category(t: Tables, name: str) -> DataFrame:
    rows = t.whole_stored().health_categories.where(F.col("name") == name)
    return rows.select(
        "repo", scaled(F.col("score"), 100).alias("score_hundredths"), listed("details")
    )


@query
def agg15_health_code_quality(t: Tables) -> DataFrame:
    return _category(t, "Code Quality").drop("details")


@query
def agg16_health_organization(t: Tables) -> DataFrame:
    return _category(t, "Organization").drop("details")


@query
def agg17_health_testing(t: Tables) -> DataFrame:
    return _category(t, "Testing").drop("details")


@query
def agg18_health_documentation(t: Tables) -> DataFrame:
    return _category(t, "Documentation")


@query
def agg19_health_maintenance(t: Tables) -> DataFrame:
    return _category(t, "Maintenance")


@query
def agg20_health_report(t: Tables) -> DataFrame:
    return t.whole_stored().health.select(
        "repo", scaled(F.col("overall_score"), 10).alias("overall_tenths"), "grade"
    )


@query
def agg21_health_recommendations(t: Tables) -> DataFrame:
    return t.whole_stored().health.select("repo", listed("recommendations"))


@query
def agg22_group_results_by_file(t: Tables) -> DataFrame:
    rows = search.group_results_by_file(_results(t))
    hits = F.array_join(F.transform("hits", lambda h: h["line_no"].cast("string")), "|")
    return rows.select("query_id", "repo", "path", "best_rank", "matches", hits.alias("hits"))


# --- rankings -----------------------------------------------------------------------------


@query
def win1_largest_files(t: Tables) -> DataFrame:
    return t.whole().largest


@query
def win2_hotspots(t: Tables) -> DataFrame:
    rows = t.whole_stored().hotspots
    return rows.select(
        "repo", "path", "rank", scaled(F.col("score"), 10).alias("score_tenths"), "is_danger_zone"
    )


@query
def win3_complex_functions(t: Tables) -> DataFrame:
    return hotspots.complex_functions(t.whole().functions)


@query
def win4_marker_context(t: Tables) -> DataFrame:
    return t.whole().markers.select(
        "repo", "path", "line_no", F.md5("context").alias("context_md5")
    )


@query
def win5_result_context(t: Tables) -> DataFrame:
    hits = _results(t).select("query_id", "repo", "path", "line_no", "rank")
    return search.result_context(hits, t.index()).select(
        "query_id", "rank", "context_line_no", F.md5("text").alias("text_md5")
    )


@query
def win6_top_results(t: Tables) -> DataFrame:
    return _results(t, 20).select("query_id", "rank", "repo", "path", "line_no")


@query
def win7_top_k_per_repo(t: Tables) -> DataFrame:
    """Ten largest languages per repository with at least one percent of the code."""
    return rank.top_k(
        t.whole().languages, 10, F.col("code_lines").desc(), F.col("language"),
        where=F.col("share") >= 1,
    ).select("repo", "language", "code_lines", "rank")


# --- sets, graph, detection ---------------------------------------------------------------


@query
def set1_union_dependencies(t: Tables) -> DataFrame:
    return t.whole_stored().dependencies


@query
def set2_entry_points(t: Tables) -> DataFrame:
    return t.whole_stored().entry_points


@query
def grf1_import_components(t: Tables) -> DataFrame:
    return graph.import_components(t.whole().edges)


@query
def grf1_circular_deps(t: Tables) -> DataFrame:
    return t.whole_stored().cycles.select("repo", "rank", "nodes", listed("cycle"))


@query
def det1_frameworks(t: Tables) -> DataFrame:
    return t.whole_stored().projects.select("repo", listed("frameworks"))


@query
def det2_package_manager(t: Tables) -> DataFrame:
    return t.whole_stored().projects.select("repo", "package_manager")


@query
def det3_project_features(t: Tables) -> DataFrame:
    return t.whole_stored().projects.select("repo", "has_tests", "has_ci", "has_docker", "has_docs")


@query
def det4_architecture_scored(t: Tables) -> DataFrame:
    return t.whole_stored().projects.select("repo", "architecture")


@query
def det5_architecture_first_match(t: Tables) -> DataFrame:
    return t.whole_stored().projects.select("repo", "first_match_architecture")


@query
def det6_explain_project(t: Tables) -> DataFrame:
    return t.whole_stored().explanations


# --- markers and search -------------------------------------------------------------------


@query
def mrk1_scan_markers(t: Tables) -> DataFrame:
    return t.whole().markers.select(
        "repo", "path", "line_no", "marker_type", "severity", strip(F.col("text")).alias("text")
    )


@query
def sch1_prepare_searches(t: Tables) -> DataFrame:
    return search.prepare_searches(t.searches()).select(
        "query_id", listed("keywords"), listed("exact_phrases"), "language_filter", "type_filter",
        "filename_filter",
    )


@query
def sch2_tokenize(t: Tables) -> DataFrame:
    words = search.tokenize(lines.explode_lines(t.whole().files))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("lines"))


@query
def sch3_line_kind(t: Tables) -> DataFrame:
    rows = search.indexed_lines(t.whole().files)
    return rows.select("repo", "path", "line_no", "kind", "function_name", "class_name")


@query
def sch4_build_index(t: Tables) -> DataFrame:
    return search.posting_blocks(search.build_index(t.stored_files())).select(
        "token", "repo", "path", F.size("entries").cast("long").alias("postings"),
        _entries().alias("entries_md5"),
    )


def _results(t: Tables, k: int = 30) -> DataFrame:
    # Stored first: the index and the shuffles of the log need not be on disk at once.
    recent = stored(history.recent_files(t.commits()))
    return search.rank_search(t.index(), t.searches(), search.synonym_table(t.spark), recent, k)


@query
def sch5_score_postings(t: Tables) -> DataFrame:
    """Scores before phrases, per query, pass, kind and file over all postings that pass."""
    scored = search.found_postings(t.index(), _terms(t))
    return scored.groupBy("query_id", "pass", "kind", "repo", "path").agg(
        F.count(F.lit(1)).alias("postings"), F.sum("score_milli").alias("score_milli")
    )


@query
def sch6_rank_search(t: Tables) -> DataFrame:
    return _results(t).select(
        "query_id", "rank", "repo", "path", "line_no", "kind",
        F.col("score_milli").cast("long").alias("score_milli"), F.md5("context").alias("context_md5"),
    )


# --- sinks --------------------------------------------------------------------------------


@query
def snk1_export_json(t: Tables) -> DataFrame:
    return _report_rows(report.export_json(t.whole_stored().report_input))


@query
def snk2_export_markdown(t: Tables) -> DataFrame:
    return report.export_markdown(t.whole_stored().report_input)


@query
def snk3_export_report_payload(t: Tables) -> DataFrame:
    return _report_rows(report.export_report_payload(t.whole_stored().report_input))


def _report_rows(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "section", F.concat_ws("/", "item").alias("item"), "line")


@query
def snk4_ci_gate(t: Tables) -> DataFrame:
    return t.whole().risk.select("repo", "gate_failed")
