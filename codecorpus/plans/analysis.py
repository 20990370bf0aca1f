"""The whole analysis of a corpus, as lazily built tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame

from codecorpus.functions import dims
from codecorpus.operators import (
    detect,
    entrypoints,
    extract,
    graph,
    health,
    history,
    hotspots,
    lines,
    rank,
    report,
    rules,
    stats,
)
from codecorpus.operators.extract import manifest
from codecorpus.sources import corpus
from codecorpus.sources.history import load_commits, no_commits


class CorpusAnalysis:
    """Result tables of one corpus, each a DataFrame keyed by ``repo``.

    ``raw_files`` has repo, path, size_bytes and content; ``commit_files`` is a commit log and
    ``as_of`` the time that the history window ends.  Nothing runs before a table is used, except
    that ``cycles`` needs jobs of its own.  For a large corpus, write ``files`` and ``modules``
    once with ``store`` and pass the stored tables back in.
    """

    def __init__(
        self,
        raw_files: DataFrame,
        commit_files: DataFrame | None = None,
        as_of: Column | None = None,
        *,
        max_depth: int = dims.MAX_DEPTH,
        extra_ignores: list[str] | None = None,
        history_days: int | None = None,
        history_commits: int | None = None,
        max_bytes: int | None = dims.MAX_TEXT_BYTES,
        cycles_per_repo: int | None = graph.CYCLES_PER_REPO,
        files: DataFrame | None = None,
        modules: DataFrame | None = None,
    ):
        self.raw_files = raw_files
        self.commit_files = commit_files
        self.as_of = as_of
        self._depth, self._ignores = max_depth, extra_ignores
        self._days, self._commits = history_days, history_commits
        self._bytes, self._cycles = max_bytes, cycles_per_repo
        self._files, self._modules = files, modules

    def store(self, path: str) -> CorpusAnalysis:
        """The same analysis on stored ``files`` and ``modules``: contents are parsed once."""
        spark = self.raw_files.sparkSession
        self.files.write.parquet(f"{path}/files")
        files = spark.read.parquet(f"{path}/files")
        extract.extract_modules(corpus.even(files)).write.parquet(f"{path}/modules")
        return CorpusAnalysis(
            self.raw_files,
            self.commit_files,
            self.as_of,
            history_days=self._days,
            history_commits=self._commits,
            cycles_per_repo=self._cycles,
            files=files,
            modules=spark.read.parquet(f"{path}/modules"),
        )

    @cached_property
    def files(self) -> DataFrame:
        if self._files is not None:
            return self._files
        return corpus.build_files(
            self.raw_files,
            max_depth=self._depth,
            extra_ignores=self._ignores,
            max_bytes=self._bytes,
        )

    def modules(self, *parts: str) -> DataFrame:
        """Structure of the files; only the wanted parts are extracted when none is stored."""
        if self._modules is not None:
            return self._modules.select("repo", "path", "language", *parts)
        return extract.extract_modules(self.files, parts)

    @cached_property
    def imports(self) -> DataFrame:
        return extract.imports(self.modules("imports"))

    @cached_property
    def functions(self) -> DataFrame:
        return extract.functions(self.modules("functions"))

    @cached_property
    def classes(self) -> DataFrame:
        return extract.classes(self.modules("classes"))

    @cached_property
    def exports(self) -> DataFrame:
        return extract.exports(self.modules("exports"))

    @cached_property
    def manifest_deps(self) -> DataFrame:
        return manifest.manifest_deps(self.raw_files)

    @cached_property
    def scripts(self) -> DataFrame:
        return manifest.script_targets(self.raw_files)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolve_imports(self.imports, self.files)

    @cached_property
    def dependencies(self) -> DataFrame:
        return graph.union_dependencies(self.imports, self.manifest_deps)

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.circular_deps(self.edges, k=self._cycles)

    @cached_property
    def history(self) -> DataFrame:
        return history.file_history(self.commits)

    @cached_property
    def commits(self) -> DataFrame:
        """Touched files of the commits in the window; none if there is no log."""
        if self.commit_files is None:
            return no_commits(self.raw_files.sparkSession)
        return load_commits(self.commit_files, self.as_of, self._days, self._commits)

    @cached_property
    def complexity(self) -> DataFrame:
        return hotspots.file_complexity(self.modules("functions"))

    @cached_property
    def hotspot_scores(self) -> DataFrame:
        return hotspots.hotspot_scores(self.files, self.history, self.complexity)

    @cached_property
    def hotspots(self) -> DataFrame:
        return hotspots.hotspots(self.hotspot_scores)

    @cached_property
    def entry_points(self) -> DataFrame:
        return entrypoints.entry_points(
            self.modules("functions", "entry_point"), self.scripts
        )

    @cached_property
    def projects(self) -> DataFrame:
        return detect.detect_projects(self.raw_files, self.files)

    @cached_property
    def stats(self) -> DataFrame:
        return stats.project_stats(self.files, self.raw_files)

    @cached_property
    def languages(self) -> DataFrame:
        return stats.language_breakdown(self.files)

    @cached_property
    def largest(self) -> DataFrame:
        return rank.largest_files(self.files)

    @cached_property
    def markers(self) -> DataFrame:
        return lines.scan_markers(self.files)

    @cached_property
    def findings(self) -> DataFrame:
        return rules.match_rules(self.files)

    @cached_property
    def risk(self) -> DataFrame:
        return rules.risk_report(self.findings, self.raw_files)

    @cached_property
    def explanations(self) -> DataFrame:
        return detect.explain_projects(
            self.projects, self.stats, self.languages, self.entry_points, self.dependencies
        )

    @cached_property
    def health_categories(self) -> DataFrame:
        facts = health.health_facts(self.files, self.functions, self.projects, self.cycles)
        return health.health_categories(facts)

    @cached_property
    def health(self) -> DataFrame:
        return health.health_report(self.health_categories)

    @cached_property
    def report_input(self) -> report.Analysis:
        return report.Analysis(
            files=self.files.drop("content"),
            projects=self.projects,
            stats=self.stats,
            languages=self.languages,
            largest=self.largest,
            edges=self.edges,
            dependencies=self.dependencies,
            cycles=self.cycles,
            hotspots=self.hotspots,
            scores=self.hotspot_scores,
            entry_points=self.entry_points,
            explanations=self.explanations,
            history=self.history,
        )
