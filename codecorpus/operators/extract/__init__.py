"""Symbol tables of a corpus: one scan, no shuffle, one row per file, then flat views of it.

Every language contributes column expressions; which of them apply is decided per row, so a
corpus of many languages is read once.  New languages are added by an entry in ``EXTRACTORS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import computed, unnest
from codecorpus.functions.text import stamp_line_ends
from codecorpus.operators.extract import generic, go, javascript, python, rust
from codecorpus.operators.extract.common import CLASS, FUNCTION, IMPORT, STRINGS, Extractor

JAVASCRIPT = Extractor(
    prepare=stamp_line_ends,
    functions=javascript.functions,
    imports=javascript.imports,
    classes=javascript.classes,
    exports=javascript.exports,
    is_entry=javascript.is_entry,
)
EXTRACTORS: dict[str, Extractor] = {
    "Python": Extractor(
        prepare=python.logical_lines,
        functions=python.functions,
        imports=python.imports,
        imports_prepared=True,
        classes=python.classes,
        is_entry=python.is_entry,
    ),
    "JavaScript": JAVASCRIPT,
    "TypeScript": JAVASCRIPT,
    "Go": Extractor(
        prepare=stamp_line_ends,
        functions=go.functions,
        imports=go.imports,
        exports=go.exports,
        is_entry=go.is_entry,
    ),
    "Rust": Extractor(
        prepare=stamp_line_ends,
        functions=rust.functions,
        imports=rust.imports,
        exports=rust.exports,
        is_entry=rust.is_entry,
    ),
}
OTHER = Extractor(prepare=stamp_line_ends, functions=generic.functions, imports=generic.imports)


def _by_language(extractors: dict[str, Extractor], build) -> Column:
    """``build`` of the extractor that belongs to the language of the row."""
    groups: dict[Extractor, list[str]] = {}
    for language, extractor in extractors.items():
        groups.setdefault(extractor, []).append(language)
    chosen = None
    for extractor, languages in groups.items():
        test = F.col("language").isin(*languages)
        value = build(extractor)
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return build(OTHER) if chosen is None else chosen.otherwise(build(OTHER))


PARTS = ("imports", "functions", "classes", "exports", "entry_point")


def extract_modules(
    files: DataFrame,
    parts: tuple[str, ...] = PARTS,
    extractors: dict[str, Extractor] | None = None,
) -> DataFrame:
    """files → one row per readable file with the wanted parts of its structure."""
    extractors = EXTRACTORS if extractors is None else extractors
    content, name, text = F.col("content"), F.col("name"), F.col("prepared")
    readable = files.where(content.isNotNull()).select(
        "repo", "path", "name", "language", "content"
    )
    prepared = computed(readable, prepared=_by_language(extractors, lambda e: e.prepare(content)))
    build = {
        "imports": lambda e: e.imports(text if e.imports_prepared else content).cast(IMPORT),
        "functions": lambda e: e.functions(text).cast(FUNCTION),
        "classes": lambda e: e.classes(text).cast(CLASS),
        "exports": lambda e: e.exports(content).cast(STRINGS),
        "entry_point": lambda e: e.is_entry(content, name, text),
    }
    found = computed(prepared, **{p: _by_language(extractors, build[p]) for p in parts})
    return found.select("repo", "path", "language", *parts)


KEYS = ["repo", "path", "language"]


def imports(modules: DataFrame) -> DataFrame:
    """One row per import: repo, path, language, pos, module, names, is_relative, is_external."""
    return unnest(modules, KEYS, "imports", "i", "pos").select(*KEYS, "pos", "i.*")


def functions(modules: DataFrame) -> DataFrame:
    """One row per function or method."""
    return unnest(modules, KEYS, "functions", "f").select(*KEYS, "f.*")


def classes(modules: DataFrame) -> DataFrame:
    return unnest(modules, KEYS, "classes", "c").select(*KEYS, "c.*")


def exports(modules: DataFrame) -> DataFrame:
    return unnest(modules, KEYS, "exports", "export_name", "pos")
