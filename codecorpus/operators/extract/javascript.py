"""Structure of JavaScript and TypeScript files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions import paths
from codecorpus.functions.text import (
    GAP,
    LINE_NO,
    SPACE,
    STAMP,
    WORD,
    drop_stamps,
    find_all,
    first_per,
    strip,
    unstamp,
)
from codecorpus.operators.extract.common import class_row, function_row, import_row, no_strings

S, W, Q = f"[{SPACE}]", f"[{WORD}]", "[\"']"

# --- fixed values: patterns that define imports, exports, functions and classes -------------
IMPORT_OR_REQUIRE = (
    rf"import{S}+(?:(?:({W}+)(?:{S}*,{S}*)?)?(?:\{{([^}}]*)\}})?{S}+from{S}+)?"
    rf"{Q}([^\"']+){Q}|require{S}*\({S}*{Q}([^\"']+){Q}{S}*\)"
)
EXPORT = (
    rf"export{S}+(?:default{S}+)?(?:(?:function|class|const|let|var|interface|type|enum)"
    rf"{S}+({W}+)|\{{([^}}]*)\}})"
)
FUNCTION = (
    rf"(?=export|async|function){LINE_NO}(?:export{GAP}+)?(async{GAP}+)?"
    rf"function{GAP}+({W}+){GAP}*\(([^)]*)\)"
)
ARROW = (
    rf"(?=export|const|let|var){LINE_NO}(?:export{GAP}+)?(?:const|let|var){GAP}+"
    rf"({W}+){GAP}*={GAP}*(async{GAP}+)?\([^)]*\){GAP}*=>"
)
CLASS = (
    rf"(?=export|default|class){LINE_NO}(?:export{GAP}+)?(?:default{GAP}+)?class{GAP}+({W}+)"
    rf"(?:{GAP}+extends{GAP}+({W}+))?"
)
NEXT_PAGE = (
    rf"(?:from|require){S}*\(?{Q}next[/'\"]|getServerSideProps|getStaticProps|getStaticPaths"
)


def _listed(text: Column) -> Column:
    """Names of ``a, b as c`` lists: ``a``, ``b``."""
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return F.transform(parts, lambda p: strip(F.split_part(p, F.lit(" as "), F.lit(1))))


def imports(content: Column) -> Column:
    found = find_all(content, IMPORT_OR_REQUIRE, default=1, named=2, es=3, required=4)
    modules = F.transform(
        found,
        lambda m: F.struct(
            F.when(m["es"] != "", m["es"]).otherwise(m["required"]).alias("module"),
            F.concat(
                F.when(m["default"] != "", F.array(m["default"])).otherwise(no_strings()),
                _listed(m["named"]),
            ).alias("names"),
        ),
    )

    def row(m: Column) -> Column:
        relative = m["module"].startswith(".")
        external = ~relative & ~m["module"].startswith("@/")
        return import_row(m["module"], m["names"], relative, external)

    return F.transform(first_per(modules, "module"), row)


def functions(text: Column) -> Column:
    def row(m: Column, parameters: Column) -> Column:
        return function_row(
            unstamp(m["line"]),
            m["name"],
            is_async=m["marked"] != "",
            parameters=parameters,
        )

    def typed_names(listed: Column) -> Column:
        parts = F.filter(F.transform(F.split(drop_stamps(listed), ","), strip), lambda p: p != "")
        return F.transform(parts, lambda p: strip(F.split_part(p, F.lit(":"), F.lit(1))))

    declared = F.transform(
        find_all(text, FUNCTION, line=1, marked=2, name=3, listed=4),
        lambda m: row(m, typed_names(m["listed"])),
    )
    arrows = F.transform(
        find_all(text, ARROW, line=1, name=2, marked=3), lambda m: row(m, no_strings())
    )
    return first_per(F.concat(declared, arrows), "name")


def classes(text: Column) -> Column:
    return F.transform(
        find_all(text, CLASS, line=1, name=2, base=3),
        lambda m: class_row(
            unstamp(m["line"]),
            m["name"],
            F.when(m["base"] != "", F.array(m["base"])).otherwise(no_strings()),
            no_strings(),
        ),
    )


def exports(content: Column) -> Column:
    return F.flatten(
        F.transform(
            find_all(content, EXPORT, name=1, listed=2),
            lambda m: F.when(m["name"] != "", F.array(m["name"])).otherwise(_listed(m["listed"])),
        )
    )


def is_entry(content: Column, name: Column, text: Column) -> Column:
    stem = F.lower(paths.stem(name))
    return (
        stem.isin("index", "main", "app", "server", "entry")
        | content.contains("createServer")
        | content.contains("app.listen")
        | (stem.isin("page", "layout", "route") & content.rlike(NEXT_PAGE))
    )
