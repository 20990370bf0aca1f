"""Structure of Rust files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.text import (
    GAP,
    LINE_NO,
    SPACE,
    STAMP,
    WORD,
    drop_stamps,
    find_all,
    strip,
    unstamp,
)
from codecorpus.operators.extract.common import function_row, import_row

S, W = f"[{SPACE}]", f"[{WORD}]"
LINE_START = r"(?<![^\n])"

# --- fixed values: patterns that define imports, functions and public items -----------------
USE = rf"{LINE_START}use{S}+([^;]+);"
FN = (
    rf"(?=pub|async|fn){LINE_NO}(?:pub{GAP}+)?(async{GAP}+)?fn{GAP}+({W}+){GAP}*"
    rf"(?:<[^>]*>)?{GAP}*\(([^)]*)\)"
)
PUBLIC_FN = rf"pub{S}+(?:async{S}+)?fn{S}+({W}+){S}*(?:<[^>]*>)?{S}*\([^)]*\)"
PUBLIC_STRUCT = rf"pub{S}+struct{S}+({W}+)"
PUBLIC_TRAIT = rf"pub{S}+trait{S}+({W}+)"
SELF_FORMS = ["", "self", "&self", "&mut self"]


def imports(content: Column) -> Column:
    found = F.transform(F.regexp_extract_all(content, F.lit(USE), F.lit(1)), strip)

    def row(use: Column) -> Column:
        parts = F.split(F.replace(use, F.lit("::"), F.lit("/")), "/")
        last = F.regexp_replace(F.element_at(parts, -1), r"^[{} ]+|[{} ]+$", "")
        first = parts[0]
        return import_row(
            F.replace(use, F.lit("/"), F.lit("::")),
            F.array(strip(F.split_part(last, F.lit(","), F.lit(1)))),
            first.isin("self", "super"),
            ~first.isin("crate", "self", "super"),
        )

    return F.transform(found, row)


def functions(text: Column) -> Column:
    def names(listed: Column) -> Column:
        parts = F.transform(F.split(drop_stamps(listed), ","), strip)
        return F.transform(
            F.filter(parts, lambda p: ~p.isin(*SELF_FORMS)),
            lambda p: strip(F.split_part(p, F.lit(":"), F.lit(1))),
        )

    return F.transform(
        find_all(text, FN, line=1, marked=2, name=3, listed=4),
        lambda m: function_row(
            unstamp(m["line"]),
            m["name"],
            is_async=m["marked"] != "",
            parameters=names(m["listed"]),
        ),
    )


def exports(content: Column) -> Column:
    """Public functions, structs and traits, in that order."""
    return F.concat(
        *[
            F.regexp_extract_all(content, F.lit(p), F.lit(1))
            for p in (PUBLIC_FN, PUBLIC_STRUCT, PUBLIC_TRAIT)
        ]
    )


def is_entry(content: Column, name: Column, text: Column) -> Column:
    return ((name == "main.rs") & content.rlike(rf"fn{S}+main{S}*\({S}*\)")) | (name == "lib.rs")
