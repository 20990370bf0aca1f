"""Structure of Go files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.text import (
    GAP,
    LINE_NO,
    SPACE,
    WORD,
    drop_stamps,
    find_all,
    strip,
    unstamp,
)
from codecorpus.operators.extract.common import function_row, import_row

S, W = f"[{SPACE}]", f"[{WORD}]"
LINE_START = r"(?<![^\n])"

# --- fixed values: patterns that define imports, functions and types ------------------------
SINGLE = rf"{LINE_START}import{S}+\"([^\"]+)\""
BLOCK = rf"(?s)import{S}*\((.*?)\)"
FUNC = (
    rf"{LINE_START}(?=func){LINE_NO}func{GAP}+(?:\({W}+{GAP}+\*?({W}+)\){GAP}+)?"
    rf"({W}+){GAP}*\(([^)]*)\)"
)
PLAIN_FUNC = rf"{LINE_START}func{S}+(?:\({W}+{S}+\*?{W}+\){S}+)?({W}+){S}*\([^)]*\)"
STRUCT = rf"{LINE_START}type{S}+({W}+){S}+struct{S}*\{{"
INTERFACE = rf"{LINE_START}type{S}+({W}+){S}+interface{S}*\{{"
MAIN_FUNC = rf"{LINE_START}func{S}+main{S}*\({S}*\)"
PACKAGE = rf"{LINE_START}package{S}+{W}+"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports(content: Column) -> Column:
    blocks = F.flatten(F.transform(_all(content, BLOCK), lambda b: _all(b, r'"([^"]+)"')))
    packages = F.array_distinct(F.concat(_all(content, SINGLE), blocks))
    return F.transform(
        packages,
        lambda p: import_row(
            p,
            F.array(F.element_at(F.split(p, "/"), -1)),
            False,
            F.split_part(p, F.lit("/"), F.lit(1)).contains("."),
        ),
    )


def functions(text: Column) -> Column:
    def first_words(listed: Column) -> Column:
        parts = F.filter(F.transform(F.split(drop_stamps(listed), ","), strip), lambda p: p != "")
        return F.transform(parts, lambda p: F.regexp_extract(p, rf"^([^{SPACE}]+)", 1))

    return F.transform(
        find_all(text, FUNC, line=1, receiver=2, name=3, listed=4),
        lambda m: function_row(
            unstamp(m["line"]),
            m["name"],
            is_method=m["receiver"] != "",
            parameters=first_words(m["listed"]),
        ),
    )


def exports(content: Column) -> Column:
    names = F.concat(*[_all(content, p) for p in (PLAIN_FUNC, STRUCT, INTERFACE)])
    return F.filter(names, lambda n: n.rlike(r"^\p{Lu}"))


def is_entry(content: Column, name: Column, text: Column) -> Column:
    return content.contains("package main") & content.rlike(PACKAGE) & content.rlike(MAIN_FUNC)
