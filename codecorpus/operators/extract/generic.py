"""Structure of files in any other language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.text import GAP, LINE_NO, SPACE, WORD, find_all, first_per, unstamp
from codecorpus.operators.extract.common import function_row, import_row, no_strings

S, W = f"[{SPACE}]", f"[{WORD}]"

# --- fixed values: patterns that define includes, imports and functions ---------------------
INCLUDE = rf"#include{S}*[<\"]([^>\"]+)[>\"]"
IMPORT = rf"(?:import|require|include|use|using){S}+['\"]?([^{SPACE};'\"]+)"
FUNC = (
    rf"(?=def|func|fn|sub|proc){LINE_NO}(?:def|func|function|fn|sub|proc){GAP}+({W}+){GAP}*\("
)
# What every match of FUNC holds, looked for once: most texts hold none.
NAMED = rf"(?:def|func|function|fn|sub|proc){GAP}+{W}+{GAP}*\("


def imports(content: Column) -> Column:
    def rows(pattern: str, external: bool) -> Column:
        return F.transform(
            F.regexp_extract_all(content, F.lit(pattern), F.lit(1)),
            lambda m: import_row(m, no_strings(), False, external),
        )

    return first_per(F.concat(rows(INCLUDE, True), rows(IMPORT, False)), "module")


def functions(text: Column) -> Column:
    found = find_all(text, FUNC, line=1, name=2)
    rows = F.transform(
        first_per(found, "name"), lambda m: function_row(unstamp(m["line"]), m["name"])
    )
    return F.when(text.rlike(NAMED), rows).otherwise(F.array())
