"""Structure of Python files, read lexically in one row-local pass.

The text is first reduced to logical lines: strings and comments are emptied, line breaks inside
brackets and after a backslash are removed, blank lines are dropped, and every remaining line
starts with its own number in private-use digits.  A top-level statement is then a run of
decorators, one unindented line and the indented lines below it, which one pattern finds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus.functions.text import (
    BRACKETED,
    DEEPEST,
    STAMP,
    WORD,
    WORD_END,
    WORD_START,
    drop_stamps,
    join_bracketed,
    let,
    stamp,
    unstamp,
)
from codecorpus.operators.extract.common import class_row, function_row, import_row

TOKEN = "|".join(
    [
        r"(?s)#[^\n]*+",
        r'"""(?:[^"\\]++|\\.|"(?!""))*+"""',
        r"'''(?:[^'\\]++|\\.|'(?!''))*+'''",
        r'"(?:[^"\\\n]++|\\.)*+"',
        r"'(?:[^'\\\n]++|\\.)*+'",
        r"[^#\"']++",
        r"[\"']",
    ]
)
LINE = rf"\n[{STAMP}]++"
INDENT = r"[ \t\f]"
STATEMENT = (
    rf"(?:{LINE}@[^\n]*+)*+{LINE}(?!{INDENT}|@|\n)[^\n]*+(?:{LINE}{INDENT}[^\n]*+)*+"
)
HEADER = rf"^(?:{LINE}@[^\n]*+)*+\n([{STAMP}]++)"
DEF = rf"{HEADER}(async[ \t]+)?def[ \t]+([{WORD}]+)"
CLASS_LINE = rf"{HEADER}class[ \t]+([{WORD}]+)"
BRANCH = (
    rf"(?:{LINE}|[:;]){INDENT}*+(?:if|elif|while|except|assert){WORD_END}"
    rf"|{WORD_START}(?:for|and|or){WORD_END}"
)
ASYNC_FOR = rf"{LINE}{INDENT}*+async[ \t]+for{WORD_END}"


def logical_lines(content: Column) -> Column:
    source = F.regexp_replace(drop_stamps(content), r"\r\n?", "\n")
    tokens = F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0))
    emptied = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t.startswith("#"), "")
            .when(
                t.startswith('"') | t.startswith("'"),
                F.concat(F.lit('""'), F.regexp_replace(t, r"[^\n]+", "")),
            )
            .otherwise(t),
        ),
        "",
    )
    numbered = F.concat(
        F.lit("\n"),
        F.array_join(
            F.transform(F.split(emptied, "\n", -1), lambda x, i: F.concat(stamp(i + 1), x)), "\n"
        ),
    )
    continued = F.regexp_replace(numbered, rf"\\\n[{STAMP}]++", " ")
    joined = let(continued, _joined_lines)
    return F.regexp_replace(joined, rf"{LINE}{INDENT}*+(?=\n|\z)", "")


def _joined_lines(numbered: Column) -> Column:
    """Lines inside brackets joined.

    The pattern of pairs sees ``DEEPEST`` levels, which no text with fewer brackets can exceed; other
    texts are joined by a running balance.  Where brackets do not pair up, as in a file with a syntax error,
    the pattern takes those pairs that it finds.
    """
    line = rf"\n[{STAMP}]++"
    pieces = F.regexp_extract_all(numbered, F.lit(rf"(?s){BRACKETED}|[^(\[{{]++|."), F.lit(0))
    by_pattern = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(r"^[(\[{]"), F.regexp_replace(p, line, " ")).otherwise(p),
        ),
        "",
    )
    many = F.regexp_count(numbered, F.lit(r"[(\[{]")) > DEEPEST
    return F.coalesce(F.when(many, join_bracketed(numbered, line)), by_pattern)


def _statements(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0))


def _trimmed_parts(text: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones."""
    return F.filter(
        F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""
    )


def _inside(brackets: Column) -> Column:
    """Text between the outer brackets, with inner bracket groups emptied."""
    inner = F.regexp_replace(brackets, r"(?s)^.|.$", "")
    return F.regexp_replace(inner, BRACKETED, "()")


def _decorators(statement: Column) -> Column:
    written = F.regexp_extract_all(statement, F.lit(rf"{LINE}@([^\n]*)"), F.lit(1))
    simple = rf"^[ \t]*([{WORD}.]+)[ \t]*(?:{BRACKETED})?[ \t]*$"
    return F.transform(
        written,
        lambda d: F.when(d.rlike(simple), F.regexp_extract(d, simple, 1)).otherwise("unknown"),
    )


def _parameters(statement: Column) -> Column:
    brackets = F.regexp_extract(
        statement,
        rf"{DEF}[ \t]*(?:\[[^\]]*\][ \t]*)?+({BRACKETED})",
        4,
    )
    inner = _inside(brackets)
    without_keyword_only = F.regexp_replace(inner, r"(?s)(?:^|,)[ \t]*\*.*$", "")
    positional = F.regexp_replace(
        without_keyword_only, r"(?s)^(?:.*,)?[ \t]*/[ \t]*(?:,|$)", ""
    )
    names = F.transform(
        _trimmed_parts(positional), lambda p: F.trim(F.regexp_replace(p, r"(?s)[:=].*$", ""))
    )
    return F.filter(names, lambda n: n != "self")


def _complexity(statement: Column) -> Column:
    return (
        F.lit(1)
        + F.regexp_count(statement, F.lit(BRANCH))
        - F.regexp_count(statement, F.lit(ASYNC_FOR))
    )


def _defs(statements: Column, owner: Column | None = None) -> Column:
    def row(s: Column) -> Column:
        return function_row(
            unstamp(F.regexp_extract(s, DEF, 1)),
            F.regexp_extract(s, DEF, 3),
            owner=owner,
            is_method=F.lit(owner is not None),
            is_async=F.regexp_extract(s, DEF, 2) != "",
            decorators=_decorators(s),
            parameters=_parameters(s),
            complexity=_complexity(s),
        )

    return F.transform(F.filter(statements, lambda s: s.rlike(DEF)), row)


def _methods(statement: Column) -> Column:
    body = F.regexp_replace(statement, rf"^(?:{LINE}@[^\n]*+)*+{LINE}[^\n]*", "")
    indent = F.regexp_extract(body, rf"^{LINE}({INDENT}*)", 1)
    dedented = F.regexp_replace(
        body, F.concat(F.lit(rf"(\n[{STAMP}]++)"), indent), F.lit("$1")
    )
    return _defs(_statements(dedented), owner=F.regexp_extract(statement, CLASS_LINE, 2))


def functions(text: Column) -> Column:
    """Top-level functions, then the methods written directly in top-level classes."""
    return let(
        _statements(text),
        lambda all_: F.concat(
            _defs(all_),
            F.flatten(F.transform(F.filter(all_, lambda s: s.rlike(CLASS_LINE)), _methods)),
        ),
    )


def classes(text: Column) -> Column:
    def bases(s: Column) -> Column:
        brackets = F.regexp_extract(
            s, rf"{CLASS_LINE}[ \t]*(?:\[[^\]]*\][ \t]*)?+({BRACKETED})", 3
        )
        plain = F.filter(
            _trimmed_parts(_inside(brackets)), lambda p: ~p.rlike(r"^\*\*|^[^()]*=")
        )
        return F.transform(
            plain, lambda p: F.when(p.rlike(rf"^[{WORD}.]+$"), p).otherwise("unknown")
        )

    def row(s: Column) -> Column:
        return class_row(
            unstamp(F.regexp_extract(s, CLASS_LINE, 1)),
            F.regexp_extract(s, CLASS_LINE, 2),
            bases(s),
            _decorators(s),
        )

    found = F.filter(_statements(text), lambda s: s.rlike(CLASS_LINE))
    return F.transform(found, row)


FROM = rf"^from[ \t]*([.]*)[ \t]*([{WORD}.]*)[ \t]*import(?!\w)(.*)$"
IMPORT_STATEMENT = (
    rf"(?:{LINE}{INDENT}*+|[:;][ \t]*)"
    rf"(import[ \t][^\n;]*|from[ \t.][^\n;]*?(?<![{WORD}])import(?![{WORD}])[^\n;]*)"
)


def imports(text: Column) -> Column:
    statements = F.regexp_extract_all(text, F.lit(IMPORT_STATEMENT), F.lit(1))

    def from_import(s: Column) -> Column:
        listed = F.regexp_replace(F.regexp_extract(s, FROM, 3), r"[()]", " ")
        names = F.transform(
            _trimmed_parts(listed), lambda n: F.regexp_extract(n, r"^(\S+)", 1)
        )
        return F.array(
            import_row(
                F.regexp_extract(s, FROM, 2), names, F.regexp_extract(s, FROM, 1) != "", False
            )
        )

    def plain_import(s: Column) -> Column:
        listed = F.regexp_replace(s, r"^import[ \t]+", "")
        return F.transform(
            _trimmed_parts(listed),
            lambda n: import_row(
                F.regexp_extract(n, r"^(\S+)", 1),
                F.array(F.regexp_extract(n, r"(\S+)$", 1)),
                False,
                False,
            ),
        )

    return F.flatten(
        F.transform(
            statements,
            lambda s: F.when(s.startswith("from"), from_import(s)).otherwise(plain_import(s)),
        )
    )


MAIN_GUARD = (
    rf"{LINE}{INDENT}*+(?:el)?if[ \t(]+__name__{WORD_END}[ \t]*(?:[=!]=|[<>]|is{WORD_END}|(?:not[ \t]+)?in{WORD_END})"
)


def is_entry(content: Column, name: Column, text: Column) -> Column:
    return (
        text.rlike(MAIN_GUARD)
        | content.contains("click.command")
        | content.contains("click.group")
        | content.contains("@app.route")
    )
