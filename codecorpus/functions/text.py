"""Text rules that decide every count: line breaks, white space, word characters.

Java regular expressions treat ``\\s`` and ``\\w`` as ASCII.  The analyses here are
defined on Unicode text, so the classes are spelled out once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line terminators of a text line.
BREAK = r"(?>\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}])"
# White space inside or between lines (body of a character class).
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Word characters (body of a character class).
WORD = r"\p{L}\p{N}_"
# Word boundaries on Unicode text.
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"
COMMENT_START = r"(?:#|//|/\*|\*|<!--|--|;)"

# Private-use digits: line numbers written into text so that a pattern can read them.
STAMP_DIGITS = "".join(chr(0xE000 + digit) for digit in range(10))
STAMP = r"\x{E000}-\x{E009}"


def split_lines(content: Column) -> Column:
    """Lines of a text; a final line break does not start another line."""
    return lines_of(F.split(content, BREAK, -1))


def lines_of(parts: Column) -> Column:
    """The same from a text that is split already."""
    cut = F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts))
    return F.slice(parts, F.lit(1), cut)


def is_blank(line: Column) -> Column:
    return line.rlike(rf"^[{SPACE}]*$")


def is_comment(line: Column) -> Column:
    """Comment by leading mark, whatever the language."""
    return line.rlike(rf"^[{SPACE}]*{COMMENT_START}")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+$", "")


def stamp(number: Column) -> Column:
    """A line number written in private-use digits."""
    return F.translate(number.cast("string"), "0123456789", STAMP_DIGITS)


def unstamp(digits: Column) -> Column:
    return F.translate(digits, STAMP_DIGITS, "0123456789").cast("int")


def drop_stamps(text: Column) -> Column:
    return F.translate(text, STAMP_DIGITS, "")


def stamp_line_ends(content: Column) -> Column:
    """Text with every ``\\n``-line followed by its own number.

    A pattern that begins with ``LINE_NO`` then captures the number of the line on which its
    match starts, without positions, windows or a shuffle.
    """

    def with_number(line: Column, i: Column) -> Column:
        number = stamp(i + 1)
        # More stamps per line, so that none is far away from a match in minified text.
        dense = F.regexp_replace(line, F.lit(r"[;{}](?!\z)"), F.concat(F.lit("$0"), number))
        return F.concat(dense, number)

    lines = F.split(drop_stamps(content), "\n", -1)
    return F.array_join(F.transform(lines, with_number), "\n")


LINE_NO = rf"(?=[^{STAMP}]*+([{STAMP}]++))"
# White space that may also step over a stamp.
GAP = rf"[{SPACE}{STAMP}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also when used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str, **groups: int) -> Column:
    """All matches in order, as an array of structs with the named groups."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in groups.values()]
    fields = list(groups)
    return F.transform(
        F.arrays_zip(*found),
        lambda m: F.struct(*[m[str(i)].alias(name) for i, name in enumerate(fields)]),
    )


def first_per(items: Column, key: str) -> Column:
    """First struct per value of a field, in the order of the array; n log n."""
    keyed = F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"), x.alias("x")))
    firsts = let(
        F.array_sort(keyed),
        lambda s: F.filter(s, lambda x, i: ~F.get(s, i - 1)["k"].eqNullSafe(x["k"])),
    )
    ordered = F.array_sort(F.transform(firsts, lambda f: F.struct(f["i"], f["x"])))
    return F.transform(ordered, lambda f: f["x"])


def nested(depth: int = 200) -> str:
    """Pattern of one bracketed group, brackets nested up to ``depth`` levels."""
    body = r"[^()\[\]{}]++"
    group = rf"[(\[{{](?:{body})?+[)\]}}]"
    for _ in range(depth - 1):
        group = rf"[(\[{{](?:{body}|{group})*+[)\]}}]"
    return group


BRACKETED = nested()


BRACKET_TOKEN = r"[^()\[\]{}]+|[()\[\]{}]"
# Stands for a bracket that is deeper than patterns look; no part of a word, a line or a pair.
DEEP = chr(0xE00A)
DEEPEST = 100
_CHUNK = 256


def bracket_depths(tokens: Column) -> Column:
    """How many brackets are open before each token of ``BRACKET_TOKEN``; negative after strays.

    A running sum in one pass: within chunks from the start of each chunk, and over the sums of the
    chunks, so no array grows with the text while it is built up.
    """

    def within(chunk: Column, start: Column) -> Column:
        sums = F.aggregate(
            chunk,
            F.struct(start.alias("sum"), F.array().cast("array<int>").alias("before")),
            lambda a, x: F.struct(
                (a["sum"] + x).alias("sum"), F.array_append(a["before"], a["sum"]).alias("before")
            ),
        )
        return sums["before"]

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    steps = F.transform(
        tokens,
        lambda t: F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0),
    )

    def chunked(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest((F.size(all_) - 1) / _CHUNK, F.lit(0)).cast("int"))
        return F.transform(
            numbers, lambda k: F.slice(all_, k * _CHUNK + 1, F.lit(_CHUNK))
        )

    def summed(chunks: Column) -> Column:
        return let(
            F.transform(chunks, total),
            lambda sums: F.flatten(
                F.transform(
                    chunks, lambda c, i: within(c, total(F.slice(sums, F.lit(1), i)))
                )
            ),
        )

    return let(steps, lambda all_: let(chunked(all_), summed))


def join_bracketed(text: Column, line: str) -> Column:
    """Text with ``line`` (a pattern) replaced by a space inside brackets of any depth.

    Brackets below ``DEEPEST`` others become ``DEEP``, so that patterns for pairs see all pairs.
    NULL if brackets do not pair up.
    """

    def rewrite(tokens: Column, depths: Column) -> Column:
        last = F.element_at(tokens, -1)
        end = F.element_at(depths, -1) - F.when(last.isin(")", "]", "}"), 1).otherwise(0)
        paired = (F.array_min(depths) >= 0) & (end == 0)
        joined = F.zip_with(
            tokens,
            depths,
            lambda t, d: F.when(t.isin("(", "[", "{"), F.when(d >= DEEPEST, DEEP).otherwise(t))
            .when(t.isin(")", "]", "}"), F.when(d > DEEPEST, DEEP).otherwise(t))
            .when(d > 0, F.regexp_replace(t, line, " "))
            .otherwise(t),
        )
        return F.when(paired, F.array_join(joined, ""))

    return let(
        F.regexp_extract_all(text, F.lit(BRACKET_TOKEN), F.lit(0)),
        lambda tokens: let(bracket_depths(tokens), lambda depths: rewrite(tokens, depths)),
    )


def glob_body(glob: Column, crosses: bool) -> Column:
    """Regular expression of a shell glob, not anchored; wildcards cross ``/`` only if asked to."""
    literal = F.regexp_replace(glob, r"([\\.+^$(){}|])", r"\\$1")
    negated = F.regexp_replace(literal, r"\[!", "[^")
    # A bracket that never closes is a plain character.
    closed = F.regexp_replace(negated, r"\[(?![^\]]+\])", r"\\[")
    if not crosses:
        closed = F.regexp_replace(closed, r"(?<!\\)\[", "(?!/)[")
    some = "." if crosses else "[^/]"
    # A question mark after a bracket belongs to the look-ahead above.
    one = F.regexp_replace(closed, r"(?<!\()\?", some)
    return F.regexp_replace(one, r"\*+", f"{some}*")
