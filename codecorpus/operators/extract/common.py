"""Shapes shared by the extractors of all languages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

IMPORT = (
    "array<struct<module:string,names:array<string>,is_relative:boolean,is_external:boolean>>"
)
FUNCTION = (
    "array<struct<line_no:int,name:string,owner_class:string,is_method:boolean,is_async:boolean,"
    "decorators:array<string>,parameters:array<string>,complexity:int>>"
)
CLASS = "array<struct<line_no:int,name:string,bases:array<string>,decorators:array<string>>>"
STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(STRINGS)


def import_row(module: Column, names: Column, relative, external) -> Column:
    return F.struct(
        module.alias("module"),
        names.alias("names"),
        (relative if isinstance(relative, Column) else F.lit(relative)).alias("is_relative"),
        (external if isinstance(external, Column) else F.lit(external)).alias("is_external"),
    )


def function_row(
    line_no: Column,
    name: Column,
    *,
    owner: Column | None = None,
    is_method: Column | None = None,
    is_async: Column | None = None,
    decorators: Column | None = None,
    parameters: Column | None = None,
    complexity: Column | None = None,
) -> Column:
    def given(value, default):
        return default if value is None else value

    return F.struct(
        line_no.cast("int").alias("line_no"),
        name.alias("name"),
        given(owner, F.lit(None).cast("string")).alias("owner_class"),
        given(is_method, F.lit(False)).alias("is_method"),
        given(is_async, F.lit(False)).alias("is_async"),
        given(decorators, no_strings()).alias("decorators"),
        given(parameters, no_strings()).alias("parameters"),
        given(complexity, F.lit(1)).cast("int").alias("complexity"),
    )


def class_row(line_no: Column, name: Column, bases: Column, decorators: Column) -> Column:
    return F.struct(
        line_no.cast("int").alias("line_no"),
        name.alias("name"),
        bases.alias("bases"),
        decorators.alias("decorators"),
    )


def nothing(kind: str) -> Callable[[Column], Column]:
    return lambda _text: F.array().cast(kind)


@dataclass(frozen=True)
class Extractor:
    """Column builders of one language.

    ``prepare`` turns content into the text that ``functions`` and ``classes`` read; it is
    computed once per file.  ``imports`` reads it too when ``imports_prepared`` is set, else it
    reads the plain content, like ``exports``.  ``is_entry`` gets content, file name and text.
    """

    prepare: Callable[[Column], Column]
    functions: Callable[[Column], Column]
    imports: Callable[[Column], Column]
    imports_prepared: bool = False
    classes: Callable[[Column], Column] = nothing(CLASS)
    exports: Callable[[Column], Column] = nothing(STRINGS)
    is_entry: Callable[[Column, Column, Column], Column] = lambda content, name, text: F.lit(False)
