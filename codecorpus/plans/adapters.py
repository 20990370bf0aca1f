"""Corpus tables derived from the shared tables.

The shared tables hold no source code, so files and commits are derived from them row by row.
The expressions below are plain SQL that Spark and other engines read alike; they define the test
input, not any operator.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import dims
from codecorpus.functions.rows import computed
from codecorpus.operators import search
from codecorpus.plans.analysis import CorpusAnalysis
from codecorpus.session import shared_folder, stored
from codecorpus.sources.corpus import even, spread

#: A row of ``part`` is short but makes a whole file of code.
PARTS_PER_TASK = 10_000
#: The text that decides the work of a row.
TEXTS = {"documents": "text", "pages": "html"}


def _join(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _line(*parts: str) -> str:
    return _join(*parts, "chr(10)")


def _when(test: str, *parts: str) -> str:
    return f"case when {test} then {_line(*parts)} else '' end"


Q = "chr(39)"
# Marker text of a comment: FIXME:, todo, or nothing.
MARK = "case when k % 7 = 0 then 'FIXME: ' when k % 7 in (1, 2) then 'todo ' else '' end"

SECRETS = [
    _when("k % 17 = 0", """'password = "hunter'""", "k", """'"'"""),
    _when("k % 11 = 0", """'url = "http://example.com/'""", "k", """'"'"""),
    _when("k % 23 = 0", """'h = md5(data)'"""),
]
PYTHON = _join(
    _line("'import pkg.m'", "t"),
    _when("z % 2 = 0", "'import os, json as js'"),
    _when("z % 3 = 0", "'from .util import (alpha,'", "chr(10)", "'    beta as b)'"),
    _when("z % 3 = 1", "'from util.text import alpha'"),
    _line("'# '", MARK, "nm"),
    "chr(10)",
    _when("k % 4 = 0", """'@app.route("/'""", "k", """'")'"""),
    _when("k % 3 = 0", "'@cached'"),
    _when("k % 6 = 0", "'async def f'", "k", "'(self, a: int, b=(1, 2), *args, c=3):'"),
    _when("k % 6 <> 0", "'def f'", "k", "'(a, b):'"),
    _when("k % 2 = 0", """'    \"\"\"text with if and for or while\"\"\"'"""),
    "repeat(concat('    if a > 1 and b < 2:', chr(10), '        a = b', chr(10)), z % 4 * (k % 5 + 1))",
    _when("z % 5 = 0", "'    xs = [x for x in b'", "chr(10)", "'        if x]'"),
    # Brackets up to 300 deep, over lines that begin in the first column.
    _when("z % 5 = 2", "'    ys = '", "repeat('(', z * 6)", "chr(10)", "'1 for q in a or b'",
          "chr(10)", "repeat(')', z * 6)"),
    _line("'    return a'"),
    "chr(10)",
    _when("k % 3 = 1", "'class C'", "k", "'(Base, mod.Other, metaclass=M):'"),
    _when("k % 3 = 1", "'    def run(self, n):'"),
    _when("k % 3 = 1", "'        while n or a:'"),
    _when("k % 3 = 1", "'            n = n - 1'"),
    _when("k % 3 = 1", "'        assert n'"),
    _when("k % 3 = 1", "'    @staticmethod'"),
    _when("k % 3 = 1", "'    async def stop(n, q=1):'"),
    _when("k % 3 = 1", "'        return n'"),
    *SECRETS,
    _when("k % 7 = 3", """'if __name__ == "__main__":'"""),
    _when("k % 7 = 3", "'    f'", "k", "'(1, 2)'"),
)
JAVASCRIPT = _join(
    _line("'import {a as x, b} from '", Q, "'./src/m'", "t", Q),
    _when("z % 2 = 0", "'import React from '", Q, "'react'", Q),
    _when("z % 3 = 0", "'const fs = require('", Q, "'fs/promises'", Q, "')'"),
    _line("'// '", MARK, "nm"),
    "chr(10)",
    _line("'export function f'", "k", "'(a: number, b) {'"),
    "repeat(concat('    if (a > 1) { return b; }', chr(10)), z % 4)",
    _line("'}'"),
    _line("'const g'", "k", "' = async (x) => x + 1;'"),
    _when("k % 3 = 1", "'export class C'", "k", "' extends Base {'", "chr(10)", "'}'"),
    _when("k % 4 = 0", "'export { f'", "k", "' as main, g'", "k", "' }'"),
    *SECRETS,
    _when("k % 7 = 3", "'app.listen(3000)'"),
)
GO = _join(
    _when("k % 2 = 0", "'package main'"),
    _when("k % 2 = 1", "'package lib'"),
    _line("""'import "m'""", "t", """'"'"""),
    _when("z % 2 = 0", """'import ('""", "chr(10)", """'    "fmt"'""", "chr(10)",
          """'    "github.com/x/y'""", "k % 3", """'"'""", "chr(10)", "')'"),
    _line("'// '", MARK, "nm"),
    "chr(10)",
    _when("z % 3 = 0", "'type S'", "k", "' struct {'", "chr(10)", "'}'"),
    _when("z % 3 = 1", "'type i'", "k", "' interface {'", "chr(10)", "'}'"),
    _line("'func F'", "k", "'(a int, b string) {'"),
    "repeat(concat('    if a > 1 && b < 2 { a = b }', chr(10)), z % 4)",
    _line("'}'"),
    _when("z % 3 = 0", "'func (r *S'", "k", "') get'", "k", "'(x int) int {'", "chr(10)", "'}'"),
    _when("k % 7 = 3", "'func main() {'", "chr(10)", "'}'"),
    *SECRETS,
)
RUST = _join(
    _line("'use crate::m'", "t", "';'"),
    _when("z % 2 = 0", "'use std::collections::{HashMap, HashSet};'"),
    _when("z % 3 = 0", "'use super::x;'"),
    _line("'// '", MARK, "nm"),
    "chr(10)",
    _when("z % 3 = 0", "'pub struct S'", "k", "' {'", "chr(10)", "'}'"),
    _when("z % 3 = 1", "'trait T'", "k", "' {'", "chr(10)", "'}'"),
    _line("'pub async fn f'", "k", "'<T>(a: i32, &mut self) {'"),
    "repeat(concat('    if a > 1 && b < 2 { a = b }', chr(10)), z % 4)",
    _line("'}'"),
    _when("k % 2 = 0", "'fn h'", "k", "'(self, q: u8) -> u8 {'", "chr(10)", "'}'"),
    *SECRETS,
)
C = _join(
    _line("""'#include "m'""", "t", """'.h"'"""),
    _when("z % 2 = 0", "'#include <stdio.h>'"),
    _line("'// '", MARK, "nm"),
    "chr(10)",
    _line("'int f'", "k", "'(int a) {'"),
    "repeat(concat('    if (a > 1) { a = 2; }', chr(10)), z % 4)",
    _line("'}'"),
    _when("k % 2 = 0", "'// fn helper'", "k", "'(a)'"),
    _when("k % 2 = 0", "'// fn helper'", "k", "' (b)'"),
    *SECRETS,
)
BASE = {
    "k": "p_partkey",
    "z": "p_size",
    "nm": "p_name",
    "g": "cast(floor(p_partkey / 5) as bigint) % 5",
    "t": "(p_partkey - p_partkey % 5) + (p_partkey * 3 + p_size) % 5",
}
CODE = {
    "repo": "concat('repo', cast(floor(k / 100) as bigint))",
    "path": (
        "case g when 0 then concat('pkg/m', k, '.py') "
        "when 1 then concat('src/m', k, case when z % 3 = 0 then '.ts' else '.js' end) "
        "when 2 then concat('m', k, '.go') when 3 then concat('src/m', k, '.rs') "
        "else concat('csrc/m', k, '.c') end"
    ),
    "content": (
        f"case g when 0 then {PYTHON} when 1 then {JAVASCRIPT} when 2 then {GO} "
        f"when 3 then {RUST} else {C} end"
    ),
}
# Root and special files of the repositories: (test on the repository number r, path, lines).
_PYPROJECT = _join(
    _line("'[project]'"), _line("""'name = "demo"'"""), _line("'dependencies = ['"),
    _line("""'    "flask>=2.0",'"""), _line("""'    "click'""", "r", """'",'"""),
    _line("""'    "numpy[extra]==1.0",'"""), _line("']'"), _line("''"),
    _line("'[project.scripts]'"), _line("""'tool = "pkg.cli:main"'"""),
    _line("""'other = "pkg.m'""", "r * 100", """':main"'"""), _line("'[tool.x]'"),
    _line("'line-length = 100'"),
)
_REQUIREMENTS = _join(
    _line("'# pinned'"), _line("'django==3.2'"), _line("'-r other.txt'"), _line("''"),
    _line("'requests>=2'"),
)
_PACKAGE = _join(
    """'{"dependencies": {"react": "^18", "next": "1'""", "r", """'"}, '""",
    """'"devDependencies": {"jest": "29", "vue": "3"}}'""",
)
_GOMOD = _join(
    _line("'module demo'"), _line("'require ('"), _line("'    github.com/gin/gin v1'"),
    _line("'    example.org/lib'", "r", "' v2'"), _line("')'"),
)
_CARGO = _join(
    _line("'[package]'"), _line("""'name = "demo"'"""), _line("'[dependencies]'"),
    _line("""'serde = "1"'"""), _line("""'# note'"""), _line("'[dev-dependencies]'"),
    _line("""'rand = { version = "0.8" }'"""), _line("'[features]'"), _line("'std = []'"),
)
_GITIGNORE = _join(
    _line("'*.log'"), _line("'# comment'"), _line("''"), _line("'generated/'"),
    _line("'src/skip?'"), _line("'csrc/m*7.c'"),
)
ROOT_FILES = [
    ("r % 2 = 0", "README.md", _join(_line("'# Repo '", "r"), _line("'text'"))),
    ("r % 3 = 0", "pyproject.toml", _PYPROJECT),
    ("r % 4 = 0", "requirements.txt", _REQUIREMENTS),
    ("r % 3 = 1", "package.json", _PACKAGE),
    ("r % 3 = 2", "go.mod", _GOMOD),
    ("r % 4 = 1", "Cargo.toml", _CARGO),
    ("r % 5 = 0", "Dockerfile", _line("'FROM python'")),
    ("r % 4 = 2", ".github/workflows/ci.yml", _line("'on: push'")),
    ("r % 3 < 2", "tests/test_main.py", _join(_line("'def test_main():'"), _line("'    assert 1'"))),
    ("r % 6 = 1", "docs/index.md", _line("'use the docs'")),
    ("r % 2 = 1", ".gitignore", _GITIGNORE),
    ("r % 2 = 0", "logs/x.log", _line("'started'")),
    ("r % 2 = 1", "deep/x.log", _line("'started'")),
    ("r % 3 = 0", "src/generated/a/b.js", _line("'var x = 1;'")),
    ("r % 5 = 1", "src/skip1/lib/c.js", _line("'var y = 1;'")),
    ("r % 5 = 1", "node_modules/x/index.js", _line("'var z = 1;'")),
    ("r % 5 = 2", "demo.egg-info/top.txt", _line("'demo'")),
    ("r % 4 = 3", "main.py", _join(_line("'import pkg.m'", "r * 100"), _line("'print(1)'"))),
    ("r % 7 = 2", "services/a/Dockerfile", _line("'FROM a'")),
    ("r % 7 = 2", "services/b/package.json", "'{}'"),
    ("r % 9 = 4", "packages/core/index.ts", _line("'export const v = 1;'")),
    ("r % 8 = 3", "models/user.py", _line("'class User: pass'")),
    ("r % 8 = 3", "views/user.py", _line("'x = 1'")),
    ("r % 8 = 5", "frontend/style.css", _line("'a { }'")),
    ("r % 8 = 6", "api/routes.js", _line("'// routes'")),
    ("r % 10 = 6", "setup.py", _line("'from setuptools import setup'")),
    ("r % 11 = 5", "mkdocs.yml", _line("'site_name: x'")),
    ("r % 13 = 6", "lerna.json", "'{}'"),
    ("r % 10 = 8", "bin/run", _line("'#!/bin/sh'")),
    ("r % 10 = 9", "empty.txt", "''"),
]


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in exprs.items())


# SQL of the derived tables; every text reads the shared tables or earlier entries.
CODE_BASE_SQL = f"select {_columns(BASE)} from part"
CODE_SQL = f"select {_columns(CODE)} from code_base"
REPO_SQL = "select distinct cast(floor(k / 100) as bigint) as r from code_base"
ROOT_SQL = " union all ".join(
    f"select concat('repo', r) as repo, '{path}' as path, {text} as content from repo_numbers "
    f"where {test}"
    for test, path, text in ROOT_FILES
)
DOC_SQL = (
    "select source as repo, concat(lang, '/doc_', doc_id, '.md') as path, text as content "
    "from documents"
)
PAGE_SQL = (
    "select regexp_extract(url, '^https?://([^/]+)', 1) as repo, "
    "concat('page_', page_id, '.html') as path, html as content from pages"
)
CORPUS_SQL = " union all ".join(
    f"select repo, path, content from {t}" for t in ("code", "root", "docs", "web")
)
COMMIT_SQL = (
    "select distinct c.repo as repo, cast(l_orderkey as varchar(20)) as sha, "
    "cast(o_custkey as varchar(20)) as author, o_orderdate as ts, c.path as path, "
    "case when l_linenumber = 1 then 'A' else 'M' end as change_type "
    "from lineitem join orders on l_orderkey = o_orderkey "
    "join code_keys c on c.k = l_partkey"
)
CODE_KEYS_SQL = f"select k, {CODE['repo']} as repo, {CODE['path']} as path from code_base"
DERIVED = {
    "code_base": CODE_BASE_SQL,
    "code": CODE_SQL,
    "code_keys": CODE_KEYS_SQL,
    "repo_numbers": REPO_SQL,
    "root": ROOT_SQL,
    "docs": DOC_SQL,
    "web": PAGE_SQL,
    "corpus": CORPUS_SQL,
    "commits": COMMIT_SQL,
}
_WORDS = "concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))"
SEARCH = {
    "query_id": "item_id",
    "query": (
        f"case item_id % 5 when 0 then {_WORDS} "
        f"""when 1 then concat('"', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3), '" ', """
        f"""split_part(text, ' ', 5)) """
        f"when 2 then concat({_WORDS}, ' lang:Mark in:doc_1') "
        f"""when 3 then 'password url "hunter" in:m lang:x lang:python' """
        f"else concat('test handler f', item_id * 25, ' type:function ', {_WORDS}) end"
    ),
}
DERIVED["searches"] = f"select {_columns(SEARCH)} from benchmark"
# Rules as data: comments that end in a name which starts with some word.
NAME_RULES = {
    "rule_id": "concat('name ', w)",
    "pattern": "concat('^(#|//) (.*: |todo )?', w, ' [a-z ]*$')",
    "severity": "case when length(w) % 2 = 0 then 'low' else 'medium' end",
    "category": "'names'",
    "title": "concat('Name with ', w)",
    "description": "'A name of a part in a comment'",
    "skip_tests": "true",
    "skip_comments": "false",
}
DERIVED["name_rules"] = (
    f"select {_columns(NAME_RULES)} from (select distinct split_part(p_name, ' ', 1) as w from part)"
)
TABLES = ["part", "orders", "lineitem", "documents", "pages", "benchmark"]


class Tables:
    """The shared tables of one folder and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @cache
    def shared(self, name: str) -> DataFrame:
        rows = self._stored_table(name)
        # Tables with text: the work per row is large, so few row groups must not mean few tasks.
        if name == "part":
            return spread(rows, PARTS_PER_TASK)
        return spread(rows, text=TEXTS[name]) if name in TEXTS else rows

    def _stored_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cache
    def code_base(self) -> DataFrame:
        return self.shared("part").selectExpr(*[f"{e} as {n}" for n, e in BASE.items()])

    @cache
    def code(self) -> DataFrame:
        # Bound, so that the long expressions are not copied into every use of a column.
        made = computed(self.code_base(), **{n: F.expr(e) for n, e in CODE.items()})
        return made.select(*CODE)

    @cache
    def root(self) -> DataFrame:
        # Repositories are few rows per file of ``part``: dealing them out first would be most of the work.
        keys = self._stored_table("part").selectExpr(f"{BASE['k']} as k")
        numbers = keys.selectExpr("cast(floor(k / 100) as bigint) as r").distinct()
        rows = [
            f"case when {test} then named_struct('path', '{path}', 'content', {text}) end"
            for test, path, text in ROOT_FILES
        ]
        return numbers.selectExpr(
            "concat('repo', r) as repo", f"explode(array_compact(array({', '.join(rows)}))) as f"
        ).select("repo", "f.path", "f.content")

    @cache
    def docs(self) -> DataFrame:
        return self.shared("documents").selectExpr(
            "source as repo", "concat(lang, '/doc_', doc_id, '.md') as path", "text as content"
        )

    @cache
    def web(self) -> DataFrame:
        return self.shared("pages").selectExpr(
            "regexp_extract(url, '^https?://([^/]+)', 1) as repo",
            "concat('page_', page_id, '.html') as path",
            "html as content",
        )

    @cache
    def code_files(self) -> DataFrame:
        """Source files and root files of the derived repositories."""
        return self.code().unionByName(self.root())

    @cache
    def corpus(self) -> DataFrame:
        return self.code_files().unionByName(self.docs()).unionByName(self.web())

    @cache
    def commits(self) -> DataFrame:
        """The commit log; a repeated row counts once.

        The path holds the key of the part and the commit is the key of the order, so rows repeat only
        if what they are joined from repeats: that is settled on keys, where the joins have dealt them,
        and the long rows are not dealt once more.
        """
        keys = self.code_base().selectExpr(
            "k as l_partkey", f"{CODE['repo']} as repo", f"{CODE['path']} as path"
        )
        orders = self.shared("orders").selectExpr(
            "o_orderkey as l_orderkey",
            "cast(o_custkey as string) as author",
            "o_orderdate as ts",
        )
        kind = F.when(F.col("l_linenumber") == 1, "A").otherwise("M")
        touched = self.shared("lineitem").select("l_orderkey", "l_partkey", kind.alias("change_type"))
        return (
            touched.join(orders, "l_orderkey")
            .distinct()
            .join(keys.distinct(), "l_partkey")
            .select(
                "repo",
                F.col("l_orderkey").cast("string").alias("sha"),
                "author",
                "ts",
                "path",
                "change_type",
            )
        )

    @cache
    def raw(self) -> DataFrame:
        """The whole corpus as raw files: repo, path, size_bytes, content (bytes)."""
        return _raw(self.corpus())

    def as_of(self):
        """Time of the newest commit, where the history window ends."""
        return self.shared("orders").select(F.max("o_orderdate")).scalar()

    @cache
    def whole(self) -> CorpusAnalysis:
        return CorpusAnalysis(
            self.raw(),
            self.commits(),
            self.as_of(),
            history_days=dims.HISTORY_DAYS,
            history_commits=dims.HISTORY_COMMITS,
        )

    @cache
    def whole_stored(self) -> CorpusAnalysis:
        """The same with files and structure stored: for results that combine several tables."""
        return self.whole().store(self._store())

    def _store(self) -> str:
        return f"{shared_folder(self.spark)}/codecorpus-{uuid.uuid4().hex}"

    @cache
    def index(self) -> search.SearchIndex:
        """The stored search index of the corpus."""
        return search.write_index(self.whole().files, self._store(), buckets=32)

    @cache
    def stored_files(self) -> DataFrame:
        """The files alone, stored and dealt evenly; postings need no structure."""
        return even(stored(self.whole().files))

    @cache
    def name_rules(self) -> DataFrame:
        """Rules derived from the names of parts."""
        words = self.shared("part").selectExpr("split_part(p_name, ' ', 1) as w").distinct()
        return words.selectExpr(*[f"{e} as {n}" for n, e in NAME_RULES.items()], "array(w) as hints")

    @cache
    def searches(self) -> DataFrame:
        """Three words of each benchmark text as a query; some get a phrase or filters."""
        return self.shared("benchmark").selectExpr(*[f"{e} as {n}" for n, e in SEARCH.items()])


def _raw(texts: DataFrame) -> DataFrame:
    content = F.col("content").cast("binary")
    return texts.select("repo", "path", F.octet_length(content).alias("size_bytes"),
                        content.alias("content"))
