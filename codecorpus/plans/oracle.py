"""The registered queries once more, in SQL on the shared tables.

Written from the meaning of each operator, not from its Spark form: line by line where Spark reads
whole texts, with windows where Spark uses arrays, with recursion where Spark iterates.
"""

from __future__ import annotations

import re

from codecorpus.functions import dims
from codecorpus.plans.adapters import CODE, DERIVED

CTES: dict[str, str] = dict(DERIVED)
ORACLE: dict[str, str] = {}


def _values(rows: list[tuple]) -> str:
    def text(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def _in(names: list[str]) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _needed(sql: str) -> list[str]:
    """Names of the tables above that a text uses, in order of definition."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in CTES and name not in used:
                used.add(name)
                visit(CTES[name])

    visit(sql)
    return [name for name in CTES if name in used]


def check(name: str, sql: str) -> None:
    parts = [f"{n} as ({CTES[n]})" for n in _needed(sql)]
    ORACLE[name] = (f"with recursive {', '.join(parts)} " if parts else "") + sql


# --- files --------------------------------------------------------------------------------
CTES["raw_code"] = "select * from code union all select * from root"
CTES["parts"] = "select *, string_split(path, '/') as comps from corpus"
CTES["own_globs"] = (
    "select repo, rtrim(trim(l), '/') as pat from (select repo, unnest(string_split(content, "
    "chr(10))) as l from corpus where path = '.gitignore') where trim(l) <> '' "
    "and not starts_with(trim(l), '#')"
)
_IGNORED_NAMES = [n for n in dims.DEFAULT_IGNORES if "*" not in n]
_DEFAULT = (
    f"len(list_filter(comps, lambda x: x in {_in(_IGNORED_NAMES)} or x like '%.egg-info')) > 0"
)
CTES["visible"] = f"select repo, path, content, comps from parts where not ({_DEFAULT})"


def _unhidden(table: str, globs: str) -> str:
    return (
        f"select p.repo, p.path, p.content, p.comps from {table} p where not exists (select 1 "
        f"from {globs} g, (select unnest(range(1, len(p.comps) + 1)) as n) where g.repo = p.repo "
        "and (array_to_string(p.comps[1:n], '/') glob g.pat "
        "or array_to_string(p.comps[1:n], '/') glob concat(g.pat, '/*') "
        "or p.comps[n] glob g.pat))"
    )


CTES["kept"] = _unhidden("visible", "own_globs")
CTES["named"] = (
    "select *, comps[len(comps)] as name, "
    "regexp_extract(comps[len(comps)], '^.+(\\.[^.]+)$', 1) as suffix from kept"
)
CTES["ext_language"] = (
    "select * from (values " + _values(list(dims.LANGUAGE_BY_EXTENSION.items()))
    + ") as v(ext, lang)"
)
CTES["name_language"] = (
    "select * from (values " + _values(list(dims.LANGUAGE_BY_NAME.items())) + ") as v(fname, lang)"
)
CTES["spoken"] = (
    "select n.repo, n.path, n.content, n.name, n.suffix, coalesce(f.lang, e.lang, 'Other') "
    "as language from named n left join name_language f on f.fname = n.name "
    "left join ext_language e on e.ext = lower(n.suffix)"
)
_LINES_OF = (
    "select repo, path, language, i as line_no, ps[i] as text from (select *, "
    "string_split(content, chr(10)) as ps from {t}) s, unnest(range(1, case "
    "when content = '' then 1 when ends_with(content, chr(10)) then len(ps) else len(ps) + 1 end"
    ")) as r(i)"
)
CTES["lines"] = _LINES_OF.format(t="spoken")
_BLANK = "regexp_matches(text, '^\\s*$')"
_COMMENT = "regexp_matches(text, '^\\s*(#|//|/\\*|\\*|<!--|--|;)')"
CTES["files"] = (
    "select s.repo, s.path, s.name, s.suffix, s.language, strlen(s.content) as size_bytes, "
    "coalesce(n.total, 0) as line_count, coalesce(n.blank, 0) as blank_lines, "
    "coalesce(n.comment, 0) as comment_lines, "
    "greatest(coalesce(n.total - n.blank - n.comment, 0), 0) as code_lines, s.content "
    "from spoken s left join (select repo, path, count(*) as total, "
    f"count(*) filter ({_BLANK}) as blank, count(*) filter ({_COMMENT}) as comment "
    "from lines group by all) n on n.repo = s.repo and n.path = s.path"
)

check("src2_filter_depth", "select repo, path from parts where len(comps) <= 2")
check("src3_filter_default_ignores", "select repo, path from visible")
CTES["more_globs"] = (
    "select repo, pat from own_globs union select distinct c.repo, g.pat from corpus c, "
    "(values ('deep'), ('doc_1?.md')) as g(pat)"
)
CTES["unhidden"] = _unhidden("parts", "more_globs")
check("src4_filter_gitignore", "select repo, path from unhidden")
check("src5_filter_binary", "select repo, path from corpus where strlen(content) % 10 >= 6")
check("src6_decode_text", "select repo, path, length(content) + 1 as n_chars from corpus")
CTES["window_start"] = "select max(o_orderdate) as until from orders"
CTES["commits_400"] = (
    "select * from (select *, dense_rank() over (partition by repo order by ts desc, sha) as r "
    "from commits where ts >= (select until - interval 400 day from window_start)) where r <= 50"
)
check("src7_load_commits", "select repo, sha, author, path from commits_400")
check(
    "src8_incremental_scan",
    "select repo, path, sha256(content) as content_sha, "
    "case when content = '' then 0 when ends_with(content, chr(10)) "
    "then len(string_split(content, chr(10))) - 1 else len(string_split(content, chr(10))) end "
    "as line_count, strlen(content) % 2 = 0 as reused from corpus",
)

# --- paths and lines ----------------------------------------------------------------------
check(
    "prj1_detect_language",
    "select p.repo, p.path, coalesce(f.lang, e.lang, 'Other') as language from parts p "
    "left join name_language f on f.fname = p.comps[len(p.comps)] left join ext_language e "
    "on e.ext = lower(regexp_extract(p.comps[len(p.comps)], '^.+(\\.[^.]+)$', 1))",
)
CTES["all_lines"] = _LINES_OF.format(t="(select *, '' as language from corpus)")
check("prj2_explode_lines", "select repo, path, line_no, md5(text) as text_md5 from all_lines")
check(
    "prj3_classify_lines",
    f"select repo, path, {_BLANK} as is_blank, {_COMMENT} as is_comment, count(*) as n, "
    "cast(sum(line_no) as bigint) as line_sum from all_lines group by all",
)
check(
    "prj4_count_lines",
    "select repo, path, line_count, blank_lines, comment_lines, code_lines from files",
)
_DIR = "case when path like '%/%' then string_split(path, '/')[1] else './' end"
check("prj5_top_level_dir", f"select repo, path, {_DIR} as directory from corpus")
check(
    "prj6_file_extension",
    "select repo, path, coalesce(nullif(regexp_extract(comps[len(comps)], '^.+(\\.[^.]+)$', 1), "
    "''), '(no ext)') as extension from parts",
)
_TEST_HEALTH = (
    "(list_has_any(string_split(path, '/'), ['tests', 'test', '__tests__', 'spec']) "
    "or starts_with(string_split(path, '/')[-1], 'test_') or ends_with(path, '_test.py') "
    "or ends_with(path, '.test.js') or ends_with(path, '.test.ts') "
    "or ends_with(path, '.spec.js') or ends_with(path, '.spec.ts'))"
)
check("prj7_is_test_file_health", f"select repo, path, {_TEST_HEALTH} as is_test from corpus")
_TEST_SECURITY = "(contains(lower(path), 'test') or contains(lower(path), 'spec'))"
check("prj8_is_test_path_security", f"select repo, path, {_TEST_SECURITY} as is_test from corpus")
_TEST_SEARCH = (
    "(contains(lower(string_split(path, '/')[-1]), 'test_') "
    "or contains(lower(string_split(path, '/')[-1]), '_test.') "
    "or starts_with(lower(string_split(path, '/')[-1]), 'test'))"
)
check("prj9_is_test_name_search", f"select repo, path, {_TEST_SEARCH} as is_test from corpus")

# --- structure: Python --------------------------------------------------------------------
# depth: brackets that are open where a line begins, outside of strings and comments.
_BARE = "regexp_replace(regexp_replace(text, '\"[^\"]*\"', '', 'g'), '#.*$', '')"
CTES["py_lines"] = (
    "select *, coalesce(sum(len(regexp_replace(bare, '[^(\\[{]', '', 'g')) - "
    "len(regexp_replace(bare, '[^)\\]}]', '', 'g'))) over (partition by repo, path order by line_no "
    f"rows between unbounded preceding and 1 preceding), 0) as depth from (select *, {_BARE} as bare "
    "from lines where language = 'Python')"
)
_TOP = "depth = 0 and not starts_with(text, ' ') and text <> ''"
# A parenthesised import that goes on for one more line is put together.
CTES["py_import_lines"] = (
    "select repo, path, line_no, case when text like '%(%' and text not like '%)%' "
    "then concat(text, ' ', next) else text end as text from (select *, lead(text) over "
    "(partition by repo, path order by line_no) as next from py_lines) "
    "where regexp_matches(text, '^\\s*(import|from)\\s')"
)
CTES["py_imports"] = (
    "select repo, path, regexp_extract(text, '^\\s*from\\s+\\.*([\\w.]*)\\s*import', 1) as module, "
    "array_to_string(list_transform(string_split(regexp_replace(regexp_extract(text, "
    "'import(.*)$', 1), '[()]', '', 'g'), ','), lambda x: string_split(trim(x), ' ')[1]), '|') "
    "as names, regexp_matches(text, '^\\s*from\\s+\\.') as is_relative, false as is_external "
    "from py_import_lines where regexp_matches(text, '^\\s*from') union all "
    "select repo, path, string_split(trim(n), ' ')[1], string_split(trim(n), ' ')[-1], false, "
    "false from (select repo, path, unnest(string_split(regexp_extract(text, 'import(.*)$', 1), "
    "',')) as n from py_import_lines where regexp_matches(text, '^\\s*import'))"
)
check("ext1_py_imports", "select * from py_imports")
# Every line with the last line that starts a top-level statement, and with its owner class.
CTES["py_scope"] = (
    f"select *, last_value(case when {_TOP} then line_no end "
    "ignore nulls) over w as top_line, last_value(case when regexp_matches(text, '^class ') then "
    f"regexp_extract(text, '^class (\\w+)', 1) when {_TOP} "
    "then '' end ignore nulls) over w as class_name, lag(text, 1) over w as before1, "
    "lag(text, 2) over w as before2 from py_lines window w as (partition by repo, path "
    "order by line_no)"
)
_DECORATOR = "regexp_extract({t}, '^\\s*@([\\w.]+)', 1)"
CTES["py_defs"] = (
    "select repo, path, line_no, regexp_extract(text, 'def (\\w+)', 1) as name, "
    "case when starts_with(text, ' ') then class_name end as owner_class, "
    "regexp_matches(text, '^\\s*async ') as is_async, "
    "array_to_string(list_filter([case when regexp_matches(before1, '^\\s*@') then "
    f"{_DECORATOR.format(t='before2')} else '' end, {_DECORATOR.format(t='before1')}], "
    "lambda x: x <> ''), '|') as decorators, "
    "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace("
    "regexp_extract(text, '\\((.*)\\):', 1), '\\([^)]*\\)', '', 'g'), ',?\\s*\\*.*$', ''), ','), "
    "lambda x: trim(regexp_replace(x, '[:=].*$', ''))), lambda x: x <> '' and x <> 'self'), '|') "
    "as parameters from py_scope where regexp_matches(text, '^(    )?(async )?def \\w+') "
    "and (not starts_with(text, ' ') or class_name <> '')"
)
check(
    "ext2_py_functions",
    "select repo, path, name, line_no, is_async, decorators, parameters from py_defs "
    "where owner_class is null",
)
CTES["py_classes"] = (
    "select repo, path, line_no, regexp_extract(text, '^class (\\w+)', 1) as name, "
    "array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '\\((.*)\\)', "
    "1), ','), lambda x: trim(x)), lambda x: x <> '' and not contains(x, '=')), '|') as bases, "
    "'' as decorators from py_lines where regexp_matches(text, '^class ')"
)
check(
    "ext3_py_classes",
    "select repo, path, name, line_no, bases, decorators from py_classes",
)
check(
    "ext4_py_methods",
    "select repo, path, owner_class, name, line_no, is_async, decorators, parameters "
    "from py_defs where owner_class is not null",
)
_NO_STRINGS = "regexp_replace(text, '\"[^\"]*\"', '', 'g')"
CTES["py_branches"] = (
    "select repo, path, line_no, top_line, text, "
    f"len(regexp_extract_all({_NO_STRINGS}, '\\b(for|and|or)\\b')) + "
    f"case when regexp_matches({_NO_STRINGS}, '^\\s*(if|elif|while|except|assert)\\b') "
    "and depth = 0 then 1 else 0 end "
    "- case when starts_with(trim(text), '#') then "
    f"len(regexp_extract_all({_NO_STRINGS}, '\\b(for|and|or)\\b')) else 0 end as n from py_scope"
)
CTES["py_functions"] = (
    "select d.repo, d.path, d.line_no, d.owner_class, d.name, 1 + (select coalesce(sum(b.n), 0) "
    "from py_branches b where b.repo = d.repo and b.path = d.path and b.line_no >= d.line_no "
    "and b.line_no < coalesce((select min(e.line_no) from (select repo, path, line_no from "
    f"py_defs union all select repo, path, line_no from py_scope where {_TOP}"
    ") e where e.repo = d.repo and e.path = d.path and e.line_no > d.line_no), "
    "1000000)) as complexity from py_defs d"
)
check(
    "ext5_py_complexity",
    "select repo, path, owner_class, name, cast(complexity as integer) as complexity "
    "from py_functions",
)
CTES["py_flags"] = (
    "select repo, path, regexp_matches(content, '(^|\\n)\\s*if __name__ ==') "
    "or contains(content, 'click.command') or contains(content, 'click.group') "
    "or contains(content, '@app.route') as entry_point from files where language = 'Python'"
)
check("ext6_py_entry_flag", "select * from py_flags")

# --- structure: JavaScript and TypeScript -------------------------------------------------
CTES["js_lines"] = "select * from lines where language in ('JavaScript', 'TypeScript')"
CTES["js_imports"] = (
    "select repo, path, line_no, module, case when starts_with(text, 'import {') then "
    "array_to_string(list_transform(string_split(regexp_extract(text, '\\{([^}]*)\\}', 1), ','), "
    "lambda x: string_split(trim(x), ' as ')[1]), '|') "
    "when starts_with(text, 'import') then regexp_extract(text, '^import (\\w+) from', 1) "
    "else '' end as names, starts_with(module, '.') as is_relative, "
    "not starts_with(module, '.') and not starts_with(module, '@/') as is_external "
    "from (select *, regexp_extract(text, '(?:from |require\\(|^import )[''\"]([^''\"]+)', 1) "
    "as module from js_lines where regexp_matches(text, '^import |require\\(')) where module <> ''"
)
check(
    "ext7_js_imports",
    "select repo, path, module, names, is_relative, is_external from js_imports",
)
CTES["js_functions"] = (
    "select repo, path, regexp_extract(text, '(?:function|const) (\\w+)', 1) as name, line_no, "
    "regexp_matches(text, '(^|\\s)async\\s') as is_async, case when contains(text, 'function') then array_to_string(list_transform("
    "string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ','), "
    "lambda x: trim(string_split(x, ':')[1])), '|') else '' end as parameters from js_lines "
    "where regexp_matches(text, 'function \\w+\\s*\\(') or regexp_matches(text, "
    "'const \\w+ = (async )?\\([^)]*\\) =>')"
)
check("ext8_js_functions", "select * from js_functions")
check(
    "ext9_js_classes",
    "select repo, path, regexp_extract(text, 'class (\\w+)', 1) as name, line_no, "
    "regexp_extract(text, 'extends (\\w+)', 1) as bases from js_lines "
    "where regexp_matches(text, '(^|\\s)class \\w+')",
)
check(
    "ext10_js_exports",
    "select repo, path, row_number() over (partition by repo, path order by line_no, i) - 1 "
    "as pos, export_name from (select repo, path, line_no, i, trim(string_split(names[i], "
    "' as ')[1]) as export_name from (select *, case when regexp_matches(text, '^export \\{') "
    "then string_split(regexp_extract(text, '\\{([^}]*)\\}', 1), ',') else [regexp_extract(text, "
    "'^export (?:function|class|const|let|var|interface|type|enum) (\\w+)', 1)] end as names "
    "from js_lines where regexp_matches(text, '^export (function|class|const|\\{)')"
    "), unnest(range(1, len(names) + 1)) as r(i))",
)
CTES["js_flags"] = (
    "select repo, path, lower(regexp_replace(name, '\\.[^.]+$', '')) in ('index', 'main', 'app', "
    "'server', 'entry') or contains(content, 'createServer') or contains(content, 'app.listen') "
    "or (lower(regexp_replace(name, '\\.[^.]+$', '')) in ('page', 'layout', 'route') and "
    "regexp_matches(content, 'getServerSideProps|getStaticProps|getStaticPaths|(from|require)"
    "\\s*\\(?[''\"]next')) as entry_point from files "
    "where language in ('JavaScript', 'TypeScript')"
)
check("ext11_js_entry_flag", "select * from js_flags")

# --- structure: Go and Rust ---------------------------------------------------------------
CTES["go_lines"] = (
    "select *, last_value(case when text = 'import (' then 1 when text = ')' then 0 end "
    "ignore nulls) over (partition by repo, path order by line_no) as in_block from lines "
    "where language = 'Go'"
)
CTES["go_imports"] = (
    "select repo, path, min(line_no) as line_no, module, string_split(module, '/')[-1] as names, "
    "false as is_relative, contains(string_split(module, '/')[1], '.') as is_external "
    "from (select *, regexp_extract(text, '\"([^\"]+)\"', 1) as module from go_lines where "
    "regexp_matches(text, '^import \"') or (in_block = 1 and contains(text, '\"'))) group by all"
)
check(
    "ext12_go_imports", "select repo, path, module, names, is_relative, is_external from go_imports"
)
CTES["go_functions"] = (
    "select repo, path, regexp_extract(text, '^func (?:\\([^)]*\\) )?(\\w+)', 1) as name, line_no, "
    "regexp_matches(text, '^func \\(') as is_method, array_to_string(list_filter(list_transform("
    "string_split(regexp_extract(text, '\\w\\(([^)]*)\\)', 1), ','), "
    "lambda x: string_split(trim(x), ' ')[1]), lambda x: x <> ''), '|') as parameters "
    "from go_lines where regexp_matches(text, '^func ')"
)
check("ext13_go_functions", "select * from go_functions")
check(
    "ext14_go_exports",
    "select repo, path, row_number() over (partition by repo, path order by kind, line_no) - 1 "
    "as pos, name as export_name from (select repo, path, 1 as kind, line_no, name from "
    "go_functions union all select repo, path, 2, line_no, regexp_extract(text, "
    "'^type (\\w+) struct', 1) from go_lines where regexp_matches(text, '^type \\w+ struct') "
    "union all select repo, path, 3, line_no, regexp_extract(text, '^type (\\w+) interface', 1) "
    "from go_lines where regexp_matches(text, '^type \\w+ interface')) "
    "where regexp_matches(name, '^[A-Z]')",
)
CTES["go_flags"] = (
    "select repo, path, contains(content, 'package main') and contains(content, 'func main()') "
    "as entry_point from files where language = 'Go'"
)
check("ext15_go_entry_flag", "select * from go_flags")
CTES["rust_lines"] = "select * from lines where language = 'Rust'"
CTES["rust_imports"] = (
    "select repo, path, line_no, module, trim(string_split(regexp_replace(string_split(module, "
    "'::')[-1], '[{}]', '', 'g'), ',')[1]) as names, string_split(module, '::')[1] in ('self', "
    "'super') as is_relative, string_split(module, '::')[1] not in ('crate', 'self', 'super') "
    "as is_external from (select *, regexp_extract(text, '^use ([^;]+);', 1) as module "
    "from rust_lines where regexp_matches(text, '^use [^;]+;'))"
)
check(
    "ext16_rust_imports",
    "select repo, path, module, names, is_relative, is_external from rust_imports",
)
CTES["rust_functions"] = (
    "select repo, path, regexp_extract(text, 'fn (\\w+)', 1) as name, line_no, "
    "contains(text, 'async fn') as is_async, "
    "array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(text, "
    "'\\(([^)]*)\\)', 1), ','), lambda x: trim(x)), lambda x: x not in ('', 'self', '&self', "
    "'&mut self')), lambda x: trim(string_split(x, ':')[1])), '|') as parameters "
    "from rust_lines where regexp_matches(text, 'fn \\w+')"
)
check("ext17_rust_functions", "select * from rust_functions")
check(
    "ext18_rust_exports",
    "select repo, path, row_number() over (partition by repo, path order by kind, line_no) - 1 "
    "as pos, export_name from (select repo, path, line_no, case when contains(text, 'fn ') then 1 "
    "when contains(text, 'struct ') then 2 else 3 end as kind, regexp_extract(text, "
    "'^pub (?:async )?(?:fn|struct|trait) (\\w+)', 1) as export_name from rust_lines "
    "where regexp_matches(text, '^pub (async )?(fn|struct|trait) '))",
)
CTES["rust_flags"] = (
    "select repo, path, (name = 'main.rs' and regexp_matches(content, 'fn\\s+main\\s*\\(\\s*\\)')) "
    "or name = 'lib.rs' as entry_point from files where language = 'Rust'"
)
check("ext19_rust_entry_flag", "select * from rust_flags")

# --- structure: other languages and manifests ---------------------------------------------
_PARSED = "('Python', 'JavaScript', 'TypeScript', 'Go', 'Rust')"
CTES["generic_imports"] = (
    "select repo, path, module, bool_or(is_external) as is_external from (select repo, path, "
    "unnest(regexp_extract_all(content, '#include\\s*[<\"]([^>\"]+)[>\"]', 1)) as module, "
    f"true as is_external from spoken where language not in {_PARSED} union all select repo, path, "
    "unnest(regexp_extract_all(content, '(?:import|require|include|use|using)\\s+[''\"]?"
    f"([^\\s;''\"]+)', 1)), false from spoken where language not in {_PARSED}) group by all"
)
CTES["generic_imports"] = CTES["generic_imports"].replace("group by all", "group by repo, path, module")
check("ext20_generic_imports", "select * from generic_imports")
CTES["generic_functions"] = (
    "select repo, path, name, min(line_no) as line_no from (select repo, path, line_no, "
    "unnest(regexp_extract_all(text, '(?:def|func|function|fn|sub|proc)\\s+([\\p{L}\\p{N}_]+)\\s*"
    f"\\(', 1)) as name from lines where language not in {_PARSED}) group by repo, path, name"
)
check("ext21_generic_functions", "select * from generic_functions")
CTES["manifest_lines"] = _LINES_OF.format(
    t="(select *, '' as language from corpus where path in ('pyproject.toml', "
    "'requirements.txt', 'go.mod', 'Cargo.toml'))"
)
CTES["manifest_state"] = (
    "select *, trim(text) as l, last_value(case when trim(text) in ('dependencies = [', "
    "'require (', '[dependencies]', '[dev-dependencies]') then 1 when trim(text) in (']', ')') "
    "or starts_with(trim(text), '[') then 0 end ignore nulls) over (partition by repo, path "
    "order by line_no) as inside from manifest_lines"
)
_NAME = "trim(regexp_replace({t}, '(>=|<=|==|\\[).*$', ''))"
CTES["manifest_deps"] = (
    "select distinct repo, manifest, package from (select repo, path as manifest, case path "
    f"when 'pyproject.toml' then {_NAME.format(t=chr(39).join(['trim(l, ', chr(34) + ',', ')']))} "
    f"when 'requirements.txt' then {_NAME.format(t='l')} "
    "when 'go.mod' then string_split(l, ' ')[1] else trim(string_split(l, '=')[1]) end as package "
    "from manifest_state where case path when 'requirements.txt' then l <> '' and "
    "not regexp_matches(l, '^[#-]') when 'Cargo.toml' then inside = 1 and contains(l, '=') "
    "else inside = 1 and l not in ('dependencies = [', 'require (') end "
    "union all select repo, path, unnest(list_concat(json_keys(content, '$.dependencies'), "
    "json_keys(content, '$.devDependencies'))) from corpus where path = 'package.json') "
    "where package <> ''"
)
check("ext22_manifest_deps", "select * from manifest_deps")
CTES["scripts"] = (
    "select repo, row_number() over (partition by repo order by line_no) - 1 as ordinal, "
    "concat(replace(string_split(trim(trim(string_split(text, '=')[2]), '\"'), ':')[1], '.', '/'), "
    "'.py') as path from (select *, last_value(case when l = '[project.scripts]' then 1 "
    "when starts_with(l, '[') then 0 end ignore nulls) over (partition by repo, path "
    "order by line_no) as in_scripts from manifest_state where path = 'pyproject.toml') "
    "where in_scripts = 1 and contains(text, '=')"
)
check("ext23_script_targets", "select * from scripts")

# --- symbol tables of all languages -------------------------------------------------------
CTES["imports"] = (
    "select repo, path, 0 as kind, module, names, is_external from py_imports union all "
    "select repo, path, 1, module, names, is_external from js_imports union all "
    "select repo, path, 2, module, names, is_external from go_imports union all "
    "select repo, path, 3, module, names, is_external from rust_imports union all "
    "select repo, path, 4, module, '' as names, is_external from generic_imports"
)
CTES["functions"] = (
    "select repo, path, line_no, owner_class, name, complexity from py_functions union all "
    "select repo, path, line_no, null, name, 1 from js_functions union all "
    "select repo, path, line_no, null, name, 1 from go_functions union all "
    "select repo, path, line_no, null, name, 1 from rust_functions union all "
    "select repo, path, line_no, null, name, 1 from generic_functions"
)
CTES["candidates"] = (
    "select i.*, i.rid, c.choice, c.target from (select *, row_number() over () as rid from "
    "imports where not is_external and module <> '') i, (select unnest(range(0, 9)) as choice) n, "
    "lateral (select n.choice as choice, case n.choice "
    "when 0 then concat(replace(i.module, '.', '/'), '.py') "
    "when 1 then concat(replace(i.module, '.', '/'), '/__init__.py') "
    "when 8 then concat(string_split(i.module, '/')[-1], '.go') "
    "else concat(ltrim(i.module, './'), ['.js', '.ts', '.jsx', '.tsx', '/index.js', '/index.ts']"
    "[n.choice - 1]) end as target) c"
)
CTES["edges"] = (
    "select c.repo, c.path as source, arg_min(c.target, c.choice) as target, "
    "any_value(c.names) as names from candidates c join files f on f.repo = c.repo "
    "and f.path = c.target group by c.repo, c.path, c.rid"
)
check("jn1_resolve_imports", "select repo, source, target, names from edges")
check(
    "agg13_import_fan_in",
    "select * from (select repo, target, count(*) as importers, row_number() over (partition by "
    "repo order by count(*) desc, target) as rank from edges"
    " group by repo, target) where rank <= 10",
)
CTES["packages"] = (
    "select repo, string_split(string_split(module, '/')[1], '.')[1] as package from imports "
    "where is_external union select repo, package from manifest_deps"
)
check("set1_union_dependencies", "select repo, package from packages")
check("agg12_external_deps", "select package, count(*) as repos from packages group by package")
CTES["links"] = (
    "select distinct repo, source, target from edges"
)
CTES["reach"] = (
    "select repo, source as a, target as b from links where source <> target union "
    "select r.repo, r.a, l.target from reach r join links l on l.repo = r.repo and l.source = r.b"
)
check(
    "grf1_import_components",
    "select repo, component, path, count(*) over (partition by repo, component) as nodes from ("
    "select x.repo, x.a as path, min(x.b) as component from reach x join reach y on y.repo = x.repo "
    "and y.a = x.b and y.b = x.a group by x.repo, x.a having count(distinct x.b) > 1)",
)
CTES["walks"] = (
    "select repo, [source, target] as nodes from links where target >= source union all "
    "select w.repo, list_append(w.nodes, l.target) from walks w join links l on l.repo = w.repo "
    "and l.source = w.nodes[-1] where w.nodes[-1] <> w.nodes[1] and len(w.nodes) <= 9 "
    "and l.target >= w.nodes[1] and (l.target = w.nodes[1] or not list_contains(w.nodes, l.target))"
)
CTES["cycles"] = (
    "select * from (select repo, row_number() over (partition by repo order by len(nodes), nodes) "
    "as rank, len(nodes) - 1 as nodes, array_to_string(nodes, '|') as cycle from walks "
    "where nodes[1] = nodes[-1]) where rank <= 10"
)
check("grf1_circular_deps", "select repo, rank, cast(nodes as integer) as nodes, cycle from cycles")

# --- history ------------------------------------------------------------------------------
CTES["commits_90"] = (
    "select * from (select *, dense_rank() over (partition by repo order by ts desc, sha) as r "
    "from commits where ts >= (select until - interval 90 day from window_start)) where r <= 500"
)
CTES["history"] = (
    "select repo, path, count(distinct sha) as commit_count, array_to_string(list_sort("
    "list_distinct(list(author))), '|') as contributors, max(ts) as last_modified "
    "from commits_90 group by repo, path"
)
check(
    "agg4_file_history",
    "select repo, path, commit_count, contributors, strftime(last_modified, '%Y-%m-%d') as "
    "last_modified, cast(floor(commit_count / max(commit_count) over (partition by repo) * 100 "
    "* 10 + 0.5) as bigint) as churn_tenths from history",
)
check(
    "agg5_contributors",
    "select repo, author, count(*) as commits from (select distinct repo, sha, author, "
    "dense_rank() over (partition by repo order by ts desc, sha) as r from commits) "
    "where r <= 100 group by repo, author",
)
CTES["recent"] = (
    "select distinct repo, path from (select *, dense_rank() over (partition by repo order by "
    "ts desc, sha) as r from commits where change_type = 'M') where r <= 200"
)
check(
    "jn6_recent_file_boost",
    "select f.repo, f.path, r.path is not null as is_recent from files f left join recent r "
    "on r.repo = f.repo and r.path = f.path",
)
check(
    "jn9_diff_snapshots",
    "select repo, change, count(*) as n, array_to_string(list_sort(list(path) filter (r <= 20)), "
    "'|') as paths from (select *, row_number() over (partition by repo, change order by path) "
    "as r from (select repo, path, case when k % 5 = 0 then "
    "'added' when k % 3 = 0 then 'deleted' when k % 7 = 0 then 'modified' end as change "
    "from (select repo, path, strlen(content) as k from corpus) "
    "where not (k % 5 = 0 and k % 3 = 0)) where change is not null) "
    "group by repo, change",
)

# --- complexity and hotspots --------------------------------------------------------------
CTES["complexity"] = (
    "select repo, path, cast(sum(complexity) as bigint) as complexity from functions "
    "group by repo, path"
)
check("agg6_file_complexity", "select * from complexity")
check(
    "agg7_complexity_summary",
    "select repo, count(*) as total_functions, cast(max(complexity) as integer) as max_complexity, "
    "cast(floor(avg(complexity) * 100 + 0.5) as bigint) as avg_hundredths from functions "
    "group by repo",
)
check(
    "win3_complex_functions",
    "select * from (select repo, path, concat_ws('.', owner_class, name) as function, line_no, "
    "cast(complexity as integer) as complexity, row_number() over (partition by repo order by "
    "complexity desc, string_split(path, '/'), line_no, concat_ws('.', owner_class, name)) "
    "as rank from functions where complexity > 10) where rank <= 20",
)
CTES["features"] = (
    "select f.repo, f.path, coalesce(h.commit_count, 0) as commit_count, "
    "coalesce(c.complexity, 1) as complexity, f.code_lines from files f left join history h "
    "on h.repo = f.repo and h.path = f.path left join complexity c on c.repo = f.repo "
    "and c.path = f.path"
)
check("jn2_hotspot_features", "select * from features")
# The largest commit count may belong to a path that no longer exists.
CTES["churn_max"] = "select repo, max(commit_count) as top from history group by repo"
CTES["shares"] = (
    "select f.repo, f.path, f.commit_count / greatest(coalesce(m.top, 1), 1) * 100 as churn, "
    "f.complexity / greatest(coalesce(x.top, 1), 1) * 100 as complex, "
    "f.code_lines / greatest(max(f.code_lines) over (partition by f.repo), 1) * 100 as size "
    "from features f left join churn_max m on m.repo = f.repo left join (select repo, "
    "max(complexity) as top from complexity group by repo) x on x.repo = f.repo"
)
CTES["scores"] = (
    "select *, churn * 0.4::double + complex * 0.35::double + size * 0.25::double as raw from shares"
)
CTES["hotspots"] = (
    "select * from (select *, row_number() over (partition by repo order by round(raw, 1) desc, "
    "string_split(path, '/')) as rank from scores) where rank <= 20"
)
check(
    "win2_hotspots",
    "select repo, path, rank, cast(floor(round(raw, 1) * 10 + 0.5) as bigint) as score_tenths, "
    "raw > 70 and churn > 50 and complex > 50 as is_danger_zone from hotspots",
)

# --- statistics ---------------------------------------------------------------------------
CTES["repos"] = "select distinct repo from corpus"
check(
    "agg1_project_stats",
    "select r.repo, count(f.path) as total_files, cast(coalesce(sum(line_count), 0) as bigint) "
    "as total_lines, cast(coalesce(sum(code_lines), 0) as bigint) as code_lines, "
    "cast(coalesce(sum(blank_lines), 0) as bigint) as blank_lines, "
    "cast(coalesce(sum(comment_lines), 0) as bigint) as comment_lines, "
    "cast(floor(coalesce(avg(size_bytes), 0)) as bigint) as avg_file_size "
    "from repos r left join files f on f.repo = r.repo group by r.repo",
)
CTES["languages"] = (
    "select repo, language, cast(sum(code_lines) as bigint) as code_lines, count(*) as files, "
    "min(string_split(path, '/')) as first_path, sum(code_lines) / greatest(sum(sum(code_lines)) "
    "over (partition by repo), 1) * 100 as share from files group by repo, language"
)
check(
    "agg2_language_breakdown",
    "select repo, language, code_lines, files, cast(floor(share * 10 + 0.5) as bigint) "
    "as share_tenths from languages",
)
check(
    "win7_top_k_per_repo",
    "select * from (select repo, language, code_lines, row_number() over (partition by repo "
    "order by code_lines desc, language) as rank from languages where share >= 1) where rank <= 10",
)
CTES["sized"] = " union all ".join(
    f"select repo, '{dim}' as dim, {expr} as name, size_bytes, code_lines from files"
    for dim, expr in [
        ("directory", _DIR),
        ("language", "language"),
        ("extension", "coalesce(nullif(suffix, ''), '(no ext)')"),
    ]
)
check(
    "agg3_size_breakdown",
    "select repo, dim, name, cast(sum(size_bytes) as bigint) as size_bytes, count(*) as "
    "file_count, cast(sum(code_lines) as bigint) as code_lines, cast(floor(case when "
    "sum(sum(size_bytes)) over w > 0 then sum(size_bytes) / sum(sum(size_bytes)) over w * 100 "
    "else 0 end * 10 + 0.5) as bigint) as tenths from sized group by repo, dim, name "
    "window w as (partition by repo, dim)",
)
check(
    "win1_largest_files",
    "select * from (select repo, path, size_bytes, row_number() over (partition by repo order by "
    "size_bytes desc, string_split(path, '/')) as rank from files) where rank <= 10",
)
check(
    "flt4_find_files",
    "select * from (select repo, path, row_number() over (partition by repo order by path) as rank "
    "from corpus where contains(lower(path), 'm1'))",
)

# --- entry points -------------------------------------------------------------------------
CTES["flagged"] = (
    "select repo, path from (select * from py_flags union all select * from js_flags union all "
    "select * from go_flags union all select * from rust_flags) where entry_point union "
    f"select repo, path from files where name in {_in(dims.ENTRY_POINT_NAMES)} union "
    "select repo, path from py_defs where owner_class is null and "
    f"regexp_matches(lower(decorators), '{'|'.join(dims.ROUTE_WORDS)}')"
)
CTES["entries"] = (
    "select repo, path, 0 as origin, 0 as ordinal from flagged union all select repo, path, 1, "
    "min(ordinal) from scripts s where not exists (select 1 from flagged f where f.repo = s.repo "
    "and f.path = s.path) group by repo, path"
)
check(
    "set2_entry_points",
    "select repo, path, origin, cast(ordinal as integer) as ordinal from entries",
)
check(
    "prj10_classify_entry_point",
    "select repo, type, count(*) as n from (select repo, lower(string_split(path, '/')[-1]) as n, "
    "case when contains(n, 'cli') or contains(n, 'command') then 'CLI' when contains(n, 'main') "
    "then 'Main' when contains(n, 'app') or contains(n, 'server') then 'Application' "
    "when contains(n, 'route') or contains(n, 'api') then 'API' when contains(n, 'index') then "
    "'Index' when contains(n, 'manage') then 'Management' else 'Entry' end as type from entries) "
    "group by repo, type",
)
CTES["roles"] = (
    "select * from (values " + _values(list(dims.DIRECTORY_ROLES.items())) + ") as v(dir, role)"
)
CTES["file_roles"] = (
    "select f.repo, coalesce(r.role, 'Project directory') as role, f.size_bytes, f.code_lines "
    "from files f left join roles r on r.dir = lower(string_split(f.path, '/')[1]) "
    "where contains(f.path, '/')"
)
check(
    "prj11_directory_roles",
    "select repo, role, count(*) as files, cast(sum(size_bytes) as bigint) as size_bytes, "
    "cast(sum(code_lines) as bigint) as code_lines from file_roles group by repo, role union all "
    "select distinct e.repo, coalesce(r.role, 'Project directory'), 0, 0, 0 from entries e "
    "left join roles r on r.dir = lower(string_split(e.path, '/')[1]) where contains(e.path, '/') "
    "and e.repo not in (select repo from file_roles)",
)
check(
    "jn7_annotate_file_tree",
    "select f.repo, f.path, f.code_lines, f.rank, exists (select 1 from entries e where "
    "e.repo = f.repo and e.path = f.path) as is_entry, exists (select 1 from scores h where "
    "h.repo = f.repo and h.path = f.path and h.raw > 70 and h.churn > 50 and h.complex > 50) "
    "as is_danger from (select *, row_number() over (partition by repo order by path) as rank "
    "from files) f",
)

# --- markers and findings -----------------------------------------------------------------
_MARK = (
    "upper(regexp_extract(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(FIXME|BUG|XXX|TODO|HACK|OPTIMIZE|NOTE)"
    "(?:$|[^\\p{L}\\p{N}_])', 1))"
)
CTES["markers"] = (
    "select repo, path, line_no, marker_type, case when marker_type in ('FIXME', 'BUG', 'XXX') "
    "then 'critical' when marker_type = 'NOTE' then 'info' else 'warning' end as severity, text, "
    "concat(coalesce(concat(before, chr(10)), ''), text, coalesce(concat(chr(10), after), '')) "
    f"as context from (select *, {_MARK} as marker_type, lag(text) over w as before, "
    "lead(text) over w as after from lines window w as (partition by repo, path order by line_no)) "
    "where marker_type <> ''"
)
check(
    "mrk1_scan_markers",
    "select repo, path, line_no, marker_type, severity, trim(text) as text from markers",
)
check(
    "win4_marker_context",
    "select repo, path, line_no, md5(context) as context_md5 from markers",
)
check(
    "flt1_markers_by_severity",
    "select repo, path, line_no from markers where severity = 'critical'",
)
check(
    "agg8_marker_counts",
    "select repo, 'total' as dim, '' as name, count(*) as n from markers group by repo union all "
    + " union all ".join(
        f"select repo, '{dim}', {col}, count(*) from markers group by repo, {col}"
        for dim, col in [("severity", "severity"), ("type", "marker_type"), ("file", "path")]
    ),
)


def _rule_selects() -> str:
    """One select per rule; boundaries and look-ahead in the form of the other engine."""
    selects = []
    for i, (pattern, severity, category, title, description, tests, comments) in enumerate(
        dims.SECURITY_RULES
    ):
        pattern = pattern.replace(dims._S, r"\s").replace("(?iu)", "(?i)")
        pattern = pattern.replace(dims._B, r"(?:^|[^\p{L}\p{N}_])")
        text = "text"
        if "(?!" in pattern:
            # Hosts that may be reached without encryption are taken out before the search.
            pattern = pattern.split("(?!")[0]
            safe = r"http://(localhost|127\.0\.0\.1|0\.0\.0\.0)"
            text = f"regexp_replace(text, '{safe}', '', 'g')"
        pattern, title, description = (
            v.replace("'", "''") for v in (pattern, title, description)
        )
        where = f"regexp_matches({text}, '{pattern}')"
        where += f" and not {_TEST_SECURITY}" if tests else ""
        where += f" and not {_COMMENT}" if comments else ""
        selects.append(
            f"select repo, path, line_no, {i} as rule_id, '{severity}' as severity, '{category}' "
            f"as category, '{title}' as title, '{description}' as description, rtrim(text) "
            f"as line_text from lines where {where}"
        )
    return " union all ".join(selects)


CTES["findings"] = _rule_selects()
check(
    "jn3_match_rules",
    "select repo, path, line_no, rule_id, severity, category, title, description, "
    "md5(line_text) as line_md5 from findings",
)
check(
    "jn3_match_rule_table",
    "select repo, path, line_no, cast(rule_id as varchar) as rule_id, severity, category, title, "
    "description, md5(line_text) as line_md5 from findings union all "
    "select l.repo, l.path, l.line_no, r.rule_id, r.severity, r.category, r.title, r.description, "
    "md5(rtrim(l.text)) from lines l join name_rules r on regexp_matches(l.text, r.pattern) "
    f"where not {_TEST_SECURITY}",
)
check(
    "flt2_findings_min_severity",
    "select repo, path, line_no, rule_id from findings where severity <> 'low'",
)
check(
    "agg9_finding_counts",
    "select repo, 'total' as dim, '' as name, count(*) as n from findings group by repo union all "
    "select repo, 'severity', severity, count(*) from findings group by repo, severity union all "
    "select repo, 'category', category, count(*) from findings group by repo, category",
)
CTES["risk"] = (
    "select r.repo, count(f.path) as findings, "
    + ", ".join(
        f"count(*) filter (f.severity = '{s}') as n_{s}, list_sort(list_distinct(list(f.title) "
        f"filter (f.severity = '{s}'))) as t_{s}"
        for s in dims.SEVERITIES
    )
    + ", cast(least(100, "
    + " + ".join(
        f"least({points} * count(*) filter (f.severity = '{s}'), {cap})"
        for s, (points, cap) in dims.SEVERITY_POINTS.items()
    )
    + ") as integer) as risk_score from repos r left join findings f on f.repo = r.repo "
    "group by r.repo"
)
check("agg10_risk_score", "select repo, findings, risk_score from risk")
check("snk4_ci_gate", "select repo, n_critical + n_high > 0 as gate_failed from risk")
check(
    "agg11_risk_summary",
    "select repo, case when findings = 0 then 'No security issues detected. Risk score: 0/100.' "
    "else concat('Found ', findings, ' potential security issue', case when findings = 1 then '' "
    "else 's' end, ': ', concat_ws(', ', "
    + ", ".join(
        f"case when n_{s} > 0 then concat(n_{s}, ' {s} (', lower(array_to_string(t_{s}[1:2], "
        "', ')), ')') end"
        for s in dims.SEVERITIES
    )
    + "), '. Risk score: ', risk_score, '/100.') end as summary from risk",
)

# --- detection ----------------------------------------------------------------------------
CTES["paths"] = "select repo, path, string_split(path, '/') as comps from corpus"
CTES["root_dirs"] = (
    "select distinct repo, comps[1] as dir from paths where len(comps) > 1 union "
    "select distinct repo, concat(comps[1], '/', comps[2]) from paths where len(comps) > 2"
)
CTES["root_names"] = "select repo, path as name from paths"
CTES["service_count"] = (
    "select repo, count(distinct comps[2]) as n from paths where len(comps) = 3 and comps[1] = "
    f"'services' and comps[3] in {_in(dims.SERVICE_CONFIGS)} group by repo"
)


def _file(*names: str) -> str:
    return (
        f"(exists (select 1 from root_names x where x.repo = r.repo and x.name in {_in(names)}))"
    )


def _dir(*names: str) -> str:
    return f"(exists (select 1 from root_dirs x where x.repo = r.repo and x.dir in {_in(names)}))"


from codecorpus.operators.detect import ROOT_DIRS, ROOT_FILES  # noqa: E402

_MANY = "coalesce((select n from service_count s where s.repo = r.repo), 0) >= 2"
check(
    "jn8_root_markers",
    "select r.repo, coalesce((select array_to_string(list_sort(list(name)), '|') from root_names x "
    f"where x.repo = r.repo and name in {_in(ROOT_FILES)}), '') as files, coalesce((select "
    "array_to_string(list_sort(list(dir)), '|') from root_dirs x where x.repo = r.repo and dir in "
    f"{_in(ROOT_DIRS)}), '') as dirs, {_MANY} as many_services from repos r",
)
CTES["code_languages"] = (
    "select repo, language, count(*) as files, min(string_split(path, '/')) as first_path "
    f"from files where language not in {_in(dims.NON_CODE_LANGUAGES)} group by repo, language"
)
CTES["primary_language"] = (
    "select r.repo, coalesce((select c.language from code_languages c where c.repo = r.repo "
    "order by c.files desc, c.first_path limit 1), "
    + ", ".join(f"case when {_file(f)} then '{lang}' end" for f, lang in dims.LANGUAGE_MARKERS)
    + ", 'Other') as language from repos r"
)
check(
    "agg14_language_counts",
    "select p.repo, p.language as primary_language, c.language, c.files from primary_language p "
    "left join code_languages c on c.repo = p.repo",
)


def _text_of(name: str) -> str:
    return f"coalesce((select max(content) from corpus x where x.repo = r.repo and x.path = '{name}'), '')"


_NPM_NAMES = (
    "coalesce(list_concat(json_keys(nullif({t}, ''), '$.dependencies'), "
    "json_keys(nullif({t}, ''), '$.devDependencies')), [])"
)
CTES["repo_texts"] = (
    f"select r.repo, {_text_of('pyproject.toml')} as pyproject, {_text_of('requirements.txt')} "
    f"as requirements, {_text_of('package.json')} as package_json from repos r"
)
CTES["framework_hits"] = " union all ".join(
    [
        f"select r.repo, {i} as i, '{fw}' as fw from repos r where {_file(name)}"
        for i, (name, fw) in enumerate(dims.FRAMEWORK_MARKERS)
    ]
    + [
        f"select repo, {20 + i}, '{fw}' from repo_texts where list_contains("
        f"{_NPM_NAMES.format(t='package_json')}, '{name}')"
        for i, (name, fw) in enumerate(dims.FRAMEWORK_PACKAGES_JS)
    ]
    + [
        f"select repo, {40 + 10 * j + i}, '{fw}' from repo_texts where "
        f"contains(lower({column}), '{name}')"
        for j, column in enumerate(["pyproject", "requirements"])
        for i, (name, fw) in enumerate(dims.FRAMEWORK_PACKAGES_PYTHON)
    ]
)
CTES["frameworks"] = (
    "select repo, list(fw order by i) as fws from (select repo, fw, min(i) as i from "
    "framework_hits group by repo, fw) group by repo"
)
check(
    "det1_frameworks",
    "select r.repo, coalesce(array_to_string(f.fws, '|'), '') as frameworks from repos r "
    "left join frameworks f on f.repo = r.repo",
)
check(
    "det2_package_manager",
    "select r.repo, coalesce("
    + ", ".join(f"case when {_file(f)} then '{pm}' end" for f, pm in dims.PACKAGE_MANAGERS)
    + ") as package_manager from repos r",
)
_HAS_TESTS = f"({_dir(*dims.TEST_DIRS)} or {_file(*dims.TEST_CONFIGS)})"
_HAS_CI = f"({_dir(*dims.CI_DIRS)} or {_file(*dims.CI_FILES, *dims.CI_DIRS)})"
_HAS_DOCKER = _file(*dims.DOCKER_FILES)
check(
    "det3_project_features",
    f"select r.repo, {_HAS_TESTS} as has_tests, {_HAS_CI} as has_ci, {_HAS_DOCKER} as has_docker, "
    f"{_dir('docs')} or {_file('README.md')} as has_docs from repos r",
)
_FRONT, _BACK = _dir(*dims.FRONTEND_DIRS), _dir(*dims.BACKEND_DIRS)
_SCRIPTS = (
    "(select contains(t.pyproject, '[project.scripts]') or contains(t.pyproject, "
    "'console_scripts') from repo_texts t where t.repo = r.repo)"
)


def _uses(*names: str) -> str:
    return (
        "(exists (select 1 from framework_hits h where h.repo = r.repo and h.fw in "
        f"{_in(names)}))"
    )


_MVC = "(" + " + ".join(f"cast({_dir(d)} as integer)" for d in dims.MVC_DIRS) + ")"
_SIGNALS = {
    "Monorepo": [
        (_dir("packages"), 3), (_dir("apps"), 3), (_file("lerna.json"), 5),
        (_file("pnpm-workspace.yaml"), 5), (_file("nx.json"), 5),
    ],
    "MVC": [(_uses("Django"), 3), (_uses("Rails"), 3)],
    "Microservices": [(_dir("services"), 3), (_MANY, 4), (_file("docker-compose.yml"), 1)],
    "Serverless": [
        (_file("serverless.yml", "serverless.yaml"), 5), (_file("sam.yaml", "template.yaml"), 5),
        (_file("netlify.toml", "vercel.json"), 2),
    ],
    "CLI Tool": [(_SCRIPTS, 4), (_dir("bin"), 2)],
    "Library": [(_dir("src/lib", "lib"), 2), (_file("setup.py"), 2)],
    "Fullstack": [(f"({_FRONT} and {_BACK})", 4), (_uses("Next.js"), 3)],
    "API Service": [(f"({_BACK} and not {_FRONT})", 3), (_uses("FastAPI", "Express"), 2)],
    "Static Site": [(_file(*dims.STATIC_SITE_FILES), 5)],
}
CTES["architecture_points"] = " union all ".join(
    f"select r.repo, {i} as i, '{pattern}' as pattern, "
    + " + ".join(f"case when {test} then {points} else 0 end" for test, points in signals)
    + (f" + case when {_MVC} >= 2 then 2 * {_MVC} else 0 end" if pattern == "MVC" else "")
    + " as points from repos r"
    for i, (pattern, signals) in enumerate(_SIGNALS.items())
)
CTES["architecture"] = (
    "select repo, case when points = 0 then 'Unknown' else pattern end as architecture from "
    "(select *, row_number() over (partition by repo order by points desc, i) as n "
    "from architecture_points) where n = 1"
)
check("det4_architecture_scored", "select repo, architecture from architecture")
_FRONT_APP = _dir(*dims.FRONTEND_DIRS, "app")
check(
    "det5_architecture_first_match",
    f"select r.repo, case when {_dir('packages', 'apps')} or "
    f"{_file('lerna.json', 'pnpm-workspace.yaml')} then 'Monorepo' when "
    f"{_dir('services', 'microservices')} then 'Microservices' when "
    f"{_file('serverless.yml', 'sam.yaml')} then 'Serverless' when {_FRONT_APP} and {_BACK} "
    f"then 'Fullstack' when {_dir(*dims.MVC_DIRS)} then 'MVC' when {_BACK} and not {_FRONT_APP} "
    f"then 'API Service' when p.language = 'Python' and {_SCRIPTS} then 'CLI Tool' when "
    f"{_dir('src')} and not {_FRONT_APP} then 'Library' else 'Unknown' end as "
    "first_match_architecture from repos r join primary_language p on p.repo = r.repo",
)
CTES["totals"] = (
    "select repo, count(*) as files, sum(code_lines) as code_lines, sum(comment_lines) as "
    "comment_lines from files group by repo"
)
CTES["first_entry"] = (
    "select repo, count(*) as n, string_split(arg_min(path, {'o': origin, 'n': ordinal, "
    "'p': string_split(path, '/')}), '/')[-1] as name from entries group by repo"
)
CTES["top_languages"] = (
    "select repo, count(*) as n, array_to_string(list(concat(language, ' (', printf('%.1f', "
    "round(share, 1)), '%)') order by code_lines desc, first_path)[1:3], ', ') as names "
    "from languages group by repo"
)
check(
    "det6_explain_project",
    "select r.repo, concat_ws(' ', concat('This is a ', p.language, ' ', lower(a.architecture), "
    "case when f.fws is not null then concat(' using ', array_to_string(f.fws[1:2], ' and ')) "
    "else '' end, '.'), case when t.code_lines > 0 then concat('It contains ', format('{:,}', "
    "t.files), ' files with ', format('{:,}', cast(t.code_lines as bigint)), "
    "' lines of code across ', l.n, ' language(s).') end, case when l.n > 1 then "
    "concat('Primary languages: ', l.names, '.') end, case when e.n > 0 then concat('There are ', "
    "e.n, ' entry point(s), starting from ', e.name, '.') end, (select case when count(*) > 0 then "
    "concat('The project depends on ', count(*), ' external package(s).') end from packages k "
    f"where k.repo = r.repo), case when {_HAS_TESTS} or {_HAS_CI} or {_HAS_DOCKER} then "
    f"concat('It includes ', concat_ws(', ', case when {_HAS_TESTS} then 'tests' end, "
    f"case when {_HAS_CI} then 'CI/CD' end, case when {_HAS_DOCKER} then 'Docker' end), '.') end) "
    "as explanation from repos r join primary_language p on p.repo = r.repo join architecture a "
    "on a.repo = r.repo left join frameworks f on f.repo = r.repo left join totals t on "
    "t.repo = r.repo left join top_languages l on l.repo = r.repo left join first_entry e "
    "on e.repo = r.repo",
)

# --- health -------------------------------------------------------------------------------
CTES["function_totals"] = (
    "select repo, count(*) as n, sum(complexity) as complexity from functions group by repo"
)
CTES["cycle_totals"] = "select repo, count(*) as n from cycles group by repo"
CTES["h_quality"] = (
    "select repo, (case when ratio between 0.1::double and 0.3::double then 100.0 when ratio < "
    "0.1::double then ratio / 0.1::double * 100 else greatest(0, 100 - (ratio - 0.3::double) / "
    "0.3::double * 100) end + case when n = 0 then 50.0 when c <= 5 then 100 when c <= 10 then "
    "100 - (c - 5) / 5 * 50 else greatest(0, 50 - (c - 10) / 10 * 50) end + case when n = 0 then "
    "50.0 when len <= 50 then 100 else greatest(0, 100 - (len - 50) / 50 * 100) end) / 3 as score "
    "from (select t.repo, t.comment_lines / greatest(t.code_lines, 1) as ratio, coalesce(f.n, 0) "
    "as n, f.complexity / f.n as c, greatest(t.code_lines, 1) / f.n as len from totals t "
    "left join function_totals f on f.repo = t.repo)"
)
_STANDARD = "(" + " + ".join(f"cast({_dir(d)} as integer)" for d in dims.STANDARD_DIRS) + ")"
CTES["line_spread"] = (
    "select repo, count(*) filter (line_count > 0) as n, stddev_pop(line_count) filter "
    "(line_count > 0) as sigma, count(*) filter (line_count > 500) as large, "
    f"count(*) filter ({_TEST_HEALTH}) as tests, count(*) filter (not {_TEST_HEALTH}) as plain, "
    "count(*) filter (ends_with(path, '.py')) as py, count(*) filter (ends_with(path, '.py') "
    "and comment_lines > 0) as py_commented from files group by repo"
)
CTES["h_organization"] = (
    "select r.repo, (case when s.n >= 2 then greatest(0, 100 - s.sigma / 500 * 100) else 50 end + "
    f"case when {_STANDARD} > 0 then least(100, {_STANDARD} * 50) else 20 end + 100 - "
    "least(100, s.large * 20)) / 3 as score from repos r join line_spread s on s.repo = r.repo"
)
CTES["h_testing"] = (
    f"select r.repo, (case when {_HAS_TESTS} then 100.0 else 0 end + case when s.plain = 0 then 0 "
    "when s.tests / s.plain >= 0.5 then 100 else s.tests / s.plain / 0.5::double * 100 end) / 2 "
    "as score from repos r join line_spread s on s.repo = r.repo"
)
_README = _file(*dims.README_NAMES)
_CONFIG_TEXT = (
    "concat_ws(', ', "
    + ", ".join(f"case when {_file(f)} then '{f}' end" for f in dims.CONFIG_FILES)
    + ")"
)
CTES["h_documentation"] = (
    f"select r.repo, (case when {_README} then 100.0 else 0 end + case when s.py = 0 then 50 "
    f"else s.py_commented / s.py * 100 end + case when {_file(*dims.CONFIG_FILES)} then 100 "
    f"else 0 end) / 3 as score, concat_ws('|', case when {_README} then 'README found' else "
    "'No README found' end, case when s.py > 0 then concat(s.py_commented, '/', s.py, "
    "' Python files have docstrings/comments') else 'No Python files to check for docstrings' end, "
    f"case when {_file(*dims.CONFIG_FILES)} then concat('Config files: ', {_CONFIG_TEXT}) else "
    "'No project config files found' end) as details from repos r join line_spread s "
    "on s.repo = r.repo"
)
_GITIGNORE = _file(".gitignore")
CTES["h_maintenance"] = (
    f"select r.repo, (case when {_HAS_CI} then 100.0 else 0 end + case when {_GITIGNORE} then 100 "
    f"else 0 end + case when {_HAS_DOCKER} then 100 else 0 end + 100 - least(100, coalesce(c.n, 0) "
    f"* 25)) / 4 as score, concat_ws('|', case when {_HAS_CI} then 'CI/CD configuration detected' "
    f"else 'No CI/CD configuration detected' end, case when {_GITIGNORE} then '.gitignore found' "
    f"else 'No .gitignore found' end, case when {_HAS_DOCKER} then 'Docker setup detected' else "
    "'No Docker setup detected' end, case when c.n > 0 then concat(c.n, ' circular dependency "
    "chain(s) found') else 'No circular dependencies detected' end) as details from repos r "
    "left join cycle_totals c on c.repo = r.repo"
)
_HUNDREDTHS = "cast(floor(score * 100 + 0.5) as bigint) as score_hundredths"
check("agg15_health_code_quality", f"select repo, {_HUNDREDTHS} from h_quality")
check("agg16_health_organization", f"select repo, {_HUNDREDTHS} from h_organization")
check("agg17_health_testing", f"select repo, {_HUNDREDTHS} from h_testing")
check("agg18_health_documentation", f"select repo, {_HUNDREDTHS}, details from h_documentation")
check("agg19_health_maintenance", f"select repo, {_HUNDREDTHS}, details from h_maintenance")
CTES["h_all"] = " union all ".join(
    f"select repo, {i} as i, '{name}' as name, {weight} as weight, score from {table}"
    for i, ((name, weight), table) in enumerate(
        zip(
            dims.HEALTH_WEIGHTS,
            ["h_quality", "h_organization", "h_testing", "h_documentation", "h_maintenance"],
            strict=True,
        )
    )
)
check(
    "agg20_health_report",
    "select repo, cast(floor(round(total, 1) * 10 + 0.5) as bigint) as overall_tenths, case when "
    "total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' when total >= 60 "
    "then 'D' else 'F' end as grade from (select repo, sum(score * (weight / 100) order by i) "
    "as total from h_all group by repo)",
)
CTES["advice"] = (
    "select * from (values " + _values(dims.HEALTH_ADVICE) + ") as v(name, low, high, advice)"
)
check(
    "agg21_health_recommendations",
    "select h.repo, coalesce(string_agg(a.advice, '|' order by h.i), '') as recommendations "
    "from h_all h left join advice a on a.name = h.name and h.score >= a.low and h.score < a.high "
    "group by h.repo",
)

# --- search -------------------------------------------------------------------------------
CTES["asked"] = (
    "select query_id, query, regexp_replace(query, '\"[^\"]+\"', '', 'g') as plain from searches"
)


def _last(kind: str) -> str:
    return f"lower(nullif(regexp_extract_all(plain, '(?i){kind}:(\\S+)', 1)[-1], ''))"


CTES["prepared"] = (
    "select query_id, list_filter(list_transform(regexp_extract_all(regexp_replace(plain, "
    "'(?i)(lang|type|in):\\S+', '', 'g'), '[a-zA-Z0-9_]+'), lambda x: lower(x)), "
    f"lambda x: x not in {_in(dims.STOP_WORDS)}) as keywords, "
    "regexp_extract_all(query, '\"([^\"]+)\"', 1) as phrases, "
    f"{_last('lang')} as lang_f, {_last('type')} as type_f, {_last('in')} as in_f from asked"
)
check(
    "sch1_prepare_searches",
    "select query_id, array_to_string(keywords, '|') as keywords, array_to_string(phrases, '|') "
    "as exact_phrases, lang_f as language_filter, type_f as type_filter, in_f as filename_filter "
    "from prepared",
)
CTES["synonyms"] = (
    "select * from (values "
    + _values([(w, o) for w, others in dims.SYNONYMS.items() for o in others])
    + ") as v(token, synonym)"
)
CTES["keyword_rows"] = (
    "select query_id, i as term_no, keywords[i] as token from prepared, "
    "unnest(range(1, len(keywords) + 1)) as r(i)"
)
CTES["related"] = (
    "select distinct k.query_id, s.synonym as token from keyword_rows k join synonyms s "
    "on s.token = k.token where not exists (select 1 from keyword_rows o where "
    "o.query_id = k.query_id and o.token = s.synonym)"
)
check("jn4_expand_synonyms", "select * from related")
CTES["phrase_words"] = (
    "select query_id, list_filter(string_split(lower(array_to_string(phrases, ' ')), ' '), "
    "lambda x: x <> '') as ws from prepared"
)
CTES["terms"] = (
    "select query_id, 0 as pass, min(term_no) as term_no, token from keyword_rows "
    "group by query_id, token union all select query_id, 1, 0, token from related union all "
    "select query_id, 2, i, ws[i] from phrase_words, unnest(range(1, len(ws) + 1)) as r(i)"
)
_W = "[\\p{L}\\p{N}_]"
_FN = [
    f"'^\\s*(?:async\\s+)?def\\s+({_W}+)'",
    f"'(?:function\\s+|(?:const|let|var)\\s+)({_W}+)'",
    f"'^func\\s+(?:\\({_W}+\\s+\\*?{_W}+\\)\\s+)?({_W}+)'",
    f"'^\\s*(?:pub\\s+)?(?:async\\s+)?fn\\s+({_W}+)'",
]
_JS_FN = f"'function\\s+{_W}+|(?:const|let|var)\\s+{_W}+\\s*=\\s*(?:async\\s*)?\\('"
CTES["kinds"] = (
    "select repo, path, language, line_no, text, coalesce(nullif(regexp_extract(text, "
    f"{_FN[0]}, 1), ''), nullif(regexp_extract(regexp_extract(text, {_JS_FN}), {_FN[1]}, 1), ''), "
    f"nullif(regexp_extract(text, {_FN[2]}, 1), ''), nullif(regexp_extract(text, {_FN[3]}, 1), '')) "
    f"as function_name, coalesce(nullif(regexp_extract(text, '(?:^|\\s)class\\s+({_W}+)', 1), ''), "
    f"nullif(regexp_extract(text, '^\\s*(?:pub\\s+)?struct\\s+({_W}+)', 1), '')) as class_name, "
    "case when contains(text, '#') or contains(text, '//') then 'comment' when regexp_matches("
    "trim(text), '^(import\\s+\\S|from\\s+\\S+\\s+import\\s+\\S|use\\s+[\\p{L}\\p{N}_:]|"
    "(const|let|var)\\s+.+=\\s*require\\(.+\\))') then 'import' when class_name is not null "
    "then 'class' when function_name is not null then 'function' else 'content' end as kind "
    "from lines"
)
check(
    "sch3_line_kind",
    "select repo, path, line_no, kind, function_name, class_name from kinds",
)
CTES["line_words"] = (
    "select repo, path, language, line_no, text, kind, unnest(list_filter(list_transform("
    f"regexp_extract_all(text, '[a-zA-Z_]{_W}*'), lambda x: lower(x)), lambda x: length(x) >= 2)) "
    "as token from kinds"
)
check(
    "sch2_tokenize",
    "select token, count(*) as n, cast(sum(line_no) as bigint) as lines from line_words "
    "group by token",
)
# ord: definitions come before the words of a line, file names after.
CTES["postings"] = (
    "select repo, path, language, line_no, text, 0 as ord, lower(function_name) as token, "
    "'function' as kind from kinds where function_name is not null union all "
    "select repo, path, language, line_no, text, 1, lower(class_name), 'class' from kinds "
    "where class_name is not null union all "
    "select repo, path, language, line_no, text, 2, token, kind from line_words union all "
    "select repo, path, language, 1, string_split(content, chr(10))[1], 3, token, 'filename' "
    "from (select *, unnest(list_filter(list_transform(regexp_extract_all(substr(name, 1, "
    f"length(name) - length(suffix)), '[a-zA-Z_]{_W}*'), lambda x: lower(x)), "
    "lambda x: length(x) >= 2)) as token from spoken)"
)
_ENTRIES = (
    "count(*) as postings, md5(string_agg(concat(line_no, ':', kind), '|' order by "
    "concat(line_no, ':', kind))) as entries_md5"
)
check(
    "sch4_build_index",
    f"select token, repo, path, {_ENTRIES} from postings group by token, repo, path",
)
CTES["found"] = (
    "select p.*, t.query_id, t.pass, t.term_no, q.keywords, q.phrases, q.lang_f, q.type_f, q.in_f "
    "from postings p join terms t on t.token = p.token join prepared q on q.query_id = t.query_id"
)
check(
    "jn5_lookup_postings",
    f"select query_id, pass, term_no - 1 + cast(pass = 1 as integer) as term_no, token, repo, path, "
    f"{_ENTRIES} from found group by query_id, pass, term_no, token, repo, path",
)
_PASSES = (
    "(lang_f is null or contains(lower(language), lang_f)) and (type_f is null or type_f not in "
    "('function', 'class') or type_f = kind) and (in_f is null or "
    "contains(lower(string_split(path, '/')[-1]), in_f))"
)
check(
    "flt3_search_filters",
    "select distinct query_id, repo, path, line_no, token, kind from found "
    f"where pass = 0 and {_PASSES}",
)
_SCORE = (
    "case when kind in ('function', 'class') then 5 when kind = 'filename' then 3 else 1 end "
    "* case when pass = 1 then 3 else 10 end * case when {recent} then 12 else 10 end * case when "
    f"not (list_contains(keywords, 'test') or contains(lower(array_to_string(phrases, chr(0))), "
    f"'test')) and {_TEST_SEARCH} then 8 else 10 end"
)
_TENS = "pow(10, len(list_filter(phrases, lambda x: contains(lower(text), lower(x)))))"
check(
    "sch5_score_postings",
    "select query_id, pass, kind, repo, path, count(*) as postings, cast(sum("
    + _SCORE.format(recent="false")
    + f") as bigint) as score_milli from found where {_PASSES} "
    "group by query_id, pass, kind, repo, path",
)
CTES["scored"] = (
    "select *, cast("
    + _SCORE.format(recent="(repo, path) in (select (repo, path) from recent)")
    + f" * {_TENS} as bigint) as s from found where {_PASSES}"
)
CTES["hit_lines"] = (
    "select query_id, repo, path, line_no, cast(sum(s) as bigint) as score_milli, arg_min(kind, "
    "{'a': pass, 'b': term_no, 'c': token, 'd': ord}) as kind, md5(min(text)) as context_md5 from scored "
    "group by query_id, repo, path, line_no"
)
CTES["ranked"] = (
    "select *, row_number() over (partition by query_id order by score_milli desc, repo, "
    "string_split(path, '/'), line_no) as rank from hit_lines"
)
check(
    "sch6_rank_search",
    "select query_id, rank, repo, path, line_no, kind, score_milli, context_md5 from ranked "
    "where rank <= 30",
)
check(
    "win6_top_results",
    "select query_id, rank, repo, path, line_no from ranked where rank <= 20",
)
check(
    "agg22_group_results_by_file",
    "select query_id, repo, path, min(rank) as best_rank, count(*) as matches, "
    "string_agg(cast(line_no as varchar), '|' order by rank) as hits from ranked "
    "where rank <= 30 group by query_id, repo, path",
)
check(
    "win5_result_context",
    "select r.query_id, r.rank, l.line_no as context_line_no, md5(l.text) as text_md5 from ranked r "
    "join lines l on l.repo = r.repo and l.path = r.path and l.line_no between r.line_no - 3 and "
    "r.line_no + 3 where r.rank <= 30",
)
