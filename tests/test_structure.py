import itertools
import json

from pyspark.sql import functions as F

from codecorpus.operators import extract, graph, report
from codecorpus.plans.analysis import CorpusAnalysis
from codecorpus.sources import corpus

PYTHON = '''"""def no(): if and"""
import os, json as js
from . import (a,
    b as c)

@app.get("/x",
         k=(1, 2))
@cached
async def f(self, a: Dict[str, int], b=(1, 2), /, c=3, *, d=4):
    # if and or
    async for x in y:
        pass
    z = [q for q in a
         for r in q if r]
    return 'if or' if a and b else None

class K(Base, m.N, G[int], metaclass=M):
    """text"""
    x = 1

    def run(self, n):
        def inner():
            while n: pass
        assert n

    if x:
        def hidden(self): pass
'''


def test_python_structure(raw):
    modules = extract.extract_modules(corpus.build_files(raw(("r", "x.py", PYTHON))))
    functions = [
        (f.name, f.line_no, f.owner_class, f.is_async, f.decorators, f.parameters, f.complexity)
        for f in extract.functions(modules).collect()
    ]
    assert functions == [
        ("f", 9, None, True, ["app.get", "cached"], ["c"], 4),
        ("run", 21, "K", False, [], ["n"], 3),
    ]
    classes = [(c.name, c.line_no, c.bases) for c in extract.classes(modules).collect()]
    assert classes == [("K", 17, ["Base", "m.N", "unknown"])]
    imports = [(i.module, i.names, i.is_relative) for i in extract.imports(modules).collect()]
    assert imports == [("os", ["os"], False), ("json", ["js"], False), ("", ["a", "b"], True)]


def test_other_languages(raw):
    modules = extract.extract_modules(
        corpus.build_files(
            raw(
                ("r", "a.js", "x();\nexport function f(a: T,\n b) {}\nconst g = (x) => 1\n"
                              "function f() {}\n" + "a;" * 400 + "function long() {}"),
                ("r", "b.go", "package main\n\nfunc (s *T) Do(a int,\n b string) {}\nfunc main() {}"),
                ("r", "c.rs", "pub fn a<T>(x: i32, &self) {}\nfn b() {}\npub struct S;"),
                ("r", "d.java", "import x.y;\nfunction q (1)"),
            )
        )
    )
    found = {
        (f.path, f.name): (f.line_no, f.parameters) for f in extract.functions(modules).collect()
    }
    assert found == {
        ("a.js", "f"): (2, ["a", "b"]),
        ("a.js", "g"): (4, []),
        ("a.js", "long"): (6, []),
        ("b.go", "Do"): (3, ["a", "b"]),
        ("b.go", "main"): (5, []),
        ("c.rs", "a"): (1, ["x"]),
        ("c.rs", "b"): (2, []),
        ("d.java", "q"): (2, []),
    }
    flags = {r.path: r.entry_point for r in modules.collect()}
    assert flags == {"a.js": False, "b.go": True, "c.rs": False, "d.java": False}


def test_cycles_against_brute_force(spark):
    pairs = [(0, 1), (1, 0), (1, 2), (2, 0), (2, 3), (3, 1), (4, 4), (3, 5), (5, 6)]
    rows = [("a", f"n{s}", f"n{t}") for s, t in pairs] + [("b", "n0", "n1"), ("b", "n2", "n0")]
    edges = spark.createDataFrame(rows, "repo string, source string, target string")
    links = set(pairs)
    expected = []
    for size in range(1, 8):
        for nodes in itertools.permutations(range(7), size):
            closed = [*nodes, nodes[0]]
            if nodes[0] == min(nodes) and all(e in links for e in itertools.pairwise(closed)):
                expected.append((size, [f"n{x}" for x in closed]))
    got = [(r.repo, r.nodes, r.cycle) for r in graph.circular_deps(edges).orderBy("rank").collect()]
    assert got == [("a", n, c) for n, c in sorted(expected)]


def test_json_export_is_whole_and_valid(spark, raw):
    files = raw(
        ("r", "pkg/a.py", "import pkg.b\ndef f():\n    pass\n"),
        ("r", "pkg/b.py", "import pkg.a\n"),
        ("r", "README.md", "# hi\n"),
        ("s", "main.go", "package main\nfunc main() {}\n"),
    )
    log = spark.createDataFrame(
        [("r", "1", "ann", "pkg/a.py", "M")],
        "repo string, sha string, author string, path string, change_type string",
    ).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    analysis = CorpusAnalysis(files, log, F.to_timestamp(F.lit("2024-01-02")))
    rows = report.export_json(analysis.report_input).orderBy("section", "item").collect()
    documents = {}
    for row in rows:
        documents[row.repo] = documents.get(row.repo, "") + row.line
    r, s = json.loads(documents["r"]), json.loads(documents["s"])
    assert [f["path"] for f in r["files"]] == ["README.md", "pkg/a.py", "pkg/b.py"]
    assert r["dependencies"]["circular"] == [["pkg/a.py", "pkg/b.py", "pkg/a.py"]]
    assert r["hotspots"][0]["path"] == "pkg/a.py"
    assert s["entryPoints"] == ["main.go"]
    assert s["project"]["primaryLanguage"] == "Go"


def test_brackets_of_any_depth(raw):
    """Depth changes nothing, in a body, in the head of a function, in bases and decorators."""

    def source(depth):
        left, right = "(" * depth, ")" * depth
        return (
            f"def f(a, b={left}1,\n2{right}, c=3):\n    x = {left}\n1 for y in a if y or 2\n{right}\n"
            f"    if x and a:\n        return 1\n\n@deco({left}\n{right})\nclass C(Base{left}\n1{right}, D):\n"
            f"    def m(self, q={left}{right}):\n        while q or 1:\n            pass\n"
        )

    depths = [1, 2, 99, 100, 101, 102, 200, 201, 256, 257, 5000]
    modules = extract.extract_modules(
        corpus.build_files(raw(*[("r", f"d{d}.py", source(d)) for d in depths]))
    )
    found = {}
    for r in extract.functions(modules).collect():
        found.setdefault(r.path, set()).add((r.name, r.complexity, tuple(r.parameters)))
    assert found == {
        f"d{d}.py": {("f", 5, ("a", "b", "c")), ("m", 3, ("q",))} for d in depths
    }
    classes = {(r.path, tuple(r.bases), tuple(r.decorators)) for r in extract.classes(modules).collect()}
    assert classes == {(f"d{d}.py", ("unknown", "D"), ("deco",)) for d in depths}


def test_brackets_that_do_not_pair_up(raw):
    """A stray bracket does not hide what follows it, whatever the number of brackets."""
    texts = {
        n: ("x = (\n" if n % 2 else ")\n") + "def f(a):\n    if a: pass\n" * n for n in (3, 4, 300, 301)
    }
    modules = extract.extract_modules(
        corpus.build_files(raw(*[("r", f"{n}.py", text) for n, text in texts.items()]))
    )
    counts = {}
    for r in extract.functions(modules).collect():
        assert (r.name, r.complexity) == ("f", 2)
        counts[r.path] = counts.get(r.path, 0) + 1
    assert counts == {f"{n}.py": n for n in texts}
