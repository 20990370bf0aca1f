"""Markdown, JSON and payload of two repositories."""

import json

import pytest
from codecorpus.operators import report
from codecorpus.plans.analysis import CorpusAnalysis
from pyspark.sql import functions as F

BUSY = "def f(a):\n" + "    if a and a:\n        a = a or 1\n" * 6


@pytest.fixture
def analysis(spark, raw):
    files = raw(
        ("r", "pkg/a.py", "import pkg.b\n" + BUSY),
        ("r", "pkg/b.py", "import pkg.a\nx = 1\n"),
        ("r", "main.py", "import pkg.a\nif __name__ == '__main__':\n    pass\n"),
        ("r", "README.md", "# \"quoted\" \\ text\n"),
        ("r", "requirements.txt", "flask>=2\n"),
        ("r", "tests/test_a.py", "def test():\n    pass\n"),
        ("s", "main.go", "package main\nfunc main() {}\n"),
        ("s", "empty.txt", ""),
        ("t", "x.bin", b"\x00\x01"),
    )
    log = spark.createDataFrame(
        [("r", str(i), "ann" if i % 2 else "bob", "pkg/a.py", "M") for i in range(6)]
        + [("r", "0", "bob", "pkg/b.py", "A"), ("r", "0", "bob", "gone.py", "D")],
        "repo string, sha string, author string, path string, change_type string",
    ).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    return CorpusAnalysis(files, log, F.to_timestamp(F.lit("2024-01-02"))).report_input


def test_markdown(analysis):
    got = {r.repo: r.markdown for r in report.export_markdown(analysis).collect()}
    text = got["r"]
    assert text.startswith("# r\n\n")
    titles = [line for line in text.split("\n") if line.startswith("## ")]
    assert titles == [
        "## Statistics", "## Languages", "## Entry Points", "## Dependency Graph",
        "## External Dependencies", "## Hotspots",
    ]
    assert "| Files | 6 |" in text
    assert "- **Python** (" in text and "█" in text
    assert "- `main.py`" in text
    graph = text.split("```mermaid\n")[1].split("\n```")[0].split("\n")
    assert graph[0] == "graph LR"
    assert set(graph[1:]) == {
        "    main_py[main.py] --> pkg_a_py[pkg/a.py]",
        "    pkg_a_py[pkg/a.py] --> pkg_b_py[pkg/b.py]",
        "    pkg_b_py[pkg/b.py] --> pkg_a_py[pkg/a.py]",
    }
    assert "## External Dependencies\n\n`flask`\n" in text
    assert "| `pkg/a.py` | 100.0 | DANGER |" in text
    # The other repository has no edges, packages or history, so those parts are left out.
    assert "Dependency Graph" not in got["s"] and "External" not in got["s"]
    assert "| Files | 2 |" in got["s"] and "- `main.go`" in got["s"]
    assert "| Files | 0 |" in got["t"] and set(got) == {"r", "s", "t"}


def test_payload(spark, analysis, tmp_path):
    report.write_report(report.export_report_payload(analysis), str(tmp_path / "out"), buckets=4)
    lines = report.read_report(spark, str(tmp_path / "out"), buckets=4)
    documents = {r.repo: json.loads(r.document) for r in report.report_documents(lines).collect()}
    r = documents["r"]
    assert [f["path"] for f in r["files"]] == [
        "README.md", "main.py", "pkg/a.py", "pkg/b.py", "requirements.txt", "tests/test_a.py",
    ]
    assert {n["id"]: (n["entry"], n["danger"]) for n in r["graphNodes"]} == {
        "main.py": (True, False), "pkg/a.py": (False, True), "pkg/b.py": (False, False),
    }
    assert r["circularDeps"] == [["pkg/a.py", "pkg/b.py", "pkg/a.py"]]
    assert r["externalDeps"] == ["flask"]
    history = {h["path"]: h for h in r["gitHistory"]}
    assert history["pkg/a.py"]["commits"] == 6 and history["pkg/a.py"]["contributors"] == ["ann", "bob"]
    assert set(history) == {"pkg/a.py", "pkg/b.py", "gone.py"}
    assert r["hotspots"][0] | {"danger": True, "score": 100.0} == r["hotspots"][0]
    assert documents["s"]["project"]["language"] == "Go" and documents["s"]["gitHistory"] == []
    assert documents["t"]["files"] == [] and set(documents) == {"r", "s", "t"}
    # Asking for one repository reads its folder only.
    one = report.read_report(spark, str(tmp_path / "out"), ["s"], buckets=4)
    assert {x.repo for x in one.collect()} == {"s"}
    assert "bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_json(analysis):
    lines = report.export_json(analysis)
    documents = {r.repo: json.loads(r.document) for r in report.report_documents(lines).collect()}
    r = documents["r"]
    assert r["dependencies"]["internal"][0] == {
        "source": "main.py", "target": "pkg/a.py", "names": ["pkg.a"],
    }
    assert r["stats"]["totalFiles"] == 6 and r["stats"]["languageBreakdown"]["Python"] > 10
    assert sum(r["stats"]["languagePercentages"].values()) == pytest.approx(100, abs=0.2)
    assert r["project"]["features"]["tests"] is True and r["project"]["languages"]["Python"] == 4
    assert [h["path"] for h in r["hotspots"]][0] == "pkg/a.py"
    assert documents["t"]["stats"]["totalFiles"] == 0
