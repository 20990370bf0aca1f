from pyspark.sql import functions as F

from codecorpus.operators import history, lines, rules, stats
from codecorpus.plans import adapters
from codecorpus.sources import corpus


def test_line_counts_and_languages(raw):
    files = corpus.build_files(
        raw(
            ("a", "x.py", "# c\n\nx = 1\r\ny = 2"),
            ("a", "Makefile", ""),
            ("b", "x.py", "one\x0btwo\n"),
        )
    )
    got = {
        (r.repo, r.path): (r.language, r.line_count, r.blank_lines, r.comment_lines, r.code_lines)
        for r in files.collect()
    }
    assert got == {
        ("a", "x.py"): ("Python", 4, 1, 1, 2),
        ("a", "Makefile"): ("Shell", 0, 0, 0, 0),
        ("b", "x.py"): ("Python", 2, 0, 0, 2),
    }


def test_ignores_depth_and_binary(raw):
    files = raw(
        ("a", ".gitignore", "*.log\n# x\ngen/\nold[12]?.txt\n"),
        ("a", "x.log", "1"),
        ("a", "gen/deep/y.py", "1"),
        ("a", "old1a.txt", "1"),
        ("a", "old3a.txt", "1"),
        ("b", "x.log", "1"),
        ("b", "node_modules/z.js", "1"),
        ("b", "p.egg-info/z.txt", "1"),
        ("b", "a/b/c/d.py", "1"),
        ("b", "elf", b"\x7fELF1"),
        ("b", "nul.txt", b"ab\x00"),
        ("b", "empty.txt", b""),
    )
    kept = {(r.repo, r.path) for r in corpus.build_files(files, max_depth=2).collect()}
    assert kept == {
        ("a", ".gitignore"),
        ("a", "old3a.txt"),
        ("b", "x.log"),
        ("b", "empty.txt"),
    }


def test_incremental_scan_reuses_and_shares(raw):
    files = raw(("a", "1", "x\ny"), ("b", "1", "x\ny"), ("b", "2", "z"))
    seen = []

    def analyse(texts):
        seen.append(texts.count())
        n = corpus.count_lines(F.col("content").cast("string"))["total"]
        return texts.select("content_sha", n.alias("n"))

    nothing = files.sparkSession.createDataFrame([], "content_sha string, n int")
    first = corpus.incremental_scan(files, nothing, analyse)
    assert sorted((r.repo, r.path, r.n, r.reused) for r in first.collect()) == [
        ("a", "1", 2, False),
        ("b", "1", 2, False),
        ("b", "2", 1, False),
    ]
    known = first.where("path = '1'").select("content_sha", "n").distinct()
    again = corpus.incremental_scan(files, known, analyse)
    assert {(r.path, r.reused) for r in again.collect()} == {("1", True), ("2", False)}
    assert seen == [2, 1]
    # A filter so small that everything looks known changes no result.
    full = corpus.incremental_scan(files, known, analyse, filter_bits=64)
    assert {(r.path, r.reused) for r in full.collect()} == {("1", True), ("2", False)}


def test_scan_with_state_analyses_new_hashes_only(raw, tmp_path, monkeypatch):
    seen = []

    def analyse(texts):
        seen.append(sorted(r.content.decode() for r in texts.select("content").collect()))
        n = corpus.count_lines(F.col("content").cast("string"))["total"]
        return texts.select("content_sha", n.alias("n"))

    def run(*files):
        monkeypatch.setattr(corpus, "HOT_COPIES", 2)
        found = corpus.scan_with_state(raw(*files), str(tmp_path / "state"), analyse, "content_sha string, n int", 1 << 12)
        return sorted((r.repo, r.path, r.n, r.reused) for r in found.collect())

    first = [("a", "1", "x\ny"), ("b", "1", "x\ny"), ("b", "1", "x\ny"), ("b", "2", "z"), ("c", "e", "")]
    assert run(*first) == [
        ("a", "1", 2, False), ("b", "1", 2, False), ("b", "1", 2, False), ("b", "2", 1, False),
        ("c", "e", 0, False),
    ]
    assert run(*first, ("d", "new", "1\n2\n3")) == [
        ("a", "1", 2, True), ("b", "1", 2, True), ("b", "1", 2, True), ("b", "2", 1, True),
        ("c", "e", 0, True), ("d", "new", 3, False),
    ]
    assert [r[3] for r in run(("d", "new", "1\n2\n3"))] == [True]
    assert seen == [["", "x\ny", "z"], ["1\n2\n3"], []]


def test_size_limit_is_a_parameter(raw):
    files = raw(("r", "a.txt", "12345\n67"))
    counts = [corpus.build_files(files, max_bytes=n).first() for n in (4, 8, None)]
    assert [(r.line_count, r.content) for r in counts] == [(0, None), (2, "12345\n67"), (2, "12345\n67")]


def test_scan_corpus_reads_a_tree(spark, tmp_path):
    for name in ("r1/a/x.py", "r2/y.py"):
        target = tmp_path / name
        target.parent.mkdir(parents=True)
        target.write_text("x = 1\n")
    found = corpus.scan_corpus(spark, str(tmp_path))
    rows = {(r.repo, r.path, r.size_bytes, bytes(r.content)) for r in found.collect()}
    assert rows == {("r1", "a/x.py", 6, b"x = 1\n"), ("r2", "y.py", 6, b"x = 1\n")}


def test_markers_have_context_and_unicode_boundaries(raw):
    files = corpus.build_files(
        raw(("a", "x.py", "top\n# todo: one, FIXME two\nend"), ("b", "x.py", "ñtodo\n_BUG\nBUGS"))
    )
    rows = lines.scan_markers(files).collect()
    assert [(r.repo, r.line_no, r.marker_type, r.severity, r.context) for r in rows] == [
        ("a", 2, "TODO", "warning", "top\n# todo: one, FIXME two\nend")
    ]


def test_findings_scores_and_clean_repos(raw):
    files = corpus.build_files(
        raw(
            ("a", "x.py", 'password = "p"\n# password = "p"\nos.system(1)\n'),
            ("a", "latest.py", 'password = "p"\nurl = "http://localhost/"\n'),
            ("a", "y.py", 'u = "http://x.org"\n'),
            ("b", "x.py", "x = 1\n"),
        )
    )
    found = rules.match_rules(files)
    assert sorted((r.path, r.line_no, r.rule_id) for r in found.collect()) == [
        ("x.py", 1, 0),
        ("x.py", 3, 8),
        ("y.py", 1, 20),
    ]
    risk = {r.repo: r for r in rules.risk_report(found, files).collect()}
    assert (risk["a"].risk_score, risk["a"].gate_failed) == (32, True)
    assert risk["a"].summary == (
        "Found 3 potential security issues: 1 critical (hardcoded password), "
        "1 high (os.system() usage), 1 low (insecure http url). Risk score: 32/100."
    )
    assert risk["b"].summary == "No security issues detected. Risk score: 0/100."


def test_every_rule_matches_with_and_without_hints(raw):
    body = "\n".join(
        [
            "password = 'x'", "api_key = 'x'", "AKIA" + "A" * 16,
            "-----BEGIN RSA PRIVATE KEY-----", "token = '12345678'", "execute('%s'",
            "execute(x.format(", "execute(f'", "os.system(", "subprocess.call(x, shell=True",
            "eval(", "exec(", "../", "md5(", "sha1(", "IV = b'", "chmod 777", "0o777",
            "DEBUG = True", "debug = true", "http://x", "verify=False", "ssl_verify: FALSE",
            "Access-Control-Allow-Origin: *",
        ]
    )
    files = corpus.build_files(raw(("a", "x.py", body)))
    hinted = {(r.line_no, r.rule_id) for r in rules.match_rules(files).collect()}
    plain = {(r.line_no, r.rule_id) for r in rules.match_rules(files, list(rules.RULES)).collect()}
    assert hinted == plain
    assert {rule_id for _, rule_id in hinted} == set(range(24))


def test_size_shares_and_diff(raw):
    files = corpus.build_files(raw(("a", "s/x.py", "123456"), ("a", "y", "12"), ("b", "z.go", "1")))
    rows = {(r.repo, r.dim, r.name): r.percentage for r in stats.size_breakdown(files).collect()}
    assert rows[("a", "directory", "s")] == 75.0
    assert rows[("a", "extension", "(no ext)")] == 25.0
    assert rows[("b", "language", "Go")] == 100.0
    before = corpus.content_hash(raw(("a", "k", "1"), ("a", "m", "1"), ("a", "d", "1")))
    after = corpus.content_hash(raw(("a", "k", "1"), ("a", "m", "2"), ("b", "d", "1")))
    changes = {(r.repo, r.path, r.change) for r in history.diff_snapshots(before, after).collect()}
    assert changes == {("a", "m", "modified"), ("a", "d", "deleted"), ("b", "d", "added")}


def test_ignore_globs(raw):
    """Names and paths, wildcards that stop at a slash in names only, and odd brackets.

    In a path as a whole a bracket may stand for a slash, so ``old[!2].txt`` hides ``old/.txt``.
    """
    paths = [
        "x.log", "a/x.log", "a/b/c.txt", "build/out.o", "src/build/out.o", "old1.txt", "old/.txt",
        "a[b", "a+b.c", "q/r/s.py", "qr", "doc/a.md", "doc/deep/a.md", "line\nbreak.log", "z.LOG",
    ]
    ignore = "*.log\n  # no\nbuild/\nold[!2].txt\na[b\na+b.?\nq*s.py\ndoc/*.md\n\n"
    files = raw(("r", ".gitignore", ignore), *[("r", p, "1") for p in paths], ("s", "x.log", "1"))
    kept = {(r.repo, r.path) for r in corpus.filter_gitignore(files).collect()}
    assert kept == {
        ("r", ".gitignore"), ("r", "a/b/c.txt"), ("r", "qr"), ("r", "z.LOG"), ("s", "x.log"),
    }


def test_ignoring_moves_no_contents(raw, monkeypatch):
    """Also beyond the limit of a broadcast, where keys go in several blocks."""
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", 100)
    names = [("r", f"f{i}.log", "1") for i in range(20)] + [("r", f"f{i}.txt", "1") for i in range(5)]
    files = raw(("r", ".gitignore", "*.log\n" + "\n".join(f"n{i}" for i in range(50))), *names)
    kept = corpus.filter_gitignore(files)
    assert kept.count() == 6
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_parts_follow_the_measured_size_of_texts_not_the_stored_bytes(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_BYTES", 1000)
    files = corpus.build_files(raw(*[("a", f"f{i}.py", "x = 1\n" * 100) for i in range(20)]))
    files.coalesce(1).write.parquet(str(tmp_path / "f"))
    dealt = corpus.even(spark.read.parquet(str(tmp_path / "f")))
    assert dealt.rdd.getNumPartitions() == 12 and dealt.count() == 20
    assert corpus.spread(spark.range(0, 100, 1, 4), 10).rdd.getNumPartitions() == 10
    assert corpus.spread(spark.range(0, 100, 1, 4), 50).rdd.getNumPartitions() == 4


def test_texts_that_shrink_when_stored_are_dealt_by_their_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_BYTES", 1024 * 1024)
    page = "if and or while " * 1024
    spark.range(0, 640, 1, 1).select(F.lit(page).alias("text")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert corpus.spread(rows).rdd.getNumPartitions() <= 4
    tasks = corpus.spread(rows, text="text").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 10 and max(n for _, n in tasks) <= 80


def test_root_files_are_made_without_dealing_out_the_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "PARTS_PER_TASK", 1)
    parts = spark.range(0, 500, 1, 1).selectExpr("id as p_partkey", "cast(id as int) as p_size", "'a b' as p_name")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    root = adapters.Tables(spark, str(tmp_path)).root()
    assert "Repartition" not in root._jdf.queryExecution().optimizedPlan().toString()
    assert root.select("repo").distinct().count() == 5


def test_rows_of_the_log_that_repeat_are_settled_on_keys(spark, tmp_path):
    """Repeated rows of all three tables; the long rows of the log are in no exchange of their own."""
    tables = {
        "part": spark.createDataFrame([(1, 3, "a b"), (1, 3, "c d"), (6, 3, "a b"), (6, 4, "a b"), (7, 1, "a b")],
                                      "p_partkey long, p_size int, p_name string"),
        "orders": spark.sql("select * from values (10L, 5L, timestamp'2020-01-01'), (10L, 5L, timestamp'2020-01-01'), "
                            "(10L, 6L, timestamp'2020-01-01'), (11L, 5L, timestamp'2020-01-02') "
                            "as t(o_orderkey, o_custkey, o_orderdate)"),
        "lineitem": spark.createDataFrame([(10, 1, 1), (10, 1, 2), (10, 1, 3), (11, 6, 1), (11, 6, 1), (12, 7, 1), (11, 9, 2)],
                                          "l_orderkey long, l_partkey long, l_linenumber int"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    log = adapters.Tables(spark, str(tmp_path)).commits()
    rows = sorted((r.repo, r.sha, r.author, r.path, r.change_type) for r in log.collect())
    assert rows == [
        ("repo0", "10", "5", "pkg/m1.py", "A"), ("repo0", "10", "5", "pkg/m1.py", "M"),
        ("repo0", "10", "6", "pkg/m1.py", "A"), ("repo0", "10", "6", "pkg/m1.py", "M"),
        ("repo0", "11", "5", "src/m6.js", "A"), ("repo0", "11", "5", "src/m6.ts", "A"),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = log.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [p for p in plan.splitlines() if "hashpartitioning" in p and "sha" in p]
    recent = history.recent_files(log, 1)
    assert [tuple(r) for r in recent.collect()] == [("repo0", "pkg/m1.py")]


def test_recent_files_store_the_log_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(history, "stored", lambda df, made=history.stored: kept.append(made(df)) or kept[-1])
    log = spark.createDataFrame(
        [("r", "s1", "a", 1, "x", "M"), ("r", "s2", "a", 2, "y", "M"), ("r", "s3", "a", 3, "z", "A"),
         ("r", "s2", "a", 2, "w", "M"), ("q", "s1", "b", 1, "x", "M")],
        "repo string, sha string, author string, ts int, path string, change_type string",
    )
    recent = history.recent_files(log, 1)
    assert {tuple(r) for r in recent.collect()} == {("r", "y"), ("r", "w"), ("q", "x")}
    # What was modified, and the newest commits: the join reads both, and not the log.
    assert [k.count() for k in kept] == [4, 2]
    assert "LogicalRDD" not in recent._jdf.queryExecution().optimizedPlan().toString()
