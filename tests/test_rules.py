"""Rules as data give what the same rules give as a list."""

from codecorpus.functions import dims
from codecorpus.operators import rules
from codecorpus.sources import corpus

FILES = (
    ("a", "app.py", 'password = "hunter22"\n# password = "hunter22"\nh = md5(x)\nurl = "http://example.com/x"\n'),
    ("a", "tests/test_app.py", 'password = "hunter22"\neval(x)\n'),
    ("b", "main.js", "eval(input)\ncursor.execute('select ' + x)\n\n"),
    ("b", "empty.js", ""),
)
KEYS = ["repo", "path", "line_no", "severity", "category", "title", "description", "line_text"]


def rows(found):
    return sorted((str(r.rule_id), *[r[k] for k in KEYS]) for r in found.collect())


def test_rule_table_equals_the_list(spark, raw):
    files = corpus.build_files(raw(*FILES))
    expected = rows(rules.match_rules(files))
    table = rules.rule_table(spark)
    assert expected and rows(rules.match_rule_table(files, table)) == expected
    # Many blocks of rules, and rules without hints, find the same.
    assert rows(rules.match_rule_table(files, table, block_bytes=500)) == expected
    plain = rules.rule_table(spark, list(dims.SECURITY_RULES), [[]] * len(dims.SECURITY_RULES))
    assert rows(rules.match_rule_table(files, plain)) == expected


def test_odd_rules(spark, raw):
    files = corpus.build_files(raw(*FILES))
    table = spark.createDataFrame(
        [
            ("x", r"eval\(", None, None, None, None, None, None, None),
            ("x", r"eval\(", None, None, None, None, None, None, []),
            ("y", None, "low", "c", "t", "d", False, False, None),
            (None, "eval", "low", "c", "t", "d", False, False, None),
            ("z", r"eval\(", "low", "c", "t", "d", True, False, ["no such hint"]),
            ("w", r"^$", "low", "c", "t", "d", True, False, None),
        ],
        rules.RULE_TABLE,
    )
    found = [(r.rule_id, r.path, r.line_no) for r in rules.match_rule_table(files, table).collect()]
    assert sorted(found) == [
        ("w", "main.js", 3), ("x", "main.js", 1), ("x", "main.js", 1),
        ("x", "tests/test_app.py", 2), ("x", "tests/test_app.py", 2),
    ]
    assert rules.match_rule_table(files, table.limit(0)).collect() == []
