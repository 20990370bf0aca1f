"""Security findings: every line against every rule, then scores per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.functions.rows import computed, unnest
from codecorpus.functions.text import is_comment, rstrip
from codecorpus.operators.lines import explode_lines, grouped_counts
from codecorpus.session import stored

RULES = dims.SECURITY_RULES


def _rule_struct(rule: tuple) -> Column:
    _, severity, category, title, description, _, _ = rule
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
    )


def _folded(text: Column) -> Column:
    """Lower case for literal searches.

    Patterns that ignore case take the long s for s, and the i without and the capital I with a dot
    for i, so they are folded first.
    """
    return F.lower(F.translate(text, chr(0x17F) + chr(0x131) + chr(0x130), "sii"))


def _any_hint(folded: Column, hints: list[str]) -> Column:
    test = F.lit(False)
    for hint in hints:
        test = test | folded.contains(hint)
    return test


def match_rules(
    files: DataFrame, rules: list[tuple] = RULES, hints: list[list[str]] | None = None
) -> DataFrame:
    """One finding per (line, rule); row-local, no shuffle and no join.

    ``rules`` are tuples as in ``dims.SECURITY_RULES``.  Patterns are literals of the plan, so each
    is compiled once per task.  ``hints`` gives, per rule, texts of which a match contains at least
    one.  Plain substring searches are much cheaper than patterns and few lines contain any hint,
    so they drop lines first; a pattern only runs where its own hint occurs.
    """
    text, folded = F.col("text"), F.col("folded")
    if hints is None:
        hints = dims.SECURITY_RULE_HINTS if rules is RULES else [[""]] * len(rules)
    every_hint = sorted({hint for group in hints for hint in group})
    hinted = computed(explode_lines(files), folded=_folded(text)).where(
        _any_hint(folded, every_hint)
    )
    candidates = computed(
        hinted,
        is_test=paths.is_test_for_security(F.col("path")),
        is_comment=is_comment(text),
    )
    found = []
    for rule_id, rule in enumerate(rules):
        test = _any_hint(folded, hints[rule_id]) & text.rlike(rule[0])
        if rule[6]:
            test = ~F.col("is_comment") & test
        if rule[5]:
            test = ~F.col("is_test") & test
        found.append(F.when(test, F.lit(rule_id)))
    keep = ["repo", "path", "line_no", "text"]
    matched = unnest(candidates, keep, F.array_compact(F.array(*found)), "rule_id")
    # A filter on the details may run before rows without a rule are dropped, hence the lenient get.
    details = F.get(F.array(*[_rule_struct(rule) for rule in rules]), F.col("rule_id"))
    return matched.withColumn("rule", details).select(
        "repo", "path", "line_no", "rule_id", "rule.*", rstrip(text).alias("line_text")
    )


RULE_TABLE = (
    "rule_id string, pattern string, severity string, category string, title string, "
    "description string, skip_tests boolean, skip_comments boolean, hints array<string>"
)
#: Bytes of rules that one join broadcasts; a larger table goes in several joins.
RULE_BLOCK_BYTES = 8 * 1024 * 1024


def rule_table(
    spark: SparkSession, rules: list[tuple] = RULES, hints: list[list[str]] | None = None
) -> DataFrame:
    """A list of rules as a table for ``match_rule_table``; rule_id is the place in the list."""
    if hints is None:
        hints = dims.SECURITY_RULE_HINTS if rules is RULES else [[""]] * len(rules)
    rows = [(str(i), *rule, hints[i]) for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_TABLE)


def match_rule_table(
    files: DataFrame, rules: DataFrame, block_bytes: int = RULE_BLOCK_BYTES
) -> DataFrame:
    """Findings of rules that are data: every line against every row of ``rules``.

    ``rules`` has the columns of ``RULE_TABLE``; ``hints`` are texts in lower case of which a match
    contains at least one, null or empty if none are known.  A rule without pattern or id finds
    nothing, null flags are false, and rows that repeat a rule find each line as often.  The result
    has the columns of ``match_rules``.

    Matching is no equality, so rules are broadcast to the lines.  They are stored and measured
    first and broadcast in blocks of about ``block_bytes``, one join per block, so a table of any
    size fits.  Hints come before the pattern in the condition: few pairs reach it.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("skip_tests", "skip_comments")]
    known = F.when(F.size("hints") > 0, F.col("hints")).otherwise(F.array(F.lit("")))
    rules = stored(
        rules.where(F.col("pattern").isNotNull() & F.col("rule_id").isNotNull()).select(
            "rule_id", "pattern", "severity", "category", "title", "description", *flags,
            known.alias("hints"),
        )
    )
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("pattern", "title", "description")]
    size = sum(lengths, F.lit(200))
    blocks = max(1, -(-int(rules.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    text, folded = F.col("text"), F.col("folded")
    lines = computed(
        explode_lines(files),
        folded=_folded(text),
        is_test=paths.is_test_for_security(F.col("path")),
        is_comment=is_comment(text),
    )
    matches = (
        ~(F.col("skip_tests") & F.col("is_test"))
        & ~(F.col("skip_comments") & F.col("is_comment"))
        & F.exists("hints", lambda h: folded.contains(h))
        & F.rlike(text, F.col("pattern"))
    )
    found = None
    for block in range(blocks):
        mine = rules.where(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)) == block)
        part = lines.join(F.broadcast(mine), matches).select(
            "repo", "path", "line_no", "rule_id", "severity", "category", "title", "description",
            rstrip(text).alias("line_text"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def findings_min_severity(findings: DataFrame, least: str) -> DataFrame:
    """Findings at least as severe as ``least``."""
    return findings.where(F.col("severity").isin(*dims.SEVERITIES[: dims.SEVERITIES.index(least) + 1]))


def finding_counts(findings: DataFrame) -> DataFrame:
    return grouped_counts(findings, {"severity": "severity", "category": "category"})


def risk_report(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Per repository (also clean ones): findings, score 0..100, failing gate, summary sentence."""
    per_severity = []
    for severity in dims.SEVERITIES:
        mine = F.col("severity") == severity
        per_severity.append(F.count_if(mine).alias(f"n_{severity}"))
        # At most as many titles as there are rules.
        titles = F.array_sort(F.collect_set(F.when(mine, F.col("title"))))
        per_severity.append(titles.alias(f"titles_{severity}"))
    counted = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("findings"), *per_severity)
    joined = repos.select("repo").distinct().join(counted, "repo", "left")

    def n(severity: str) -> Column:
        return F.coalesce(F.col(f"n_{severity}"), F.lit(0))

    score = F.lit(0)
    parts = []
    for severity, (points, cap) in dims.SEVERITY_POINTS.items():
        score = score + F.least(n(severity) * points, F.lit(cap))
        shown = F.lower(F.concat_ws(", ", F.slice(f"titles_{severity}", 1, 2)))
        part = F.concat(n(severity).cast("string"), F.lit(f" {severity} ("), shown, F.lit(")"))
        parts.append(F.when(n(severity) > 0, part))
    score = F.least(score, F.lit(100)).cast("int")
    total = F.coalesce(F.col("findings"), F.lit(0))
    summary = F.when(
        total == 0, F.lit("No security issues detected. Risk score: 0/100.")
    ).otherwise(
        F.concat(
            F.lit("Found "),
            total.cast("string"),
            F.when(total == 1, " potential security issue: ").otherwise(
                " potential security issues: "
            ),
            F.concat_ws(", ", *parts),
            F.lit(". Risk score: "),
            score.cast("string"),
            F.lit("/100."),
        )
    )
    return joined.select(
        "repo",
        total.alias("findings"),
        *[n(s).alias(f"n_{s}") for s in dims.SEVERITIES],
        score.alias("risk_score"),
        (n("critical") + n("high") > 0).alias("gate_failed"),
        summary.alias("summary"),
    )
