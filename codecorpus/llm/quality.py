"""Quality rules: base statistics of a text, and lines that too many documents of a host share.

All of it is column expressions: the base statistics never leave their row, and the cross-document
part shuffles one hash per distinct line of a document, counted map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import computed
from codecorpus.llm.frames import numbered, place, restored
from codecorpus.llm.host_lines import (
    WORD,
    has_word,
    lines_of,
    shared_lines,
    text_of,
    with_shared_lines,
    without_lines,
)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Limits of a line: documents of its host that hold it, and their share of the host's documents.
LINE_MIN_DOCS = 20
LINE_MAX_SHARE = 0.2
#: Documents of its host above which a line goes, whatever their share.
LINE_MAX_DOCS = 10_000
#: A document is depleted if fewer words, or a smaller share of its words, remain.
LEFT_MIN_WORDS = 10
LEFT_MIN_SHARE = 0.3


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Words are runs of characters other than ASCII white space; a null text has none, and all counts
    are 0 for it.  ``n_repeat_words`` counts the words inside five-word windows that occur twice or
    more in the same text.  Windows are compared by 64-bit hash within one text: hashes are sorted
    as plain numbers, and only texts with equal hashes sort them with their positions.  The result
    columns replace columns of the same name.
    """
    rest = [F.col(name) for name in docs.columns if name not in BASE]
    body = text_of(text)
    lines = F.filter(lines_of(body), has_word)
    rows = computed(
        docs.select(*rest),
        _words=F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        word_chars=F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        _lines_seen=lines,
    )
    words, n_words = F.col("_words"), F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n_words - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    rows = computed(
        rows.withColumn(
            "n_dup_lines",
            (F.size("_lines_seen") - F.size(F.array_distinct("_lines_seen"))).cast("long"),
        ),
        _hashes=F.when(n_words >= WINDOW, window).otherwise(none),
        n_words=n_words.cast("long"),
    ).drop("_words", "_lines_seen")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    rows = computed(rows, _sorted=F.when(repeats, F.sort_array(placed))).drop("_hashes")
    ordered = F.col("_sorted")

    def has_twin(x, i):
        before = F.when(i > 0, F.get(ordered, i - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(
            F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)
        )

    starts = F.sort_array(F.transform(F.filter(ordered, has_twin), lambda x: x["i"]))
    rows = computed(rows, _starts=starts).drop("_sorted")
    starts = F.col("_starts")
    new_words = F.transform(
        starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(new_words, F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")
    )
    return rows.drop("_starts").withColumn("base_failed", failed)


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    line_min_docs: int = LINE_MIN_DOCS,
    line_max_share: float = LINE_MAX_SHARE,
    line_max_docs: int = LINE_MAX_DOCS,
    left_min_words: int = LEFT_MIN_WORDS,
    left_min_share: float = LEFT_MIN_SHARE,
) -> DataFrame:
    """``docs`` with base statistics, the text without shared lines, and the verdict.

    A line (compared in lower case with single spaces) is removed if more than ``line_max_docs``
    documents of its host hold it, or at least ``line_min_docs`` documents that are more than
    ``line_max_share`` of the host's.  A document of which fewer than ``left_min_words`` words or
    less than ``left_min_share`` of its words remain is depleted.  ``kept`` is false for a failed
    base or a depleted document.  New columns: those of ``base_statistics``, clean_text,
    n_lines_removed, n_words_left, kept; they replace columns of the same name in any case, and
    other columns may have any name.  A null text has no words and fails; null is a host of its own;
    rows of one host with the same id and text are one document in the counts, and each gets its
    result; an empty table gives an empty table.
    """
    names = ["clean_text", "n_lines_removed", "n_words_left", "kept"]
    source = numbered(docs)
    text, host, doc_id = (f"_in{place(docs, name)}" for name in (text, host, doc_id))
    shared = shared_lines(
        source, min_docs=line_min_docs, share=line_max_share, max_docs=line_max_docs,
        text=text, host=host, doc_id=doc_id,
    )
    rows = with_shared_lines(base_statistics(source, text), shared, text=text, host=host)
    rows = without_lines(rows, text, "n_lines_removed")
    left = F.when(F.col("_lines").isNull(), F.col("n_words")).otherwise(
        F.regexp_count("clean_text", F.lit(WORD)).cast("long")
    )
    rows = rows.withColumn("n_words_left", left)
    depleted = (F.col("n_words_left") < left_min_words) | (
        F.col("n_words_left") < F.lit(left_min_share) * F.col("n_words")
    )
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~depleted)
    names = BASE + names
    return rows.select(*restored(docs, names), *names)
