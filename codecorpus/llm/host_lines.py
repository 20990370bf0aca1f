"""Lines that many documents of one host share: counts, and texts without those lines.

A document is a distinct pair of id and text: rows that repeat are taken together first, spread by
document.  Documents of a host are then counted map-side, so a host with a third of all documents is
no heavier than others.  What is shared goes to the documents as a short list per host where its
measured size allows that, else by joins on salted (host, line); both give the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.rows import computed, unnest
from codecorpus.session import stored

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Shared lines go to their documents as one list per host, broadcast, if no list is longer than
#: ``LIST`` and all lists together hold at most ``LISTED`` hashes; otherwise they are joined by line.
LIST = 256
LISTED = 500_000
#: Parts that the documents of one (host, line) are split into when shared lines are joined by line.
SALTS = 64


def text_of(column: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normalised(line: Column) -> Column:
    """A line in lower case with single spaces and no space at its ends."""
    return F.lower(F.trim(F.regexp_replace(line, BLANK, " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def shared_lines(
    docs: DataFrame,
    *,
    min_docs: int,
    share: float,
    max_docs: int | None = None,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Hashes of the lines in too many documents of their host (null is a host): _host, _line.

    Those are lines in at least ``min_docs`` documents and in more than ``share`` of the host's
    documents, and, if ``max_docs`` is given, all lines in more documents than that.  Rows of one
    host with the same id (null is an id) and the same text are one document.
    """
    body = text_of(text)
    lines = F.filter(lines_of(body), has_word)
    hashes = F.array_distinct(F.transform(lines, line_hash))
    rows = docs.select(
        F.col(host).alias("_host"), F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_digest"),
        # The null at the end counts the documents of the host.
        F.concat(hashes, F.array(F.lit(None).cast("long"))).alias("_hashes"),
    )
    lines = unnest(rows.distinct(), ["_host"], "_hashes", "_line")
    counts = lines.groupBy("_host", "_line").count()
    counts = stored(counts.where(F.col("_line").isNull() | (F.col("count") >= min_docs)))
    totals = counts.where(F.col("_line").isNull()).select(
        F.col("_host").alias("_total_host"), F.col("count").alias("_docs")
    )
    too_many = F.col("count") > F.lit(share) * F.col("_docs")
    if max_docs is not None:
        too_many |= F.col("count") > max_docs
    joined = counts.where(F.col("_line").isNotNull()).join(
        totals, F.col("_host").eqNullSafe(F.col("_total_host"))
    )
    return joined.where(too_many).select("_host", "_line")


def with_shared_lines(
    docs: DataFrame, shared: DataFrame, *, text: str = "text", host: str = "source"
) -> DataFrame:
    """``docs`` with the column ``_lines``: hashes of shared lines of the host, or null for none.

    All hashes of ``_lines`` are of shared lines, and every shared line of the document is among
    them.  Joined by line, distinct (host, text) stand for their rows, since they decide the answer.
    """
    shared = stored(shared)
    lists = shared.groupBy("_host").agg(F.collect_list("_line").alias("_lines"))
    sizes = shared.groupBy("_host").count().agg(F.max("count"), F.sum("count")).first()
    if (sizes[0] or 0) <= LIST and (sizes[1] or 0) <= LISTED:
        return docs.join(
            F.broadcast(lists), docs[host].eqNullSafe(lists["_host"]), "left"
        ).drop("_host")
    body = text_of(text)
    digests = {"_digest": F.xxhash64(body), "_digest2": F.xxhash64(body, F.lit(1))}
    hashes = F.array_distinct(F.transform(F.filter(lines_of(body), has_word), line_hash))
    texts = docs.select(
        F.col(host).alias("_host"), *[value.alias(name) for name, value in digests.items()],
        hashes.alias("_hashes"),
    )
    key = ["_host", *digests]
    own = unnest(texts.distinct(), key, "_hashes", "_line")
    own = own.withColumn("_salt", F.pmod("_digest", F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    spread = shared.select(
        F.col("_host").alias("_shared_host"), F.col("_line").alias("_shared_line"),
        salts.alias("_shared_salt"),
    )
    hits = own.join(
        spread,
        own["_host"].eqNullSafe(spread["_shared_host"])
        & (own["_line"] == spread["_shared_line"])
        & (own["_salt"] == spread["_shared_salt"]),
        "left_semi",
    )
    hits = hits.groupBy(*key).agg(F.collect_list("_line").alias("_lines"))
    found = hits.toDF("_hit_host", "_hit_digest", "_hit_digest2", "_lines")
    rows = docs.withColumns(digests)
    return rows.join(
        found,
        rows[host].eqNullSafe(found["_hit_host"])
        & (rows["_digest"] == found["_hit_digest"])
        & (rows["_digest2"] == found["_hit_digest2"]),
        "left",
    ).drop("_digest", "_digest2", "_hit_host", "_hit_digest", "_hit_digest2")


def without_lines(rows: DataFrame, text: str, removed: str) -> DataFrame:
    """``rows`` with clean_text, the text without the lines of ``_lines``, and how many these are.

    Every line is hashed once.  Where ``_lines`` is null the text is unchanged, empty for null.
    """
    body, hashes = text_of(text), F.col("_lines")
    kept = F.filter(
        lines_of(body), lambda line: ~(has_word(line) & F.array_contains(hashes, line_hash(line)))
    )
    rows = computed(rows, _kept=F.when(hashes.isNotNull(), kept))
    n_removed = F.size(lines_of(body)) - F.size("_kept")
    return rows.withColumns(
        {
            "clean_text": F.when(hashes.isNull(), body).otherwise(F.array_join("_kept", "\n")),
            removed: F.when(hashes.isNull(), F.lit(0)).otherwise(n_removed).cast("long"),
        }
    ).drop("_kept")
