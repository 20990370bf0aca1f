"""From stored files to the ``files`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import dims, paths
from codecorpus.functions.rows import computed, unnest
from codecorpus.functions.text import glob_body, is_blank, is_comment, let, split_lines, strip
from codecorpus.session import broadcast_if_small, stored


def scan_corpus(
    spark: SparkSession, root: str, *, glob: str | None = None, with_content: bool = True
) -> DataFrame:
    """Files below ``root/<repo>/…``: repo, path, size_bytes, mtime, content (binary).

    Listing and reading are distributed by the binary file source; without content only the
    metadata columns are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    # Compare on the part after the scheme: the source reports file:/x, hdfs://h/x, s3a://b/x.
    base = root.split("://")[-1].replace("file:", "").rstrip("/")
    relative = F.substring_index(F.col("path"), f"{base}/", -1)
    columns = [
        F.split_part(relative, F.lit("/"), F.lit(1)).alias("repo"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    ]
    if with_content:
        columns.append(F.col("content"))
    return reader.load(root).select(*columns)


#: Bytes of contents and number of files that one task parses.
TASK_BYTES = 32 * 1024 * 1024
TASK_FILES = 20_000


def spread(rows: DataFrame, most: int = TASK_FILES, text: str | None = None) -> DataFrame:
    """Rows over at least as many partitions as there are cores and as their measured work asks for.

    A task gets about ``most`` rows, and about ``TASK_BYTES`` of the column ``text`` if one is named.
    Only a source with fewer splits than that (small, stored as one row group, or of rows that each
    make much work) is moved; a large corpus has many splits and stays where it is.  Splits are made
    by stored bytes, which tell little about texts: those that repeat shrink to almost nothing.
    """
    length = F.lit(0) if text is None else F.octet_length(text)
    size, n = rows.agg(F.coalesce(F.sum(length), F.lit(0)), F.count(F.lit(1))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-size // TASK_BYTES), -(-n // most))
    return rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted)


def even(files: DataFrame) -> DataFrame:
    """Stored ``files`` dealt by key into parts of equal work, as many as their measured size asks for.

    Spark makes splits by stored bytes, at most 128 MB of them.  Contents shrink very differently
    when stored, so a split may hold any amount of text, and the longest task would grow with it.
    """
    size, n = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, -(-size // TASK_BYTES), -(-n // TASK_FILES))
    return files.repartition(parts, "repo", "path")


def filter_depth(raw_files: DataFrame, max_depth: int = dims.MAX_DEPTH) -> DataFrame:
    """Files with at most ``max_depth`` directories above them."""
    return raw_files.where(F.size(F.split("path", "/")) - 1 <= max_depth)


def filter_default_ignores(raw_files: DataFrame) -> DataFrame:
    return raw_files.where(~paths.default_ignored(F.col("path")))


def ignore_patterns(raw_files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Ignore globs per repository: lines of the root ``.gitignore`` and the caller's own list."""
    own = unnest(
        raw_files.where(F.col("path") == ".gitignore"),
        ["repo"],
        split_lines(F.col("content").cast("string")),
        "line",
    )
    glob = strip(F.col("line"))
    own = own.select("repo", glob.alias("glob")).where((glob != "") & ~glob.startswith("#"))
    if extra:
        added = F.explode(F.array(*[F.lit(g) for g in extra])).alias("glob")
        own = own.unionByName(raw_files.select("repo").distinct().select("repo", added))
    return own.select("repo", F.regexp_replace("glob", "/+$", "").alias("glob")).distinct()


def ignore_matchers(globs: DataFrame) -> DataFrame:
    """(repo, matcher): one regular expression per repository that finds ignored paths.

    A glob hides a path when it matches one component of it, or the path up to the end of any
    component; so an ignored directory hides its subtree.
    """
    one = F.struct(
        glob_body(F.col("glob"), crosses=False).alias("name"),
        glob_body(F.col("glob"), crosses=True).alias("prefix"),
    )
    bodies = globs.groupBy("repo").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def either(field: str) -> Column:
        return F.array_join(F.transform("all", lambda b: b[field]), "|")

    end = F.lit(r")(?:/|\z)")
    matcher = F.concat(
        F.lit("(?s)(?:^|/)(?:"), either("name"), end, F.lit("|^(?:"), either("prefix"), end
    )
    return bodies.select("repo", matcher.alias("matcher"))


def hidden_keys(raw_files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(repo, path) of files that an ignore glob of their repository hides; contents are not read.

    The matchers of all repositories are stored and measured: small ones are broadcast, others
    are joined on a salted key, which moves paths only.
    """
    matchers = stored(ignore_matchers(ignore_patterns(raw_files, extra)))
    keys = raw_files.select("repo", "path")
    size = matchers.agg(F.sum(F.octet_length("matcher"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = keys.join(F.broadcast(matchers), "repo")
    else:
        joined = per_repo_facts(keys, matchers, "inner")
    return joined.where(F.rlike(F.col("path"), F.col("matcher"))).select("repo", "path")


def filter_gitignore(raw_files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Drop files that a glob of their repository hides, also through a parent directory.

    Which paths are hidden is decided on paths alone and stored.  They are then taken out by broadcast anti
    joins, each with keys of at most about ``BROADCAST_BYTES``, so contents are in no exchange
    however many patterns and hidden files there are.
    """
    hidden = stored(hidden_keys(raw_files, extra).distinct())
    length = F.octet_length("repo") + F.octet_length("path") + 32
    size = hidden.agg(F.sum(length)).first()[0] or 0
    blocks = max(1, -(-size // BROADCAST_BYTES))
    kept = raw_files
    for block in range(blocks):
        mine = hidden.where(F.pmod(F.xxhash64("repo", "path"), F.lit(blocks)) == block)
        kept = kept.join(F.broadcast(mine), ["repo", "path"], "left_anti")
    return kept


SALTS = 16
BROADCAST_BYTES = 64 * 1024 * 1024


def per_repo_facts(rows: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Join one row per repository to many rows per repository.

    A single repository may hold a large part of all rows, so its rows are spread over ``SALTS``
    keys and the one-row-per-repository side is repeated for each.  Spark still broadcasts that
    side by itself when its measured size allows.
    """
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["repo", "_salt"], how).drop("_salt")


def is_binary(content: Column) -> Column:
    """Known signature or a zero byte within the first bytes; empty files are text."""
    head = F.hex(F.substring(content.cast("binary"), 1, dims.SNIFF_BYTES))
    signature = f"^({'|'.join(dims.BINARY_SIGNATURES_HEX)})"
    return head.rlike(signature) | head.rlike("^(?:..)*?00")


def filter_binary(raw_files: DataFrame) -> DataFrame:
    return raw_files.where(~is_binary(F.col("content")))


def decode_text(
    content: Column, size_bytes: Column, max_bytes: int | None = dims.MAX_TEXT_BYTES
) -> Column:
    """UTF-8 text with replacement characters; NULL above ``max_bytes``, if that is not None."""
    text = F.make_valid_utf8(content.cast("string"))
    return text if max_bytes is None else F.when(size_bytes <= max_bytes, text)


def count_lines(content: Column) -> Column:
    """Struct of total, blank, comment and code lines of one text."""

    def counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("total"),
            F.size(F.filter(lines, is_blank)).alias("blank"),
            F.size(F.filter(lines, is_comment)).alias("comment"),
        )

    def with_code(c: Column) -> Column:
        code = F.greatest(c["total"] - c["blank"] - c["comment"], F.lit(0))
        return F.struct(c["total"], c["blank"], c["comment"], code.alias("code"))

    return let(let(split_lines(content), counts), with_code)


def file_facts(texts: DataFrame) -> DataFrame:
    """(repo, path, size_bytes, content) → the ``files`` table, row by row."""
    name = paths.file_name(F.col("path"))
    named = texts.select(
        "repo",
        "path",
        name.alias("name"),
        paths.language_of(name).alias("language"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        "content",
    )
    counted = named.withColumn("n", count_lines(F.col("content")))

    def number(field: str, alias: str) -> Column:
        return F.coalesce(F.col(f"n.{field}"), F.lit(0)).alias(alias)

    return counted.select(
        "repo",
        "path",
        "name",
        "language",
        "size_bytes",
        number("total", "line_count"),
        number("blank", "blank_lines"),
        number("comment", "comment_lines"),
        number("code", "code_lines"),
        "content",
    )


def build_files(
    raw_files: DataFrame,
    *,
    max_depth: int = dims.MAX_DEPTH,
    extra_ignores: list[str] | None = None,
    max_bytes: int | None = dims.MAX_TEXT_BYTES,
) -> DataFrame:
    """raw files (binary content) → ``files``: path filters first, content last.

    Files of more than ``max_bytes`` are listed without content; None reads all of them.
    """
    kept = filter_gitignore(
        filter_default_ignores(filter_depth(raw_files, max_depth)), extra_ignores
    )
    texts = filter_binary(kept).withColumn(
        "content", decode_text(F.col("content"), F.col("size_bytes"), max_bytes)
    )
    return file_facts(texts)


def content_hash(raw_files: DataFrame) -> DataFrame:
    return raw_files.withColumn("content_sha", F.sha2(F.col("content").cast("binary"), 256))


#: Bits of the filter of known hashes: 8 MiB as an array of words.
FILTER_BITS = 1 << 26
FILTER_HASHES = 6
PREFIX_CHARS = 2


def _filter_places(sha: Column, bits: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)
    ]


def known_filter(known: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A Bloom filter of the hashes in ``known`` as one value: an array of 64-bit words.

    Its size is fixed by ``bits``.  With more hashes more unknown ones look known, which costs a
    second look at those files and never a result.
    """
    places = F.explode(F.array(*_filter_places(F.col("content_sha"), bits))).alias("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = (
        known.select(places)
        .groupBy(F.floor(F.col("place") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    every = known.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").fillna(0, ["bits"])
    one = filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return one.select(F.transform("words", lambda w: w["bits"])).scalar()


def _may_hold(words: str, sha: Column, bits: int) -> Column:
    holds = F.lit(True)
    for place in _filter_places(sha, bits):
        word = F.get(words, F.floor(place / 64).cast("int"))
        shifted = F.call_function("shiftrightunsigned", word, (place % 64).cast("int"))
        holds = holds & (shifted.bitwiseAND(F.lit(1).cast("long")) == 1)
    return holds


def incremental_scan(
    raw_files: DataFrame,
    known: DataFrame,
    analyse: Callable[[DataFrame], DataFrame],
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Results per file, computed only for contents whose SHA-256 is not in ``known``.

    ``known`` holds one row per hash with the result columns of ``analyse``, which maps
    (content_sha, content) to (content_sha, results…).  Every new hash is analysed once, however
    many copies there are; copies share the result.  A null content has no hash and no result.
    """
    keys, fresh = _scan(raw_files, known, analyse, filter_bits)
    results = known.withColumn("reused", F.lit(True)).unionByName(
        fresh.withColumn("reused", F.lit(False))
    )
    return _with_results(keys, results)


def scan_with_state(
    raw_files: DataFrame,
    folder: str,
    analyse: Callable[[DataFrame], DataFrame],
    schema: str,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``incremental_scan`` that keeps its results in ``folder`` from run to run.

    The results are one append-only table (content_sha, results…) by the first characters of the
    hash; ``schema`` gives these columns.  A run appends the results of new hashes only, and reads
    results only of prefixes that occur.
    """
    spark = raw_files.sparkSession
    place = f"{schema}, prefix string"
    # The first run has no table yet.
    spark.createDataFrame([], place).write.mode("append").partitionBy("prefix").parquet(folder)
    known = spark.read.schema(place).parquet(folder)
    # What is known is fixed now: later appends add files that this run must not read as known.
    written = known.inputFiles()
    before = known.limit(0)
    if written:
        before = spark.read.schema(place).option("basePath", folder).parquet(*written)
    columns = [c for c in known.columns if c != "prefix"]
    keys, fresh = _scan(raw_files, before.select(*columns), analyse, filter_bits)
    fresh = stored(fresh.select(*columns))
    prefix = F.substring("content_sha", 1, PREFIX_CHARS)
    by_prefix = fresh.withColumn("prefix", prefix).repartition("prefix")
    by_prefix.write.mode("append").partitionBy("prefix").parquet(folder)
    occurring = [r[0] for r in keys.select(prefix).distinct().collect()]
    results = before.where(F.col("prefix").isin(occurring)).select(*columns).withColumn("reused", F.lit(True)).unionByName(
        fresh.withColumn("reused", F.lit(False))
    )
    return _with_results(keys, results)


def _scan(
    raw_files: DataFrame, known: DataFrame, analyse: Callable, filter_bits: int
) -> tuple[DataFrame, DataFrame]:
    """(repo, path, content_sha) of all files, and results of the hashes that are not known.

    One pass reads and hashes each content and stores the keys, together with the contents whose
    hash the filter does not hold: those are new for certain.  Among the rest an anti join on
    hashes finds the few that only look known; their files are read again.
    """
    hashed = computed(
        raw_files.select("repo", "path", "content"),
        content_sha=F.sha2(F.col("content").cast("binary"), 256),
    ).where(F.col("content_sha").isNotNull())
    filtered = hashed.withColumn("_words", known_filter(known.select("content_sha"), filter_bits))
    may = _may_hold("_words", F.col("content_sha"), filter_bits)
    seen = stored(
        filtered.select(
            "repo", "path", "content_sha", may.alias("_may"), F.when(~may, F.col("content")).alias("content")
        )
    )
    keys = seen.select("repo", "path", "content_sha")

    def first_files(rows: DataFrame) -> DataFrame:
        """One file of each hash; copies are counted out map-side."""
        first = rows.groupBy("content_sha").agg(F.min(F.struct("repo", "path")).alias("file"))
        return first.select("file.*", "content_sha")

    new = stored(first_files(seen.where(~F.col("_may")).select("repo", "path", "content_sha")))
    fresh = seen.where(~F.col("_may")).join(
        broadcast_if_small(new), ["repo", "path", "content_sha"], "left_semi"
    )
    fresh = fresh.select("content_sha", "content")
    look = first_files(seen.where("_may").select("repo", "path", "content_sha"))
    look = stored(look.join(known.select("content_sha"), "content_sha", "left_anti"))
    if not look.isEmpty():
        again = raw_files.select("repo", "path", "content").join(
            broadcast_if_small(look), ["repo", "path"]
        )
        fresh = fresh.unionByName(again.select("content_sha", "content"))
    # Rows that repeat a file are one content.
    return keys, analyse(fresh.dropDuplicates(["content_sha"]))


#: Files of one content from which on its result is joined by broadcast.
HOT_COPIES = 100_000


def _with_results(keys: DataFrame, results: DataFrame) -> DataFrame:
    """Results joined to files; hashes of very many copies apart, so that none is a hot key."""
    copies = keys.groupBy("content_sha").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(copies.where(F.col("n") > HOT_COPIES).select("content_sha"))
    if hot.isEmpty():
        return keys.join(results, "content_sha")
    few = broadcast_if_small(hot)
    usual = keys.join(few, "content_sha", "left_anti").join(results, "content_sha")
    common = stored(results.join(few, "content_sha", "left_semi"))
    return usual.unionByName(keys.join(broadcast_if_small(common), "content_sha"))
