"""Spelling variants by blocked Gram matrices of letter counts.

Words become vectors of letter counts.  Words that differ by one inserted or deleted letter are at a
squared distance of one, by one replaced letter at two, so pairs at a squared distance of at most two
are the only ones to verify.  Distances come from matrix products of blocks: |a|^2 + |b|^2 - 2ab.

Blocks hold words of one length and equal counts over a few classes of letters.  An edit changes the
length by at most one and the class counts by at most one each, so a block only meets its neighbours:
the work grows with the words per neighbourhood, not with the square of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.frames import only
from codecorpus.session import stored

# --- fixed values of the contract --------------------------------------------------------------
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3

#: Classes of letters whose counts split a length; further letters are the last class.
CLASSES = ["eaà", "nrsé", "tiu", "oldh"]
#: Words of a block in one product; a longer block is several, and every pair of them is compared.
BLOCK_WORDS = 1024


def noisy_words(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters over all documents, some with one letter deleted.

    Which are changed follows from the crc32 of id and run.  A null id is empty in that hash, a null
    text holds no run.  Counted map-side, so a frequent word is one row per task.
    """
    docs = only(documents, _id=id_column, _text=text_column)
    run = F.explode(F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(RUN), F.lit(0)))
    ident = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    runs = docs.where(F.col("_text").isNotNull()).select(ident.alias("_id"), run.alias("run"))
    crc = F.crc32(F.concat("_id", F.lit(":"), "run"))
    gone = (F.col("h") % F.length("run")).cast("int")
    rest = F.concat(
        F.substr("run", F.lit(1), gone), F.substr("run", gone + 2, F.length("run"))
    )
    word = F.when(F.col("h") % EVERY == 0, rest).otherwise(F.col("run"))
    return (
        runs.withColumn("h", crc)
        .select(word.alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words that are long and frequent enough."""
    return words.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _class_counts(word: Column) -> list[Column]:
    """How many letters of each class a word has; the rest follows from its length."""
    return [
        F.length(word) - F.length(F.translate(word, letters, "")) for letters in CLASSES
    ]


def _changes() -> list[tuple[int, ...]]:
    """Differences of (length, class counts) between a word and an equal or later neighbour block.

    Length and first class first, so the half that is kept is the one that sorts after its opposite.
    """
    size = len(CLASSES)

    def unit(i: int, by: int) -> list[int]:
        return [by if k == i else 0 for k in range(size)]

    # The class at `size` is that of all further letters and has no count of its own.
    inserted = [(1, *unit(i, 1)) for i in range(size + 1)]
    replaced = [
        (0, *[a + b for a, b in zip(unit(i, 1), unit(j, -1))])
        for i in range(size + 1)
        for j in range(size + 1)
        if i != j
    ]
    same = (0,) * (size + 1)
    return [same, *[change for change in replaced if change > same], *inserted]


def _blocks(words: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(key, part, members) and (key, parts): words in blocks of about ``block_words``.

    The part of a word is a hash of it, so no block grows with the vocabulary.
    """
    key = F.array(F.length("word"), *_class_counts(F.col("word"))).alias("key")
    keyed = words.select(key, "word", "n")
    parts = stored(
        keyed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("key", F.ceil(F.col("size") / block_words).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")
    members = (
        keyed.join(parts, "key")
        .select("key", part, "word", "n")
        .groupBy("key", "part")
        .agg(F.collect_list(F.struct("word", "n")).alias("members"))
    )
    return stored(members), parts


def _block_pairs(parts: DataFrame) -> DataFrame:
    """(key, part, other_key, other_part): each pair of neighbour blocks once."""
    changes = F.array(*[F.array(*map(F.lit, change)) for change in _changes()])
    other = F.zip_with("key", "change", lambda a, b: a + b)
    ends = parts.select(F.col("key").alias("other_key"), F.col("parts").alias("others"))
    near = (
        parts.select("key", "parts", F.explode(changes).alias("change"))
        .withColumn("other_key", other)
        .join(ends, "other_key")
    )
    numbered = near.select(
        "key",
        "other_key",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "others",
    )
    return numbered.select(
        "key",
        "part",
        "other_key",
        F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other_part"),
    ).where((F.col("key") != F.col("other_key")) | (F.col("part") <= F.col("other_part")))


def _codes(words: np.ndarray) -> np.ndarray:
    """Code points of words of one length, one row per word."""
    length = len(words[0])
    return words.astype(f"U{length}").view(np.uint32).reshape(len(words), length)


def _letters(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Counts of the letters of the alphabet, one row per word."""
    places = np.searchsorted(alphabet, codes) + np.arange(len(codes))[:, None] * len(alphabet)
    counts = np.bincount(places.ravel(), minlength=len(codes) * len(alphabet))
    # Small whole numbers: products in float32 are exact up to 2^24, squares of 4096 letters.
    exact = np.float32 if codes.shape[1] < 4096 else np.float64
    return counts.reshape(len(codes), len(alphabet)).astype(exact)


def close_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose letter counts are at a squared distance of at most two."""
    alphabet = np.union1d(left, right)
    a, b = _letters(left, alphabet), _letters(right, alphabet)
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.nonzero(squared <= 2)


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows of codes differ by exactly one inserted, deleted or replaced code point."""
    if left.shape[1] > right.shape[1]:
        left, right = right, left
    if left.shape[1] == right.shape[1]:
        return (left != right).sum(axis=1) == 1
    # The longer one is right: equal up to some place, and from there on if shifted by one.
    length = left.shape[1]
    before = np.logical_and.accumulate(left == right[:, :length], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= length


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            same = batch.column("same")[row].as_py()
            left, n_left = _members(batch.column("members"), row)
            right, n_right = (left, n_left) if same else _members(batch.column("others"), row)
            a, b = _codes(left), _codes(right)
            i, j = close_pairs(a, b)
            if same:
                i, j = i[i < j], j[i < j]
            # Verified in slices, so that many candidates of long words stay small in memory.
            step = max(1, (1 << 22) // a.shape[1])
            near = [one_edit(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
            if not near or not any(part.any() for part in near):
                continue
            near = np.concatenate(near)
            i, j = i[near], j[near]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(left[i], pa.string()),
                    pa.array(n_left[i], pa.int64()),
                    pa.array(right[j], pa.string()),
                    pa.array(n_right[j], pa.int64()),
                ],
                ["word", "n", "near", "near_n"],
            )


def _members(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    values = column[row].values
    words = values.field("word").to_numpy(zero_copy_only=False)
    return words, values.field("n").to_numpy()


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart, once.

    ``words`` is a stored table (word, n) of distinct words.  A pair of blocks is one row of at most
    about 2 * ``block_words`` words, whatever the sizes of their neighbourhoods.
    """
    members, parts = _blocks(words, block_words)
    pairs = _block_pairs(parts)
    same = (F.col("key") == F.col("other_key")) & (F.col("part") == F.col("other_part"))
    right = members.select(
        F.col("key").alias("other_key"), F.col("part").alias("other_part"),
        F.col("members").alias("others"),
    )
    joined = (
        pairs.join(members, ["key", "part"])
        .join(right, ["other_key", "other_part"])
        .select(same.alias("same"), "members", "others")
    )
    schema = "word string, n long, near string, near_n long"
    return joined.mapInArrow(_compare, schema)


def variant_forms(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table (word, n) of distinct words.

    The form of a word is its most frequent neighbour (ties: the first in code-point order) if that
    is at least twice as frequent; the root is the end of the chain of forms, the word itself if it
    has no form.  Counts double along a chain, so it has at most log2 of the largest count steps, and
    jumping over known steps ends after the logarithm of that.
    """
    words = stored(words)
    pairs = near_words(words, block_words)
    both = pairs.unionByName(
        pairs.select(
            F.col("near").alias("word"), F.col("near_n").alias("n"),
            F.col("word").alias("near"), F.col("n").alias("near_n"),
        )
    )
    best = stored(
        both.groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"),
        )
    )
    with_best = words.join(best, "word", "left")
    takes = -F.col("best.order") >= 2 * F.col("n")
    forms = stored(
        with_best.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"),
            F.when(takes, -F.col("best.order")).alias("form_n"),
        )
    )
    steps = forms.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        jumped = steps.join(ahead, "to", "left")
        steps = stored(
            jumped.select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        )
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("word", "to")
    roots = steps.select("word", F.col("to").alias("root"))
    joined = forms.join(roots, "word", "left")
    return joined.withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """Words of the documents with their spelling groups, as ``variant_forms``.

    Repeated rows count as often as they stand; null and empty texts hold no words; a table without
    words gives no rows; other columns are ignored.
    """
    words = noisy_words(documents, id_column, text_column)
    return variant_forms(vocabulary(words, least_length, least_count))
