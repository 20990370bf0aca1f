"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage is (spark, docs, folder of the tables) -> DataFrame.  All but the last return the columns
of ``documents``; where a stage changes a text, ``n_chars`` is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.decontam import decontaminate
from codecorpus.llm.frames import numbered, place, restored
from codecorpus.llm.line_dedup import site_line_dedup
from codecorpus.llm.mixing import mix, take_copies
from codecorpus.llm.quality import quality_rules
from codecorpus.llm.simhash import near_duplicates
from codecorpus.session import stored


def _with_text(rows: DataFrame, clean: Column, columns: list[str]) -> DataFrame:
    """The given columns with the text replaced; a text that did not change keeps its n_chars."""
    same = clean.eqNullSafe(F.col("text"))
    changed = {"text": clean}
    if "n_chars" in columns:
        n_chars = F.when(same, F.col("n_chars")).otherwise(F.length(clean).cast("long"))
        changed["n_chars"] = n_chars
    return rows.withColumns(changed).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose lines that too many documents of their host share."""
    rows = quality_rules(docs).where("kept")
    return _with_text(rows, F.col("clean_text"), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; documents stay, even if nothing is left of their text."""
    rows = site_line_dedup(docs)
    clean = F.when(F.col("text").isNotNull(), F.col("clean_text"))
    return _with_text(rows, clean, docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Rows that repeat a doc_id and its text are one document.  Rows without doc_id stay if one of
    them is in no group with an identified document.
    """
    groups = near_duplicates(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Join and duplicates both go by the id as text, empty for null, so texts are shuffled once.
    def key(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    first = first.select(key("doc_id").alias("_id")).distinct()
    own_id, text = (f"_in{place(docs, name)}" for name in ("doc_id", "text"))
    rows = numbered(docs).withColumns({"_id": key(own_id), "_digest": F.xxhash64(text)})
    rows = rows.join(first, "_id", "left_semi").dropDuplicates(["_id", "_digest"])
    return rows.select(*restored(docs, []))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontaminate(docs, benchmark).where(~F.col("dropped"))
    return _with_text(rows, F.col("clean_text"), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with ``copy`` from 1."""
    return take_copies(docs, mix(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL cannot express the hashes of SimHash nor the draws of the rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
