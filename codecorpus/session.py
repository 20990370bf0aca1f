"""Session helpers: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only by a local master that names none, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="codecorpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside give the disk of their shuffles back once the written table stands for them.

    Otherwise those files stay until the driver happens to collect its garbage, so the disk would hold
    the shuffles of all steps at once.
    """
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage, so a lost executor costs no recomputation of earlier rounds.  Unlike an
    RDD checkpoint it computes ``df`` once, and the stored size is known to later join planning.
    ``by`` names a column whose values get folders of their own.
    """
    path = f"{shared_folder(df.sparkSession)}/codecorpus-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when a count proves that it has at most ``max_rows`` rows.

    Otherwise ``df`` comes back unchanged and joins shuffle.  ``df`` should be stored, since the
    count reads it (it stops after ``max_rows`` + 1 rows).
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
