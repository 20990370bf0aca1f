import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def raw(spark):
    """Raw files from (repo, path, text or bytes) tuples."""

    def build(*rows):
        data = [
            (repo, path, bytearray(body.encode() if isinstance(body, str) else body))
            for repo, path, body in rows
        ]
        frame = spark.createDataFrame(data, "repo string, path string, content binary")
        return frame.withColumn("size_bytes", F.octet_length("content"))

    return build
