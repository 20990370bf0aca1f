"""Numbers of all rows of a group, when one group is too large for a task."""

from codecorpus.operators import rank
from pyspark.sql import functions as F


def test_rows_of_a_large_group_are_numbered_in_ranges(spark):
    rows = spark.range(0, 1000, 1, 3).select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("r"), F.col("id") % 3))
        .when(F.col("id") % 5 == 1, F.lit(None))
        .otherwise("large")
        .alias("repo"),
        F.md5(F.col("id").cast("string")).alias("path"),
        F.col("id").alias("code_lines"),
    )
    whole = rank.top_k(rows, None, F.col("path"))
    dealt = rank.numbered(rows, F.col("path"), task_rows=60)
    assert dealt.schema.simpleString() == whole.schema.simpleString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    # No window goes over more than about one range of the large group.
    tasks = dealt.where("repo = 'large'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1
