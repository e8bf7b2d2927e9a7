"""What the session settings bound."""

from pyspark.sql import functions as F


def test_shuffled_pieces_are_bounded(spark):
    # More than a piece for each core may hold: pieces stay small instead of growing with the input.
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        rows = spark.range(16_000_000).select(F.xxhash64("id").alias("k")).repartition("k")
        largest = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set(key, before)
    assert largest < 1_200_000
