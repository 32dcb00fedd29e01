from pyspark.sql import functions as F

from flowloom.common import LARGEST, cut


def test_the_estimated_size_stays_a_number_of_bounded_length(spark):
    """Joins multiply estimates and a checkpoint keeps them; over 30 rounds the number took all of the driver's memory."""
    live = spark.range(3)
    for _ in range(7):
        live = cut(live.join(live.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert live._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2 * LARGEST
    assert sorted(r.id for r in live.collect()) == [0, 1, 2] and not live.schema["id"].nullable


def test_a_small_estimate_is_kept(spark):
    df = spark.range(3).withColumn("x", F.lit("a"))
    assert cut(df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1000
