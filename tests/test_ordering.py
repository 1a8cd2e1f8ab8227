"""Skew-safe running numbers/sums against the plain window (brute force)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartflow.functions.ordering import grouped_row_number, running_sums


def test_row_number_with_hot_group(spark):
    # group 0 holds about half the rows, so it spans several range partitions
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("g"),
        (F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    got = grouped_row_number(df, ["g"], ["k", "id"], "rn", num_partitions=7)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    a = sorted(tuple(r) for r in got.select("id", "rn").collect())
    b = sorted(tuple(r) for r in want.select("id", "rn").collect())
    assert a == b


def test_global_running_sum(spark):
    df = spark.range(0, 3000).select((F.col("id") % 101).alias("s"), (F.col("id") % 3).alias("v"), "id")
    got = running_sums(df, [], [F.col("s").desc(), F.col("id")], {"cum": F.col("v")}, num_partitions=5)
    w = Window.orderBy(F.col("s").desc(), F.col("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("cum", F.sum("v").over(w))
    a = sorted(tuple(r) for r in got.select("id", "cum").collect())
    b = sorted(tuple(r) for r in want.select("id", "cum").collect())
    assert a == b
