"""Tables kept by key: joins on the key need no shuffle of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` as a table of ``buckets`` files by hash of ``key``, sorted by it, in the shared folder; returns its scan.

    Each bucket is written by one task, so the shuffle that fills the buckets is the last one by this key.
    """
    spark, table = df.sparkSession, f"cartflow_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").option("path", shared_path(spark, "bucketed", table))
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def write_by_key(df: DataFrame, key: str, buckets: int, name: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(bucketed table, plain table of the rows of hot keys): keys with more than ``hot_rows`` rows would make one bucket long.

    The hot keys are those of one aggregate, kept in the shared folder, so the
    joins that tell the rows apart can split a hot key's partition.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key).checkpoint(eager=True)
    path = shared_path(df.sparkSession, "bucketed", f"{name}-hot-{uuid.uuid4().hex}")
    if not hot.count():
        df.limit(0).write.parquet(path)
        return write_bucketed(df, key, buckets, name), df.sparkSession.read.parquet(path)
    df.join(hot, key, "left_semi").write.parquet(path)
    return write_bucketed(df.join(hot, key, "left_anti"), key, buckets, name), df.sparkSession.read.parquet(path)
