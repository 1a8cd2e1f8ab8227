"""Models: seed-stable and better than chance on a planted signal."""

from pyspark.sql import functions as F

from cartflow.operators import features as FT
from cartflow.operators import models as M


def _planted(spark, n=4000):
    df = spark.range(n).select(F.col("id").alias("user_id"), (F.col("id") % 97).alias("product_id"))
    for i, c in enumerate(FT.FEATURES):
        df = df.withColumn(c, ((F.col("user_id") * (i + 3) * 7919) % 1000) / 1000.0)
    return df.withColumn("reordered", (F.col("uxp_reorder_ratio") > 0.6).cast("int"))


def test_forest_finds_planted_signal_and_is_reproducible(spark):
    df = _planted(spark)
    m1 = M.fit(M.random_forest(max_depth=5), df)
    m2 = M.fit(M.random_forest(max_depth=5), df)
    s1 = M.score(m1, df.withColumn("label", F.col("reordered")))
    assert M.auc(s1) > 0.95
    a = [r["score"] for r in s1.orderBy("user_id").limit(50).collect()]
    b = [r["score"] for r in M.score(m2, df).orderBy("user_id").limit(50).collect()]
    assert a == b


def test_importance_tables(spark):
    df = _planted(spark, 2000)
    m = M.fit(M.gradient_boosting(rounds=3), df)
    imp = M.feature_importance(m).collect()
    assert imp[0]["feature"] == "uxp_reorder_ratio"
    splits = {r["feature"]: r["splits"] for r in M.split_importance(m).collect()}
    assert splits["uxp_reorder_ratio"] > 0 and len(splits) == len(FT.FEATURES)
