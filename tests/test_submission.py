"""Submission strings, thresholds and the row check (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from cartflow.operators import features as FT
from cartflow.operators import submission as SUB


def _scored(fixture_tables, threshold):
    t = fixture_tables
    data = FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"], min_purchases=1, last_n=2)
    test = data.where("eval_set = 'test'").select("user_id", "product_id",
                                                   F.col("uxp_reorder_ratio").alias("score"))
    return SUB.apply_threshold(test, threshold)


def test_submission_thresholds(fixture_tables):
    orders = fixture_tables["orders"]
    for thr, expected in ((0.5, "100 300"), (0.6, "300"), (1.1, "None")):
        sub = SUB.submission(_scored(fixture_tables, thr), orders).collect()
        assert [(r["order_id"], r["products"]) for r in sub] == [(23, expected)]  # user 3: no history, no row


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.21,), (0.2099999,)], "score double")
    got = [r["prediction"] for r in SUB.apply_threshold(df, 0.21).orderBy("score").collect()]
    assert got == [0, 1]


def test_row_check(fixture_tables):
    t = fixture_tables
    sub = SUB.submission(_scored(fixture_tables, 0.5), t["orders"])
    r = SUB.submission_row_check(sub, t["orders"], t["prior_lines"]).first()
    assert (r["n_rows"], r["n_test_orders"], r["n_without_history"], r["ok"]) == (1, 2, 1, True)
