"""Scoring at a threshold and the one-line-per-order submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import threshold_flag


def apply_threshold(scored: DataFrame, threshold: float = 0.21, score: str = "score") -> DataFrame:
    """M9 + P8: ``prediction = (score >= threshold)`` as INT."""
    return scored.withColumn("prediction", threshold_flag(F.col(score), threshold))


def test_orders(orders: DataFrame) -> DataFrame:
    """(user_id, order_id) of test orders."""
    return orders.where(F.col("eval_set") == "test").select("user_id", "order_id")


def submission(predictions: DataFrame, orders: DataFrame) -> DataFrame:
    """T7 (J11 + A12): one row per test order of a scored user.

    ``predictions`` has (user_id, product_id, prediction).  Products with
    prediction 1 are listed in ascending number, space-separated; an order
    with none gets the string ``None``.  Users without history have no
    scored pair and so no row, as in the reference.  The list of one order
    is bounded by the product catalogue.
    """
    joined = predictions.select("user_id", "product_id", "prediction").join(
        test_orders(orders), "user_id", "left")
    listed = joined.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("prediction") == 1, F.col("product_id")))).alias("_p"))
    return listed.select(
        "order_id",
        F.when(F.size("_p") > 0, F.array_join(F.transform("_p", lambda x: x.cast("string")), " "))
        .otherwise(F.lit("None")).alias("products"))


def submission_row_check(sub: DataFrame, orders: DataFrame, prior_lines: DataFrame) -> DataFrame:
    """Rows of the submission = test orders - test users without history.

    One row: n_rows, n_test_orders, n_without_history, ok.
    """
    tests = test_orders(orders)
    with_history = (orders.where(F.col("eval_set") == "prior").select("order_id", "user_id")
                    .join(prior_lines.select("order_id").distinct(), "order_id", "left_semi")
                    .select("user_id").distinct())
    no_hist = tests.join(with_history, "user_id", "left_anti")
    # Three counts as rows of one union, folded into one row by a global
    # aggregate (no join of one-row frames).
    parts = (sub.select(F.lit(1).alias("_w")).unionByName(tests.select(F.lit(2).alias("_w")))
             .unionByName(no_hist.select(F.lit(3).alias("_w"))))
    c = parts.agg(F.count_if(F.col("_w") == 1).alias("n_rows"), F.count_if(F.col("_w") == 2).alias("n_test_orders"),
                  F.count_if(F.col("_w") == 3).alias("n_without_history"))
    return c.select("n_rows", "n_test_orders", "n_without_history",
                    (F.col("n_rows") == F.col("n_test_orders") - F.col("n_without_history")).alias("ok"))
