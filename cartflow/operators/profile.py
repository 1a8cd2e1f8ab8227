"""Order profile, top-k reports over the dimension tables, data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import bounded_broadcast


def basket_sizes(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """(order_id, user_id, order_number, basket_size, n_reordered) per order with lines."""
    per_order = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("basket_size"),
                                              F.sum("reordered").cast("long").alias("n_reordered"))
    return orders.select("order_id", "user_id", "order_number").join(per_order, "order_id", "inner")


def order_profile(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Per order number: orders, mean basket size, reorder share of lines."""
    b = basket_sizes(orders, lines)
    return b.groupBy("order_number").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("basket_size").alias("n_lines"),
        (F.sum("basket_size") / F.count(F.lit(1))).alias("mean_basket_size"),
        (F.sum("n_reordered") / F.sum("basket_size")).alias("reorder_share"))


def basket_size_histogram(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Number of orders per basket size."""
    return basket_sizes(orders, lines).groupBy("basket_size").agg(F.count(F.lit(1)).alias("n_orders"))


def orders_per_user_histogram(orders: DataFrame) -> DataFrame:
    """Number of users per count of orders."""
    per_user = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_orders"))
    return per_user.groupBy("n_orders").agg(F.count(F.lit(1)).alias("n_users"))


def _top(df: DataFrame, key: str, k: int) -> DataFrame:
    # Full tie-break (count desc, key asc) so the top-k is deterministic.
    return df.orderBy(F.col("n_lines").desc(), F.col(key).asc()).limit(k)


def top_products(lines: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most bought products with name and reorder share."""
    per = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                          F.avg("reordered").alias("reorder_share"))
    top = _top(per, "product_id", k)
    names = bounded_broadcast(products.select("product_id", "product_name"))
    return top.join(names, "product_id", "left").select("product_id", "product_name", "n_lines",
                                                       "reorder_share")


def _top_dim(lines: DataFrame, products: DataFrame, dim: DataFrame, key: str, label: str,
             k: int) -> DataFrame:
    pmap = bounded_broadcast(products.select("product_id", key))
    per = (lines.join(pmap, "product_id", "inner").groupBy(key)
           .agg(F.count(F.lit(1)).alias("n_lines"), F.avg("reordered").alias("reorder_share")))
    top = _top(per, key, k)
    return top.join(bounded_broadcast(dim), key, "left").select(key, label, "n_lines", "reorder_share")


def top_aisles(lines: DataFrame, products: DataFrame, aisles: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` aisles with most lines."""
    return _top_dim(lines, products, aisles, "aisle_id", "aisle", k)


def top_departments(lines: DataFrame, products: DataFrame, departments: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` departments with most lines."""
    return _top_dim(lines, products, departments, "department_id", "department", k)


def data_checks(orders: DataFrame, prior_lines: DataFrame, train_lines: DataFrame,
                features: DataFrame | None = None, train_set: DataFrame | None = None,
                test_set: DataFrame | None = None) -> DataFrame:
    """Q1: one row per rule with its violation count (0 = rule holds).

    Rules: unique order key, unique line key in prior and train lines, at most
    one future order per user, eval_set in the known set, no NULL key, no
    NULL in the feature table, and the same feature columns in the training
    and scoring sets (besides the label and the order key).
    """
    def dup_count(df, keys):
        return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("violations")))

    def rule(name, df):
        return df.select(F.lit(name).alias("rule"), "violations")

    checks = [
        rule("orders.order_id unique", dup_count(orders, ["order_id"])),
        rule("prior_lines (order_id, product_id) unique", dup_count(prior_lines, ["order_id", "product_id"])),
        rule("train_lines (order_id, product_id) unique", dup_count(train_lines, ["order_id", "product_id"])),
        rule("one future order per user",
             dup_count(orders.where(F.col("eval_set").isin("train", "test")), ["user_id"])),
        rule("eval_set known", orders.agg(
            F.count_if(~F.col("eval_set").isin("prior", "train", "test") | F.col("eval_set").isNull())
            .alias("violations"))),
        rule("orders keys not null", orders.agg(
            F.count_if(F.col("order_id").isNull() | F.col("user_id").isNull()
                       | F.col("order_number").isNull()).alias("violations"))),
    ]
    if features is not None:
        cols = [c for c in features.columns if c not in ("reordered", "order_id", "eval_set")]
        any_null = F.lit(False)
        for c in cols:
            any_null = any_null | F.col(c).isNull()
        nulls = features.agg(F.count_if(any_null).alias("violations"))
        checks.append(rule("feature table has no NULL", nulls))
        if train_set is not None and test_set is not None:
            # A schema rule: columns of one side missing on the other (driver metadata).
            extra = {"reordered", "order_id"}
            diff = (set(train_set.columns) - extra) ^ (set(test_set.columns) - extra)
            checks.append(nulls.select(F.lit("train and test share feature columns").alias("rule"),
                                       F.lit(len(diff)).cast("long").alias("violations")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
