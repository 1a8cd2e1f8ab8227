"""Feature operators on the hand-made fixture (FIXTURES.md §4) and their properties."""

import pytest
from pyspark.sql import functions as F

from cartflow.operators import features as FT


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_user_features(fixture_tables):
    op = FT.purchase_history(fixture_tables["orders"], fixture_tables["prior_lines"])
    got = rows(FT.user_features(op), "user_id", "u_total_orders", "u_reordered_ratio")
    assert got[0][:2] == (1, 3) and got[0][2] == pytest.approx(0.4)
    assert got[1][:2] == (2, 2) and got[1][2] == pytest.approx(1 / 3)


def test_product_features_rule_is_strictly_greater(fixture_tables):
    op = FT.purchase_history(fixture_tables["orders"], fixture_tables["prior_lines"])
    got = {r[0]: (r[1], r[2]) for r in rows(FT.product_features(op, 1), "product_id", "p_total_purchases",
                                            "p_reorder_ratio")}
    assert got[100] == (4, pytest.approx(0.5))
    assert got[200] == (1, 0.0)          # exactly min_purchases lines -> 0, not the mean
    assert got[300][0] == 3 and got[300][1] == pytest.approx(1 / 3)


def test_user_product_features_last_n(fixture_tables):
    op = FT.purchase_history(fixture_tables["orders"], fixture_tables["prior_lines"])
    got = {(r[0], r[1]): r[2:] for r in rows(FT.user_product_features(op, last_n=2), "user_id", "product_id",
                                             "uxp_total_bought", "uxp_reorder_ratio", "times_last5")}
    assert got[(1, 100)] == (3, 1.0, 2)
    assert got[(1, 200)][0] == 1 and got[(1, 200)][1] == pytest.approx(1 / 3) and got[(1, 200)][2] == 0
    assert got[(1, 300)] == (1, 1.0, 1)
    assert got[(2, 100)] == (1, 0.5, 1)
    assert got[(2, 300)] == (2, 1.0, 2)


def test_fused_equals_stepwise_and_labels(fixture_tables):
    t = fixture_tables
    fused = FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"], min_purchases=1, last_n=2)
    op = FT.purchase_history(t["orders"], t["prior_lines"])
    step = FT.feature_table(FT.user_product_features(op, 2), FT.user_features(op),
                            FT.product_features(op, 1), t["orders"])
    cols = ["user_id", "product_id", *FT.FEATURES, "eval_set", "order_id"]
    a = rows(fused.select(*cols), *cols)
    b = rows(step.select(*cols), *cols)
    assert len(a) == len(b) == 5
    for x, y in zip(a, b):
        assert x[:2] == y[:2] and x[-2:] == y[-2:]
        assert all(u == pytest.approx(v) for u, v in zip(x[2:-2], y[2:-2]))
    labels = {(r[0], r[1]): r[2] for r in rows(fused.where("eval_set = 'train'"), "user_id", "product_id",
                                               "reordered")}
    assert labels == {(1, 100): 1, (1, 200): 0, (1, 300): 0}   # product 400 never bought before: absent
    train = FT.training_set(step, t["train_lines"])
    assert rows(train, "user_id", "product_id", "reordered") == [(1, 100, 1), (1, 200, 0), (1, 300, 0)]


def test_golden_ratios_from_prose(spark):
    # user ratio 0,1,0,0,1,1 -> 0.5; product ratio 0,1,0,0,1,1,0,0,1 -> 4/9
    from cartflow.sources import schemas
    orders = spark.createDataFrame([(i, 7, "prior", i) for i in range(1, 10)], schemas.ORDERS)
    flags = [0, 1, 0, 0, 1, 1, 0, 0, 1]
    lines = spark.createDataFrame([(i, 5, f) for i, f in zip(range(1, 10), flags)], schemas.ORDER_LINES)
    op = FT.purchase_history(orders, lines)
    assert FT.product_features(op, 0).first()["p_reorder_ratio"] == pytest.approx(4 / 9)
    six = FT.purchase_history(orders, lines.where("order_id <= 6"))
    assert FT.user_features(six).first()["u_reordered_ratio"] == pytest.approx(0.5)


def test_pair_ratio_golden(spark):
    # 10 orders, first purchase in order 2, bought 3 times -> 3 / 9
    from cartflow.sources import schemas
    orders = spark.createDataFrame([(i, 1, "prior", i) for i in range(1, 11)], schemas.ORDERS)
    lines = spark.createDataFrame([(2, 13032, 0), (5, 13032, 1), (9, 13032, 1)]
                                  + [(i, 1, 0) for i in range(1, 11)], schemas.ORDER_LINES)
    op = FT.purchase_history(orders, lines)
    r = FT.user_product_features(op).where("product_id = 13032").first()
    assert r["uxp_reorder_ratio"] == pytest.approx(1 / 3)
    back = FT.order_number_back(op).where("order_id = 10").select("order_number_back").first()[0]
    assert back == 1


def test_properties_on_test_data(spark):
    from cartflow.sources import load
    t = load(spark, "/root/testdata/sf0.001", "item")
    data = FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"])
    n_op = FT.purchase_history(t["orders"], t["prior_lines"]).count()
    agg = data.agg(F.sum("uxp_total_bought").alias("s"),
                   F.count_if((F.col("uxp_reorder_ratio") <= 0) | (F.col("uxp_reorder_ratio") > 1)).alias("bad_ratio"),
                   F.count_if(F.col("times_last5") > F.least(F.lit(5), F.col("uxp_total_bought"))).alias("bad_last")
                   ).first()
    assert agg["s"] == n_op
    assert agg["bad_ratio"] == 0 and agg["bad_last"] == 0


def test_independent_of_shuffle_partitions(spark):
    from cartflow.sources import load
    t = load(spark, "/root/testdata/sf0.001", "category")
    cols = ["user_id", "product_id", *FT.FEATURES, "reordered"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = rows(FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"]).select(*cols), *cols)
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = rows(FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"]).select(*cols), *cols)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
