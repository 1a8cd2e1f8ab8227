"""Sizes without caps, columns by name, NULL keys, large totals, hot keys in join plans."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cartflow.functions.ordering import grouped_row_number
from cartflow.operators import baskets as B
from cartflow.operators import evaluate as E
from cartflow.operators import features as FT
from cartflow.sources import csv as CSV
from cartflow.sources import schemas


def test_csv_columns_by_name_and_missing_ones_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("order_id,product_id,add_to_cart_order,reordered\n1,10,7,0\n2,20,8,1\n")
    df = CSV.by_name(spark, str(tmp_path / "x.csv"), schemas.ORDER_LINES)
    assert [tuple(r) for r in df.orderBy("order_id").select("order_id", "reordered").collect()] == [(1, 0), (2, 1)]
    (tmp_path / "y.csv").write_text("product_id,reordered,order_id\n10,0,1\n")
    assert [r.asDict() for r in CSV.by_name(spark, str(tmp_path / "y.csv"), schemas.ORDER_LINES).collect()] == [
        {"order_id": 1, "product_id": 10, "reordered": 0}]
    (tmp_path / "z.csv").write_text("order_id,product_id\n1,10\n")
    with pytest.raises(ValueError, match="reordered"):
        CSV.by_name(spark, str(tmp_path / "z.csv"), schemas.ORDER_LINES)


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(3)], "k long, v long")
    got = sorted((r.k or -1, r.v, r.n) for r in grouped_row_number(df, ["k"], ["v"], "n").collect())
    assert got == sorted([(-1, i, i + 1) for i in range(5)] + [(1, i, i + 1) for i in range(3)])


def brute(lines, k, least):
    by_order = {}
    for o, p in lines:
        by_order.setdefault(o, set()).add(p)
    counts = {}
    for items in by_order.values():
        for c in itertools.combinations(sorted(items), k):
            counts[c] = counts.get(c, 0) + 1
    return {c: n for c, n in counts.items() if n >= least * len(by_order)}


def test_more_than_five_thousand_frequent_items(spark):
    lines = [(o, p) for o in range(3000) for p in (2 * o, 2 * o + 1)]
    df = spark.createDataFrame(lines, "order_id long, product_id long")
    got = {(r.item_a, r.item_b): r.n_orders for r in B.frequent_pairs(df, 1 / 3000).collect()}
    assert got == brute(lines, 2, 1 / 3000) and len(got) == 3000


def test_one_basket_with_a_third_of_the_lines(spark):
    rng = random.Random(2)
    lines = [(0, p) for p in range(300)] + [(o, rng.randrange(300)) for o in range(1, 150) for _ in range(4)]
    df = spark.createDataFrame(lines, "order_id long, product_id long")
    for k, fn in ((2, B.frequent_pairs), (3, B.frequent_triples)):
        got = {tuple(r[f"item_{c}"] for c in "abc"[:k]): r.n_orders for r in fn(df, 0.013).collect()}
        assert got == brute(lines, k, 0.013)


def test_auc_of_large_totals(spark):
    pts = spark.range(1).select(F.lit(4_000_000_000).alias("_P"), F.lit(4_000_000_000).alias("_N"))
    assert pts.select(F.col("_P").cast("double") * F.col("_N")).first()[0] == 1.6e19
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    assert E.roc_auc(df).first().auc == 0.875


def test_hot_keys_are_split(spark):
    """One key has a third of the rows; with broadcasts off AQE must split its partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        op = spark.range(60_000, numPartitions=16).select(
            F.col("id").alias("order_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"),
            F.col("id").cast("int").alias("order_number"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("product_id"),
            F.lit(1).alias("reordered"))
        frame = FT.product_group_filter(op, 40)
        frame.write.format("noop").mode("overwrite").save()
        rows = frame.collect()
        assert len(rows) > 20_000 and "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_types_of_any_number_get_ids_that_do_not_collide(spark):
    from cartflow.sources.testdata import product_tables
    rows = [(b * 1000 + t, f"part {t}", f"Brand#{b}", f"type {t:03}") for b in (1, 13, 14) for t in range(112)] + [(9, "none", "Brand#13", None)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string")
    category = product_tables(part, "category")
    assert category["part_map"].select("product_id").distinct().count() == 3 * 112 == category["products"].count()
    assert [r.department_id for r in category["departments"].orderBy("department").collect()] == list(range(1, 113))
    assert product_tables(part, "brand")["part_map"].count() == len(rows)  # no type needed there


def test_tables_of_each_fitted_model_and_the_grids_submission(spark):
    from cartflow.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    facts = {r.model: r for r in QUERIES["model_contract"](spark, sf).collect()}
    assert set(facts) == {"logistic_regression", "random_forest", "gradient_boosting", "decision_tree"}
    cells = QUERIES["model_confusion_matrices"](spark, sf).collect()
    report = {(r.model, r["class"]): r for r in QUERIES["model_reports"](spark, sf).collect()}
    for model, f in facts.items():
        assert sum(r.n for r in cells if r.model == model) == f.n_rows
        assert report[(model, "1")].support == f.n_positive and report[(model, "accuracy")].support == f.n_rows
    last = {r.model: (r.tp, r.fp) for r in QUERIES["model_roc_points"](spark, sf).orderBy(F.col("threshold").desc()).collect()}
    assert last == {m: (f.n_positive, f.n_rows - f.n_positive) for m, f in facts.items()}
    lines = QUERIES["grid_search_submission"](spark, sf).collect()
    assert sorted(r.order_id for r in lines) == sorted(r.order_id for r in QUERIES["model_submission_orders"](spark, sf).collect())
    up = [r.importance for r in QUERIES["feature_importance_ascending"](spark, sf).collect()]
    assert up == sorted(up)


def test_each_data_check_finds_its_planted_violation(spark):
    from cartflow.operators.profile import data_checks
    orders = spark.createDataFrame([(1, 1, "prior", 1), (1, 1, "prior", 2), (2, 1, "train", 3), (3, 1, "test", 4), (4, None, "later", 1)],
                                   "order_id long, user_id long, eval_set string, order_number int")  # nullable, unlike the schema
    lines = spark.createDataFrame([(1, 7, 0), (1, 7, 0), (1, 7, 1)], schemas.ORDER_LINES)
    features = spark.createDataFrame([(1, 7, 0.5), (1, 8, None)], "user_id long, product_id long, f double")
    found = {r.rule: r.violations for r in data_checks(orders, lines, lines.limit(1), features, features, features.withColumnRenamed("f", "g")).collect()}
    assert found == {"orders.order_id unique": 1, "prior_lines (order_id, product_id) unique": 2, "train_lines (order_id, product_id) unique": 0,
                     "one future order per user": 1, "eval_set known": 1, "orders keys not null": 1, "feature table has no NULL": 1,
                     "train and test share feature columns": 2}
