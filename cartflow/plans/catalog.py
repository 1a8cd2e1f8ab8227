"""

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs over the whole tables of
``sf_dir``; ``SQL[name]`` is the DuckDB text of the same result (missing for
model-based queries, whose results cannot be written in SQL).

Grains (FIXTURES.md §3): feature and boundary queries use ``item`` (it has
products at exactly 40 purchases); labels, metrics and the submission use
``category`` (enough positives); basket mining uses ``brand``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import boosting as BO
from ..operators import evaluate as E
from ..operators import features as FT
from ..operators import models as M
from ..operators import profile as PR
from ..operators import sampling as S
from ..operators import submission as SUB
from ..session import shared_path
from ..sources import csv as CSV
from ..sources import load
from ..sources.schemas import SUBMISSION
from . import sql_blocks as Q
from .oracle import split_sql, with_adapter

FEATURE_GRAIN = "item"
MODEL_GRAIN = "category"
BASKET_GRAIN = "brand"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _t(spark, sf, grain=FEATURE_GRAIN):
    return load(spark, sf, grain)


def _op(spark, sf, grain=FEATURE_GRAIN):
    t = _t(spark, sf, grain)
    return FT.purchase_history(t["orders"], t["prior_lines"])


def _features(spark, sf, grain, labelled=True):
    t = _t(spark, sf, grain)
    return FT.basket_features(t["orders"], t["prior_lines"], t["train_lines"] if labelled else None, Q.MIN_PURCHASES, Q.LAST_N)


def _training(spark, sf, grain=MODEL_GRAIN):
    d = _features(spark, sf, grain)
    return d.where(F.col("eval_set") == "train").select("user_id", "product_id", *FT.FEATURES, "reordered")


def _scoring(spark, sf, grain=MODEL_GRAIN):
    d = _features(spark, sf, grain, labelled=False)
    return d.where(F.col("eval_set") == "test").select("user_id", "product_id", *FT.FEATURES, "order_id")


def _validation(spark, sf):
    """Validation rows at the model grain, scored by the pair reorder ratio (SQL-checkable)."""
    tr = S.split_rows(_training(spark, sf), Q.VALIDATION_SHARE, Q.SPLIT_SEED)
    v = tr.where(F.col("split") == "validation")
    return v.select("user_id", "product_id", F.col("reordered").alias("label"),
                    F.col("uxp_reorder_ratio").alias("score"),
                    (F.col("uxp_reorder_ratio") >= F.lit(Q.VALIDATION_THRESHOLD)).cast("int").alias("prediction"))


def _sql(select: str, *blocks: str, grain: str = FEATURE_GRAIN) -> str:
    return with_adapter(Q.ctes(*blocks) if blocks else "", select, grain)


# ----------------------------------------------------------------- 2.1 scans
@query("scan_orders", _sql("SELECT order_id, user_id, eval_set, order_number FROM ic_orders"))
def scan_orders(spark, sf):
    return _t(spark, sf)["orders"].select("order_id", "user_id", "eval_set", "order_number")


def _csv_tables(spark, sf, only=None):
    """Write the basket tables as headed CSV files (the original layout) and scan them back."""
    t = _t(spark, sf)
    folder = shared_path(spark, "csv", uuid.uuid4().hex)
    names = {"orders": "orders.csv", "prior_lines": "order_products__prior.csv",
             "train_lines": "order_products__train.csv", "products": "products.csv",
             "aisles": "aisles.csv", "departments": "departments.csv"}
    from ..sources.schemas import TABLE_FILES
    for name, fname in names.items():
        if only and name != only:
            continue
        cols = [f.name for f in TABLE_FILES[name][1].fields]
        CSV.write_csv(t[name].select(*cols), f"{folder}/{fname}")
    return {only: CSV.read_table(spark, folder, only)} if only else CSV.read_tables(spark, folder)


@query("scan_csv_tables", _sql(
    "SELECT 'orders' AS table_name, count(*) AS n_rows, CAST(sum(order_id) AS BIGINT) AS key_sum FROM ic_orders "
    "UNION ALL SELECT 'prior_lines', count(*), CAST(sum(order_id + product_id) AS BIGINT) FROM ic_prior "
    "UNION ALL SELECT 'train_lines', count(*), CAST(sum(order_id + product_id) AS BIGINT) FROM ic_train "
    "UNION ALL SELECT 'products', count(*), CAST(sum(product_id) AS BIGINT) FROM ic_products "
    "UNION ALL SELECT 'aisles', count(*), CAST(sum(aisle_id) AS BIGINT) FROM ic_aisles "
    "UNION ALL SELECT 'departments', count(*), CAST(sum(department_id) AS BIGINT) FROM ic_departments"))
def scan_csv_tables(spark, sf):
    """The six tables through CSV with explicit schemas; rows and a key checksum per table."""
    t = _csv_tables(spark, sf)
    keys = {"orders": F.col("order_id"), "prior_lines": F.col("order_id") + F.col("product_id"),
            "train_lines": F.col("order_id") + F.col("product_id"), "products": F.col("product_id"),
            "aisles": F.col("aisle_id"), "departments": F.col("department_id")}
    out = None
    for name, key in keys.items():
        part = t[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                           F.sum(key).cast("long").alias("key_sum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("scan_csv_prior_lines", _sql("SELECT order_id, product_id, reordered FROM ic_prior"))
def scan_csv_prior_lines(spark, sf):
    """The prior lines, whole table, read from CSV with the explicit schema."""
    return _csv_tables(spark, sf, "prior_lines")["prior_lines"]


@query("head_orders", _sql("SELECT order_id, user_id, eval_set, order_number FROM ic_orders "
                           "ORDER BY order_id LIMIT 10"))
def head_orders(spark, sf):
    return scan_orders(spark, sf).orderBy("order_id").limit(10)


@query("user_sample_semi", _sql(
    "SELECT order_id, user_id, eval_set, order_number FROM ic_orders WHERE user_id IN ("
    f"SELECT DISTINCT user_id FROM ic_orders WHERE {split_sql('user_id', seed=Q.SAMPLE_SEED)} < {Q.SAMPLE_SHARE})"))
def user_sample_semi(spark, sf):
    return S.user_sample_semi(scan_orders(spark, sf), Q.SAMPLE_SHARE, Q.SAMPLE_SEED)


@query("user_sample", _sql(
    "SELECT order_id, user_id, eval_set, order_number FROM ic_orders WHERE user_id IN ("
    f"SELECT DISTINCT user_id FROM ic_orders WHERE {split_sql('user_id', seed=Q.SAMPLE_SEED)} < {Q.SAMPLE_SHARE})"))
def user_sample(spark, sf):
    return S.user_sample(scan_orders(spark, sf), Q.SAMPLE_SHARE, Q.SAMPLE_SEED)


# ----------------------------------------------------------------- 2.2 filters
@query("filter_user_point", _sql("SELECT * FROM op WHERE user_id = 1", Q.OP))
def filter_user_point(spark, sf):
    return _op(spark, sf).where(F.col("user_id") == 1)


@query("future_orders", _sql("SELECT user_id, eval_set, order_id FROM ic_orders "
                             "WHERE eval_set = 'train' OR eval_set = 'test'"))
def future_orders(spark, sf):
    return FT.future_orders(_t(spark, sf)["orders"])


@query("future_orders_not_prior", _sql("SELECT user_id, eval_set, order_id FROM ic_orders "
                                       "WHERE eval_set <> 'prior'"))
def future_orders_not_prior(spark, sf):
    return _t(spark, sf)["orders"].where("eval_set <> 'prior'").select("user_id", "eval_set", "order_id")


@query("test_orders", _sql("SELECT user_id, order_id FROM ic_orders WHERE eval_set = 'test'"))
def test_orders(spark, sf):
    return SUB.test_orders(_t(spark, sf)["orders"])


@query("category_codes", _sql("SELECT department_id, department FROM ic_departments"))
def category_codes(spark, sf):
    return _t(spark, sf)["departments"].select("department_id", "department")


# ----------------------------------------------------------------- 2.3 joins / T1
@query("history_join", _sql("SELECT * FROM op", Q.OP))
def history_join(spark, sf):
    return _op(spark, sf)


# ----------------------------------------------------------------- 2.4 user / product
@query("user_total_orders", _sql("SELECT user_id, u_total_orders FROM u", Q.OP, Q.USER))
def user_total_orders(spark, sf):
    return FT.user_total_orders(_op(spark, sf))


@query("user_reorder_ratio", _sql("SELECT user_id, u_reordered_ratio FROM u", Q.OP, Q.USER))
def user_reorder_ratio(spark, sf):
    return FT.user_reorder_ratio(_op(spark, sf))


@query("user_features", _sql("SELECT user_id, u_total_orders, u_reordered_ratio FROM u", Q.OP, Q.USER))
def user_features(spark, sf):
    return FT.user_features(_op(spark, sf))


@query("product_purchases", _sql("SELECT product_id, p_total_purchases FROM p", Q.OP, Q.PRODUCT))
def product_purchases(spark, sf):
    return FT.product_purchases(_op(spark, sf))


@query("product_group_filter", _sql(
    f"SELECT * FROM op WHERE product_id IN (SELECT product_id FROM op GROUP BY product_id "
    f"HAVING count(*) > {Q.MIN_PURCHASES})", Q.OP))
def product_group_filter(spark, sf):
    return FT.product_group_filter(_op(spark, sf), Q.MIN_PURCHASES)


@query("product_reorder_ratio", _sql(
    f"SELECT product_id, avg(reordered) AS p_reorder_ratio FROM op GROUP BY product_id "
    f"HAVING count(*) > {Q.MIN_PURCHASES}", Q.OP))
def product_reorder_ratio(spark, sf):
    return FT.product_reorder_ratio(_op(spark, sf), Q.MIN_PURCHASES)


@query("product_features", _sql("SELECT product_id, p_total_purchases, p_reorder_ratio FROM p",
                                Q.OP, Q.PRODUCT))
def product_features(spark, sf):
    return FT.product_features(_op(spark, sf), Q.MIN_PURCHASES)


# ----------------------------------------------------------------- 2.4 pairs
@query("pair_times_bought", _sql("SELECT user_id, product_id, count(order_id) AS uxp_total_bought "
                                 "FROM op GROUP BY user_id, product_id", Q.OP))
def pair_times_bought(spark, sf):
    return FT.pair_times_bought(_op(spark, sf))


@query("pair_first_order", _sql("SELECT user_id, product_id, CAST(min(order_number) AS INTEGER) "
                                "AS first_order_number FROM op GROUP BY user_id, product_id", Q.OP))
def pair_first_order(spark, sf):
    return FT.pair_first_order(_op(spark, sf))


@query("pair_span_right_join", _sql(
    "SELECT f.user_id, f.product_id, t.total_orders, f.first_order_number, "
    "CAST(t.total_orders - f.first_order_number + 1 AS INTEGER) AS order_range_d "
    "FROM (SELECT user_id, CAST(max(order_number) AS INTEGER) AS total_orders FROM op GROUP BY user_id) t "
    "RIGHT JOIN (SELECT user_id, product_id, CAST(min(order_number) AS INTEGER) AS first_order_number "
    "FROM op GROUP BY user_id, product_id) f ON t.user_id = f.user_id", Q.OP))
def pair_span_right_join(spark, sf):
    return FT.pair_span_right_join(_op(spark, sf))


@query("pair_reorder_ratio", _sql("SELECT user_id, product_id, uxp_reorder_ratio FROM uxp",
                                  Q.OP, Q.USER, Q.BACK, Q.UXP))
def pair_reorder_ratio(spark, sf):
    return FT.pair_reorder_ratio(_op(spark, sf))


# ----------------------------------------------------------------- 2.5 windows
@query("order_number_back", _sql(
    "SELECT order_id, user_id, order_number, eval_set, product_id, reordered, order_number_back FROM ob",
    Q.OP, Q.BACK))
def order_number_back(spark, sf):
    return FT.order_number_back(_op(spark, sf)).select(
        "order_id", "user_id", "order_number", "eval_set", "product_id", "reordered", "order_number_back")


@query("last_n_orders", _sql(
    "SELECT order_id, user_id, order_number, eval_set, product_id, reordered, order_number_back FROM ob "
    f"WHERE order_number_back <= {Q.LAST_N}", Q.OP, Q.BACK))
def last_n_orders(spark, sf):
    return FT.last_n_orders(_op(spark, sf), Q.LAST_N).select(
        "order_id", "user_id", "order_number", "eval_set", "product_id", "reordered", "order_number_back")


@query("pair_times_last5", _sql(
    f"SELECT user_id, product_id, count(order_id) AS times_last5 FROM ob WHERE order_number_back <= {Q.LAST_N} "
    "GROUP BY user_id, product_id", Q.OP, Q.BACK))
def pair_times_last5(spark, sf):
    return FT.pair_times_last_n(_op(spark, sf), Q.LAST_N)


@query("pair_features", _sql("SELECT user_id, product_id, uxp_total_bought, uxp_reorder_ratio, times_last5 "
                             "FROM uxp", Q.OP, Q.USER, Q.BACK, Q.UXP))
def pair_features(spark, sf):
    return FT.user_product_features(_op(spark, sf), Q.LAST_N)


@query("user_features_stepwise", _sql("SELECT user_id, u_total_orders, u_reordered_ratio FROM u", Q.OP, Q.USER))
def user_features_stepwise(spark, sf):
    return FT.user_features_stepwise(_op(spark, sf))


@query("product_features_stepwise", _sql("SELECT product_id, p_total_purchases, p_reorder_ratio FROM p",
                                         Q.OP, Q.PRODUCT))
def product_features_stepwise(spark, sf):
    return FT.product_features_stepwise(_op(spark, sf), Q.MIN_PURCHASES)


@query("pair_features_stepwise", _sql("SELECT user_id, product_id, uxp_total_bought, uxp_reorder_ratio, "
                                      "times_last5 FROM uxp", Q.OP, Q.USER, Q.BACK, Q.UXP))
def pair_features_stepwise(spark, sf):
    return FT.user_product_features_stepwise(_op(spark, sf), Q.LAST_N)


# ----------------------------------------------------------------- T5 / T6
@query("feature_table", _sql(f"SELECT user_id, product_id, {Q.FEATURE_COLS}, eval_set, order_id FROM data",
                             Q.ALL_FEATURES))
def feature_table(spark, sf):
    return _features(spark, sf, FEATURE_GRAIN).drop("reordered")


@query("feature_table_stepwise", _sql(f"SELECT user_id, product_id, {Q.FEATURE_COLS}, eval_set, order_id "
                                      "FROM data", Q.ALL_FEATURES))
def feature_table_stepwise(spark, sf):
    t = _t(spark, sf)
    op = FT.purchase_history(t["orders"], t["prior_lines"])
    return FT.feature_table(FT.user_product_features(op, Q.LAST_N), FT.user_features(op),
                            FT.product_features(op, Q.MIN_PURCHASES), t["orders"])


@query("training_set", _sql("SELECT * FROM tr", Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def training_set(spark, sf):
    return _training(spark, sf)


@query("training_set_item", _sql("SELECT * FROM tr", Q.ALL_FEATURES, Q.TRAIN))
def training_set_item(spark, sf):
    return _training(spark, sf, FEATURE_GRAIN)


@query("training_set_brand", _sql("SELECT * FROM tr", Q.ALL_FEATURES, Q.TRAIN, grain=BASKET_GRAIN))
def training_set_brand(spark, sf):
    return _training(spark, sf, BASKET_GRAIN)


@query("scoring_set", _sql(f"SELECT user_id, product_id, {Q.FEATURE_COLS}, order_id FROM data "
                           "WHERE eval_set = 'test'", Q.ALL_FEATURES, grain=MODEL_GRAIN))
def scoring_set(spark, sf):
    return _scoring(spark, sf)


# ----------------------------------------------------------------- 2.8 split / threshold
@query("split_rows", _sql(
    f"SELECT user_id, product_id, reordered, CASE WHEN {split_sql('user_id', 'product_id', seed=Q.SPLIT_SEED)} "
    f"< {Q.VALIDATION_SHARE} THEN 'validation' ELSE 'train' END AS split FROM tr",
    Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def split_rows(spark, sf):
    return S.split_rows(_training(spark, sf), Q.VALIDATION_SHARE, Q.SPLIT_SEED).select(
        "user_id", "product_id", "reordered", "split")


_SCORED_SQL = (f"SELECT user_id, product_id, order_id, uxp_reorder_ratio AS score, "
               f"CAST(uxp_reorder_ratio >= CAST({Q.TEST_THRESHOLD} AS DOUBLE) AS INTEGER) AS prediction "
               "FROM data WHERE eval_set = 'test'")


@query("score_threshold", _sql(_SCORED_SQL, Q.ALL_FEATURES, grain=MODEL_GRAIN))
def score_threshold(spark, sf):
    s = _scoring(spark, sf).select("user_id", "product_id", "order_id", F.col("uxp_reorder_ratio").alias("score"))
    return SUB.apply_threshold(s, Q.TEST_THRESHOLD)


@query("head_predictions", _sql("SELECT * FROM scored ORDER BY user_id, product_id LIMIT 20",
                                Q.ALL_FEATURES, f"scored AS ({_SCORED_SQL})", grain=MODEL_GRAIN))
def head_predictions(spark, sf):
    return score_threshold(spark, sf).orderBy("user_id", "product_id").limit(20)


_GRID_SQL = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in Q.SWEEP_GRID)


@query("threshold_sweep", _sql(
    "SELECT threshold, tp, fp, fn, "
    "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, "
    "CASE WHEN P_ > 0 THEN CAST(tp AS DOUBLE) / CAST(P_ AS DOUBLE) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1 "
    "FROM (SELECT g.threshold, count(*) FILTER (WHERE v.label = 1 AND v.score >= g.threshold) AS tp, "
    "count(*) FILTER (WHERE v.label <> 1 AND v.score >= g.threshold) AS fp, "
    "count(*) FILTER (WHERE v.label = 1 AND v.score < g.threshold) AS fn, "
    "count(*) FILTER (WHERE v.label = 1) AS P_ "
    f"FROM (VALUES {_GRID_SQL}) g(threshold), val v GROUP BY g.threshold)",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, grain=MODEL_GRAIN))
def threshold_sweep(spark, sf):
    return E.threshold_sweep(_validation(spark, sf), Q.SWEEP_GRID)


@query("best_threshold", _sql(
    "SELECT threshold, tp, fp, fn, precision, recall, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL,
    "sweep AS (SELECT threshold, tp, fp, fn, "
    "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, "
    "CASE WHEN P_ > 0 THEN CAST(tp AS DOUBLE) / CAST(P_ AS DOUBLE) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1 "
    "FROM (SELECT g.threshold, count(*) FILTER (WHERE v.label = 1 AND v.score >= g.threshold) AS tp, "
    "count(*) FILTER (WHERE v.label <> 1 AND v.score >= g.threshold) AS fp, "
    "count(*) FILTER (WHERE v.label = 1 AND v.score < g.threshold) AS fn, "
    "count(*) FILTER (WHERE v.label = 1) AS P_ "
    f"FROM (VALUES {_GRID_SQL}) g(threshold), val v GROUP BY g.threshold))",
    grain=MODEL_GRAIN))
def best_threshold(spark, sf):
    """The grid threshold with the best validation F1."""
    return E.best_threshold(E.threshold_sweep(_validation(spark, sf), Q.SWEEP_GRID))


# ----------------------------------------------------------------- 2.9 metrics
def _div(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"


@query("f1_binary", _sql(f"SELECT {_div('2 * tp', '2 * tp + fp + fn')} AS f1, tp, fp, fn FROM cc",
                         Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.CONF, grain=MODEL_GRAIN))
def f1_binary(spark, sf):
    return E.f1_binary(_validation(spark, sf))


@query("accuracy", _sql(f"SELECT {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, tp + fp + fn + tn AS n "
                        "FROM cc", Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.CONF, grain=MODEL_GRAIN))
def accuracy(spark, sf):
    return E.accuracy(_validation(spark, sf))


@query("confusion_matrix", _sql(
    "SELECT 0 AS label, 0 AS prediction, tn AS n FROM cc UNION ALL SELECT 0, 1, fp FROM cc "
    "UNION ALL SELECT 1, 0, fn FROM cc UNION ALL SELECT 1, 1, tp FROM cc",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.CONF, grain=MODEL_GRAIN))
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_validation(spark, sf))


_REPORT_SQL = f"""m AS (
  SELECT tp, fp, fn, tn, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
         {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
         tp + fn AS s1, tn + fp AS s0 FROM cc),
m2 AS (SELECT *, {_div('2 * p1 * r1', 'p1 + r1')} AS f1_1, {_div('2 * p0 * r0', 'p0 + r0')} AS f1_0,
              s0 + s1 AS n FROM m)"""


@query("classification_report", _sql(
    "SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support "
    "FROM (SELECT '0' AS class, p0 AS precision, r0 AS recall, f1_0 AS f1, CAST(s0 AS BIGINT) AS support FROM m2 "
    "UNION ALL SELECT '1', p1, r1, f1_1, s1 FROM m2 "
    f"UNION ALL SELECT 'accuracy', NULL, NULL, {_div('tp + tn', 'n')}, n FROM m2 "
    "UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM m2 "
    f"UNION ALL SELECT 'weighted avg', {_div('p0 * s0 + p1 * s1', 'n')}, {_div('r0 * s0 + r1 * s1', 'n')}, "
    f"{_div('f1_0 * s0 + f1_1 * s1', 'n')}, n FROM m2)",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.CONF, _REPORT_SQL, grain=MODEL_GRAIN))
def classification_report(spark, sf):
    r = E.classification_report(_validation(spark, sf))
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("roc_points", _sql("SELECT threshold, pos, neg, tp, fp, tpr, fpr FROM pts",
                          Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.ROC, grain=MODEL_GRAIN))
def roc_points(spark, sf):
    return E.roc_points(_validation(spark, sf)).select("threshold", "pos", "neg", "tp", "fp", "tpr", "fpr")


@query("roc_auc", _sql(
    "SELECT round(CASE WHEN max(P_) * max(N_) <> 0 THEN sum(pos * (N_ - fp + 0.5 * neg)) / "
    "(CAST(max(P_) AS DOUBLE) * CAST(max(N_) AS DOUBLE)) ELSE 0.0 END, 9) AS auc FROM pts",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.ROC, grain=MODEL_GRAIN))
def roc_auc(spark, sf):
    return E.roc_auc(_validation(spark, sf))


@query("roc_auc_trapezoid", _sql(
    "SELECT round(sum((fpr - CASE WHEN N_ <> 0 THEN CAST(fp - neg AS DOUBLE) / CAST(N_ AS DOUBLE) ELSE 0.0 END) * "
    "(tpr + CASE WHEN P_ <> 0 THEN CAST(tp - pos AS DOUBLE) / CAST(P_ AS DOUBLE) ELSE 0.0 END) / 2), 9) AS auc "
    "FROM pts", Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.ROC, grain=MODEL_GRAIN))
def roc_auc_trapezoid(spark, sf):
    return E.roc_auc_trapezoid(_validation(spark, sf))


# ----------------------------------------------------------------- T7 submission
_SUB_SQL = (
    "SELECT o.order_id, coalesce(string_agg(CAST(s.product_id AS VARCHAR), ' ' ORDER BY s.product_id) "
    "FILTER (WHERE s.prediction = 1), 'None') AS products "
    "FROM scored s LEFT JOIN (SELECT user_id, order_id FROM ic_orders WHERE eval_set = 'test') o "
    "ON s.user_id = o.user_id GROUP BY o.order_id")


def _submission(spark, sf):
    t = _t(spark, sf, MODEL_GRAIN)
    return SUB.submission(score_threshold(spark, sf), t["orders"])


@query("submission", _sql(_SUB_SQL, Q.ALL_FEATURES, f"scored AS ({_SCORED_SQL})", grain=MODEL_GRAIN))
def submission(spark, sf):
    return _submission(spark, sf)


@query("submission_csv_roundtrip", _sql(_SUB_SQL, Q.ALL_FEATURES, f"scored AS ({_SCORED_SQL})",
                                        grain=MODEL_GRAIN))
def submission_csv_roundtrip(spark, sf):
    import uuid
    path = shared_path(spark, "submissions", uuid.uuid4().hex)
    CSV.write_csv(_submission(spark, sf), path)
    return CSV.read_csv(spark, path, SUBMISSION)


@query("submission_row_check", _sql(
    "SELECT n_rows, n_test_orders, n_without_history, n_rows = n_test_orders - n_without_history AS ok FROM "
    f"(SELECT count(*) AS n_rows FROM ({_SUB_SQL})) a, "
    "(SELECT count(*) AS n_test_orders FROM ic_orders WHERE eval_set = 'test') b, "
    "(SELECT count(*) AS n_without_history FROM ic_orders t WHERE t.eval_set = 'test' AND t.user_id NOT IN "
    "(SELECT DISTINCT o.user_id FROM ic_orders o JOIN ic_prior l ON o.order_id = l.order_id)) c",
    Q.ALL_FEATURES, f"scored AS ({_SCORED_SQL})", grain=MODEL_GRAIN))
def submission_row_check(spark, sf):
    t = _t(spark, sf, MODEL_GRAIN)
    return SUB.submission_row_check(_submission(spark, sf), t["orders"], t["prior_lines"])


@query("data_checks", _sql(
    "SELECT 'orders.order_id unique' AS rule, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n "
    "FROM ic_orders GROUP BY order_id HAVING count(*) > 1))::BIGINT AS violations "
    "UNION ALL SELECT 'prior_lines (order_id, product_id) unique', (SELECT coalesce(sum(n - 1), 0) FROM "
    "(SELECT count(*) AS n FROM ic_prior GROUP BY order_id, product_id HAVING count(*) > 1))::BIGINT "
    "UNION ALL SELECT 'train_lines (order_id, product_id) unique', (SELECT coalesce(sum(n - 1), 0) FROM "
    "(SELECT count(*) AS n FROM ic_train GROUP BY order_id, product_id HAVING count(*) > 1))::BIGINT "
    "UNION ALL SELECT 'one future order per user', (SELECT coalesce(sum(n - 1), 0) FROM "
    "(SELECT count(*) AS n FROM ic_orders WHERE eval_set IN ('train', 'test') GROUP BY user_id "
    "HAVING count(*) > 1))::BIGINT "
    "UNION ALL SELECT 'eval_set known', (SELECT count(*) FILTER (WHERE eval_set IS NULL OR eval_set NOT IN "
    "('prior', 'train', 'test')) FROM ic_orders) "
    "UNION ALL SELECT 'orders keys not null', (SELECT count(*) FILTER (WHERE order_id IS NULL OR user_id IS NULL "
    "OR order_number IS NULL) FROM ic_orders) "
    "UNION ALL SELECT 'feature table has no NULL', (SELECT count(*) FILTER (WHERE user_id IS NULL OR product_id "
    "IS NULL OR uxp_total_bought IS NULL OR uxp_reorder_ratio IS NULL OR times_last5 IS NULL OR u_total_orders "
    "IS NULL OR u_reordered_ratio IS NULL OR p_total_purchases IS NULL OR p_reorder_ratio IS NULL) FROM data) "
    "UNION ALL SELECT 'train and test share feature columns', CAST(0 AS BIGINT)",
    Q.ALL_FEATURES))
def data_checks(spark, sf):
    t = _t(spark, sf)
    feat = _features(spark, sf, FEATURE_GRAIN)   # built once; train / test sides are projections of it
    train = feat.where(F.col("eval_set") == "train").select("user_id", "product_id", *FT.FEATURES, "reordered")
    test = feat.where(F.col("eval_set") == "test").select("user_id", "product_id", *FT.FEATURES, "order_id")
    return PR.data_checks(t["orders"], t["prior_lines"], t["train_lines"],
                          feat.drop("eval_set", "order_id", "reordered"), train, test)


# ----------------------------------------------------------------- 2.11 baskets
@query("baskets", _sql(
    "SELECT order_id, count(*) AS n_items, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY product_id) "
    "AS products FROM (SELECT DISTINCT order_id, product_id FROM ic_prior) GROUP BY order_id"))
def baskets(spark, sf):
    return B.baskets(_t(spark, sf)["prior_lines"]).select("order_id", "n_items", "products")


def _pairs_sql(support: float) -> str:
    return f"""bk AS (SELECT DISTINCT order_id, product_id FROM ic_prior),
nb AS (SELECT count(DISTINCT order_id) AS n FROM bk),
fi AS (SELECT product_id, count(*) AS cnt FROM bk GROUP BY product_id
       HAVING count(*) >= (SELECT CAST({support} AS DOUBLE) * n FROM nb)),
bf AS (SELECT bk.* FROM bk JOIN fi ON bk.product_id = fi.product_id),
pr AS (SELECT x.product_id AS item_a, y.product_id AS item_b, count(*) AS n_orders
       FROM bf x JOIN bf y ON x.order_id = y.order_id AND x.product_id < y.product_id
       GROUP BY x.product_id, y.product_id
       HAVING count(*) >= (SELECT CAST({support} AS DOUBLE) * n FROM nb))"""


@query("frequent_pairs", _sql(
    "SELECT item_a, item_b, n_orders, n_orders / CAST(nb.n AS DOUBLE) AS support FROM pr, nb",
    _pairs_sql(Q.PAIR_SUPPORT), grain=BASKET_GRAIN))
def frequent_pairs(spark, sf):
    return B.frequent_pairs(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.PAIR_SUPPORT)


@query("frequent_triples", _sql(
    "SELECT a.product_id AS item_a, b.product_id AS item_b, c.product_id AS item_c, count(*) AS n_orders, "
    "count(*) / CAST(max(nb.n) AS DOUBLE) AS support "
    "FROM bf a JOIN bf b ON a.order_id = b.order_id AND a.product_id < b.product_id "
    "JOIN bf c ON b.order_id = c.order_id AND b.product_id < c.product_id, nb "
    f"GROUP BY a.product_id, b.product_id, c.product_id "
    f"HAVING count(*) >= CAST({Q.TRIPLE_SUPPORT} AS DOUBLE) * max(nb.n)",
    _pairs_sql(Q.TRIPLE_SUPPORT), grain=BASKET_GRAIN))
def frequent_triples(spark, sf):
    return B.frequent_triples(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.TRIPLE_SUPPORT)


@query("association_rules", _sql(
    "SELECT antecedent, consequent, n_orders, support, round(confidence, 9) AS confidence, "
    "round(lift, 9) AS lift FROM (SELECT r.*, CAST(r.n_orders AS DOUBLE) / CAST(a.cnt AS DOUBLE) AS confidence, "
    "(CAST(r.n_orders AS DOUBLE) / CAST(a.cnt AS DOUBLE)) / (CAST(c.cnt AS DOUBLE) / CAST(nb.n AS DOUBLE)) AS lift "
    "FROM (SELECT item_a AS antecedent, item_b AS consequent, n_orders, n_orders / CAST(nb.n AS DOUBLE) AS support "
    "FROM pr, nb UNION ALL SELECT item_b, item_a, n_orders, n_orders / CAST(nb.n AS DOUBLE) FROM pr, nb) r "
    "JOIN (SELECT product_id, count(*) AS cnt FROM bk GROUP BY product_id) a ON r.antecedent = a.product_id "
    "JOIN (SELECT product_id, count(*) AS cnt FROM bk GROUP BY product_id) c ON r.consequent = c.product_id, nb)",
    _pairs_sql(Q.PAIR_SUPPORT), grain=BASKET_GRAIN))
def association_rules(spark, sf):
    r = B.association_rules(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.PAIR_SUPPORT)
    return r.select("antecedent", "consequent", "n_orders", "support",
                    F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"))


_BASKET_SIZES = """bs AS (
  SELECT o.order_id, o.user_id, o.order_number, l.basket_size, l.n_reordered
  FROM ic_orders o JOIN (SELECT order_id, count(*) AS basket_size, CAST(sum(reordered) AS BIGINT) AS n_reordered
                         FROM ic_prior GROUP BY order_id) l ON o.order_id = l.order_id)"""


@query("order_profile", _sql(
    "SELECT order_number, count(*) AS n_orders, CAST(sum(basket_size) AS BIGINT) AS n_lines, "
    "CAST(sum(basket_size) AS BIGINT) / count(*) AS mean_basket_size, "
    "CAST(sum(n_reordered) AS BIGINT) / CAST(sum(basket_size) AS BIGINT) AS reorder_share "
    "FROM bs GROUP BY order_number", _BASKET_SIZES))
def order_profile(spark, sf):
    t = _t(spark, sf)
    return PR.order_profile(t["orders"], t["prior_lines"])


@query("basket_size_histogram", _sql("SELECT basket_size, count(*) AS n_orders FROM bs GROUP BY basket_size",
                                     _BASKET_SIZES))
def basket_size_histogram(spark, sf):
    t = _t(spark, sf)
    return PR.basket_size_histogram(t["orders"], t["prior_lines"])


@query("orders_per_user_histogram", _sql(
    "SELECT n_orders, count(*) AS n_users FROM (SELECT user_id, count(*) AS n_orders FROM ic_orders "
    "GROUP BY user_id) GROUP BY n_orders"))
def orders_per_user_histogram(spark, sf):
    return PR.orders_per_user_histogram(_t(spark, sf)["orders"])


@query("top_products", _sql(
    "SELECT t.product_id, p.product_name, t.n_lines, t.reorder_share FROM (SELECT product_id, count(*) AS n_lines, "
    "avg(reordered) AS reorder_share FROM ic_prior GROUP BY product_id ORDER BY n_lines DESC, product_id LIMIT 10) t "
    "LEFT JOIN ic_products p ON t.product_id = p.product_id"))
def top_products(spark, sf):
    t = _t(spark, sf)
    return PR.top_products(t["prior_lines"], t["products"], 10)


@query("top_aisles", _sql(
    "SELECT t.aisle_id, a.aisle, t.n_lines, t.reorder_share FROM (SELECT p.aisle_id, count(*) AS n_lines, "
    "avg(l.reordered) AS reorder_share FROM ic_prior l JOIN ic_products p ON l.product_id = p.product_id "
    "GROUP BY p.aisle_id ORDER BY n_lines DESC, p.aisle_id LIMIT 10) t "
    "LEFT JOIN ic_aisles a ON t.aisle_id = a.aisle_id"))
def top_aisles(spark, sf):
    t = _t(spark, sf)
    return PR.top_aisles(t["prior_lines"], t["products"], t["aisles"], 10)


@query("top_departments", _sql(
    "SELECT t.department_id, d.department, t.n_lines, t.reorder_share FROM (SELECT p.department_id, "
    "count(*) AS n_lines, avg(l.reordered) AS reorder_share FROM ic_prior l JOIN ic_products p "
    "ON l.product_id = p.product_id GROUP BY p.department_id ORDER BY n_lines DESC, p.department_id LIMIT 10) t "
    "LEFT JOIN ic_departments d ON t.department_id = d.department_id"))
def top_departments(spark, sf):
    t = _t(spark, sf)
    return PR.top_departments(t["prior_lines"], t["products"], t["departments"], 10)


# ----------------------------------------------------------------- 2.8 models (rows only)
def _split_training(spark, sf):
    """Training pairs with their split, checkpointed once: fitting and validation
    scoring read the same materialised rows instead of rebuilding the features."""
    tr = S.split_rows(_training(spark, sf), Q.VALIDATION_SHARE, Q.SPLIT_SEED)
    return tr.checkpoint(eager=True)


def _spark_ml(estimator_fn):
    """Fits a Spark ML estimator: training rows -> (model, scorer of (rows, threshold))."""
    def fitted(train):
        model = M.fit(estimator_fn(train), train)
        return model, lambda df, threshold: M.score(model, df, threshold)
    return fitted


def _boosted(train):
    model = BO.fit(train)
    return model, lambda df, threshold: BO.score(model, df, threshold)


def _fit_and_validate(spark, sf, fitted, tr=None):
    tr = _split_training(spark, sf) if tr is None else tr
    model, scorer = fitted(tr.where(F.col("split") == "train"))
    val = tr.where(F.col("split") == "validation").withColumn("label", F.col("reordered"))
    return model, scorer(val, Q.VALIDATION_THRESHOLD)


_FOREST, _TREE = _spark_ml(lambda _: M.random_forest()), _spark_ml(lambda _: M.decision_tree())
_MODELS = {"logistic_regression": _spark_ml(lambda train: M.logistic_regression(train.count())), "random_forest": _FOREST,
           "gradient_boosting": _boosted, "decision_tree": _TREE}


@query("logistic_regression")
def logistic_regression(spark, sf):
    return _fit_and_validate(spark, sf, _MODELS["logistic_regression"])[1]


@query("random_forest")
def random_forest(spark, sf):
    return _fit_and_validate(spark, sf, _FOREST)[1]


@query("gradient_boosting")
def gradient_boosting(spark, sf):
    return _fit_and_validate(spark, sf, _boosted)[1]


@query("decision_tree")
def decision_tree(spark, sf):
    return _fit_and_validate(spark, sf, _TREE)[1]


@query("feature_importance")
def feature_importance(spark, sf):
    return M.feature_importance(_fit_and_validate(spark, sf, _FOREST)[0])


@query("split_importance")
def split_importance(spark, sf):
    return BO.split_importance(_fit_and_validate(spark, sf, _boosted)[0], spark)


@query("boosted_trees")
def boosted_trees(spark, sf):
    """M4: the nodes of the boosted trees: split, threshold, gain, weight, leaf value."""
    return _fit_and_validate(spark, sf, _boosted)[0].nodes(spark)


@query("feature_importance_ascending")
def feature_importance_ascending(spark, sf):
    """O2: the same table, least important first."""
    return feature_importance(spark, sf).orderBy("importance", "feature")


@query("grid_search")
def grid_search(spark, sf):
    tr = _split_training(spark, sf).where(F.col("split") == "train")
    return BO.grid_search(tr)[1]


@query("model_params")
def model_params(spark, sf):
    return BO.model_params(_fit_and_validate(spark, sf, _boosted)[0], spark)


@query("model_comparison")
def model_comparison(spark, sf):
    """Rank-sum AUC and F1 per model on the same validation rows."""
    def auc_and_f1(scored):
        return E.roc_auc(scored).withColumn("_k", F.lit(1)).join(E.f1_binary(scored).select("f1", F.lit(1).alias("_k")), "_k").drop("_k")
    return _per_model(spark, sf, auc_and_f1)


_scored: dict[tuple, str] = {}


def _scored_rows(spark, sf):
    """Validation rows scored by each model, fitted once per session and folder: one table, a folder per model."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _scored:
        path = shared_path(spark, "scored", uuid.uuid4().hex)
        tr = _split_training(spark, sf)
        for name, fitted in _MODELS.items():
            _fit_and_validate(spark, sf, fitted, tr)[1].write.parquet(f"{path}/model={name}")
        _scored[key] = path
    return spark.read.parquet(_scored[key])


def _per_model(spark, sf, table):
    """``table(scored validation rows)`` of each model, with the model's name, on the same split."""
    rows = _scored_rows(spark, sf)
    parts = [table(rows.where(F.col("model") == name).drop("model")).select(F.lit(name).alias("model"), "*") for name in _MODELS]
    return reduce(DataFrame.unionByName, parts)


@query("model_reports")
def model_reports(spark, sf):
    """E2 per fitted model: the classification report of its validation rows."""
    return _per_model(spark, sf, E.classification_report)


@query("model_confusion_matrices")
def model_confusion_matrices(spark, sf):
    """E3 per fitted model."""
    return _per_model(spark, sf, E.confusion_matrix)


@query("model_roc_points")
def model_roc_points(spark, sf):
    """E5 per fitted model."""
    return _per_model(spark, sf, lambda s: E.roc_points(s).select("threshold", "pos", "neg", "tp", "fp", "tpr", "fpr"))


@query("model_contract", _sql(
    "SELECT m.model, v.* FROM (VALUES " + ", ".join(f"('{m}')" for m in _MODELS) + ") m(model), "
    "(SELECT count(*) AS n_rows, count(DISTINCT (user_id, product_id)) AS n_keys, count(*) FILTER (WHERE label = 1) AS n_positive, "
    "CAST(0 AS BIGINT) AS n_bad_scores, CAST(0 AS BIGINT) AS n_bad_flags FROM val) v",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, grain=MODEL_GRAIN))
def model_contract(spark, sf):
    """What SQL can say of each model's scored rows: every validation pair once, labels kept, scores
    within 0 and 1, flags that follow the threshold (P10, M2-M4, B7, M7-M10)."""
    def facts(s):
        score, flag = F.col("score"), F.col("prediction")
        keys = s.groupBy("user_id", "product_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"),
                F.count_if(score.isNull() | F.isnan(score) | ~score.between(0, 1)).alias("b"),
                F.count_if(~flag.eqNullSafe((score >= Q.VALIDATION_THRESHOLD).cast("int"))).alias("f"))
        return keys.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum("p").alias("n_positive"),
                        F.sum("b").alias("n_bad_scores"), F.sum("f").alias("n_bad_flags"))
    return _per_model(spark, sf, facts)


def _itemsets_sql(select: str) -> str:
    """Frequent itemsets of any size: every subset of every basket, counted."""
    sql = _sql(select, f"""bk AS (SELECT DISTINCT order_id, product_id FROM ic_prior),
nb AS (SELECT count(DISTINCT order_id) AS n FROM bk),
fs AS (SELECT order_id, [product_id] AS items FROM bk
       UNION ALL SELECT f.order_id, list_append(f.items, b.product_id) FROM fs f JOIN bk b ON b.order_id = f.order_id AND b.product_id > f.items[-1]),
s AS (SELECT items, count(*) AS n_orders FROM fs GROUP BY items HAVING count(*) >= (SELECT CAST({Q.PAIR_SUPPORT} AS DOUBLE) * n FROM nb))""",
               grain=BASKET_GRAIN)
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


@query("fp_growth", _itemsets_sql("SELECT array_to_string(items, ' ') AS items, n_orders FROM s"))
def fp_growth(spark, sf):
    m = B.fp_growth(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.PAIR_SUPPORT)
    return m.freqItemsets.select(F.array_join(F.transform(F.array_sort("items"), lambda x: x.cast("string")), " ")
                                 .alias("items"), F.col("freq").alias("n_orders"))


@query("fp_growth_rules", _itemsets_sql(
    "SELECT array_to_string(a.items, ' ') AS antecedent, CAST(c AS VARCHAR) AS consequent, "
    "round(r.n_orders / CAST(a.n_orders AS DOUBLE), 9) AS confidence, "
    "round((r.n_orders / CAST(a.n_orders AS DOUBLE)) / (k.n_orders / CAST(nb.n AS DOUBLE)), 9) AS lift, "
    "round(r.n_orders / CAST(nb.n AS DOUBLE), 9) AS support "
    "FROM (SELECT items, n_orders, unnest(items) AS c FROM s WHERE len(items) > 1) r "
    "JOIN s a ON a.items = list_filter(r.items, lambda x: x <> r.c) JOIN s k ON k.items = [r.c], nb"))
def fp_growth_rules(spark, sf):
    m = B.fp_growth(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.PAIR_SUPPORT)
    r = m.associationRules
    return r.select(F.array_join(F.transform(F.array_sort("antecedent"), lambda x: x.cast("string")), " ").alias("antecedent"),
                    F.array_join(F.transform("consequent", lambda x: x.cast("string")), " ").alias("consequent"),
                    F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift"),
                    F.round("support", 9).alias("support"))


@query("model_submission")
def model_submission(spark, sf):
    """Entry 1 end to end: forest fitted on all training pairs, test pairs scored, threshold 0.21,
    one line per test order."""
    return _model_submission(spark, sf, _FOREST)


def _model_submission(spark, sf, fitted):
    t = _t(spark, sf, MODEL_GRAIN)
    data = _features(spark, sf, MODEL_GRAIN).checkpoint(eager=True)   # train and test pairs, built once
    train = data.where(F.col("eval_set") == "train").select("user_id", "product_id", *FT.FEATURES, "reordered")
    test = data.where(F.col("eval_set") == "test").select("user_id", "product_id", *FT.FEATURES, "order_id")
    return SUB.submission(fitted(train)[1](test, Q.TEST_THRESHOLD), t["orders"])


@query("model_submission_orders", _sql("SELECT DISTINCT order_id FROM data WHERE eval_set = 'test'", Q.ALL_FEATURES, grain=MODEL_GRAIN))
def model_submission_orders(spark, sf):
    """The orders that a fitted model's submission has a line for (its products are the model's own)."""
    return _model_submission(spark, sf, _TREE).select("order_id")


@query("grid_search_submission")
def grid_search_submission(spark, sf):
    """Entry 2 end to end: the grid's best boosting model scores the test pairs, threshold 0.21, one line per test order."""
    def fitted(train):
        model = BO.grid_search(train)[0]
        return model, lambda df, threshold: BO.score(model, df, threshold)
    return _model_submission(spark, sf, fitted)
