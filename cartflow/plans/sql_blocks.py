"""DuckDB CTE blocks shared by the oracle queries (after the adapter CTEs)."""

from __future__ import annotations

from .oracle import split_sql

# Parameters of the reference's pipeline (fixed values).
MIN_PURCHASES = 40      # product reorder ratio only for products with more than 40 lines
LAST_N = 5              # "times bought in the last 5 orders"
VALIDATION_SHARE = 0.8  # test_size as coded in the reference (its text says 0.2)
SPLIT_SEED = 42
SAMPLE_SHARE = 0.1      # user sample share
SAMPLE_SEED = 25
VALIDATION_THRESHOLD = 0.30
TEST_THRESHOLD = 0.21
SWEEP_GRID = sorted({round(0.05 * k, 2) for k in range(1, 20)} | {0.21, 0.3})
PAIR_SUPPORT = 0.02
TRIPLE_SUPPORT = 0.002
QUAD_SUPPORT = 0.0002

OP = """op AS (
  SELECT o.order_id, o.user_id, o.order_number, o.eval_set, l.product_id, l.reordered
  FROM ic_orders o JOIN ic_prior l ON o.order_id = l.order_id)"""

USER = """u AS (
  SELECT user_id, CAST(max(order_number) AS INTEGER) AS u_total_orders,
         avg(reordered) AS u_reordered_ratio
  FROM op GROUP BY user_id)"""

PRODUCT = f"""p AS (
  SELECT product_id, count(order_id) AS p_total_purchases,
         CASE WHEN count(order_id) > {MIN_PURCHASES} THEN avg(reordered) ELSE 0.0 END AS p_reorder_ratio
  FROM op GROUP BY product_id)"""

BACK = """ob AS (
  SELECT op.*, CAST(max(order_number) OVER (PARTITION BY user_id) - order_number + 1 AS INTEGER)
         AS order_number_back
  FROM op)"""

UXP = f"""x AS (
  SELECT user_id, product_id, count(*) AS uxp_total_bought, min(order_number) AS first_on,
         count(*) FILTER (WHERE order_number_back <= {LAST_N}) AS times_last5
  FROM ob GROUP BY user_id, product_id),
uxp AS (
  SELECT x.user_id, x.product_id, x.uxp_total_bought,
         x.uxp_total_bought / (u.u_total_orders - x.first_on + 1) AS uxp_reorder_ratio, x.times_last5
  FROM x JOIN u ON x.user_id = u.user_id)"""

DATA = """fut AS (SELECT user_id, eval_set, order_id FROM ic_orders WHERE eval_set IN ('train', 'test')),
data AS (
  SELECT uxp.user_id, uxp.product_id, uxp.uxp_total_bought, uxp.uxp_reorder_ratio, uxp.times_last5,
         u.u_total_orders, u.u_reordered_ratio, p.p_total_purchases, p.p_reorder_ratio,
         f.eval_set, f.order_id
  FROM uxp LEFT JOIN u ON uxp.user_id = u.user_id
           LEFT JOIN p ON uxp.product_id = p.product_id
           LEFT JOIN fut f ON uxp.user_id = f.user_id)"""

FEATURE_COLS = ("uxp_total_bought, uxp_reorder_ratio, times_last5, u_total_orders, u_reordered_ratio, "
                "p_total_purchases, p_reorder_ratio")

TRAIN = f"""tr AS (
  SELECT d.user_id, d.product_id, {', '.join('d.' + c.strip() for c in FEATURE_COLS.split(','))},
         CAST(coalesce(t.reordered, 0) AS INTEGER) AS reordered
  FROM data d LEFT JOIN ic_train t ON d.product_id = t.product_id AND d.order_id = t.order_id
  WHERE d.eval_set = 'train')"""

ALL_FEATURES = ",\n".join([OP, USER, PRODUCT, BACK, UXP, DATA])

VAL = f"""val AS (
  SELECT user_id, product_id, reordered AS label, uxp_reorder_ratio AS score,
         CAST(uxp_reorder_ratio >= CAST({VALIDATION_THRESHOLD} AS DOUBLE) AS INTEGER) AS prediction
  FROM tr WHERE {split_sql('user_id', 'product_id', seed=SPLIT_SEED)} < {VALIDATION_SHARE})"""

CONF = """cc AS (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
  FROM val)"""

ROC = """sc AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
         count(*) FILTER (WHERE label <> 1) AS neg
  FROM val GROUP BY score),
rs AS (
  SELECT threshold, pos, neg,
         CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp
  FROM sc),
tot AS (SELECT CAST(sum(pos) AS BIGINT) AS P_, CAST(sum(neg) AS BIGINT) AS N_ FROM sc),
pts AS (
  SELECT threshold, pos, neg, tp, fp,
         CASE WHEN P_ <> 0 THEN CAST(tp AS DOUBLE) / CAST(P_ AS DOUBLE) ELSE 0.0 END AS tpr,
         CASE WHEN N_ <> 0 THEN CAST(fp AS DOUBLE) / CAST(N_ AS DOUBLE) ELSE 0.0 END AS fpr,
         P_, N_
  FROM rs, tot)"""


def ctes(*blocks: str) -> str:
    return ",\n".join(blocks)
