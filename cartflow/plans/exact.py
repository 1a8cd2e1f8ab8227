"""Queries whose results SQL can follow to the row: exact samples, the drawn ROC curve, itemsets of any size, an exact tree,
the optimum of the regression, tables kept by key, rejected rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.selection import hash_sql
from ..operators import baskets as B
from ..operators import copartitioned as CO
from ..operators import deep_forest as DF
from ..operators import evaluate as E
from ..operators import exact_tree as X
from ..operators import features as FT
from ..operators import logistic as L
from ..operators import sampling as S
from ..session import shared_path
from ..sources import csv as CSV
from ..sources.schemas import ORDER_LINES
from . import sql_blocks as Q
from .catalog import BASKET_GRAIN, MODEL_GRAIN, _op, _sql, _t, _training, _validation, query


@query("user_sample_exact", _sql(
    "SELECT o.order_id, o.user_id, o.eval_set, o.order_number FROM ic_orders o JOIN ("
    f"SELECT user_id, row_number() OVER (ORDER BY {hash_sql('user_id', seed=Q.SAMPLE_SEED)}, user_id) AS i, count(*) OVER () AS n "
    f"FROM (SELECT DISTINCT user_id FROM ic_orders)) u ON o.user_id = u.user_id WHERE u.i <= round_even({Q.SAMPLE_SHARE} * u.n, 0)"))
def user_sample_exact(spark, sf):
    """S3: whole histories of exactly a tenth of the users."""
    return S.user_sample_exact(_t(spark, sf)["orders"].select("order_id", "user_id", "eval_set", "order_number"), Q.SAMPLE_SHARE, Q.SAMPLE_SEED)


@query("split_rows_exact", _sql(
    "SELECT user_id, product_id, reordered, CASE WHEN row_number() OVER (ORDER BY "
    f"{hash_sql('user_id', 'product_id', seed=Q.SPLIT_SEED)}, user_id, product_id) <= ceil({Q.VALIDATION_SHARE} * count(*) OVER ()) "
    "THEN 'validation' ELSE 'train' END AS split FROM tr", Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def split_rows_exact(spark, sf):
    """M1: exactly four fifths of the rows are validation rows."""
    return S.split_rows_exact(_training(spark, sf), Q.VALIDATION_SHARE, Q.SPLIT_SEED).select("user_id", "product_id", "reordered", "split")


@query("roc_curve", _sql(
    "SELECT threshold, fpr, tpr FROM (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i FROM pts "
    "WINDOW w AS (ORDER BY threshold DESC)) WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg "
    "UNION ALL SELECT CAST('Infinity' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)",
    Q.ALL_FEATURES, Q.TRAIN, Q.VAL, Q.ROC, grain=MODEL_GRAIN))
def roc_curve(spark, sf):
    """E5 as drawn: the origin, and no point on a straight stretch."""
    return E.roc_curve(_validation(spark, sf))


@query("label_join", _sql("SELECT * FROM tr", Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def label_join(spark, sf):
    """The label by a join on (product, order), on the step-wise feature table."""
    t, op = _t(spark, sf, MODEL_GRAIN), _op(spark, sf, MODEL_GRAIN)
    data = FT.feature_table(FT.user_product_features(op, Q.LAST_N), FT.user_features(op), FT.product_features(op, Q.MIN_PURCHASES), t["orders"])
    return FT.training_set(data, t["train_lines"])


@query("feature_table_copartitioned", _sql(f"SELECT user_id, product_id, {Q.FEATURE_COLS}, eval_set, order_id FROM data", Q.ALL_FEATURES))
def feature_table_copartitioned(spark, sf):
    """Pairs, user features and future orders kept by user, joined without an exchange of them."""
    t, op = _t(spark, sf), _op(spark, sf)
    kept = CO.store(FT.user_product_features(op, Q.LAST_N), FT.user_features(op), t["orders"],
                    int(spark.conf.get("spark.sql.shuffle.partitions")))
    return CO.feature_table(kept, FT.product_features(op, Q.MIN_PURCHASES))


@query("frequent_itemsets_4", _sql(
    "SELECT concat_ws(' ', a.product_id, b.product_id, c.product_id, d.product_id) AS items, count(*) AS n_orders, "
    "count(*) / CAST(max(nb.n) AS DOUBLE) AS support FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.product_id < b.product_id "
    "JOIN bk c ON b.order_id = c.order_id AND b.product_id < c.product_id JOIN bk d ON c.order_id = d.order_id AND c.product_id < d.product_id, nb "
    f"GROUP BY a.product_id, b.product_id, c.product_id, d.product_id HAVING count(*) >= CAST({Q.QUAD_SUPPORT} AS DOUBLE) * max(nb.n)",
    "bk AS (SELECT DISTINCT order_id, product_id FROM ic_prior), nb AS (SELECT count(DISTINCT order_id) AS n FROM bk)", grain=BASKET_GRAIN))
def frequent_itemsets_4(spark, sf):
    """B3 at level 4."""
    found = B.frequent_itemsets(_t(spark, sf, BASKET_GRAIN)["prior_lines"], Q.QUAD_SUPPORT, 4)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "n_orders", "support")


_FEATURES = [c.strip() for c in Q.FEATURE_COLS.split(",")]


def _tree_sql() -> str:
    """A tree of depth 2 over all thresholds of all features."""
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in _FEATURES)
    names = ", ".join(f"'{c}'" for c in _FEATURES)

    def side(pos: str, n: str) -> str:
        return f"2.0::DOUBLE * CAST({pos} AS DOUBLE) * CAST({n} - {pos} AS DOUBLE) / CAST({n} AS DOUBLE)"

    def level(k: int, rows: str) -> str:
        return f"""
c{k} AS (SELECT node, f, v, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM {rows} GROUP BY node, f, v),
s{k} AS (SELECT node, f, v, CAST(sum(n) OVER w AS BIGINT) AS nl, CAST(sum(pos) OVER w AS BIGINT) AS pl,
               CAST(sum(n) OVER a AS BIGINT) AS n, CAST(sum(pos) OVER a AS BIGINT) AS pos FROM c{k}
         WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
g{k} AS (SELECT *, {side('pos', 'n')} - ({side('pl', 'nl')} + {side('(pos - pl)', '(n - nl)')}) AS gain FROM s{k} WHERE nl < n AND pos > 0 AND pos < n),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS i FROM g{k}) WHERE i = 1 AND gain > 1e-9)"""

    return _sql(
        f"""SELECT CAST(node AS INTEGER) AS node, feature, threshold, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos FROM (
SELECT 0 AS node, (SELECT [{names}][f + 1] FROM b0) AS feature, (SELECT v FROM b0) AS threshold, count(*) AS n, sum(reordered) AS pos FROM tr
UNION ALL SELECT x.node, [{names}][b1.f + 1], b1.v, x.n, x.pos
  FROM (SELECT 1 AS node, nl AS n, pl AS pos FROM b0 UNION ALL SELECT 2, n - nl, pos - pl FROM b0) x LEFT JOIN b1 ON b1.node = x.node
UNION ALL SELECT 2 * node + 1, NULL, NULL, nl, pl FROM b1
UNION ALL SELECT 2 * node + 2, NULL, NULL, n - nl, pos - pl FROM b1)""",
        Q.ALL_FEATURES, Q.TRAIN,
        f"xu AS (SELECT 0 AS node, user_id, product_id, reordered AS y, unnest(range({len(_FEATURES)})) AS f, unnest([{values}]) AS v FROM tr)",
        level(0, "xu").strip(),
        "xa AS (SELECT xu.user_id, xu.product_id, CASE WHEN xu.v <= b0.v THEN 1 ELSE 2 END AS node FROM xu JOIN b0 ON xu.f = b0.f)",
        "xu1 AS (SELECT xa.node, xu.f, xu.v, xu.y FROM xu JOIN xa ON xu.user_id = xa.user_id AND xu.product_id = xa.product_id)",
        level(1, "xu1").strip(), grain=MODEL_GRAIN)


@query("exact_tree", _tree_sql())
def exact_tree(spark, sf):
    """A decision tree of depth 2 with every value as a threshold."""
    return X.table(X.fit(_training(spark, sf).checkpoint(eager=True), 2), spark)


@query("deep_tree", _sql(
    f"SELECT user_id, product_id, CAST(sum(reordered) OVER w AS DOUBLE) / count(*) OVER w AS score FROM tr WINDOW w AS (PARTITION BY {Q.FEATURE_COLS})",
    Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def deep_tree(spark, sf):
    """M3: a tree without a depth limit gives every training row the share of positives among the rows with its features."""
    train = _training(spark, sf).checkpoint(eager=True)
    return DF.score(DF.fit(train, DF.Growth(trees=1, bootstrap=False)), train)


@query("deep_forest")
def deep_forest(spark, sf):
    """M3: ten trees without a depth limit on drawn rows, fitted on the training rows, scores of the validation rows."""
    rows = S.split_rows(_training(spark, sf), Q.VALIDATION_SHARE, Q.SPLIT_SEED).checkpoint(eager=True)
    return DF.score(DF.fit(rows.where(F.col("split") == "train")), rows.where(F.col("split") == "validation"))


@query("logistic_optimum", _sql("SELECT count(*) AS n_rows, true AS converged FROM tr", Q.ALL_FEATURES, Q.TRAIN, grain=MODEL_GRAIN))
def logistic_optimum(spark, sf):
    """M2: whether the gradient at the fitted weights vanishes."""
    train = _training(spark, sf).checkpoint(eager=True)
    return L.certificate(train, L.optimum(train)).select("n_rows", "converged")


@query("csv_rejects", _sql(
    "SELECT CASE WHEN product_id % 97 = 0 THEN 'type of order_id' WHEN product_id % 89 = 0 THEN 'type of reordered' ELSE 'read' END AS reason, "
    "count(*) AS n_rows, CAST(sum(product_id) AS BIGINT) AS key_sum FROM ic_prior GROUP BY 1"))
def csv_rejects(spark, sf):
    """The prior lines as CSV, some rows spoilt: those are set aside with their reason, all others are read."""
    p = F.col("product_id")
    spoilt = _t(spark, sf)["prior_lines"].select(
        F.when(p % 97 == 0, F.concat(F.lit("x"), F.col("order_id").cast("string"))).otherwise(F.col("order_id").cast("string")).alias("order_id"),
        p.cast("string").alias("product_id"),
        F.when((p % 97 != 0) & (p % 89 == 0), F.lit("yes")).otherwise(F.col("reordered").cast("string")).alias("reordered"))
    path = CSV.write_csv(spoilt, shared_path(spark, "csv", uuid.uuid4().hex))
    good, bad = CSV.with_rejects(spark, path, ORDER_LINES)
    of = lambda df, reason, key: df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).cast("long").alias("key_sum"))
    return of(good, F.lit("read"), F.col("product_id")).unionByName(of(bad, F.col("reason"), F.split("row", ",")[1].cast("long")))
