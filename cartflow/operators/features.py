"""User, product and user x product features; feature, training and scoring tables.

Two forms of the same results:

* step functions (``purchase_history``, ``user_features``, ...), one per
  feature family, usable on their own;
* ``basket_features``, the fused form used by the end-to-end jobs: the
  order lines are shuffled once for the order join and once for the
  (user, product) aggregate (plus a one-column distinct of their order
  ids); everything else (user, product, recency, label) is derived at
  order, pair or user grain.


* ``u_total_orders`` = highest order number among the user's prior orders
  that have lines; ``u_reordered_ratio`` = mean of ``reordered`` over them;
* ``p_total_purchases`` = lines of the product; ``p_reorder_ratio`` = mean of
  ``reordered`` when the product has more than ``min_purchases`` lines,
  else 0 (the rule is ``count > min_purchases``: exactly 40 gives 0);
* ``uxp_total_bought`` = lines of the pair; ``uxp_reorder_ratio`` =
  ``uxp_total_bought / (u_total_orders - first order number of the pair + 1)``;
* ``times_last5`` = lines of the pair in the user's last ``last_n`` orders
  (order number back, ``u_total_orders - order_number + 1``, at most ``last_n``);
* label ``reordered`` = the ``reordered`` flag of the pair's line in the
  user's train order, 0 when the train order lacks the product (for a
  product bought before, the flag is 1 whenever the line exists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["uxp_total_bought", "uxp_reorder_ratio", "times_last5",
            "u_total_orders", "u_reordered_ratio", "p_total_purchases", "p_reorder_ratio"]


# --------------------------------------------------------------------------- T1
def purchase_history(orders: DataFrame, prior_lines: DataFrame) -> DataFrame:
    """``op``: prior order lines with their order (J1, inner join on order_id)."""
    return (orders.select("order_id", "user_id", "order_number", "eval_set")
            .join(prior_lines.select("order_id", "product_id", "reordered"), "order_id", "inner")
            .select("order_id", "user_id", "order_number", "eval_set", "product_id", "reordered"))


# --------------------------------------------------------------------------- T2
def user_total_orders(op: DataFrame) -> DataFrame:
    """A1: highest order number per user."""
    return op.groupBy("user_id").agg(F.max("order_number").cast("int").alias("u_total_orders"))


def user_reorder_ratio(op: DataFrame) -> DataFrame:
    """A2: mean of ``reordered`` per user."""
    return op.groupBy("user_id").agg(F.avg("reordered").alias("u_reordered_ratio"))


def user_features(op: DataFrame) -> DataFrame:
    """T2 (A1 + A2 + J2 fused into one aggregate)."""
    return op.groupBy("user_id").agg(F.max("order_number").cast("int").alias("u_total_orders"),
                                     F.avg("reordered").alias("u_reordered_ratio"))


def _small_side(df: DataFrame) -> DataFrame:
    """A side with one row per key, kept in the shared folder.

    A join of it is then a plain shuffle on both sides, which is what lets
    AQE split the partition of a hot key on the other side (a side that is an
    aggregate of the same plan is already partitioned by the key, and Spark
    leaves it whole).
    """
    return df.checkpoint(eager=True)


def _kept(df: DataFrame) -> DataFrame:
    """An order-grain table that two steps read: made once, kept in the shared folder."""
    return df.checkpoint(eager=True)


# --------------------------------------------------------------------------- T3
def product_purchases(op: DataFrame) -> DataFrame:
    """A3: lines per product."""
    return op.groupBy("product_id").agg(F.count("order_id").alias("p_total_purchases"))


def product_group_filter(op: DataFrame, min_purchases: int = 40) -> DataFrame:
    """A4: rows of products with more than ``min_purchases`` lines (HAVING on rows).

    Products passing the rule come from a partial aggregate (one row per
    product), then the rows are kept by a semi join; no per-product window
    (a hot product would be one task) and no Python lambda per group.
    """
    big = (op.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > min_purchases).select("product_id"))
    return op.join(_small_side(big), "product_id", "left_semi")


def product_reorder_ratio(op: DataFrame, min_purchases: int = 40) -> DataFrame:
    """A5 on A4: reorder ratio of products with more than ``min_purchases`` lines."""
    return (op.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.avg("reordered").alias("p_reorder_ratio"))
            .where(F.col("_n") > min_purchases).select("product_id", "p_reorder_ratio"))


def product_features(op: DataFrame, min_purchases: int = 40) -> DataFrame:
    """T3 (A6): count, filter, ratio, left join and fill in one aggregate."""
    n = F.count("order_id")
    return op.groupBy("product_id").agg(
        n.alias("p_total_purchases"),
        F.when(n > min_purchases, F.avg("reordered")).otherwise(F.lit(0.0)).alias("p_reorder_ratio"))


# --------------------------------------------------------------------------- T4
def order_number_back(op: DataFrame) -> DataFrame:
    """``u_total_orders - order_number + 1`` on every line.

    Computed at order grain (one row per order) and attached by order key,
    instead of a per-user window over all lines.
    """
    back = _order_recency(op)
    return op.join(back, "order_id", "inner")


def _order_recency(op: DataFrame) -> DataFrame:
    """(order_id, order_number_back) for the prior orders that have lines."""
    orders_with_lines = op.select("order_id", "user_id", "order_number").distinct()
    umax = orders_with_lines.groupBy("user_id").agg(F.max("order_number").alias("_umax"))
    return (orders_with_lines.join(_small_side(umax), "user_id", "inner")
            .select("order_id", (F.col("_umax") - F.col("order_number") + 1).cast("int")
                    .alias("order_number_back")))


def last_n_orders(op: DataFrame, last_n: int = 5) -> DataFrame:
    """W2 + F6: lines of each user's last ``last_n`` orders."""
    return order_number_back(op).where(F.col("order_number_back") <= last_n)


def pair_times_bought(op: DataFrame) -> DataFrame:
    """Lines per (user, product)."""
    return op.groupBy("user_id", "product_id").agg(F.count("order_id").alias("uxp_total_bought"))


def pair_first_order(op: DataFrame) -> DataFrame:
    """First order number of each (user, product)."""
    return op.groupBy("user_id", "product_id").agg(F.min("order_number").cast("int").alias("first_order_number"))


def pair_span_right_join(op: DataFrame) -> DataFrame:
    """J4 + P4: user totals right-joined to pairs, span = total - first + 1."""
    total = op.groupBy("user_id").agg(F.max("order_number").cast("int").alias("total_orders"))
    first = pair_first_order(op)
    return (total.join(first, "user_id", "right")
            .select("user_id", "product_id", "total_orders", "first_order_number",
                    (F.col("total_orders") - F.col("first_order_number") + 1).cast("int")
                    .alias("order_range_d")))


def pair_reorder_ratio(op: DataFrame) -> DataFrame:
    """A9 (+ J5, P5, P2, P3): times bought / orders since the first purchase."""
    span = pair_span_right_join(op)
    times = pair_times_bought(op).withColumnRenamed("uxp_total_bought", "times_bought_n")
    return (times.join(span, ["user_id", "product_id"], "left")
            .select("user_id", "product_id",
                    (F.col("times_bought_n") / F.col("order_range_d")).alias("uxp_reorder_ratio")))


def pair_times_last_n(op: DataFrame, last_n: int = 5) -> DataFrame:
    """A10: lines of each pair inside the user's last ``last_n`` orders."""
    recent = last_n_orders(op, last_n)
    return recent.groupBy("user_id", "product_id").agg(F.count("order_id").alias("times_last5"))


def user_product_features(op: DataFrame, last_n: int = 5) -> DataFrame:
    """T4: one aggregate over lines tagged with their order's recency.

    ``u_total_orders`` is the highest number of the user's orders with lines;
    the pair ratio and recency are computed from it after the aggregate (at
    pair grain), so the lines are shuffled once, by (user, product).
    """
    tagged = op.join(_order_recency(op), "order_id", "inner")
    pairs = tagged.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("uxp_total_bought"),
        F.min("order_number").alias("_first"),
        F.max(F.col("order_number") + F.col("order_number_back") - 1).alias("_umax"),
        F.count_if(F.col("order_number_back") <= last_n).alias("times_last5"))
    return pairs.select(
        "user_id", "product_id", "uxp_total_bought",
        (F.col("uxp_total_bought") / (F.col("_umax") - F.col("_first") + 1)).alias("uxp_reorder_ratio"),
        "times_last5")


def user_features_stepwise(op: DataFrame) -> DataFrame:
    """T2 as two aggregates and a left join."""
    return user_total_orders(op).join(user_reorder_ratio(op), "user_id", "left")


def product_features_stepwise(op: DataFrame, min_purchases: int = 40) -> DataFrame:
    """T3 as count, ratio of the big products, left join (J3) and fill 0."""
    return (product_purchases(op).join(product_reorder_ratio(op, min_purchases), "product_id", "left")
            .fillna(0.0, subset=["p_reorder_ratio"]))


def user_product_features_stepwise(op: DataFrame, last_n: int = 5) -> DataFrame:
    """T4 as pair count, pair ratio and last-n count, left-joined (J6) and filled with 0.

    ``fillna`` on the whole table touches numeric columns only (Spark); the
    only missing values here are last-n counts of pairs absent from the last
    n orders.
    """
    return (pair_times_bought(op)
            .join(pair_reorder_ratio(op), ["user_id", "product_id"], "left")
            .join(pair_times_last_n(op, last_n), ["user_id", "product_id"], "left")
            .fillna(0)
            .select("user_id", "product_id", "uxp_total_bought", "uxp_reorder_ratio", "times_last5"))


# --------------------------------------------------------------------------- T5/T6
def future_orders(orders: DataFrame) -> DataFrame:
    """F2 + P1: each user's train or test order."""
    return (orders.where(F.col("eval_set").isin("train", "test"))
            .select("user_id", "eval_set", "order_id"))


def feature_table(uxp: DataFrame, user: DataFrame, prd: DataFrame, orders: DataFrame) -> DataFrame:
    """T5: pairs with user, product and future-order columns."""
    return (uxp.join(user, "user_id", "left")
            .join(prd, "product_id", "left")
            .join(future_orders(orders), "user_id", "left")
            .select("user_id", "product_id", *FEATURES, "eval_set", "order_id"))


def training_set(data: DataFrame, train_lines: DataFrame) -> DataFrame:
    """Train pairs with the label (J10, left join on (product, order), fill 0)."""
    lab = train_lines.select("product_id", "order_id", F.col("reordered").alias("_lab"))
    return (data.where(F.col("eval_set") == "train")
            .join(lab, ["product_id", "order_id"], "left")
            .select("user_id", "product_id", *FEATURES,
                    F.coalesce(F.col("_lab"), F.lit(0)).cast("int").alias("reordered")))


# --------------------------------------------------------------------------- fused
def orders_with_recency(orders: DataFrame, prior_lines: DataFrame) -> DataFrame:
    """Prior orders that have lines, with ``order_number_back`` (order grain).

    Only order ids are taken from the lines (distinct, partially aggregated
    before the shuffle); the user maximum is an aggregate, joined back at
    order grain.  No per-user window.
    """
    with_lines = _kept(orders.where(F.col("eval_set") == "prior").select("order_id", "user_id", "order_number")
                       .join(prior_lines.select("order_id").distinct(), "order_id", "left_semi"))
    umax = with_lines.groupBy("user_id").agg(F.max("order_number").alias("_umax"))
    return (with_lines.join(_small_side(umax), "user_id", "inner")
            .select("order_id", "user_id", "order_number",
                    (F.col("_umax") - F.col("order_number") + 1).cast("int").alias("order_number_back")))


def pair_rollup(orders: DataFrame, prior_lines: DataFrame, train_lines: DataFrame | None = None,
                last_n: int = 5) -> DataFrame:
    """One aggregate over all prior lines (and train lines, for the label) by (user, product).

    Columns: user_id, product_id, uxp_total_bought, _n_reordered, _first,
    _last, times_last5, _label.  Partial aggregation runs before the shuffle,
    so a hot (user, product) key is combined map-side.
    """
    lines = (prior_lines.select("order_id", "product_id", "reordered")
             .join(orders_with_recency(orders, prior_lines), "order_id", "inner")
             .select("user_id", "product_id", "order_number", "order_number_back", "reordered",
                     F.lit(None).cast("int").alias("_lab")))
    if train_lines is not None:
        # Label = ``reordered`` of the pair's line in the user's train order.
        lab = (orders.where(F.col("eval_set") == "train").select("order_id", "user_id")
               .join(train_lines.select("order_id", "product_id", "reordered"), "order_id", "inner")
               .select("user_id", "product_id", F.lit(None).cast("int").alias("order_number"),
                       F.lit(None).cast("int").alias("order_number_back"),
                       F.lit(None).cast("int").alias("reordered"), F.col("reordered").cast("int").alias("_lab")))
        lines = lines.unionByName(lab)
    return (lines.groupBy("user_id", "product_id").agg(
        F.count("order_number").alias("uxp_total_bought"),
        F.sum("reordered").alias("_n_reordered"),
        F.min("order_number").alias("_first"),
        F.max("order_number").alias("_last"),
        F.count_if(F.col("order_number_back") <= last_n).alias("times_last5"),
        F.max("_lab").alias("_label"))
        .where(F.col("uxp_total_bought") > 0))


def basket_features(orders: DataFrame, prior_lines: DataFrame, train_lines: DataFrame | None = None,
                    min_purchases: int = 40, last_n: int = 5, materialize: bool = True) -> DataFrame:
    """The whole feature table in one plan (T1-T6 fused).

    Output: user_id, product_id, the seven features, eval_set, order_id (the
    future order) and ``reordered`` (label; 0/1 for train pairs, NULL for
    test pairs).

    Line-grain work: one join of the lines with an order-grain table that
    already carries the recency, and one (user, product) aggregate with
    partial aggregation; the label rides along in that aggregate (train
    lines are unioned in, not joined afterwards).  The pair aggregate feeds
    three consumers (user rows, product rows, the output), so it is
    checkpointed once (``materialize=True``, reliable checkpoint in the
    shared folder) instead of being recomputed per consumer.  User rows are
    joined at pair grain: AQE broadcasts them when measured small, otherwise
    a sort-merge join whose skewed partitions AQE splits.
    """
    pairs = pair_rollup(orders, prior_lines, train_lines, last_n)
    if materialize:
        pairs = pairs.checkpoint(eager=True)

    user = pairs.groupBy("user_id").agg(
        F.max("_last").cast("int").alias("u_total_orders"),
        (F.sum("_n_reordered") / F.sum("uxp_total_bought")).alias("u_reordered_ratio"))
    user_all = user.join(future_orders(orders), "user_id", "left")

    prd = pairs.groupBy("product_id").agg(
        F.sum("uxp_total_bought").alias("_pn"), F.sum("_n_reordered").alias("_pr"))
    prd = prd.select("product_id", F.col("_pn").alias("p_total_purchases"),
                     F.when(F.col("_pn") > min_purchases, F.col("_pr") / F.col("_pn"))
                     .otherwise(F.lit(0.0)).alias("p_reorder_ratio"))

    if materialize:
        user_all, prd = _small_side(user_all), _small_side(prd)
    data = pairs.join(user_all, "user_id", "inner").join(prd, "product_id", "inner")
    label = (F.when(F.col("eval_set") == "train", F.coalesce(F.col("_label"), F.lit(0)))
             .cast("int").alias("reordered"))
    return data.select(
        "user_id", "product_id", "uxp_total_bought",
        (F.col("uxp_total_bought") / (F.col("u_total_orders") - F.col("_first") + 1)).alias("uxp_reorder_ratio"),
        "times_last5", "u_total_orders", "u_reordered_ratio", "p_total_purchases", "p_reorder_ratio",
        "eval_set", "order_id", label)
