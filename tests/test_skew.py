"""A user holding a third of all orders: results equal a pandas brute force.

The fused plan has no per-user window over lines; this checks that the
order-grain recency, the pair aggregate with the label and the user roll-up
stay exact when one key dominates, at several partition counts.
"""

import random

import pandas as pd
import pytest

from cartflow.functions.ordering import grouped_row_number
from cartflow.operators import features as FT
from cartflow.sources import schemas


def _history(n_users=30, hot_orders=300, seed=3):
    rnd = random.Random(seed)
    orders, prior, train = [], [], []
    oid = 1000
    for u in range(1, n_users + 1):
        n = hot_orders if u == 1 else rnd.randint(2, 12)
        for k in range(1, n + 1):
            oid += 1
            last = k == n
            ev = ("test" if u % 3 == 0 else "train") if last else "prior"
            orders.append((oid, u, ev, k))
            if ev == "test":
                continue
            seen = set()
            for _ in range(rnd.randint(0, 5)):          # some orders have no lines
                p = rnd.randint(1, 15)
                if p not in seen:
                    seen.add(p)
                    (train if ev == "train" else prior).append((oid, p, rnd.randint(0, 1)))
    return orders, prior, train


def _brute(orders, prior, train, min_purchases, last_n):
    o = pd.DataFrame(orders, columns=["order_id", "user_id", "eval_set", "order_number"])
    p = pd.DataFrame(prior, columns=["order_id", "product_id", "reordered"])
    t = pd.DataFrame(train, columns=["order_id", "product_id", "reordered"])
    op = o.merge(p, on="order_id")
    umax = op.groupby("user_id")["order_number"].max()
    urat = op.groupby("user_id")["reordered"].mean()
    pn = op.groupby("product_id")["order_id"].count()
    prat = op.groupby("product_id")["reordered"].mean()
    op["back"] = op["user_id"].map(umax) - op["order_number"] + 1
    out = {}
    for (u, pid), g in op.groupby(["user_id", "product_id"]):
        n = len(g)
        ratio = n / (umax[u] - g["order_number"].min() + 1)
        last = int((g["back"] <= last_n).sum())
        pr = prat[pid] if pn[pid] > min_purchases else 0.0
        fut = o[(o.user_id == u) & o.eval_set.isin(["train", "test"])]
        ev, fo = fut.iloc[0]["eval_set"], int(fut.iloc[0]["order_id"])
        lab = None
        if ev == "train":
            hit = t[(t.order_id == fo) & (t.product_id == pid)]
            lab = int(hit["reordered"].iloc[0]) if len(hit) else 0
        out[(u, pid)] = (n, ratio, last, int(umax[u]), urat[u], int(pn[pid]), pr, ev, fo, lab)
    return out


@pytest.mark.parametrize("partitions", [3, 8])
def test_fused_features_with_hot_user(spark, partitions):
    orders, prior, train = _history()
    odf = spark.createDataFrame(orders, schemas.ORDERS)
    pdf = spark.createDataFrame(prior, schemas.ORDER_LINES)
    tdf = spark.createDataFrame(train, schemas.ORDER_LINES)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = FT.basket_features(odf, pdf, tdf, min_purchases=40, last_n=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = _brute(orders, prior, train, 40, 5)
    assert len(got) == len(want)
    for r in got:
        w = want[(r["user_id"], r["product_id"])]
        assert (r["uxp_total_bought"], r["times_last5"], r["u_total_orders"], r["p_total_purchases"],
                r["eval_set"], r["order_id"], r["reordered"]) == (w[0], w[2], w[3], w[5], w[7], w[8], w[9])
        assert r["uxp_reorder_ratio"] == pytest.approx(w[1])
        assert r["u_reordered_ratio"] == pytest.approx(w[4])
        assert r["p_reorder_ratio"] == pytest.approx(w[6])


def test_order_numbers_of_hot_user_span_partitions(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    orders, _, _ = _history(hot_orders=2000)
    o = spark.createDataFrame([(oid, u, k * 7 % 97) for oid, u, _, k in orders],
                              "order_id long, user_id long, day int")
    got = grouped_row_number(o, ["user_id"], ["day", "order_id"], "n", num_partitions=6)
    want = o.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("day", "order_id")))
    assert sorted(map(tuple, got.select("order_id", "n").collect())) == \
        sorted(map(tuple, want.select("order_id", "n").collect()))
