"""Exact counts, the drawn curve, itemsets of any size, the exact tree, the regression's optimum, tables by key, rejected rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartflow.functions.ordering import with_next
from cartflow.functions.selection import first_k, hash_of, kth_smallest
from cartflow.operators import baskets, copartitioned, evaluate, exact_tree, features, logistic, sampling
from cartflow.sources import bucketed
from cartflow.sources import csv as CSV
from cartflow.sources import schemas


@pytest.mark.parametrize("values", [list(range(0, 50_000, 7)), [5] * 300 + [3] * 10 + [2 ** 60 - 1], [random.Random(1).randrange(2 ** 60) for _ in range(6000)]])
def test_kth_smallest_is_that_of_the_sorted_values(spark, values):
    df, order = spark.createDataFrame([(v,) for v in values], "v long").repartition(3), sorted(values)
    for k in (1, 2, len(values) // 2, len(values)):
        last, among = kth_smallest(df, F.col("v"), k)
        assert last == order[k - 1] and among == k - order.index(last)
    assert kth_smallest(df, F.col("v"), len(values) + 1) is None and kth_smallest(df, F.col("v"), 0) is None


def test_first_k_takes_exactly_k_rows_though_a_third_are_equal(spark):
    rows = [(7, i) for i in range(400)] + [(v, 0) for v in range(800)] + [(None, 1)]
    df = spark.createDataFrame(rows, "v long, tie long").repartition(5)
    for k in (0, 3, 100, 300, 500):
        got = first_k(df, F.col("v"), k, [F.col("tie")]).where("_first").collect()
        assert sorted((r.v, r.tie) for r in got) == sorted(r for r in rows if r[0] is not None)[:k]


def test_exact_samples(spark):
    orders = spark.createDataFrame([(i, i % 37, "prior", 1) for i in range(500)] + [(999, None, "prior", 1)],
                                   "order_id long, user_id long, eval_set string, order_number int")
    for fraction in (0.0, 0.1, 0.5, 1.0):
        assert sampling.user_sample_exact(orders, fraction).select("user_id").distinct().count() == round(fraction * 37)
    rows = spark.createDataFrame([(i % 10, i % 7) for i in range(333)], "user_id long, product_id long")  # keys that repeat
    for part in (1, 4):
        split = sampling.split_rows_exact(rows.repartition(part), 0.8)
        assert split.where("split = 'validation'").count() == math.ceil(0.8 * 333) and split.count() == 333
    assert sampling.split_rows_exact(rows.limit(0)).count() == 0


def test_the_next_row_is_found_over_partition_borders(spark):
    rows = [(i, i * i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    for parts in (1, 3, 40):
        got = {r.k: r.nxt for r in with_next(df, [F.col("k").desc()], {"nxt": F.col("v")}, parts).collect()}
        assert got == {k: (k - 1) ** 2 if k else None for k, _ in rows}


def drawn_curve(rows):
    """Origin, then points where either count's step changes."""
    steps = [(t, sum(1 for s, y in rows if s == t and y), sum(1 for s, y in rows if s == t and not y)) for t in sorted({s for s, _ in rows}, reverse=True)]
    p, n, tp, fp, out = sum(y for _, y in rows), sum(1 - y for _, y in rows), 0, 0, {(math.inf, 0.0, 0.0)}
    for i, (t, a, b) in enumerate(steps):
        tp, fp = tp + a, fp + b
        if i in (0, len(steps) - 1) or steps[i + 1][1:] != (a, b):
            out.add((t, fp / n, tp / p))
    return out


def test_roc_curve_has_the_origin_and_no_point_on_a_straight_stretch(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60) / 60, int(rng.random() < 0.4)) for _ in range(150)] + [(2.0 + i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(4)
    curve = evaluate.roc_curve(df)
    got = sorted(((r.threshold, r.fpr, r.tpr) for r in curve.collect()), reverse=True)
    assert set(got) == drawn_curve(rows) and len(got) < evaluate.roc_points(df).count()
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(got, got[1:]))
    assert abs(area - evaluate.roc_auc(df).first().auc) < 1e-8


def plain_itemsets(lines, least, size):
    held = {}
    for o, p in lines:
        held.setdefault(o, set()).add(p)
    n = {}
    for items in held.values():
        for c in itertools.combinations(sorted(items), size):
            n[c] = n.get(c, 0) + 1
    return {c: k for c, k in n.items() if k >= least * len(held)}


def test_itemsets_of_any_size_with_a_huge_basket(spark):
    rng = random.Random(3)
    lines = [(o, rng.randrange(12)) for o in range(60) for _ in range(rng.randint(1, 7))] + [(1000, p) for p in range(60)]
    df = spark.createDataFrame([(o, p, 0) for o, p in lines], schemas.ORDER_LINES)
    for size in (1, 2, 3, 4):
        for block in (4, 1000):
            got = {tuple(r["items"]): r.n_orders for r in baskets.frequent_itemsets(df, 0.03, size, block).collect()}
            assert got == plain_itemsets(lines, 0.03, size)
    assert baskets.frequent_itemsets(df.limit(0), 0.03, 3).count() == 0


def test_a_huge_basket_s_pairs_are_shared_out(spark):
    df = spark.createDataFrame([(1, p) for p in range(1000)] + [(2, 1), (2, 2)], "order_id long, product_id long")
    tiles = baskets.basket_tiles(df, 100).collect()
    big = [t for t in tiles if t.order_id == 1]
    assert len(big) == 55 and max(len(b) for t in big for b in (t["items"], t.others or [])) < 160  # 10 blocks, each with each and with itself
    pairs = [p for t in big for p in (itertools.combinations(t["items"], 2) if t.others is None else itertools.product(t["items"], t.others))]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs}) == 1000 * 999 // 2


def plain_tree(rows, depth, node=0):
    """{node: (feature, threshold, n, pos)} by direct search; rows are (values, label)."""
    n, pos = len(rows), sum(y for _, y in rows)
    imp = lambda p, k: 2.0 * p * (k - p) / k
    best = None
    if depth and 0 < pos < n:
        for f in range(len(rows[0][0])):
            for v in sorted({x[f] for x, _ in rows})[:-1]:
                left = [y for x, y in rows if x[f] <= v]
                gain = imp(pos, n) - (imp(sum(left), len(left)) + imp(pos - sum(left), n - len(left)))
                if best is None or gain > best[0]:
                    best = (gain, f, v)
    if best is None or best[0] <= 1e-9:
        return {node: (None, None, n, pos)}
    _, f, v = best
    return ({node: (f"f{f}", v, n, pos)} | plain_tree([r for r in rows if r[0][f] <= v], depth - 1, 2 * node + 1)
            | plain_tree([r for r in rows if r[0][f] > v], depth - 1, 2 * node + 2))


def test_exact_tree_is_that_of_direct_search(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(250):
        x = (rng.randrange(30) / 4, rng.random(), float(rng.randrange(3)))
        rows.append((x, int((x[0] > 3.1) != (x[2] == 1) if rng.random() < 0.9 else rng.random() < 0.5)))
    df = spark.createDataFrame([(i, *x, y) for i, (x, y) in enumerate(rows)], "k long, f0 double, f1 double, f2 double, reordered int").repartition(3)
    nodes = exact_tree.fit(df, 3, ["f0", "f1", "f2"])
    assert {i: (x.feature, x.threshold, x.n, x.pos) for i, x in nodes.items()} == plain_tree(rows, 3)
    assert exact_tree.table(nodes, spark).count() == len(nodes)
    scores = exact_tree.score(nodes, df, ("k", "reordered")).agg(F.sum("score"), F.sum("reordered")).first()
    assert abs(scores[0] - scores[1]) < 1e-9  # every leaf scores its share of positives


def test_regression_reaches_its_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [1, 30]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.05] + 0.3)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, reordered int")
    w = logistic.optimum(df, ["a", "b"])
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.abs(np.append(x.T @ (p - y) + w[:2], (p - y).sum())).max() < 1e-6
    proof = logistic.certificate(df, w, ["a", "b"]).first()
    assert proof.converged and proof.n_rows == 400
    assert not logistic.certificate(df, w + 0.01, ["a", "b"]).first().converged


def exchanges(plan):
    return plan.count("Exchange hashpartitioning(user_id")


def test_tables_by_user_join_without_an_exchange(spark, fixture_tables):
    t = fixture_tables
    op = features.purchase_history(t["orders"], t["prior_lines"])
    uxp, user, prd = features.user_product_features(op), features.user_features(op), features.product_features(op)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for hot_rows, hot in ((1000, 0), (2, 3)):  # in the second, a user with 3 pairs is hot
            kept = copartitioned.store(uxp, user, t["orders"], 4, hot_rows)
            assert kept.hot_pairs.count() == hot
            table = copartitioned.feature_table(kept, prd)
            want = features.feature_table(uxp, user, prd, t["orders"])
            assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))
        join = kept.pairs.join(kept.users, "user_id", "left")
        join.collect()
        plan = join._jdf.queryExecution().executedPlan().toString()
        assert exchanges(plan) == 0 and "SortMergeJoin" in plan
        assert exchanges(uxp.join(user, "user_id", "left")._jdf.queryExecution().executedPlan().toString()) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bad_csv_rows_are_set_aside_with_their_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text("order_id,product_id,reordered\n1,2,0\nx,2,0\n3,4\n5,6,1,9\n7,8,no\n")
    (tmp_path / "b.csv").write_text("order_id,product_id,reordered\n9,10,1\n\n11,,0\n")
    good, bad = CSV.with_rejects(spark, str(tmp_path), schemas.ORDER_LINES)
    assert sorted((r.order_id, r.product_id, r.reordered) for r in good.collect() if r.product_id) == [(1, 2, 0), (9, 10, 1)]
    assert good.where("product_id is null").count() == 1  # an empty field is null, not malformed
    got = {r.row: (r.reason, r.file.rsplit("/", 1)[1]) for r in bad.collect()}
    assert got == {"x,2,0": ("type of order_id", "a.csv"), "3,4": ("2 of 3 fields", "a.csv"), "5,6,1,9": ("4 of 3 fields", "a.csv"),
                   "7,8,no": ("type of reordered", "a.csv")}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("order_id,product\n1,2\n")
    with pytest.raises(ValueError, match="product_id"):
        CSV.with_rejects(spark, str(tmp_path / "c"), schemas.ORDER_LINES)


def test_hash_and_buckets(spark):
    r = spark.range(1).select(hash_of(F.lit(3), F.lit(None).cast("string"), seed=1).alias("h")).first()
    assert 0 <= r.h < 2 ** 60
    table = bucketed.write_bucketed(spark.range(100).withColumnRenamed("id", "user_id"), "user_id", 3, "t")
    assert table.count() == 100
