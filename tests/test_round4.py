"""Order lines shuffled once by (user, product), steps that read a shared table once, bounded groups of scored rows,
the walk down boosted trees."""

from datetime import date

import numpy as np

from cartflow.operators import boosting as BO
from cartflow.operators import deep_forest as DF
from cartflow.operators import features as FT
from cartflow.sources import testdata


def test_lines_are_shuffled_once_by_pair(spark, tmp_path):
    orders = [(1, 7, date(2020, 1, 1)), (2, 7, date(2020, 1, 2)), (3, 7, date(2020, 1, 3)), (4, None, date(2020, 1, 1)), (5, None, date(2020, 1, 2))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 10), (1, 10), (2, 10), (2, 20), (2, None), (3, 20), (4, 10), (5, 10)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    numbered = testdata.derive_orders(spark, str(tmp_path)).checkpoint()
    got = testdata.derive_lines(spark, str(tmp_path), numbered, "item")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(user_id" in line for line in plan.splitlines()) == 1
    # lines without a user or a product have no pair
    assert sorted(map(tuple, got.collect())) == [(1, 10, 0, "prior"), (2, 10, 1, "prior"), (2, 20, 0, "prior"), (3, 20, 1, "train")]


def test_orders_with_lines_are_made_once(spark, fixture_tables):
    got = FT.orders_with_recency(fixture_tables["orders"], fixture_tables["prior_lines"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plan  # kept, not made again for the join with the users' highest numbers
    assert sorted(map(tuple, got.collect())) == [(11, 1, 1, 3), (12, 1, 2, 2), (13, 1, 3, 1), (21, 2, 1, 2), (22, 2, 2, 1)]


def test_groups_of_scored_rows_are_bounded(spark, monkeypatch):
    assert DF.SCORED_ROWS <= 100_000
    rows = spark.createDataFrame([(i, i % 3, float(i % 5), i % 5 % 2) for i in range(300)], "user_id long, product_id long, a double, reordered int")
    model = DF.fit(rows, DF.Growth(trees=1, bootstrap=False), ["a"])
    whole = sorted(map(tuple, DF.score(model, rows).collect()))
    monkeypatch.setattr(DF, "SCORED_ROWS", 20)
    assert sorted(map(tuple, DF.score(model, rows).collect())) == whole
    assert [r[2] for r in whole] == [float(i % 5 % 2) for i in range(300)]


def test_rows_go_down_a_tree_without_a_copy_of_rows_per_step():
    def one_by_one(tree, row):
        feature, cut, missing_left, left, right, _ = tree
        i = 0
        while feature[i] >= 0:
            b = row[feature[i]]
            i = (left if (missing_left[i] if b == 0 else b <= cut[i]) else right)[i]
        return i

    class NoIndexing(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple):
                raise AssertionError("pairs of index arrays are slow")
            return super().__getitem__(key)

    rng = np.random.default_rng(5)
    tree = BO.Tree()
    for node in range(40):  # nodes of all depths, some leaves
        if node % 4 != 3:
            tree.feature[node], tree.cut[node], tree.missing_left[node] = int(rng.integers(3)), int(rng.integers(1, 9)), bool(node % 2)
            tree.left[node], tree.right[node] = tree.add(0.0, 1.0), tree.add(0.0, 1.0)
    bins = rng.integers(0, 10, (500, 3)).astype(np.int16)
    want = [one_by_one(tree.arrays(), row) for row in bins]
    assert BO.node_of(tree.arrays(), bins.view(NoIndexing)).tolist() == want
    assert BO.node_of(tree.arrays(), bins[:0]).tolist() == [] and BO.node_of(BO.Tree().arrays(), bins).tolist() == [0] * 500
