"""Boosted trees grown from sums by cell: the same trees as level by level, in passes that don't grow with the depth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartflow.operators import boosting as B

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 50 == 0 else i % 90, i, float(a), None if i % 6 == 0 else float(b), float("nan") if i % 7 == 0 else float(c), float(d), int(a + b * d + rng.normal() > 1))
            for i, (a, b, c, d) in enumerate(rng.normal(size=(1500, 4)).round(1))]
    return spark.createDataFrame(rows, "user_id long, product_id long, a double, b double, c double, d double, reordered int").checkpoint()


def grown(frame, jobs, fold=None):
    cuts = B.feature_cuts(frame, FEATURES, 64)
    return [m.trees for m in B.grow(B.binned_rows(frame, FEATURES, cuts, "reordered", ("user_id", "product_id"), fold), jobs, FEATURES, cuts)]


def test_a_round_is_one_pass_whatever_the_depth(frame, spark):
    def passes(depth):
        sc = spark.sparkContext
        cuts = B.feature_cuts(frame, FEATURES, 64)
        rows = B.binned_rows(frame, FEATURES, cuts, "reordered", ("user_id", "product_id"), None)
        sc.setJobGroup(f"depth {depth}", "")
        try:
            trees = B.grow(rows, [(B.Boosting(rounds=2, depth=depth, feature_share=0.5), None)], FEATURES, cuts)[0].trees
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return trees, len(sc.statusTracker().getJobIdsForGroup(f"depth {depth}"))

    (shallow, few), (deep, many) = passes(1), passes(7)
    assert few == many
    assert max(len(t.feature) for t in shallow) == 3 and min(len(t.feature) for t in deep) > 15


def test_cells_and_levels_give_the_same_trees(frame, monkeypatch):
    data = frame.withColumn("fold", F.when(F.col("user_id").isNotNull(), F.col("product_id") % 2))
    jobs = [(B.Boosting(rounds=3, depth=d, feature_share=s, gamma=0.05), k) for d, s in ((2, 0.25), (6, 0.5), (4, 0.75)) for k in (0, 1, None)]
    cells = [B.Cells((0,), (66,)).number, 70 * 70]
    together = []
    for most in (0, cells[0], cells[1], 1 << 20):  # all by levels, one feature by cells, two, all
        monkeypatch.setattr(B, "CELLS", most)
        together.append(grown(data, jobs, "fold"))
    assert together[0] == together[1] == together[2] == together[3]
    assert any(t.missing_left[i] for trees in together[0] for t in trees for i in range(len(t.feature)) if t.feature[i] >= 0)


def test_leaf_values_by_cell_are_those_of_the_walk(frame, monkeypatch):
    cuts = B.feature_cuts(frame, FEATURES, 64)
    rows = B.binned_rows(frame, FEATURES, cuts, "reordered", ("user_id", "product_id"), None)
    model = B.grow(rows, [(B.Boosting(rounds=4, depth=5, feature_share=0.5), None)], FEATURES, cuts)[0]
    rng = np.random.default_rng(1)
    bins = np.stack([rng.integers(0, len(c) + 2, 400) for c in cuts], 1).astype(np.int16)
    want = B.margins([t.arrays() for t in model.trees], bins)
    trees = model.grown()
    for most in (0, trees[0].cells.number, B.LOOKED_UP):
        monkeypatch.setattr(B, "LOOKED_UP", most)
        tables = B.Tables({0: trees})
        assert sum(values is None for _, values in tables.trees[0]) == {0: 4, trees[0].cells.number: 3}.get(most, 0)
        assert tables.margins(0, B.Rows(bins)).tolist() == want.tolist()


def test_cells_number_all_combinations_and_sums_are_exact():
    cells = B.Cells((1, 3), (4, 5))
    every = np.arange(cells.number)
    assert cells.of(cells.bins(every)).tolist() == every.tolist() and cells.bins(every)[:, [0, 2]].sum() == 0
    assert B.added(np.array([0, 0, 2]), np.array([2**60 + 1, 2, -2**55 - 1]), 3).tolist() == [2**60 + 3, 0, -2**55 - 1]


def test_rows_of_many_records_and_of_none(frame):
    p = B.Boosting(rounds=2, depth=4, feature_share=0.5)
    cuts = B.feature_cuts(frame, FEATURES, 64)
    rows = B.binned_rows(frame.repartition(5), FEATURES, cuts, "reordered", ("user_id", "product_id"), None)
    assert rows.agg(F.sum(F.length("y")) / 8).first()[0] == 1500
    assert B.grow(rows, [(p, None)], FEATURES, cuts)[0].trees == grown(frame, [(p, None)])[0]
    none = grown(frame.limit(0), [(p, 0)])[0]
    assert [t.feature for t in none] == [[-1], [-1]] and [t.value for t in none] == [[0.0], [0.0]]
