"""Second-order boosting and the shared grid: against a plain numpy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartflow.operators import boosting as B
from cartflow.operators.models import fold_column
from cartflow.plans import catalog as C

SF = "/root/testdata/sf0.001"


def plain_tree(x, g, h, features, p):
    """One tree by direct sums over rows: {node path: (feature, cut, missing left) or leaf value}."""
    def loss(gs, hs):
        return gs * gs / (hs + p.l2)

    def build(rows, depth, gs, hs):
        leaf = -p.step * gs / (hs + p.l2) + 0.0
        best = None
        for f in features if depth < p.depth else ():
            b = x[rows, f]
            for cut in np.unique(b[b > 0]):
                for missing_left in (False, True):
                    left = (b > 0) & (b <= cut) | ((b == 0) & missing_left)
                    gl, hl = g[rows][left].sum() / B.UNIT, h[rows][left].sum() / B.UNIT
                    if min(hl, hs - hl) < p.least_weight:
                        continue
                    gain = (loss(gl, hl) + loss(gs - gl, hs - hl) - loss(gs, hs)) / 2 - p.gamma
                    if best is None or gain > best[0]:
                        best = (gain, f, int(cut), missing_left, left, gl, hl)
        if best is None or best[0] <= B.LEAST_GAIN:
            return leaf
        _, f, cut, missing_left, left, gl, hl = best
        return (int(f), cut, missing_left, build(rows[left], depth + 1, gl, hl), build(rows[~left], depth + 1, gs - gl, hs - hl))

    rows = np.arange(len(x))
    return build(rows, 0, g.sum() / B.UNIT, h.sum() / B.UNIT)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return (tree.feature[node], tree.cut[node], tree.missing_left[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def value_of(tree, row):
    while isinstance(tree, tuple):
        f, cut, missing_left, left, right = tree
        tree = left if (missing_left if row[f] == 0 else row[f] <= cut) else right
    return tree


def plain_boosting(rows, cuts, p, n_features):
    h, x, y = np.array([r.h for r in rows]), B.binned(np.array([r.v for r in rows], float), cuts), np.array([r.y for r in rows], float)
    margin, trees = np.zeros(len(y)), []
    for t in range(p.rounds):
        use = B.sampled(h, p.seed, t, p.row_share)
        q = 1 / (1 + np.exp(-margin))
        g, w = np.rint((q - y) * B.UNIT), np.rint(q * (1 - q) * B.UNIT)
        tree = plain_tree(x[use], g[use], w[use], p.features_of(t, n_features), p)
        trees.append(tree)
        margin = margin + np.array([value_of(tree, r) for r in x])
    return trees, 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def pairs(spark):
    return C._training(spark, SF).checkpoint(eager=True)


def collected(frame, features, label="reordered", keys=("user_id", "product_id")):
    return frame.select(F.xxhash64(*keys).alias("h"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"), F.col(label).alias("y"),
                        *keys).collect()


@pytest.mark.parametrize("params", [B.Boosting(rounds=2, depth=3), B.Boosting(rounds=1, depth=4, feature_share=0.6, gamma=0.1, least_weight=3.0, bins=16)])
def test_trees_and_scores_are_those_of_plain_numpy(pairs, params):
    model = B.fit(pairs, params)
    rows = collected(pairs, model.features)
    trees, scores = plain_boosting(rows, model.cuts, params, len(model.features))
    assert [nested(t) for t in model.trees] == trees
    got = {(r.user_id, r.product_id): r.score for r in B.score(model, pairs).collect()}
    assert max(abs(got[r.user_id, r.product_id] - s) for r, s in zip(rows, scores)) < 1e-12


def test_trees_do_not_depend_on_partitions(pairs):
    p = B.Boosting(rounds=1, depth=3)
    assert B.fit(pairs.repartition(7), p).trees == B.fit(pairs.orderBy("product_id"), p).trees


def test_shares_that_admit_other_numbers_of_features_give_other_trees(pairs):
    one, other = (B.fit(pairs, B.Boosting(rounds=2, depth=3, feature_share=s)) for s in (0.3, 0.6))
    assert one.trees != other.trees
    assert [len(B.Boosting(feature_share=s).features_of(0, 7)) for s in (0.1, 0.3, 0.4, 0.6, 1.0)] == [1, 2, 2, 4, 7]


def test_missing_values_go_where_they_gain_and_odd_tables_work(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 10), float("nan") if i % 7 == 0 else 1.0, int(i % 4 == 0 or i % 10 > 7)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k long, a double, b double, reordered int")
    p = B.Boosting(rounds=4, depth=3, feature_share=1.0, row_share=1.0)
    model = B.fit(frame, p, ["a", "b"], keys=["k"])
    data = collected(frame, ["a", "b"], keys=("k",))
    trees, _ = plain_boosting([type("R", (), {"h": r.h, "v": [np.nan if v is None else v for v in r.v], "y": r.y}) for r in data], model.cuts, p, 2)
    assert [nested(t) for t in model.trees] == trees
    hit = B.score(model, frame.withColumn("label", F.col("reordered")), 0.5, ("k",)).where("prediction = label").count()
    assert hit == 400 and any(any(t.missing_left) for t in model.trees) | any(t.feature[0] >= 0 for t in model.trees)
    empty = B.fit(frame.limit(0), p, ["a", "b"], keys=["k"])
    assert {r.score for r in B.score(empty, frame, keep=("k",)).collect()} == {0.5}
    one = B.fit(frame.where("reordered = 1"), B.Boosting(rounds=1), ["a", "b"], keys=["k"])
    assert all(len(t.feature) == 1 for t in one.trees)  # nothing to split


def test_grid_is_that_of_separate_fits(pairs, spark):
    p = B.Boosting(rounds=1)
    model, report = B.grid_search(pairs, (2, 4), (0.3, 0.6), 2, p)
    data = fold_column(pairs, 2, 7).checkpoint(eager=True)
    cuts = B.feature_cuts(data, B.FEATURES, p.bins)
    for r in report.collect():
        params = B.replace(p, depth=r.max_depth, feature_share=r.feature_share)
        rows = B.binned_rows(data.where(F.col("fold") != r.fold), B.FEATURES, cuts, "reordered", ("user_id", "product_id"), None)
        alone = B.grow(rows, [(params, None)], B.FEATURES, cuts)[0]
        held = B.score(alone, data.where(F.col("fold") == r.fold)).agg(F.avg((F.col("prediction_default") == F.col("reordered")).cast("double"))).first()[0]
        assert abs(held - r.accuracy) < 1e-12
        if r.best:
            assert (model.params.depth, model.params.feature_share) == (r.max_depth, r.feature_share)
    assert report.where("best").count() == 2


def test_tables_of_the_model(pairs, spark):
    model = B.fit(pairs, B.Boosting(rounds=2))
    nodes = model.nodes(spark)
    inner = nodes.where("feature is not null")
    assert inner.count() + 2 == nodes.count() - inner.count()  # a binary tree has one leaf more than splits
    assert inner.where("threshold is null or gain <= 0").count() == 0
    counts = {r.feature: r.splits for r in B.split_importance(model, spark).collect()}
    assert sum(counts.values()) == inner.count() and set(counts) == set(model.features)
    assert {r.param for r in B.model_params(model, spark).collect()} >= {"depth", "l2", "rounds", "seed"}
