"""Trees and forests on counted rows of bins: the same trees, no more rows than there are different ones, any partitioning."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.sql import functions as F

from cartflow.operators import features as FT
from cartflow.operators import models as M


def _few_values(spark, n=20_000):
    """All keys differ, features have 2 to 8 values, labels are noisy."""
    df = spark.range(n).select(F.col("id").alias("user_id"), (F.col("id") % 89).alias("product_id"))
    for i, c in enumerate(FT.FEATURES):
        df = df.withColumn(c, F.pmod(F.xxhash64(F.lit(i), F.col("user_id") % 3001), F.lit(2 + i)) / 4.0)
    noise = F.pmod(F.xxhash64(F.lit(99), "user_id"), F.lit(10))
    return df.withColumn("reordered", (F.col(FT.FEATURES[6]) * 4 + noise > 9).cast("int"))


def _scores(model, df):
    return {(r.user_id, r.product_id): (r.score, r.prediction_default) for r in M.score(model, df).collect()}


def test_a_tree_on_counted_rows_is_the_library_tree(spark):
    df = _few_values(spark)
    plain = Pipeline(stages=[M.assembler(), M.decision_tree(max_depth=8)]).fit(M.to_labeled(df))
    counted = M.fit(M.decision_tree(max_depth=8), df)
    assert counted.stages[-1].numNodes == plain.stages[-1].numNodes
    a, b = _scores(plain, df), _scores(counted, df)
    assert a.keys() == b.keys() and all(a[k][0] == pytest.approx(b[k][0], abs=1e-12) and a[k][1] == b[k][1] for k in a)


def test_a_tree_of_many_values_is_the_library_tree(spark):
    """Under 10,000 rows the library's cuts come from all rows: with more values than bins, skewed counts and negative values."""
    df = spark.range(6000).select(F.col("id").alias("user_id"), (F.col("id") % 89).alias("product_id"))
    for i, c in enumerate(FT.FEATURES):
        u = F.pmod(F.xxhash64(F.lit(i), "user_id"), F.lit(30 * (i + 1))).cast("double")
        df = df.withColumn(c, F.round(u * u / 7 - 20, 1) if i % 2 else u)
    df = df.withColumn("reordered", (F.col(FT.FEATURES[6]) + F.col(FT.FEATURES[1]) + F.pmod(F.xxhash64(F.lit(99), "user_id"), F.lit(100)) > 200).cast("int"))
    plain = Pipeline(stages=[M.assembler(), M.decision_tree()]).fit(M.to_labeled(df))
    assert _scores(plain, df) == _scores(M.fit(M.decision_tree(), df), df)


@pytest.mark.parametrize("estimator", [lambda: M.decision_tree(max_depth=4), lambda: M.random_forest(num_trees=3, max_depth=4)])
def test_trees_grow_on_no_more_rows_than_differ(spark, monkeypatch, estimator):
    seen, fit = [], Estimator.fit

    def counting(self, dataset, params=None):
        seen.append(dataset.count())
        return fit(self, dataset, params)

    df = _few_values(spark)
    monkeypatch.setattr(Estimator, "fit", counting)
    M.fit(estimator(), df)
    assert seen and max(seen) <= df.select(*FT.FEATURES, "reordered").distinct().count() < df.count() / 3


def test_forest_does_not_depend_on_partitions(spark):
    df = _few_values(spark, 4000)
    forest = lambda: M.random_forest(max_depth=6)
    a, b = M.fit(forest(), df.coalesce(1)), M.fit(forest(), df.repartition(7))
    assert _scores(a, df) == _scores(b, df)
    assert [r.importance for r in M.feature_importance(a).collect()] == [r.importance for r in M.feature_importance(b).collect()]


def test_forest_probability_is_the_mean_of_its_trees(spark):
    df = _few_values(spark, 3000)
    model = M.fit(M.random_forest(num_trees=4, max_depth=5), df)
    binned = Pipeline(stages=model.stages[:2]).fit(df).transform(df)
    each = [{(r.user_id, r.product_id): r.probability[1] for r in t.transform(binned).collect()} for t in model.trees]
    assert len({tuple(e.values()) for e in each}) == 4
    for k, (s, _) in _scores(model, df).items():
        assert s == pytest.approx(sum(e[k] for e in each) / 4, abs=1e-12)
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def test_unseen_values_go_to_the_nearest_bins(spark):
    df = _few_values(spark, 3000)
    model = M.fit(M.random_forest(num_trees=3, max_depth=5), df)
    far = df.select("user_id", "product_id", *[(F.lit(-5.0) if i % 2 else F.lit(1e9)).alias(c) for i, c in enumerate(FT.FEATURES)])
    ends = df.agg(*[(F.min(c) if i % 2 else F.max(c)).alias(c) for i, c in enumerate(FT.FEATURES)]).select(F.lit(0).alias("user_id"), F.lit(0).alias("product_id"), "*")
    assert {v for v in _scores(model, far).values()} == set(_scores(model, ends).values())


@pytest.mark.parametrize("n", [1, 3])
def test_few_rows_of_one_class(spark, n):
    df = _few_values(spark, n).withColumn("reordered", F.lit(0))
    for estimator in (M.random_forest(), M.decision_tree()):
        assert {v[0] for v in _scores(M.fit(estimator, df), df).values()} == {0.0}


def test_a_value_on_a_cut_goes_left_as_in_the_library(spark):
    df = spark.range(40).select(F.col("id").alias("user_id"), F.lit(1).alias("product_id"),
                                *[(F.col("id") % 2).cast("double").alias(c) for c in FT.FEATURES], (F.col("id") % 2).cast("int").alias("reordered"))
    middle = df.limit(1).select("user_id", "product_id", *[F.lit(0.5).alias(c) for c in FT.FEATURES])
    plain = Pipeline(stages=[M.assembler(), M.decision_tree()]).fit(M.to_labeled(df))
    assert set(_scores(M.fit(M.decision_tree(), df), middle).values()) == set(_scores(plain, middle).values()) == {(0.0, 0)}
