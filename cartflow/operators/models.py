"""Classifiers on the training set and their report tables.

``pyspark.ml`` only: the data stays distributed while models fit (the
driver coordinates iterations, executors compute the statistics).
The training input is persisted for the iterations and released after.
trees with seed 42; boosting with depth 5, feature share 0.4, row share
0.75, 10 rounds, step 0.3.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import bounded_broadcast
from ..session import shared_path
from .boosting import feature_cuts
from .deep_forest import Growth, drawn
from .features import FEATURES

#: Bins of a feature, as Spark's trees have them.
BINS = 32
#: Values of a feature that are counted one by one for its cuts.
COUNTED_VALUES = 10_000
#: Binned rows of a task while trees grow: each task sends sums of all open nodes, so more tasks than needed cost as much as rows.
BINNED_ROWS = 50_000
#: Trees that grow at the same time.
TREES_AT_ONCE = 10


def assembler(features: Sequence[str] = FEATURES) -> VectorAssembler:
    """P10: feature columns -> one vector; the label stays a column."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def logistic_regression(n_rows: int | None = None) -> LogisticRegression:
    # C = 1 with L2 on the mean loss: regParam = 1 / n.
    reg = 1.0 / n_rows if n_rows else 0.0
    return LogisticRegression(labelCol="label", maxIter=100, regParam=reg, elasticNetParam=0.0,
                              standardization=False)


def random_forest(seed: int = 42, num_trees: int = 10, max_depth: int = 30) -> RandomForestClassifier:
    # Depth 30 is the most Spark allows (trees grow until leaves are pure); caching each row's node id saves re-walking the trees per level.
    return RandomForestClassifier(labelCol="label", numTrees=num_trees, seed=seed,
                                  featureSubsetStrategy="sqrt", maxDepth=max_depth, cacheNodeIds=True)


def gradient_boosting(seed: int = 42, max_depth: int = 5, feature_share: float = 0.4,
                      row_share: float = 0.75, rounds: int = 10, step: float = 0.3) -> GBTClassifier:
    return GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=max_depth, subsamplingRate=row_share,
                         featureSubsetStrategy=str(feature_share), stepSize=step, seed=seed)


def decision_tree(seed: int = 42, max_depth: int = 30) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol="label", maxDepth=max_depth, seed=seed, cacheNodeIds=True)


def to_labeled(train: DataFrame, label: str = "reordered") -> DataFrame:
    return train.withColumn("label", F.col(label).cast("double"))


def fit(estimator, train: DataFrame, features: Sequence[str] = FEATURES):
    """Fit ``assembler + estimator`` on a labelled frame (persisted while fitting); trees and forests on its binned rows."""
    data = to_labeled(train).persist()
    try:
        if isinstance(estimator, (DecisionTreeClassifier, RandomForestClassifier)):
            return fit_trees(estimator, data, features)
        return Pipeline(stages=[assembler(features), estimator]).fit(data)
    finally:
        data.unpersist()


@dataclass(frozen=True)
class Forest:
    """Fitted trees over binned features: ``probability`` is the mean of theirs."""

    binning: PipelineModel
    trees: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows of the same bins have the same probability: each distinct one goes down the trees once."""
        bins = self.binning.stages[0].getOutputCols()
        # bins are under 2 ** 7: nine of them fit a long
        codes = [sum((F.col(b).cast("long") * 128 ** j for j, b in enumerate(bins[i:i + 9])), F.lit(0).cast("long")) for i in range(0, len(bins), 9)]
        keys = [f"_k{i}" for i in range(len(codes))]
        rows = self.binning.stages[0].transform(df).withColumns(dict(zip(keys, codes)))
        out = self.binning.stages[1].transform(rows.select(*keys, *bins).distinct())
        columns = [f"_p{t}" for t in range(len(self.trees))]
        for name, tree in zip(columns, self.trees):
            out = tree.copy().setProbabilityCol(name).setRawPredictionCol("").setPredictionCol("").transform(out)
        positive = sum((vector_to_array(c)[1] for c in columns), F.lit(0.0)) / len(columns)
        known = bounded_broadcast(out.select(*keys, positive.alias("_s")).checkpoint(eager=True))
        return (rows.drop(*bins).join(known, keys, "left").withColumn("probability", array_to_vector(F.array(1 - F.col("_s"), F.col("_s"))))
                .withColumn("prediction", (F.col("_s") > 0.5).cast("double")).drop("_s", *keys))

    @property
    def stages(self) -> list:
        return [*self.binning.stages, self]

    @property
    def featureImportances(self) -> DenseVector:
        """Mean of the trees' importances (each adds up to 1), scaled to 1."""
        total = np.sum([tree.featureImportances.toArray() for tree in self.trees], axis=0)
        return DenseVector(total / total.sum() if total.sum() else total)


def tree_cuts(data: DataFrame, features: Sequence[str]) -> list:
    """Cuts of every feature by the library's rule, on the counts of all its values (the library counts those of about 10,000 rows).

    Up to ``BINS`` values: all neighbours are cut; else in steps of equal
    counts, where a value brings the sum no nearer to the next step.  Features
    with more than ``COUNTED_VALUES`` values are cut at approximate quantiles.
    """
    cols = [F.col(f).cast("double") for f in features]
    about = data.agg(*[F.approx_count_distinct(c).alias(f) for f, c in zip(features, cols)]).first()
    counted = [i for i, f in enumerate(features) if about[f] <= COUNTED_VALUES]
    found: dict[int, list] = {i: [] for i in counted}
    if counted:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (cols[i] + 0.0).alias("v")) for i in counted])).alias("s")
        for r in data.select(cells).where("s.v is not null and not isnan(s.v)").groupBy("s.i", "s.v").count().collect():
            found[r.i].append((r.v, r["count"]))
    many = [i for i in range(len(features)) if i not in found]
    quantiles = dict(zip(many, feature_cuts(data, [features[i] for i in many], BINS))) if many else {}
    out = []
    for i in range(len(features)):
        values = sorted(found.get(i, []))
        middles = [(a + b) / 2 for (a, _), (b, _) in zip(values, values[1:])]
        if i in quantiles or len(values) <= BINS:
            out.append(quantiles.get(i, middles))
            continue
        step = sum(n for _, n in values) / BINS
        cuts, target, total = [], step, values[0][1]
        for middle, (_, n) in zip(middles, values[1:]):
            if abs(total - target) < abs(total + n - target):
                cuts.append(middle)
                target += step
            total += n
        out.append(cuts)
    return out


def fit_trees(estimator, data: DataFrame, features: Sequence[str], keys: Sequence[str] = ("user_id", "product_id")):
    """A tree or forest of Spark's library on the distinct rows of binned features, with the number of rows as weight.

    A tree cannot tell rows of the same bins apart, so it is the same with one
    row of their total weight.  In a forest each tree has its own weights: rows
    are drawn with repetition by a hash of their keys before they are counted.
    """
    k, forest = len(features), isinstance(estimator, RandomForestClassifier)
    trees = estimator.getNumTrees() if forest else 1
    growth = Growth(trees=trees, bootstrap=forest and estimator.getBootstrap(), seed=estimator.getSeed())
    cuts = [c if len(c) else [0.0] for c in tree_cuts(data, features)]
    bins = [f"_b{j}" for j in range(k)]
    # a value on a cut goes left, as in the library's trees
    bucketizer = Bucketizer(splitsArray=[[-np.inf, *[float(np.nextafter(v, np.inf)) for v in c], np.inf] for c in cuts], inputCols=list(features), outputCols=bins)
    binning = PipelineModel([bucketizer, VectorAssembler(inputCols=bins, outputCol="features", handleInvalid="error")])
    weights = [f"_w{t}" for t in range(trees)]
    # the sum drops the bins' metadata, which would make them categories without an order
    counted = (bucketizer.transform(data).groupBy(*[(F.col(b) + 0.0).alias(b) for b in bins], "label")
               .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(drawn(keys, growth, t)).cast("double").alias(w) for t, w in enumerate(weights)])
               .checkpoint(eager=True))
    totals = counted.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(w) for w in weights]).first()
    two = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0.0", "1.0"]}}
    # by value and in order, so that trees don't depend on the partitions of the data
    rows = (binning.stages[1].transform(counted.repartition(max(1, -(-totals.rows // BINNED_ROWS)), *bins, "label").sortWithinPartitions(*bins, "label"))
            .select("features", F.col("label").alias("label", metadata=two), F.col("_n").cast("double").alias("_n"), *weights).persist())

    def grown(t: int):
        own = estimator.copy().setMaxBins(4 * BINS).setSeed(growth.seed + t)
        if forest:
            own = own.setNumTrees(1).setBootstrap(False)
        # where few rows are given, a tree may have drawn none: it takes all
        return own.setWeightCol(weights[t]).fit(rows.where(F.col(weights[t]) > 0)) if totals[weights[t]] else own.setWeightCol("_n").fit(rows)

    try:
        if not forest:
            return PipelineModel([*binning.stages, grown(0)])
        with ThreadPool(TREES_AT_ONCE) as pool:
            return Forest(binning, pool.map(inheritable_thread_target(_spark())(grown), range(trees)))
    finally:
        rows.unpersist()


def score(model: PipelineModel, df: DataFrame, threshold: float | None = None,
          keep: Sequence[str] = ("user_id", "product_id")) -> DataFrame:
    """score = P(class 1); ``prediction`` at ``threshold`` (inclusive).

    ``prediction_default`` is the model's own class (probability 0.5 rule,
    M8); without a threshold both columns are that class.  Rows keep their
    keys (no positional alignment).
    """
    out = model.transform(df)
    s = vector_to_array("probability")[1]
    default = F.col("prediction").cast("int")
    pred = (s >= F.lit(float(threshold))).cast("int") if threshold is not None else default
    extra = [c for c in ("label", "reordered", "order_id") if c in df.columns and c not in keep]
    return out.select(*keep, *extra, s.alias("score"), pred.alias("prediction"),
                      default.alias("prediction_default"))


def auc(scored: DataFrame, label: str = "label") -> float:
    """Area under ROC of a scored frame (distributed, Spark's evaluator)."""
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="score", metricName="areaUnderROC")
    return ev.evaluate(scored.withColumn(label, F.col(label).cast("double")))


def feature_importance(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """M11 + O1: importance per feature, descending."""
    spark = _spark()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(v) for v in imp])), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature").asc())


def split_importance(model: PipelineModel, features: Sequence[str] = FEATURES, name: str = "model") -> DataFrame:
    """Number of splits per feature, read from the saved tree table.

    The model is saved (parquet node table) in the shared folder and the
    internal nodes (``leftChild >= 0``) are counted by split feature.
    """
    spark = _spark()
    path = shared_path(spark, "models", f"{name}-{os.getpid()}-{id(model)}")
    tree_model = model.stages[-1]
    tree_model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" in nodes.columns:
        nodes = nodes.select("nodeData.*")
    names = spark.createDataFrame(list(enumerate(features)), "feature_index int, feature string")
    counts = (nodes.where(F.col("leftChild") >= 0)
              .groupBy(F.col("split.featureIndex").alias("feature_index")).agg(F.count(F.lit(1)).alias("splits")))
    return (names.join(counts, "feature_index", "left")
            .select("feature", F.coalesce("splits", F.lit(0)).cast("long").alias("splits"))
            .orderBy(F.col("splits").desc(), F.col("feature").asc()))


def fold_column(df: DataFrame, folds: int = 3, seed: int = 7,
                keys: Sequence[str] = ("user_id", "product_id")) -> DataFrame:
    """Deterministic fold number per row (hash of the keys), stable under repartitioning."""
    from ..functions.columns import hash_fraction
    return df.withColumn("fold", F.floor(hash_fraction(*[F.col(k) for k in keys], seed=seed) * folds)
                         .cast("int"))


def grid_search(train: DataFrame, depths: Sequence[int] = (5, 10), shares: Sequence[float] = (0.3, 0.4),
                folds: int = 3, parallelism: int = 4, seed: int = 42):
    """M5 + M6: 2 x 2 grid x 3 folds over boosting, accuracy metric, refit of the best.

    Folds come from a hash of the row keys (stable under repartitioning).
    Returns (cv_model, report) where the report has one row per parameter set
    and fold: max_depth, feature_share, fold, accuracy (of that fold's model
    on its held-out fold), mean_accuracy, std_accuracy and ``best`` (the set
    the refit used).  The report holds grid x folds rows, model-sized.
    """
    spark = _spark()
    data = fold_column(to_labeled(train), folds).persist()
    try:
        gbt = gradient_boosting(seed=seed)
        pipe = Pipeline(stages=[assembler(), gbt])
        grid = (ParamGridBuilder().addGrid(gbt.maxDepth, list(depths))
                .addGrid(gbt.featureSubsetStrategy, [str(s) for s in shares]).build())
        ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                            foldCol="fold", parallelism=parallelism, seed=seed, collectSubModels=True)
        cvm = cv.fit(data)
        per_fold = [[ev.evaluate(cvm.subModels[k][i].transform(data.where(F.col("fold") == k)))
                     for i in range(len(grid))] for k in range(folds)]
    finally:
        data.unpersist()
    best = max(range(len(grid)), key=lambda i: cvm.avgMetrics[i])
    std = cvm.stdMetrics if cvm.stdMetrics else [None] * len(grid)
    rows = []
    for i, pm in enumerate(grid):
        d = {p.name: v for p, v in pm.items()}
        for k in range(folds):
            rows.append((int(d["maxDepth"]), float(d["featureSubsetStrategy"]), k, float(per_fold[k][i]),
                         float(cvm.avgMetrics[i]), None if std[i] is None else float(std[i]), i == best))
    report = spark.createDataFrame(rows, "max_depth int, feature_share double, fold int, accuracy double, "
                                         "mean_accuracy double, std_accuracy double, best boolean")
    return cvm, report


def model_params(model: PipelineModel) -> DataFrame:
    """M6: the fitted model's parameters as (param, value) rows."""
    spark = _spark()
    m = model.stages[-1]
    rows = [(p.name, str(v)) for p, v in sorted(m.extractParamMap().items(), key=lambda kv: kv[0].name)]
    return spark.createDataFrame(rows, "param string, value string")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()
