"""A forest without a depth limit, on exact thresholds (M3).

Rows with equal features are one row with counts from the start, so a leaf is
pure or can't be split any more.  Nodes of more than ``task_rows`` such rows
are split on Spark: counts by (node, feature, value), running sums over range
partitions, the best cut of each node and feature; the driver keeps these top
nodes, about one for every ``task_rows`` rows of a tree.  Once a node's rows fit
a task, they are grouped by node and the task grows the whole subtree.  The
subtrees stay a table in the shared folder and never reach the driver.

Each node tries its features in an order drawn for it and takes the best cut
of the first ``tried`` that have one (so a node is a leaf only if all its rows
are of one class or have equal features, also where no cut gains anything).
Rows are drawn with repetition for each tree by a hash of their keys (Poisson
weights).  Equal gains go to the lower feature number, then to the lower value;
the threshold is the last value on the left; missing values (null, NaN) count as the largest.
An empty table gives no trees, and scores are null.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_sums
from ..session import shared_path
from .features import FEATURES

NODES = "tree int, part long, node int, feature int, threshold double, left int, right int, n long, pos long"
#: Scored rows of one subtree that go to one group, which a worker holds whole.
SCORED_ROWS = 100_000


@dataclass(frozen=True)
class Growth:
    """``tried`` features with a cut per node (None: the square root of their number); ``bootstrap``: rows drawn with repetition."""

    trees: int = 10
    bootstrap: bool = True
    tried: int | None = None
    seed: int = 42
    task_rows: int = 100_000


@dataclass
class Top:
    """Nodes that Spark split, of all trees: the first ``trees`` are the roots.  ``part``: its subtree was grown in a task."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    share: list[float]
    part: list[bool]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.share, self.part))


@dataclass
class DeepForest:
    features: list[str]
    growth: Growth
    top: Top
    subtrees: DataFrame


def walk(nodes: tuple[np.ndarray, ...], start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where rows end that start at a node."""
    feature, threshold, left, right = nodes[:4]
    at, rows = start.copy(), np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at]), at)


def subtree(x: np.ndarray, n: np.ndarray, pos: np.ndarray, tried: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, threshold, left, right, n, pos) of distinct rows with counts; feature -1 in leaves."""
    nodes: list[list] = [[-1, 0.0, 0, 0, int(n.sum()), int(pos.sum())]]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        total, good = nodes[at][4], nodes[at][5]
        if good in (0, total) or len(rows) < 2:
            continue
        options = []
        for f in rng.permutation(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            ends = np.flatnonzero(v[1:] != v[:-1])
            if len(ends):
                nl, pl = np.cumsum(n[order])[ends].astype(float), np.cumsum(pos[order])[ends].astype(float)
                nr, pr = total - nl, good - pl
                left = pl * (nl - pl) / nl + pr * (nr - pr) / nr
                best = int(np.argmin(left))
                options.append((left[best], int(f), float(v[ends[best]])))
                if len(options) == tried:
                    break
        if not options:
            continue
        _, f, threshold = min(options)
        low = x[rows, f] <= threshold
        for side in (rows[low], rows[~low]):
            todo.append((len(nodes), side))
            nodes.append([-1, 0.0, 0, 0, int(n[side].sum()), int(pos[side].sum())])
        nodes[at][:4] = [f, threshold, len(nodes) - 2, len(nodes) - 1]
    return [tuple(row) for row in nodes]


def vector(features: Sequence[str]) -> Column:
    def value(name: str) -> Column:
        c = F.col(name).cast("double")
        return F.when(c.isNull() | F.isnan(c), F.lit(math.inf)).otherwise(c + F.lit(0.0))
    return F.array(*[value(f) for f in features])


def drawn(keys: Sequence[str], growth: Growth, tree: int) -> Column:
    """How often a row comes in a tree: Poisson with mean 1, from a hash of its keys."""
    if not growth.bootstrap:
        return F.lit(1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(growth.seed), F.lit(tree), *keys), 11).cast("double") / float(1 << 53)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return sum((F.when(u >= float(b), 1).otherwise(0) for b in below[1:]), F.when(u >= float(below[0]), 1).otherwise(0))


def placed(rows: DataFrame, top: Top, only: Sequence[int]) -> DataFrame:
    """``node`` of the rows (tree, x, n, pos) that stand at one of the nodes ``only``."""
    arrays, wanted = top.arrays(), np.array(sorted(only))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                node = walk(arrays, batch.tree.to_numpy(np.int64), np.stack(batch.x.to_numpy()))
                yield batch.assign(node=node)[np.isin(node, wanted)]

    return rows.mapInPandas(run, "tree int, x array<double>, n long, pos long, node long")


def fit(train: DataFrame, growth: Growth = Growth(), features: Sequence[str] = FEATURES, label: str = "reordered",
        keys: Sequence[str] = ("user_id", "product_id")) -> DeepForest:
    """The forest of a labelled table; its subtrees are written to the shared folder."""
    spark, k = train.sparkSession, len(features)
    tried = growth.tried or max(1, int(math.sqrt(k)))
    y = (F.col(label) == 1).cast("long")
    weights = [drawn(keys, growth, t).cast("long") for t in range(growth.trees)]
    counts = [c for t, w in enumerate(weights) for c in (F.sum(w).alias(f"n{t}"), F.sum(w * y).alias(f"p{t}"))]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col(f"n{t}").alias("n"), F.col(f"p{t}").alias("pos")) for t in range(growth.trees)]))
    rows = (train.groupBy(vector(features).alias("x")).agg(*counts).select("x", each.alias("s")).where("s.n > 0")
            .select("s.tree", "x", "s.n", "s.pos").checkpoint(eager=True))
    top = Top(*[[v] * growth.trees for v in (-1, 0.0, 0, 0, math.nan, False)])
    size: dict[int, tuple[int, int, int]] = {}

    def settle(node: int, n: int, pos: int, distinct: int) -> bool:
        """Whether the node is for Spark to split; else it is a leaf or a task's."""
        size[node], top.share[node] = (n, pos, distinct), pos / n
        top.part[node] = 0 < pos < n and distinct <= growth.task_rows
        return 0 < pos < n and distinct > growth.task_rows

    roots = rows.groupBy("tree").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("d")).orderBy("tree").collect()
    waiting = [r.tree for r in roots if settle(r.tree, r.n, r.pos, r.d)]
    while waiting:
        totals = spark.createDataFrame([(i, *size[i][:2]) for i in waiting], "node long, all_n long, all_pos long")
        value = F.posexplode("x").alias("f", "v")
        cells = (placed(rows, top, waiting).select("node", "n", "pos", value).groupBy("node", "f", "v")
                 .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("d")))
        sums = running_sums(cells, ["node", "f"], [F.col("v")], {"nl": F.col("n"), "pl": F.col("pos"), "dl": F.col("d")}).join(totals, "node")
        nr, pr = F.col("all_n") - F.col("nl"), F.col("all_pos") - F.col("pl")
        left = (F.col("pl") * (F.col("nl") - F.col("pl"))).cast("double") / F.col("nl") + (pr * (nr - pr)).cast("double") / nr
        best = (sums.where(nr > 0).groupBy("node", "f")
                .agg(F.min(F.struct(left.alias("left"), "v", "nl", "pl", "dl")).alias("b")).collect())
        found: dict[int, dict[int, tuple]] = {}
        for r in best:
            found.setdefault(r.node, {})[r.f] = tuple(r.b)
        coming = []
        for i in waiting:  # more than one distinct row: some feature has a cut
            order = np.random.default_rng([growth.seed, 1, i]).permutation(k)
            options = [(found[i][f][0], int(f), found[i][f]) for f in order if f in found[i]][:tried]
            _, f, (_, v, nl, pl, dl) = min(options)
            n, pos, d = size[i]
            top.feature[i], top.threshold[i], top.part[i] = f, v, False
            top.left[i], top.right[i] = len(top.feature), len(top.feature) + 1
            for child in ((nl, pl, dl), (n - nl, pos - pl, d - dl)):
                for column, start in zip((top.feature, top.threshold, top.left, top.right, top.share, top.part), (-1, 0.0, 0, 0, math.nan, False)):
                    column.append(start)
                if settle(len(top.feature) - 1, *child):
                    coming.append(len(top.feature) - 1)
        waiting = coming

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.x.to_numpy())
        order = np.lexsort(x.T[::-1])
        part = int(group.node.iloc[0])
        made = subtree(x[order], group.n.to_numpy()[order], group.pos.to_numpy()[order], tried, np.random.default_rng([growth.seed, 2, part]))
        out = pd.DataFrame(made, columns=["feature", "threshold", "left", "right", "n", "pos"])
        return out.assign(tree=int(group.tree.iloc[0]), part=part, node=np.arange(len(out)))[[c.split()[0] for c in NODES.split(", ")]]

    path = shared_path(spark, f"forest-{uuid.uuid4().hex}")
    parts = [i for i, is_part in enumerate(top.part) if is_part]
    placed(rows, top, parts).groupBy("node").applyInPandas(finish, NODES).write.parquet(path)
    return DeepForest(list(features), growth, top, spark.read.parquet(path))


def score(model: DeepForest, df: DataFrame, keep: Sequence[str] = ("user_id", "product_id")) -> DataFrame:
    """``keep`` (which tell rows apart) and ``score``: the mean over the trees of the share of positives in the row's leaf.

    Rows with equal features end in the same leaves: each distinct vector goes
    down the trees once, and its values are joined to its rows.
    """
    trees, arrays = model.growth.trees, model.top.arrays()
    given = df.select(*keep, vector(model.features).alias("_x"))
    vectors = given.select("_x").distinct().select(F.monotonically_increasing_id().alias("_id"), "_x").checkpoint(eager=True)
    rows = vectors.select("_id", "_x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = walk(arrays, batch._tree.to_numpy(np.int64), np.stack(batch._x.to_numpy()))
                yield batch.drop(columns="_tree").assign(_part=np.where(arrays[5][at], at, -1), _value=arrays[4][at])

    rows = rows.mapInPandas(down, "_id long, _x array<double>, _part long, _value double").checkpoint(eager=True)
    # a subtree that many rows reach comes several times
    many = {r._part: -(-r["count"] // SCORED_ROWS) for r in rows.where("_part >= 0").groupBy("_part").count().where(F.col("count") > SCORED_ROWS).collect()}
    copies = lambda part: F.coalesce(F.create_map(*[F.lit(int(x)) for pair in many.items() for x in pair])[part], F.lit(1)) if many else F.lit(1)
    mine = rows.where("_part >= 0").withColumn("_copy", F.pmod(F.xxhash64("_id"), copies(F.col("_part"))).cast("int"))
    nodes = model.subtrees.withColumnRenamed("part", "_part").withColumn("_copy", F.explode(F.sequence(F.lit(0), (copies(F.col("_part")) - 1).cast("int"))))

    def through(nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        rows = rows[["_id", "_x"]]
        if not len(rows):
            return rows.drop(columns="_x").assign(_value=np.zeros(0))
        end = walk(tuple(nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right")), np.zeros(len(rows), np.int64), np.stack(rows._x.to_numpy()))
        return rows.drop(columns="_x").assign(_value=(nodes.pos / nodes.n).to_numpy()[end])

    ended = nodes.groupBy("_part", "_copy").cogroup(mine.groupBy("_part", "_copy")).applyInPandas(through, "_id long, _value double")
    leaves = (rows.where("_part < 0").select("_id", "_value").unionByName(ended).groupBy("_id")
              .agg(F.collect_list(F.when(~F.isnan("_value"), F.col("_value"))).alias("_v")))
    # kept in the shared folder, so AQE can split the rows of a vector that many of them share
    known = vectors.join(leaves, "_id").select("_x", "_v").checkpoint(eager=True)
    values = F.sort_array(F.flatten(F.collect_list("_v")))  # one a tree, added up in the same order always
    return (given.join(known, "_x", "left").groupBy(*keep).agg(values.alias("v"))
            .select(*keep, F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")).alias("score")))
