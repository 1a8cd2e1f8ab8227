"""A decision tree with exact splits: every distinct value is a threshold.

Each level counts rows and positives by (node, feature, value), runs sums over
the values of a node's feature, range-partitioned so that a feature with many
values spans many partitions, and takes the best cut.  The driver sees one row
per node and feature.  Rows find their node by a column expression of the tree
so far.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import running_sums
from .features import FEATURES


@dataclass
class Node:
    """``n`` rows with ``pos`` positives; a split sends values at or under ``threshold`` to node 2i + 1, others to 2i + 2."""

    n: int
    pos: int
    feature: str | None = None
    threshold: float | None = None
    gain: float | None = None


def node_expression(nodes: dict[int, Node], at: int = 0) -> Column:
    """The number of the leaf a row falls into."""
    node = nodes[at]
    if node.feature is None:
        return F.lit(at)
    return (F.when(F.col(node.feature).cast("double") <= F.lit(node.threshold), node_expression(nodes, 2 * at + 1))
            .otherwise(node_expression(nodes, 2 * at + 2)))


def fit(train: DataFrame, depth: int, features: Sequence[str] = FEATURES, label: str = "reordered", least_rows: int = 1) -> dict[int, Node]:
    """Nodes by number (root 0).  Null values go right.

    The impurity is Gini's; a split's gain is what it takes off the sum of
    ``2 * pos * neg / n`` over both sides.  Equal gains go to the first feature,
    then to the lowest value; the threshold is the last value on the left.
    """
    y = (F.col(label) == 1).cast("long")
    total = train.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).first()
    nodes = {0: Node(total.n, int(total.pos or 0))}
    fresh = [0]
    for _ in range(depth):
        fresh = [i for i in fresh if 0 < nodes[i].pos < nodes[i].n]
        if not fresh:
            break
        values = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f).cast("double").alias("v")) for j, f in enumerate(features)]))
        counts = (train.select(node_expression(nodes).alias("node"), y.alias("y"), values.alias("s")).where(F.col("node").isin(fresh) & F.col("s.v").isNotNull())
                  .groupBy("node", F.col("s.f").alias("f"), F.col("s.v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
        sums = running_sums(counts, ["node", "f"], [F.col("v")], {"nl": F.col("n"), "pl": F.col("pos")})
        size = F.create_map(*[F.lit(x) for i in fresh for x in (i, nodes[i].n)])[F.col("node")]
        good = F.create_map(*[F.lit(x) for i in fresh for x in (i, nodes[i].pos)])[F.col("node")]

        def impurity(pos: Column, n: Column) -> Column:
            return 2.0 * pos.cast("double") * (n - pos).cast("double") / n.cast("double")

        nr, pr = size - F.col("nl"), good - F.col("pl")
        gain = impurity(good, size) - (impurity(F.col("pl"), F.col("nl")) + impurity(pr, nr))
        cuts = sums.where((F.col("nl") >= least_rows) & (nr >= least_rows)).withColumn("gain", gain)
        best = cuts.groupBy("node", "f").agg(F.max(F.struct("gain", (-F.col("v")).alias("place"), "nl", "pl")).alias("b")).collect()
        coming = []
        for i in fresh:
            options = sorted((r for r in best if r.node == i), key=lambda r: (-r.b.gain, r.f))
            if options and options[0].b.gain > 1e-9:
                r, node = options[0], nodes[i]
                node.feature, node.threshold, node.gain = features[r.f], -r.b.place + 0.0, r.b.gain
                nodes[2 * i + 1], nodes[2 * i + 2] = Node(r.b.nl, r.b.pl), Node(node.n - r.b.nl, node.pos - r.b.pl)
                coming += [2 * i + 1, 2 * i + 2]
        fresh = coming
    return nodes


def table(nodes: dict[int, Node], spark: SparkSession) -> DataFrame:
    """``node, feature, threshold, n, pos``; feature and threshold null in leaves."""
    return spark.createDataFrame([(i, x.feature, x.threshold, x.n, x.pos) for i, x in sorted(nodes.items())],
                                 "node int, feature string, threshold double, n long, pos long")


def score(nodes: dict[int, Node], df: DataFrame, keep: Sequence[str] = ("user_id", "product_id")) -> DataFrame:
    """The share of positives in each row's leaf."""
    share = F.create_map(*[F.lit(x) for i, node in nodes.items() for x in (i, node.pos / max(node.n, 1))])
    return df.select(*keep, share[node_expression(nodes)].alias("score"))
