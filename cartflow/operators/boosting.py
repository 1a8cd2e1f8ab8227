"""Second-order gradient boosting, and its grid search with shared passes.

Features are cut into bins once (all distinct values where they are few, else
quantiles); the binned rows are kept in the shared folder, many rows a record.
A tree that may use few features grows in one pass: tasks add up first and
second derivatives of the logistic loss by cell (a combination of bins of its
features), and one task a model grows the tree on the sums, which hold all that
any of its levels needs.  A tree with more than ``CELLS`` cells grows level by
level: in one pass, tasks add up the derivatives by (model, node, feature, bin),
Spark sums them and finds each feature's best cut from prefix sums, and the
driver sees one row per model, node and feature.  Both give the same tree.  So
every model of a grid and every fold grows in the same passes; their number is
rounds, or rounds times depth, whatever the grid.

Gain, leaf and regularisation are the usual second-order ones: a split gains
``(GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)) / 2 - gamma`` and needs
``least_weight`` of second derivatives on either side, a leaf is
``-step * G / (H + l2)``.  A share of the features is drawn per tree (rounded
down, one at least), a share of the rows per round by a hash of the row's keys.
Missing values (null, NaN) go to the side that gains more.

Derivatives are added up as integers (2^-24 steps), so trees don't depend on
partitions or on the order of rows.  Equal gains go to the first feature, then
the lowest cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import FEATURES

UNIT = float(1 << 24)
LEAST_GAIN = 1e-6
NO_FOLD = -1
#: Rows of a record of binned rows.
CHUNK = 1 << 16
#: Binned rows of a task, at least and at most: each task sends sums, so more tasks than cores need cost as much as rows.
LEAST_ROWS, MOST_ROWS = 50_000, 2_000_000
#: Most cells that tasks add up for a tree.
CELLS = 1 << 17
#: Cells of finished trees that a task looks leaf values up in; rows walk down any further trees.
LOOKED_UP = 1 << 23


@dataclass(frozen=True)
class Boosting:
    rounds: int = 10
    depth: int = 5
    step: float = 0.3
    feature_share: float = 0.4
    row_share: float = 0.75
    l2: float = 1.0
    gamma: float = 0.0
    least_weight: float = 1.0
    bins: int = 256
    seed: int = 42

    def features_of(self, tree: int, n: int) -> np.ndarray:
        """The features that a tree may use."""
        return np.sort(np.random.default_rng([self.seed, tree]).choice(n, max(1, int(self.feature_share * n + 1e-9)), replace=False))


@dataclass
class Tree:
    """Nodes by number: ``feature`` -1 in leaves; a row goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float, weight: float) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, value),
                          (self.gain, 0.0), (self.weight, weight)):
            column.append(v)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature), np.array(self.cut), np.array(self.missing_left), np.array(self.left), np.array(self.right),
                np.array(self.value))


def node_of(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The leaf (or node that isn't split yet) of every row of binned features; bin 0 is missing."""
    feature, cut, missing_left, left, right, _ = tree
    n, k = bins.shape
    node, inner, own = np.zeros(n, np.int64), feature >= 0, np.arange(len(feature))
    # where a node's rows go: right, left; those of other nodes stay
    child = np.stack([np.where(inner, right, own), np.where(inner, left, own)], 1).ravel()
    tested, first, flat = np.maximum(feature, 0), np.arange(n) * k, bins.ravel()
    while inner.take(node).any():
        b = flat.take(first + tested.take(node))
        node = child.take(2 * node + np.where(b == 0, missing_left.take(node), b <= cut.take(node)))
    return node


def margins(trees: Sequence[tuple[np.ndarray, ...]], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins))
    for tree in trees:
        out += tree[5][node_of(tree, bins)]
    return out


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def sampled(row_hash: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Rows of a round: a mixed hash of the row's own under the share."""
    with np.errstate(over="ignore"):
        x = row_hash.view(np.uint64) + np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) < share


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of raw feature columns: 0 for NaN, else 1 + the number of cuts at or under the value."""
    out = np.empty((len(values), len(cuts)), np.int16)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(values[:, j]), 0, 1 + np.searchsorted(c, values[:, j], "right"))
    return out


@dataclass(frozen=True)
class Cells:
    """The combinations of bins of a tree's features, by number."""

    features: tuple[int, ...]
    widths: tuple[int, ...]

    @property
    def number(self) -> int:
        return prod(self.widths)

    def of(self, bins: np.ndarray) -> np.ndarray:
        """The cell of every row of binned features."""
        out = np.zeros(len(bins), np.int64)
        for f, w in zip(self.features, self.widths):
            out *= w
            out += bins[:, f]
        return out

    def bins(self, at: np.ndarray) -> np.ndarray:
        """Rows of binned features in the given cells; other features are 0."""
        out = np.zeros((len(at), max(self.features) + 1), np.int16)
        for f, w in zip(self.features[::-1], self.widths[::-1]):
            at, out[:, f] = np.divmod(at, w)
        return out


@dataclass(frozen=True)
class Grown:
    """A finished tree for tasks: its nodes, and the leaf of every cell where these are few."""

    nodes: tuple[np.ndarray, ...]
    cells: Cells | None = None
    leaf: np.ndarray | None = None

    @classmethod
    def made(cls, tree: Tree, cells: Cells) -> Grown:
        nodes = tree.arrays()
        if cells.number > CELLS:
            return cls(nodes)
        return cls(nodes, cells, node_of(nodes, cells.bins(np.arange(cells.number))).astype(np.int32))


class Tables:
    """Finished trees of models in a task: leaf values by cell, for as many trees as ``LOOKED_UP`` allows."""

    def __init__(self, models: dict[int, Sequence[Grown]]) -> None:
        self.trees: dict[int, list] = {}
        left = LOOKED_UP
        for m, trees in models.items():
            self.trees[m] = []
            for tree in trees:
                left -= tree.cells.number if tree.cells else 0
                self.trees[m].append((tree, tree.nodes[5].take(tree.leaf) if tree.cells and left >= 0 else None))

    def margins(self, m: int, rows: Rows) -> np.ndarray:
        """As :func:`margins`."""
        out = np.zeros(len(rows.bins))
        for tree, values in self.trees[m]:
            out += tree.nodes[5][node_of(tree.nodes, rows.bins)] if values is None else values.take(rows.cells(tree.cells))
        return out


class Rows:
    """Binned features of some rows, with their cells, which models share."""

    def __init__(self, bins: np.ndarray) -> None:
        self.bins, self._cells = bins, {}

    def cells(self, cells: Cells) -> np.ndarray:
        if cells not in self._cells:
            self._cells[cells] = cells.of(self.bins)
        return self._cells[cells]


@dataclass
class BoostedModel:
    params: Boosting
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def probability(self, values: np.ndarray) -> np.ndarray:
        return logistic(margins([t.arrays() for t in self.trees], binned(values, self.cuts)))

    def grown(self) -> list[Grown]:
        """The trees for tasks."""
        widths = [len(c) + 2 for c in self.cuts]
        drawn = [self.params.features_of(t, len(self.features)) for t in range(len(self.trees))]
        return [Grown.made(tree, Cells(tuple(map(int, fs)), tuple(widths[f] for f in fs))) for tree, fs in zip(self.trees, drawn)]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row a node: tree, node, feature and threshold (null in leaves; values under it go left), children, value, gain, weight."""
        rows = []
        for t, tree in enumerate(self.trees):
            for i, f in enumerate(tree.feature):
                inner = f >= 0
                at = float(self.cuts[f][tree.cut[i] - 1]) if inner and tree.cut[i] <= len(self.cuts[f]) else None
                rows.append((t, i, self.features[f] if inner else None, at, bool(tree.missing_left[i]) if inner else None, tree.left[i] if inner else None,
                             tree.right[i] if inner else None, float(tree.value[i]), float(tree.gain[i]), float(tree.weight[i])))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, left int, right int, "
                                           "value double, gain double, weight double")


def feature_cuts(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cut points of every feature: between all neighbouring values where there are at most ``bins``, else at quantiles."""
    cols = [F.col(f).cast("double") for f in features]
    about = train.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(features)) if about[f"n{i}"] <= bins // 2]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:  # features times bins rows
        each = train.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cols[i].alias("v")) for i in few])).alias("s")).select("s.*").distinct()
        for r in each.where(F.col("v").isNotNull() & ~F.isnan("v")).collect():
            values[r.i].append(r.v)
    many = [i for i in range(len(features)) if i not in few]
    if many:
        at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        found = train.agg(*[F.percentile_approx(F.when(~F.isnan(cols[i]), cols[i]), at, F.lit(50_000)).alias(f"q{i}") for i in many]).first()
    out = []
    for i in range(len(features)):
        if i in values:
            v = np.sort(np.array(values[i], float))
            out.append((v[1:] + v[:-1]) / 2)
        else:
            out.append(np.unique(np.array(found[f"q{i}"] or [], float)))
    return out


def binned_rows(train: DataFrame, features: Sequence[str], cuts: list[np.ndarray], label: str, keys: Sequence[str], fold: str | None) -> DataFrame:
    """Records of up to ``CHUNK`` rows, kept in the shared folder: ``h`` (hash of the keys), ``fold``, ``y`` and ``bins`` of the features as plain arrays."""
    k = len(features)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*parts)], ["h", "fold", "y", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(3 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)], 1)
            # rows without a fold (keys that are null) are in none: every model learns from them
            held.append((batch.column(0).to_numpy(), batch.column(1).fill_null(NO_FOLD).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(float),
                         binned(values, cuts)))
            if sum(len(h) for h, *_ in held) + batch.num_rows > CHUNK:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    rows = train.select(F.xxhash64(*keys), F.col(fold).cast("int") if fold else F.lit(NO_FOLD), F.col(label).cast("double"),
                        *[F.col(f).cast("double") for f in features])
    n = train.count()
    parts = max(1, -(-n // MOST_ROWS), min(-(-n // LEAST_ROWS), 2 * train.sparkSession.sparkContext.defaultParallelism))
    return rows.coalesce(parts).mapInArrow(run, "h binary, fold binary, y binary, bins binary").checkpoint(eager=True)


def chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, fold, label and bins of each record's rows."""
    for batch in batches:
        for record in zip(*batch.columns):
            h, fold, y, bins = (np.frombuffer(c.as_buffer(), t) for c, t in zip(record, (np.int64, np.int32, np.float64, np.int16)))
            yield h, fold, y, bins.reshape(-1, k)


def learning(h: np.ndarray, fold: np.ndarray, params: Boosting, round_: int, without: int | None) -> np.ndarray:
    """Which rows a model learns from in a round."""
    use = sampled(h, params.seed, round_, params.row_share)
    return use if without is None else use & (fold != without)


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, in units."""
    p = logistic(margin)
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


@dataclass
class Growing:
    """What tasks need of a model: its trees so far, the one that grows, the nodes to split and the features they may use."""

    params: Boosting
    without_fold: int | None
    trees: list[Grown] = field(default_factory=list)
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    features: np.ndarray | None = None
    cells: Cells | None = None


def sums(rows: DataFrame, growing: dict[int, Growing], round_: int, width: int, k: int) -> DataFrame:
    """``model, node, feature, bin, g, h``: partial sums of each task over its rows."""
    trees = {m: s.trees for m, s in growing.items()}
    work = [(m, s.params, s.without_fold, s.tree.arrays(), np.array(s.open), s.features) for m, s in growing.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(trees)
        total = {m: np.zeros((2, len(open_) * len(features) * width)) for m, *_, open_, features in work}
        for h, fold, y, bins in chunks(batches, k):
            for m, params, without, tree, open_, features in work:
                use = learning(h, fold, params, round_, without)
                x = bins[use]
                node = node_of(tree, x)
                slot = np.minimum(np.searchsorted(open_, node), len(open_) - 1)
                here = open_[slot] == node
                x, slot = x[here], slot[here]
                g, w = derivatives(tables.margins(m, Rows(x)), y[use][here])
                for j, f in enumerate(features):
                    key = (slot * len(features) + j) * width + x[:, f]
                    total[m][0] += np.bincount(key, g, total[m].shape[1])
                    total[m][1] += np.bincount(key, w, total[m].shape[1])
        for m, *_, open_, features in work:
            at = np.flatnonzero(total[m].any(0))
            cell, b = np.divmod(at, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), m, np.int32)), pa.array(open_[cell // len(features)].astype(np.int32)),
                 pa.array(features[cell % len(features)].astype(np.int32)), pa.array(b.astype(np.int32)),
                 pa.array(total[m][0, at].astype(np.int64)), pa.array(total[m][1, at].astype(np.int64))], ["model", "node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, "model int, node int, feature int, bin int, g long, h long")


def cell_sums(rows: DataFrame, growing: dict[int, Growing], round_: int, k: int) -> DataFrame:
    """``model, at, g, h``: partial sums of each task by cell of the model's features; the cells that have rows, and their sums, as plain arrays."""
    trees = {m: s.trees for m, s in growing.items()}
    cells = {m: s.cells for m, s in growing.items()}
    # models that learn from the same rows share them
    work: dict[tuple, list[int]] = {}
    for m, s in growing.items():
        work.setdefault((s.params.seed, s.params.row_share, s.without_fold), []).append(m)
    same_rows = [(growing[models[0]].params, without, models) for (*_, without), models in work.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(trees)
        total = {m: np.zeros((2, c.number)) for m, c in cells.items()}
        for h, fold, y, bins in chunks(batches, k):
            for params, without, models in same_rows:
                use = np.flatnonzero(learning(h, fold, params, round_, without))
                x, y_ = Rows(bins.take(use, 0)), y.take(use)
                for m in models:
                    g, w = derivatives(tables.margins(m, x), y_)
                    total[m][0] += np.bincount(x.cells(cells[m]), g, cells[m].number)
                    total[m][1] += np.bincount(x.cells(cells[m]), w, cells[m].number)
        for m in cells:
            at = np.flatnonzero(total[m].any(0))
            made = [at.astype(np.int32), *total[m][:, at].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in made]], ["model", "at", "g", "h"])

    return rows.mapInArrow(run, "model int, at binary, g binary, h binary")


def trees_of(partial: DataFrame, growing: dict[int, Growing]) -> dict[int, Tree]:
    """The tree of every model from partial sums by cell, grown by one task a model."""
    jobs = {m: (s.params, s.cells) for m, s in growing.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, *record in zip(*batch.columns):
                if (m := m.as_py()) not in total:
                    total[m] = np.zeros((2, jobs[m][1].number), np.int64)
                at, g, h = (np.frombuffer(c.as_buffer(), t) for c, t in zip(record, (np.int32, np.int64, np.int64)))
                total[m][0, at] += g
                total[m][1, at] += h
        for m, (g, h) in total.items():
            tree = vars(tree_of_cells(*jobs[m], g, h))
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *[pa.array([tree[c]], pa.list_(t)) for c, t in columns.items()]], ["model", *columns])

    whole, real = pa.int32(), pa.float64()
    columns = {"feature": whole, "cut": whole, "missing_left": pa.bool_(), "left": whole, "right": whole, "value": real, "gain": real, "weight": real}
    schema = ", ".join(["model int", *[f"`{c}` array<{'int' if t == whole else 'double' if t == real else 'boolean'}>" for c, t in columns.items()]])
    found = partial.repartition(len(growing), "model").mapInArrow(run, schema).collect()
    return {r.model: Tree(*[list(r[c]) for c in columns]) for r in found}


class Cut(NamedTuple):
    gain: float
    place: int
    missing_left: bool
    gl: float
    hl: float


class Option(NamedTuple):
    """A node's sums, and a feature's best cut of it."""

    feature: int
    all_g: float
    all_h: float
    best: Cut | None


def tree_of_cells(params: Boosting, cells: Cells, g: np.ndarray, h: np.ndarray) -> Tree:
    """The tree that :func:`grow` makes level by level, from sums by cell."""
    at = np.flatnonzero((g != 0) | (h != 0))
    x, g, h, width = cells.bins(at), g[at], h[at], max(cells.widths)
    tree, open_, level = Tree(), [0], 0
    while open_ and level < params.depth:
        node, nodes = node_of(tree.arrays(), x), np.array(open_)
        slot = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        here = nodes[slot] == node
        found: dict[int, list[Option]] = {}
        for f in cells.features:
            key = slot[here] * width + x[here, f]
            for node_at, option in best_of(f, *(added(key, v[here], len(nodes) * width).reshape(-1, width) for v in (g, h)), params):
                found.setdefault(open_[node_at], []).append(option)
        open_ = split(tree, params, open_, found)
        level += 1
    return tree


def added(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by key, exact beyond 2^53 too."""
    high, low = (np.bincount(key, part, n).astype(np.int64) for part in (values >> 24, values & (1 << 24) - 1))
    return (high << 24) + low


def best_of(feature: int, g: np.ndarray, h: np.ndarray, params: Boosting) -> Iterator[tuple[int, Option]]:
    """Every node's sums and best cut by a feature from its sums by node and bin, by the rule of :func:`cut_finder`."""
    filled = (g != 0) | (h != 0)
    all_g, all_h = g.sum(1) / UNIT, h.sum(1) / UNIT
    part = lambda g, h: g * g / (h + params.l2)
    below = [(np.cumsum(v[:, 1:], 1) / UNIT, v[:, :1] / UNIT) for v in (g, h)]
    sides = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for missing_left in (False, True):
            gl, hl = (real + none if missing_left else real for real, none in below)
            gr, hr = all_g[:, None] - gl, all_h[:, None] - hl
            gain = (part(gl, hl) + part(gr, hr) - part(all_g, all_h)[:, None]) / 2 - params.gamma
            sides.append((np.where(filled[:, 1:] & (hl >= params.least_weight) & (hr >= params.least_weight), gain, -np.inf), gl, hl))
    # a cut with equal gains on both sides of missing values sends them right
    to_left = sides[1][0] > sides[0][0]
    gain = np.where(to_left, sides[1][0], sides[0][0])
    best = gain.argmax(1) if gain.shape[1] else np.zeros(len(gain), int)
    for i in np.flatnonzero(filled.any(1)):
        b, cut = int(best[i]), None
        if gain.shape[1] and gain[i, b] > -np.inf:
            left = bool(to_left[i, b])
            cut = Cut(float(gain[i, b]), -(b + 1), left, float(sides[left][1][i, b]), float(sides[left][2][i, b]))
        yield int(i), Option(int(feature), float(all_g[i]), float(all_h[i]), cut)


def split(tree: Tree, p: Boosting, nodes: Sequence[int], found: dict[int, list]) -> list[int]:
    """Splits those of the nodes that gain, each by the best of the cuts found; returns the new nodes."""
    coming, leaf = [], lambda g, h: -p.step * g / (h + p.l2) + 0.0
    for node in nodes:
        options = sorted(found.get(node, []), key=lambda r: r.feature)
        if not options:
            continue
        if node == 0:
            tree.value[0], tree.weight[0] = leaf(options[0].all_g, options[0].all_h), options[0].all_h
        best = max((r for r in options if r.best), key=lambda r: (r.best.gain, -r.feature), default=None)
        if best is None or best.best.gain <= LEAST_GAIN:
            continue
        b = best.best
        tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = best.feature, -b.place, b.missing_left, b.gain
        tree.left[node] = tree.add(leaf(b.gl, b.hl), b.hl)
        tree.right[node] = tree.add(leaf(best.all_g - b.gl, best.all_h - b.hl), best.all_h - b.hl)
        coming += [tree.left[node], tree.right[node]]
    return coming


def cut_finder(params: Boosting) -> Callable[[DataFrame, int], DataFrame]:
    """Turns partial sums (and the number of their cells) into one row for every model, node and feature: its sums, and its
    best cut with gain, side of missing values, and sums on the left.  The expressions are made once."""
    keys = ["model", "node", "feature"]
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    real, none = F.col("bin") > 0, F.col("bin") == 0
    unit = F.lit(UNIT)
    summed = [F.sum("g").alias("g"), F.sum("h").alias("h")]
    prefix = {
        "all_g": F.sum("g").over(whole) / unit, "all_h": F.sum("h").over(whole) / unit,
        "g0": F.coalesce(F.sum(F.when(none, F.col("g"))).over(whole), F.lit(0)) / unit,
        "h0": F.coalesce(F.sum(F.when(none, F.col("h"))).over(whole), F.lit(0)) / unit,
        "gl": F.coalesce(F.sum(F.when(real, F.col("g"))).over(upto), F.lit(0)) / unit,
        "hl": F.coalesce(F.sum(F.when(real, F.col("h"))).over(upto), F.lit(0)) / unit}

    def side(missing_left: bool):
        gl = F.col("gl") + F.col("g0") if missing_left else F.col("gl")
        hl = F.col("hl") + F.col("h0") if missing_left else F.col("hl")
        part = lambda g, h: g * g / (h + params.l2)
        gr, hr = F.col("all_g") - gl, F.col("all_h") - hl
        gain = (part(gl, hl) + part(gr, hr) - part(F.col("all_g"), F.col("all_h"))) / 2 - params.gamma
        fits = real & (hl >= params.least_weight) & (hr >= params.least_weight)
        return F.when(fits, F.struct(gain.alias("gain"), (-F.col("bin")).alias("place"), F.lit(missing_left).alias("missing_left"), gl.alias("gl"), hl.alias("hl")))

    # a cut with equal gains on both sides of missing values sends them right
    left, right = side(True), side(False)
    one = F.when(left.isNull() | (right["gain"] >= left["gain"]), right).otherwise(left)
    found = [F.first("all_g").alias("all_g"), F.first("all_h").alias("all_h"), F.max(one).alias("best")]

    def best(partial: DataFrame, cells: int) -> DataFrame:
        hist = partial.repartition(max(1, cells // 20_000), *keys).groupBy(*keys, "bin").agg(*summed)
        return hist.withColumns(prefix).groupBy(*keys).agg(*found)

    return best


def grow(rows: DataFrame, jobs: Sequence[tuple[Boosting, int | None]], features: Sequence[str], cuts: list[np.ndarray]) -> list[BoostedModel]:
    """A model for each job (parameters, fold that is left out), all in the same passes over the binned rows."""
    state = {m: Growing(p, without) for m, (p, without) in enumerate(jobs)}
    made: dict[int, list[Tree]] = {m: [] for m in state}
    widths, k = [len(c) + 2 for c in cuts], len(features)
    first = jobs[0][0]
    if any((p.l2, p.gamma, p.least_weight) != (first.l2, first.gamma, first.least_weight) for p, _ in jobs):
        raise ValueError("models that grow together share l2, gamma and least_weight")
    best_cuts = cut_finder(first)
    for round_ in range(max(p.rounds for p, _ in jobs)):
        for m, s in state.items():
            s.tree, s.open = Tree(), [0] if round_ < s.params.rounds else []
            s.features = s.params.features_of(round_, k)
            s.cells = Cells(tuple(map(int, s.features)), tuple(widths[f] for f in s.features))
        if few := {m: s for m, s in state.items() if s.open and s.cells.number <= CELLS}:
            for m, tree in trees_of(cell_sums(rows, few, round_, k), few).items():
                state[m].tree = tree
            for s in few.values():
                s.open = []
        level = 0
        while now := {m: s for m, s in state.items() if s.open and level < s.params.depth}:
            cells = sum(len(s.open) * len(s.features) for s in now.values()) * max(widths)
            found: dict[int, dict[int, list]] = {}
            for r in best_cuts(sums(rows, now, round_, max(widths), k), cells).collect():
                found.setdefault(r.model, {}).setdefault(r.node, []).append(r)
            for m, s in now.items():
                s.open = split(s.tree, s.params, s.open, found.get(m, {}))
            level += 1
        for m, s in state.items():
            if round_ < s.params.rounds:
                s.trees.append(Grown.made(s.tree, s.cells))
                made[m].append(s.tree)
    return [BoostedModel(s.params, list(features), cuts, made[m]) for m, s in state.items()]


def fit(train: DataFrame, params: Boosting = Boosting(), features: Sequence[str] = FEATURES, label: str = "reordered",
        keys: Sequence[str] = ("user_id", "product_id")) -> BoostedModel:
    """M4: boosted trees on a labelled frame; ``keys`` name a row (they choose the rows of each round)."""
    cuts = feature_cuts(train, features, params.bins)
    return grow(binned_rows(train, features, cuts, label, keys, None), [(params, None)], features, cuts)[0]


def score(model: BoostedModel, df: DataFrame, threshold: float | None = None, keep: Sequence[str] = ("user_id", "product_id")) -> DataFrame:
    """M7-M10 for boosted trees: the kept columns (and label, reordered, order_id where present), score, flags at the threshold and at 0.5."""
    extra = [c for c in ("label", "reordered", "order_id") if c in df.columns and c not in keep]
    held, k = [*keep, *extra], len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(len(held) + j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)]
            found = model.probability(np.stack(values, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(held)], pa.array(found, pa.float64())], [*held, "score"])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in held], "score double"])
    out = df.select(*held, *[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(model.features)]).mapInArrow(run, schema)
    default = (F.col("score") >= 0.5).cast("int")
    return out.select(*held, "score", (default if threshold is None else (F.col("score") >= F.lit(float(threshold))).cast("int")).alias("prediction"),
                      default.alias("prediction_default"))


def split_importance(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """Number of splits of each feature, with their total gain."""
    names = spark.createDataFrame([(f,) for f in model.features], "feature string")
    counts = model.nodes(spark).where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    return (names.join(counts, "feature", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
            .orderBy(F.col("splits").desc(), "feature"))


def model_params(model: BoostedModel, spark: SparkSession) -> DataFrame:
    """M6: parameters as (param, value) rows."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(vars(model.params).items())], "param string, value string")


def grid_search(train: DataFrame, depths: Sequence[int] = (5, 10), shares: Sequence[float] = (0.3, 0.4), folds: int = 3,
                params: Boosting = Boosting(), features: Sequence[str] = FEATURES, label: str = "reordered",
                keys: Sequence[str] = ("user_id", "product_id"), fold_seed: int = 7) -> tuple[BoostedModel, DataFrame]:
    """M5 + M6: every depth and share on every fold, grown in the same passes; the best by mean accuracy is fitted on all rows.

    Returns (model, report): max_depth, feature_share, fold, accuracy on that fold, mean and standard deviation over folds, and whether
    the parameters are the best (the first of equal ones).
    """
    from .models import fold_column
    spark = train.sparkSession
    data = fold_column(train, folds, fold_seed, keys)
    cuts = feature_cuts(data, features, params.bins)
    rows = binned_rows(data, features, cuts, label, keys, "fold")
    grid = [replace(params, depth=d, feature_share=s) for d in depths for s in shares]
    jobs = [(p, k) for p in grid for k in range(folds)]
    models = grow(rows, jobs, features, cuts)
    right = held_out_hits(rows, models, jobs)
    accuracy = np.array([[right[i * folds + k][0] / max(right[i * folds + k][1], 1) for k in range(folds)] for i in range(len(grid))])
    mean, std = accuracy.mean(1), accuracy.std(1, ddof=1) if folds > 1 else np.zeros(len(grid))
    best = int(np.argmax(mean))
    report = spark.createDataFrame(
        [(p.depth, p.feature_share, k, float(accuracy[i, k]), float(mean[i]), float(std[i]), i == best) for i, p in enumerate(grid) for k in range(folds)],
        "max_depth int, feature_share double, fold int, accuracy double, mean_accuracy double, std_accuracy double, best boolean")
    return grow(rows, [(grid[best], None)], features, cuts)[0], report


def held_out_hits(rows: DataFrame, models: Sequence[BoostedModel], jobs: Sequence[tuple[Boosting, int | None]]) -> dict[int, tuple[int, int]]:
    """For every model the rows of the fold it hasn't seen that it gets right, and their number, in one pass."""
    k, trees = len(models[0].features), {m: model.grown() for m, model in enumerate(models)}
    folds: dict[int | None, list[int]] = {}
    for m, (_, fold) in enumerate(jobs):
        folds.setdefault(fold, []).append(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = Tables(trees), np.zeros((len(trees), 2), np.int64)
        for _, fold, y, bins in chunks(batches, k):
            for without, mine in folds.items():
                held = fold == without
                x, positive = Rows(bins[held]), y[held] == 1
                for m in mine:
                    hit = (logistic(tables.margins(m, x)) >= 0.5) == positive
                    total[m] += (int(hit.sum()), len(hit))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["model", "hits", "n"])

    found = rows.mapInArrow(run, "model int, hits long, n long").groupBy("model").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    return {r.model: (r.hits, r.n) for r in found}
