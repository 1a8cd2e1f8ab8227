"""The forest without a depth limit: pure or inseparable leaves, top levels by Spark, no dependence on partitions."""
import math
import random

from pyspark.sql import functions as F

from cartflow.operators import deep_forest as D

NAMES = ["a", "b", "c"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "user_id long, product_id long, a double, b double, c int, reordered int").repartition(parts)


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 30) / 4, rng.choice([None, math.nan, 0.0, -0.0, *map(float, range(9))]), rng.randint(0, 3)
        rows.append((i, i % 7, a, b, c, int(rng.random() < (0.2 + 0.1 * c))))
    return rows


def scores(model, df):
    return {r.user_id: r.score for r in D.score(model, df).collect()}


def test_one_tree_gives_each_distinct_row_its_share(spark):
    rows = made(3000)
    rows += [(10_000 + i, 0, 1.0, 1.0, 1, i % 3 == 0) for i in range(1500)]  # a third of the rows are the same
    rows = [(*r[:5], int(r[5])) for r in rows]
    of = {}
    value = lambda x: math.inf if x is None or math.isnan(x) else x + 0.0
    for _, _, a, b, c, y in rows:
        of.setdefault((a, value(b), c), []).append(y)
    want = {r[0]: sum(of[r[2], value(r[3]), r[4]]) / len(of[r[2], value(r[3]), r[4]]) for r in rows}
    for task_rows in (100_000, 150, 1):  # whole tree in a task; top levels by Spark; all levels by Spark
        model = D.fit(frame(spark, rows), D.Growth(trees=1, bootstrap=False, task_rows=task_rows), NAMES)
        assert (len(model.top.feature) > 1) == (task_rows < 100_000)
        assert scores(model, frame(spark, rows)) == want
        leaves = model.subtrees.where("feature < 0").count() + sum(f < 0 and not p for f, p in zip(model.top.feature, model.top.part))
        assert leaves <= len(of)


def test_exclusive_or_is_split_though_no_cut_gains(spark):
    rows = [(i, 0, float(i & 1), float(i >> 1 & 1), 0, (i & 1) ^ (i >> 1 & 1)) for i in range(4)]
    for task_rows in (10, 1):
        model = D.fit(frame(spark, rows), D.Growth(trees=1, bootstrap=False, task_rows=task_rows), NAMES)
        assert scores(model, frame(spark, rows)) == {r[0]: float(r[5]) for r in rows}


def test_forest_is_the_same_at_any_partitioning_and_finds_a_signal(spark, monkeypatch):
    rows = [(*r[:5], int(r[2] > 4)) for r in made(1200)]
    growth = D.Growth(trees=5, task_rows=200)
    train, test = rows[:800], rows[800:]
    first = scores(D.fit(frame(spark, train), growth, NAMES), frame(spark, test))
    monkeypatch.setattr(D, "SCORED_ROWS", 20)  # a subtree that many rows reach comes several times
    assert scores(D.fit(frame(spark, train, 7), growth, NAMES), frame(spark, test, 5)) == first
    assert sum((first[r[0]] >= 0.5) == (r[5] == 1) for r in test) > 0.95 * len(test)
    assert len(first) == len(test) and all(0 <= s <= 1 for s in first.values())


def test_empty_tables(spark):
    none = frame(spark, []).where(F.lit(False))
    model = D.fit(none, D.Growth(trees=2), NAMES)
    assert scores(model, none) == {} and set(scores(model, frame(spark, made(5))).values()) == {None}


def test_rows_with_equal_features_go_down_the_trees_once(spark, monkeypatch):
    rows = [(i, 0, float(i % 5), [None, math.nan, 1.0][i % 3], i % 2, int(i % 5 > 2)) for i in range(600)]  # 20 vectors: null and NaN are one value
    rows += [(7, 0, 4.0, 1.0, 0, 0), (None, None, 4.0, 1.0, 0, 1), (None, None, 0.0, 1.0, 0, 0)]  # keys that come again, null keys
    model = D.fit(frame(spark, [(*r[:5], int(r[2] > 2)) for r in made(300)]), D.Growth(trees=4, task_rows=50), NAMES)
    df = frame(spark, rows)
    kind, walked = type(df), []
    plain = kind.mapInPandas

    def counted(self, *args, **more):
        walked.append(self.count())
        return plain(self, *args, **more)

    monkeypatch.setattr(kind, "mapInPandas", counted)
    got = {(r.user_id, r.product_id): r.score for r in D.score(model, df).collect()}
    assert walked == [20 * 4]
    monkeypatch.undo()
    assert len(got) == 601
    again = [r for r in rows if r[0] in (None, 7)]
    alone = scores(model, frame(spark, [(i, 0, *r[2:]) for i, r in enumerate(again)]))
    for key in ((7, 0), (None, None)):  # rows of one key are one row with the mean of their scores
        of = [alone[i] for i, r in enumerate(again) if r[:2] == key]
        assert len(of) == 2 and abs(got[key] - sum(of) / 2) < 1e-12
