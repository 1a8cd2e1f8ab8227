"""Metric tables: E6 = E7, confusion cells sum to rows, report values, sweep."""

import pytest

from cartflow.operators import evaluate as E


def _df(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.7), (0, 0.3), (0, 0.3), (1, 0.2), (0, 0.1), (0, 0.1), (1, 0.6)]
    return spark.createDataFrame(data, "label int, score double")


def _auc_brute(data):
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_rank_sum_equals_trapezoid_and_brute(spark):
    df = _df(spark)
    data = [(r["label"], r["score"]) for r in df.collect()]
    a = E.roc_auc(df).first()["auc"]
    b = E.roc_auc_trapezoid(df).first()["auc"]
    assert a == pytest.approx(b, abs=1e-9)
    assert a == pytest.approx(_auc_brute(data), abs=1e-9)


def test_confusion_and_report(spark):
    df = _df(spark).selectExpr("label", "score", "CAST(score >= 0.5 AS INT) AS prediction")
    cells = {(r["label"], r["prediction"]): r["n"] for r in E.confusion_matrix(df).collect()}
    assert sum(cells.values()) == 10 and len(cells) == 4
    assert cells == {(1, 1): 4, (0, 1): 1, (1, 0): 1, (0, 0): 4}
    rep = {r["class"]: r for r in E.classification_report(df).collect()}
    assert rep["1"]["precision"] == pytest.approx(0.8) and rep["1"]["recall"] == pytest.approx(0.8)
    assert rep["accuracy"]["f1"] == pytest.approx(0.8)
    assert E.f1_binary(df).first()["f1"] == pytest.approx(0.8)
    assert E.accuracy(df).first()["accuracy"] == pytest.approx(0.8)


def test_f1_zero_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert E.f1_binary(df).first()["f1"] == 0.0


def test_threshold_sweep_matches_direct(spark):
    df = _df(spark)
    grid = [0.1, 0.25, 0.5, 0.75, 0.95]
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in E.threshold_sweep(df, grid).collect()}
    data = [(r["label"], r["score"]) for r in df.collect()]
    for t in grid:
        tp = sum(1 for y, s in data if y == 1 and s >= t)
        fp = sum(1 for y, s in data if y == 0 and s >= t)
        assert got[t] == (tp, fp)
