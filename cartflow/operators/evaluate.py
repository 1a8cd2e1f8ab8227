"""Evaluation tables: confusion counts, F1, report, accuracy, ROC, AUC, threshold sweep.

Every metric is a DataFrame built from aggregates; nothing is collected.
The ROC curve needs running totals over all scores in descending order: the
scores are first reduced to one row per distinct score (partial
aggregation), then running sums are taken with range partitioning
(:func:`cartflow.functions.ordering.running_sums`), never a window without
``partitionBy`` (which would move every row into one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running_sums, with_next


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tp, fp, fn, tn (BIGINT)."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def f1_binary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F1 of class 1; 0.0 when there is no positive prediction or label."""
    c = confusion_counts(df, label, prediction)
    return c.select(_safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                    "tp", "fp", "fn")


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows where label = prediction."""
    return df.agg(_safe_div(F.count_if(F.col(label) == F.col(prediction)), F.count(F.lit(1)))
                  .alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Four cells (label, prediction, n), zero cells included."""
    c = confusion_counts(df, label, prediction)
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(n).alias("n"))
                      for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(F.explode(cells).alias("c")).select("c.label", "c.prediction", "c.n")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision / recall / f1 / support per class, accuracy, macro and weighted averages.

    Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg``; the
    accuracy row carries the accuracy in ``f1`` and NULL precision/recall,
    as the usual printed report does.
    """
    c = confusion_counts(df, label, prediction)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1 = _safe_div(2 * p1 * r1, p1 + r1)
    f1_0 = _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = _safe_div(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
            _safe_div(f1_0 * s0 + f1_1 * s1, n), n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation first)."""
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E5 (+ W3): one ROC point per distinct score, thresholds descending.

    Columns: threshold, tp, fp (running counts of rows with score >=
    threshold), tpr, fpr.  The (0, 0) origin is implied, not a row.
    """
    counts = score_counts(df, label, score)
    cum, tot = running_sums(counts, [], [F.col("threshold").desc()],
                            {"tp": F.col("pos"), "fp": F.col("neg")}, with_totals=True)
    # Totals come from the same partition summary (two numbers on the driver).
    p_all, n_all = F.lit(tot["tp"]).cast("long"), F.lit(tot["fp"]).cast("long")
    return cum.select("threshold", "pos", "neg", "tp", "fp",
                      _safe_div(F.col("tp"), p_all).alias("tpr"),
                      _safe_div(F.col("fp"), n_all).alias("fpr"),
                      p_all.alias("_P"), n_all.alias("_N"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E5 as a drawn curve: ``threshold, fpr, tpr`` from the origin (threshold infinite) on, without points that lie
    between equal steps of both counts.

    A point stays if the next distinct score adds other numbers of positives
    or negatives than its own, or if it is the first or last one.
    """
    counts = with_next(score_counts(df, label, score), [F.col("threshold").desc()], {"_next_pos": F.col("pos"), "_next_neg": F.col("neg")})
    cum, tot = running_sums(counts, [], [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, with_totals=True)
    p_all, n_all = F.lit(tot["tp"]).cast("long"), F.lit(tot["fp"]).cast("long")
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bend = F.col("_next_pos").isNull() | (F.col("_next_pos") != F.col("pos")) | (F.col("_next_neg") != F.col("neg"))
    points = cum.where(first | bend).select("threshold", _safe_div(F.col("fp"), n_all).alias("fpr"), _safe_div(F.col("tp"), p_all).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 9) -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half."""
    pts = roc_points(df, label, score)
    # negatives strictly below this score = N - (running fp including this score)
    # (products of two totals pass the range of a long: doubles)
    term = F.col("pos").cast("double") * (F.col("_N") - F.col("fp") + 0.5 * F.col("neg"))
    return pts.agg(F.round(_safe_div(F.sum(term), F.first("_P").cast("double") * F.first("_N")), digits).alias("auc"))


def roc_auc_trapezoid(df: DataFrame, label: str = "label", score: str = "score", digits: int = 9) -> DataFrame:
    """Trapezoid rule over the ROC points (previous point = running sum minus this step)."""
    pts = roc_points(df, label, score)
    fpr_prev = _safe_div(F.col("fp") - F.col("neg"), F.col("_N"))
    tpr_prev = _safe_div(F.col("tp") - F.col("pos"), F.col("_P"))
    area = (F.col("fpr") - fpr_prev) * (F.col("tpr") + tpr_prev) / 2
    return pts.agg(F.round(F.sum(area), digits).alias("auc"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], label: str = "label",
                    score: str = "score") -> DataFrame:
    """Precision, recall, F1 for each threshold of a grid, in one pass.

    Each row is put in the bucket of the highest grid value not above its
    score; bucket counts (partial aggregation, one row per grid value) are
    summed from the top, which gives the counts at every threshold.
    """
    grid = sorted(float(t) for t in thresholds)
    bucket = sum((F.col(score) >= F.lit(t)).cast("int") for t in grid)
    counts = df.groupBy(bucket.alias("b")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    thr = F.array(*[F.lit(t) for t in grid])
    # Explode the grid into rows (bounded by its length), join bucket counts.
    g = counts.agg(F.collect_list(F.struct("b", "pos", "neg")).alias("bk"),
                   F.sum("pos").alias("P"))
    rows = g.select("bk", "P", F.posexplode(thr).alias("i", "threshold"))
    rows = rows.select(
        "threshold", "P",
        F.aggregate(F.filter("bk", lambda x: x["b"] >= F.col("i") + 1), F.lit(0).cast("long"),
                    lambda acc, x: acc + x["pos"]).alias("tp"),
        F.aggregate(F.filter("bk", lambda x: x["b"] >= F.col("i") + 1), F.lit(0).cast("long"),
                    lambda acc, x: acc + x["neg"]).alias("fp"))
    return rows.select(
        "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"),
        _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _safe_div(F.col("tp"), F.col("P")).alias("recall"),
        _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("P") - F.col("tp")).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The grid value with the highest F1 (ties: lowest threshold); a top-1 report."""
    return sweep.orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)
