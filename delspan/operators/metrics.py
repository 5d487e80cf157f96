"""Classification metrics as aggregates; every function takes ``by``, columns to report for separately (such as an epoch).

Curves are built from one row for each threshold. Their running totals are two-level: within ranges of the threshold, then over the ranges,
so no task holds a whole curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 64


def _pairs(rows: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p)).alias(f"n{y}{p}")
    return _pairs(rows, by, *(cell(y, p) for y in (0, 1) for p in (0, 1)))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``label, pred, n``: all four cells, zero ones too."""
    by = by or []
    cells = F.array(*(F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(f"n{y}{p}").alias("n")) for y in (0, 1) for p in (0, 1)))
    return _cells(rows, by).select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def class_report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``label, precision, recall, f1, support``; what has no denominator is 0."""
    by = by or []
    cells = _cells(rows, by)

    def one(y: int) -> Column:
        hit, missed, wrong = F.col(f"n{y}{y}"), F.col(f"n{y}{1 - y}"), F.col(f"n{1 - y}{y}")
        return F.struct(F.lit(y).alias("label"), _ratio(hit, hit + wrong).alias("precision"), _ratio(hit, hit + missed).alias("recall"), _ratio(2 * hit, 2 * hit + missed + wrong).alias("f1"), (hit + missed).alias("support"), (hit + missed + wrong).alias("seen"))

    return cells.select(*by, F.explode(F.array(one(0), one(1))).alias("r")).select(*by, "r.*")


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``weighted_f1, macro_f1, balanced_accuracy, accuracy`` (percent). Macro: over labels in truth or prediction; balanced: labels in the truth."""
    by = by or []
    report = class_report(rows, by)
    there = lambda c, cond: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))
    f = _pairs(report, by, _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), there("f1", F.col("seen") > 0).alias("macro_f1"), there("recall", F.col("support") > 0).alias("balanced_accuracy"), (_ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")) * 100).alias("accuracy"))
    return f


def _curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """``prob, tp, fp, p, n``: counts at or above each distinct probability, and totals.

    Thresholds are dealt to ``SLICES`` ranges by approximate quantiles of all scores, so ranges hold about as many whatever the scores are like.
    """
    points = rows.groupBy(*by, "prob").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count("*").alias("all"))
    marks = [F.lit(k / SLICES) for k in range(1, SLICES)]
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx("prob", F.array(*marks), F.lit(100 * SLICES)))).alias("cuts"))  # one row
    points = points.join(F.broadcast(cuts)).withColumn("slice", F.size(F.filter("cuts", lambda c: c <= F.col("prob")))).drop("cuts")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    slices = points.groupBy(*by, "slice").agg(F.sum("pos").alias("sp"), F.sum("all").alias("sa"))
    above = whole.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*by, "slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("sa").over(above), F.lit(0)).alias("ba"), F.sum("sp").over(whole).alias("p"), F.sum("sa").over(whole).alias("t"))
    within = Window.partitionBy(*by, "slice").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumn("tp", F.sum("pos").over(within)).withColumn("at", F.sum("all").over(within)).join(slices, [*by, "slice"])
    tp, seen = F.col("tp") + F.col("bp"), F.col("at") + F.col("ba")
    return out.select(*by, "slice", "prob", "pos", "all", tp.alias("tp"), (seen - tp).alias("fp"), F.col("p"), (F.col("t") - F.col("p")).alias("n"))


def roc_curve(rows: DataFrame, by: list[str] | None = None, drop_intermediate: bool = True) -> DataFrame:
    """``prob, fpr, tpr`` of the curve as it is plotted: from (null, 0, 0) through the distinct thresholds from the greatest down.

    ``drop_intermediate``: points that lie on a straight line between their neighbours, the next threshold adding the same counts, are left out. Each slice of
    thresholds learns its next one from the first of the slice after it.
    """
    by = by or []
    points = _curve(rows, by)
    if drop_intermediate:
        own = F.struct("pos", "all")
        heads = points.groupBy(*by, "slice").agg(F.max_by(own, "prob").alias("head"))
        order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("slice"))
        heads = heads.select(*by, "slice", F.lead("head").over(order).alias("head"))
        points = points.join(heads, [*by, "slice"])
        after = F.coalesce(F.lead(own).over(Window.partitionBy(*by, "slice").orderBy(F.desc("prob"))), "head")
        first = F.col("tp") + F.col("fp") == F.col("all")
        points = points.withColumn("after", after).where(first | F.col("after").isNull() | (F.col("after") != own))
    points = points.select(*by, "prob", _ratio(F.col("fp"), F.col("n")).alias("fpr"), _ratio(F.col("tp"), F.col("p")).alias("tpr"))
    return points.unionByName(_end_point(rows, by, fpr=0.0, tpr=0.0))


def _end_point(rows: DataFrame, by: list[str], **values: float) -> DataFrame:
    """One row for each group, without a threshold."""
    groups = rows.select(*by).distinct() if by else rows.groupBy().agg(F.count("*").alias("x")).drop("x")
    return groups.select(*by, F.lit(None).cast("double").alias("prob"), *(F.lit(v).alias(c) for c, v in values.items()))


def precision_recall_curve(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``prob, precision, recall`` at each distinct threshold, and the final point (null, 1, 0)."""
    by = by or []
    points = _curve(rows, by).select(*by, "prob", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"))
    return points.unionByName(_end_point(rows, by, precision=1.0, recall=0.0))


def ranking_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``roc_auc`` (trapezoids; equal probabilities share a rank) and ``average_precision``.

    Both sum, over distinct thresholds, terms of a point's own counts and the totals above it, so no step looks across rows.
    """
    by = by or []
    rows = rows.withColumn("label", F.col("label").cast("bigint"))
    own = rows.groupBy(*by, "prob").agg(F.sum("label").alias("dp"), F.count("*").alias("dt"))
    points = _curve(rows, by).join(own, [*by, "prob"])
    dp, df = F.col("dp"), F.col("dt") - F.col("dp")
    area = F.sum((df * (2 * F.col("tp") - dp)).cast("double"))
    ap = F.sum(dp * F.col("tp") / (F.col("tp") + F.col("fp")))
    return _pairs(points, by, _ratio(area, 2.0 * F.max("p") * F.max("n")).alias("roc_auc"), _ratio(ap, F.max("p").cast("double")).alias("average_precision"))


def weighted_log_loss(rows: DataFrame, weights: DataFrame, by: list[str] | None = None, least: float = 1e-12) -> DataFrame:
    """``loss``: the mean of -ln p(label), weighed by class (label, weight)."""
    by = by or []
    p = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    both = rows.join(F.broadcast(weights.select("label", "weight")), "label")  # two rows
    return _pairs(both, by, (F.sum(F.col("weight") * -F.log(F.greatest(p, F.lit(least)))) / F.sum("weight")).alias("loss"))


def history(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Metrics of each epoch."""
    by = ["epoch"]
    return summary(rows, by).join(ranking_scores(rows, by), by).join(weighted_log_loss(rows, weights, by), by)


def best_epoch(history: DataFrame, score: str = "weighted_f1") -> DataFrame:
    """The first epoch with the greatest score above 0."""
    return history.where(F.col(score) > 0).orderBy(F.desc(score), "epoch").limit(1).select("epoch", score)


def saved_epochs(history: DataFrame, score: str = "weighted_f1") -> DataFrame:
    """Epochs that beat all earlier ones (one row an epoch)."""
    before = F.max(score).over(Window.partitionBy(F.lit(0)).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col(score) > F.col("before")).select("epoch", score)
