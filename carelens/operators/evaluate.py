"""Model evaluation over a long predictions table.

Input rows: (model, label, score[, prediction]). Every metric is an aggregate;
curve metrics first group rows by (model, score) so each distinct score is one
row, then take running true/false positive counts with ``ordered_scan``
(slices at fixed bounds, no single-task window).

Definitions (binary labels 0/1, predicted class = score > threshold):
* ROC AUC: trapezoid area over all distinct thresholds (ties count half).
* average precision: sum over distinct thresholds of (recall step) x precision.
* ROC points: collinear interior points dropped, a (0, 0) point first.
* PR points: one per distinct threshold, then (recall 0, precision 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators.windows import ordered_scan


def with_prediction(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) > threshold).cast("int"))


def confusion(df: DataFrame, group: str = "model", label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(group).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def score_counts(df: DataFrame, group: str = "model", label: str = "label", score: str = "score",
                 prediction: str | None = None) -> DataFrame:
    """One row per (group, distinct score): positives and negatives at that score,
    and with ``prediction`` the confusion counts too."""
    y = F.col(label)
    aggs = [F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")]
    if prediction:
        p = F.col(prediction)
        aggs += [F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp")]
    return df.groupBy(group, score).agg(*aggs)


def _running(counts: DataFrame, group: str, score: str, with_next: bool = False) -> DataFrame:
    """``counts`` (checkpointed) with tps/fps at or above each score and the class totals."""
    leads = {"next_pos": "pos", "next_neg": "neg"} if with_next else None
    run = ordered_scan(counts.select(group, score, "pos", "neg"), [group], score, sums={"tps": "pos", "fps": "neg"},
                       leads=leads, checkpointed=True)
    totals = counts.groupBy(group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return run.join(totals, on=group, how="left")


def running_counts(df: DataFrame, group: str = "model", label: str = "label", score: str = "score",
                   with_next: bool = False) -> DataFrame:
    """Per distinct score in descending order: tps/fps at or above it, class totals.
    The predictions are read once, for the counts."""
    return _running(score_counts(df, group, label, score).checkpoint(), group, score, with_next)


def _auc(run: DataFrame, group: str, fallback: float | None) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2.0))
    auc = run.groupBy(group).agg(F.try_divide(area, F.first("P") * F.first("N")).alias("roc_auc"))
    if fallback is not None:
        auc = auc.withColumn("roc_auc", F.coalesce(F.col("roc_auc"), F.lit(fallback)))
    return auc


def roc_auc(df: DataFrame, group: str = "model", label: str = "label", score: str = "score",
            fallback: float | None = 0.5) -> DataFrame:
    """Trapezoidal ROC AUC per group; NULL (or ``fallback``) with a single class."""
    return _auc(running_counts(df, group, label, score), group, fallback)


def average_precision(df: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    run = running_counts(df, group, label, score)
    step = F.try_divide(F.col("pos"), F.col("P")) * F.try_divide(F.col("tps"), F.col("tps") + F.col("fps"))
    return run.groupBy(group).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def roc_points(df: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """ROC curve points (fpr, tpr, threshold) with collinear interior points dropped."""
    run = running_counts(df, group, label, score, with_next=True)
    # Second differences of the running counts are the changes between this
    # score's counts and the next one's; the first and last points always stay.
    w_first = F.col("tps") == F.col("pos")
    first = w_first & (F.col("fps") == F.col("neg"))
    last = F.col("next_pos").isNull()
    keep = first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = run.filter(keep).select(
        group, F.col(score).alias("threshold"),
        F.try_divide(F.col("fps"), F.col("N")).alias("fpr"), F.try_divide(F.col("tps"), F.col("P")).alias("tpr"))
    origin = (run.groupBy(group).agg(F.first("P").alias("P"))
                .select(group, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr")))
    return pts.unionByName(origin)


def pr_points(df: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """Precision-recall points per distinct threshold plus the (recall 0, precision 1) end."""
    run = running_counts(df, group, label, score)
    precision = F.coalesce(F.try_divide(F.col("tps"), F.col("tps") + F.col("fps")), F.lit(0.0))
    recall = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("tps"), F.col("P")))
    pts = run.select(group, F.col(score).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    end = (run.select(group).distinct()
             .select(group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                     F.lit(0.0).alias("recall")))
    return pts.unionByName(end)


def model_metrics(df: DataFrame, group: str = "model", label: str = "label", score: str = "score",
                  prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division) and ROC AUC, as %."""
    counts = score_counts(df, group, label, score, prediction).checkpoint()
    cm = counts.groupBy(group).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    acc = F.try_divide(tp + tn, tp + tn + fp + fn)
    m = cm.select(group, (acc * 100).alias("accuracy_pct"), (prec * 100).alias("precision_pct"),
                  (rec * 100).alias("recall_pct"), (f1 * 100).alias("f1_pct"))
    auc = _auc(_running(counts, group, score), group, 0.5)
    return m.join(auc.select(group, (F.col("roc_auc") * 100).alias("roc_auc_pct")), on=group, how="left")


def model_rank(group: str = "model", order: list[str] = C.MODEL_ORDER):
    expr = None
    for i, name in enumerate(order):
        is_it = F.col(group).isin(name, C.MODEL_ALIASES.get(name, name))
        expr = F.when(is_it, F.lit(i)) if expr is None else expr.when(is_it, F.lit(i))
    return expr.otherwise(F.lit(len(order)))


def best_model(metrics: DataFrame, metric: str = "roc_auc_pct", group: str = "model",
               order: list[str] = C.MODEL_ORDER) -> DataFrame:
    """The model with the highest ``metric``; ties go to the earlier model in ``order``."""
    return (metrics.orderBy(F.col(metric).desc_nulls_last(), model_rank(group, order))
                   .limit(1).select(F.col(group).alias("best_model"), F.col(metric).alias("value")))


def best_per_metric(metrics: DataFrame, metrics_cols=("accuracy_pct", "f1_pct", "roc_auc_pct"),
                    group: str = "model", order: list[str] = C.MODEL_ORDER) -> DataFrame:
    stacked = ", ".join(f"'{m}', {m}" for m in metrics_cols)
    long = metrics.select(group, model_rank(group, order).alias("__rank"),
                          F.expr(f"stack({len(metrics_cols)}, {stacked}) AS (metric, value)"))
    # At most (models x metrics) rows reach this window.
    w = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), F.col("__rank"))
    return (long.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1)
                .select("metric", F.col(group).alias("best_model"), "value"))


def score_histogram(df: DataFrame, group_cols: list[str], score: str = "score",
                    bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per group over the group's own [min, max]; the max
    falls in the last bin; a constant group lands in the middle bin. Without
    ``group_cols`` one histogram over all rows."""
    if not group_cols:
        one = df.withColumn("__all", F.lit(0))
        return score_histogram(one, ["__all"], score, bins).drop("__all")
    rng = df.groupBy(*group_cols).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    j = df.join(rng, on=group_cols, how="inner")
    lo, hi, x = F.col("lo"), F.col("hi"), F.col(score)
    b = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins) + 1, F.lit(bins))) \
         .otherwise(F.lit(bins // 2 + 1))
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0) / bins)
    start = F.when(hi > lo, lo).otherwise(lo - 0.5)
    binned = j.withColumn("bin", b.cast("int")).withColumn("bin_start", start + (F.col("bin") - 1) * width)
    return binned.groupBy(*group_cols, "bin", "bin_start").agg(F.count(F.lit(1)).alias("n"))
