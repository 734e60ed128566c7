"""Uncertainty of ROC AUC by placement values, and of the difference of two models.

The placement of a positive is the share of negatives scored below it (ties count
half), that of a negative the share of positives scored above it. The AUC is the mean
placement of the positives; its variance is the variance of both kinds of placements,
each over its number of rows. Two models scored on the same rows are compared by the
covariance of their placements.

Placements come from the running counts per distinct score (``evaluate.running_counts``,
sliced, no single-task window); a model's own variance is an aggregate of those counts,
and only the comparison of models joins them back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.evaluate import running_counts

#: Fixed value: the normal deviate of a two-sided 95 % interval.
Z95 = 1.959963984540054


def placements(df: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """(group, score, pos, neg, P, N, of_positive, of_negative): the placement of the
    positives and of the negatives at each distinct score."""
    below = F.col("N") - F.col("fps") + F.col("neg") / 2.0
    above = F.col("tps") - F.col("pos") / 2.0
    return running_counts(df, group, label, score).select(
        group, score, "pos", "neg", "P", "N", F.try_divide(below, F.col("N")).alias("of_positive"), F.try_divide(above, F.col("P")).alias("of_negative"))


def _aucs(placed: DataFrame, group: str) -> DataFrame:
    return placed.groupBy(group).agg(F.try_divide(F.sum(F.col("pos") * F.col("of_positive")), F.first("P")).alias("auc"),
                                     F.first("P").alias("n_pos"), F.first("N").alias("n_neg"))


def _variance(of_positive, of_negative):
    """From sums of squares about the mean over both kinds of rows."""
    return (F.try_divide(of_positive, (F.col("n_pos") - 1) * F.col("n_pos").cast("double"))
            + F.try_divide(of_negative, (F.col("n_neg") - 1) * F.col("n_neg").cast("double")))


def auc_intervals(df: DataFrame, group: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """(group, auc, se, low, high, n_pos, n_neg). A standard error needs two rows of each
    class, an AUC one; otherwise NULL. The interval is cut at 0 and 1."""
    placed = placements(df, group, label, score).checkpoint()
    known = placed.drop("P", "N").join(_aucs(placed, group), group)
    off = lambda c: (F.col(c) - F.col("auc")) * (F.col(c) - F.col("auc"))
    sums = known.groupBy(group, "auc", "n_pos", "n_neg").agg(F.sum(F.col("pos") * off("of_positive")).alias("sp"), F.sum(F.col("neg") * off("of_negative")).alias("sn"))
    out = sums.withColumn("se", F.sqrt(_variance(F.col("sp"), F.col("sn"))))
    return out.select(group, "auc", "se", F.when(F.col("se").isNotNull(), F.greatest(F.lit(0.0), F.col("auc") - Z95 * F.col("se"))).alias("low"),
                      F.when(F.col("se").isNotNull(), F.least(F.lit(1.0), F.col("auc") + Z95 * F.col("se"))).alias("high"), "n_pos", "n_neg")


def auc_differences(df: DataFrame, models: list[str], group: str = "model", label: str = "label", score: str = "score",
                    id_col: str = "INGRESO_ACTUAL") -> DataFrame:
    """(model_a, model_b, auc_a, auc_b, difference, se, z, distinct) for each pair of
    ``models`` in their order: whether one is better by more than its uncertainty. Rows
    are matched by ``id_col``, unique within a model; every model scores the same rows."""
    placed = placements(df, group, label, score).checkpoint()
    aucs = _aucs(placed, group)
    value = F.when(F.col(label) == 1, F.col("of_positive")).otherwise(F.col("of_negative")) - F.col("auc")
    rows = (df.select(group, id_col, label, score).join(placed.select(group, score, "of_positive", "of_negative"), [group, score])
              .join(F.broadcast(aucs), group))          # one row per model
    wide = rows.groupBy(id_col, label).agg(*(F.max(F.when(F.col(group) == m, value)).alias(f"v{i}") for i, m in enumerate(models)),
                                           F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    off = lambda i, j: (F.col(f"v{i}") - F.col(f"v{j}")) * (F.col(f"v{i}") - F.col(f"v{j}"))
    sums = wide.agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
                    *(F.sum(F.when(F.col(label) == y, off(i, j))).alias(f"s{y}_{i}_{j}") for i, j in pairs for y in (0, 1)))
    # The variance of a difference is that of the rows' differences of placements.
    listed = F.explode(F.array(*(F.struct(F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"),
                                          F.sqrt(_variance(F.col(f"s1_{i}_{j}"), F.col(f"s0_{i}_{j}"))).alias("se")) for i, j in pairs)))
    a, b = (aucs.select(F.col(group).alias(f"model_{x}"), F.col("auc").alias(f"auc_{x}")) for x in "ab")
    out = sums.select(listed.alias("p")).select("p.*").join(F.broadcast(a), "model_a").join(F.broadcast(b), "model_b")
    out = out.withColumn("difference", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.try_divide("difference", "se"))
    return out.select("model_a", "model_b", "auc_a", "auc_b", "difference", "se", "z", (F.abs("z") > Z95).alias("distinct"))
