"""Reproducible stratified split, class weights and standard scaling.

Split rule: within each class, rows are ordered by a hash of ``seed:id``; the
first ``round_half_up(test_share * n_class)`` rows are the test set. The
order statistic that separates test from train is found without sorting a
class: hash values are uniform, so a histogram over 2^20 hash buckets (one
aggregate, bounded size) locates the boundary bucket, and only the rows of
that bucket are ranked.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens import config as C

HASH_BITS = 60
BUCKET_BITS = 20


def hash_key(id_col: str, seed: int = C.SEED):
    """60-bit integer from md5('seed:id'); ordered like the first 15 hex digits."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _test_counts(label_counts: DataFrame, stratify: bool, share: float) -> DataFrame:
    """Test rows of each class: the exact share of its rows, halves rounded up; of
    one pool, rounded up."""
    part = Fraction(str(share))
    top, bottom = F.lit(part.numerator).cast("decimal(18,0)"), F.lit(part.denominator).cast("decimal(18,0)")
    n = F.col("n").cast("decimal(19,0)")
    if stratify:
        return label_counts.withColumn("k", F.floor((2 * n * top + bottom) / (2 * bottom)).cast("long"))
    return label_counts.withColumn("k", F.ceil(n * top / bottom).cast("long"))


def stratified_split(df: DataFrame, label: str = "REINGRESO", id_col: str = "INGRESO_ACTUAL",
                     share: float = C.TEST_SHARE, seed: int = C.SEED) -> DataFrame:
    """Adds boolean ``is_test``. Stratified by ``label`` unless a class has fewer
    than 2 rows or there is only one class (then one pool, ceil(share * n) test rows)."""
    h = "__h"
    base = df.withColumn(h, hash_key(id_col, seed))
    bucket = F.shiftright(F.col(h), HASH_BITS - BUCKET_BITS)
    # Hash histogram per class: at most 2^20 rows per class, kept for the steps below.
    by_label = (base.groupBy(F.col(label).alias("__lab"), bucket.alias("__b"))
                    .agg(F.count(F.lit(1)).alias("cnt")).persist())
    per_label = by_label.groupBy("__lab").agg(F.sum("cnt").alias("n")).collect()  # one row per class
    stratify = len(per_label) > 1 and min(r["n"] for r in per_label) >= 2
    grp = "__grp"
    grp_of_label = F.col(label).cast("long") if stratify else F.lit(0).cast("long")
    base = base.withColumn(grp, grp_of_label)
    hist_grp = F.col("__lab").cast("long") if stratify else F.lit(0).cast("long")
    hist = by_label.groupBy(hist_grp.alias(grp), "__b").agg(F.sum("cnt").alias("cnt"))
    # At most 2^20 buckets per class reach this window.
    w = Window.partitionBy(grp).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    totals = Window.partitionBy(grp)
    hist = (hist.withColumn("cum", F.sum("cnt").over(w))
                .withColumn("n", F.sum("cnt").over(totals)))
    hist = _test_counts(hist, stratify, share)
    boundary = (hist.filter((F.col("cum") - F.col("cnt") < F.col("k")) & (F.col("k") <= F.col("cum")))
                    .select(grp, "__b", (F.col("k") - (F.col("cum") - F.col("cnt"))).alias("need"))
                    .collect())  # one row per class
    by_label.unpersist()
    if not boundary:
        return df.withColumn("is_test", F.lit(False))
    # Rank only the rows of each class's boundary bucket; the cut is one row per class.
    in_bucket = None
    for r in boundary:
        cond = (F.col(grp) == r[grp]) & (bucket == r["__b"])
        in_bucket = cond if in_bucket is None else in_bucket | cond
    need = None
    for r in boundary:
        need = (F.when(F.col(grp) == r[grp], F.lit(r["need"])) if need is None
                else need.when(F.col(grp) == r[grp], F.lit(r["need"])))
    w_rank = Window.partitionBy(grp).orderBy(F.col(h), F.col(id_col))
    cuts = (base.filter(in_bucket).withColumn("__rn", F.row_number().over(w_rank))
                .filter(F.col("__rn") == need).select(grp, h, id_col).collect())
    is_test = F.lit(False)
    for r in cuts:
        # (hash, id) <= (cut hash, cut id), lexicographically.
        below = (F.col(h) < F.lit(r[h])) | ((F.col(h) == F.lit(r[h])) & (F.col(id_col) <= F.lit(r[id_col])))
        is_test = F.when(F.col(grp) == r[grp], F.coalesce(below, F.lit(False))).otherwise(is_test)
    return base.withColumn("is_test", is_test).drop(h, grp)


def class_weights(df: DataFrame, label: str = "REINGRESO") -> DataFrame:
    """Balanced weights n / (2 * n_class), one row."""
    n = F.count(F.lit(1))
    n1 = F.count_if(F.col(label) == 1)
    n0 = F.count_if(F.col(label) == 0)
    return df.agg(n.alias("n"), n0.alias("n0"), n1.alias("n1"),
                  F.try_divide(n, n0 * 2).alias("w0"), F.try_divide(n, n1 * 2).alias("w1"))


def weight_column(df: DataFrame, weights_row, label: str = "REINGRESO", out: str = "weight") -> DataFrame:
    if weights_row["w0"] is None or weights_row["w1"] is None:
        raise ValueError("class weights need rows of both classes")
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(weights_row["w1"]))).otherwise(F.lit(float(weights_row["w0"]))))


def scaler_stats(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per feature (NULLs skipped); a zero
    deviation scales by 1. One row of statistics comes back to the driver."""
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    stats = {}
    for i, f in enumerate(features):
        m, s = row[f"m{i}"], row[f"s{i}"]
        stats[f] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return stats


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    out = df
    for f, (m, s) in stats.items():
        out = out.withColumn(f + suffix, (F.col(f).cast("double") - F.lit(m)) / F.lit(s))
    return out
