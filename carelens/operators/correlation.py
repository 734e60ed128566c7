"""Pearson correlation matrix.

A first aggregate takes range and missing counts of the columns. Columns without
missing values then share one aggregate of shifted sums and products (few enough
buffers for generated code); pairs with a partly missing column use the pairwise
``covar_pop``. A constant or empty column gives NULL instead of a division error.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (var1, var2, pos1, pos2, corr), both triangles and the diagonal."""
    spark = df.sparkSession
    cols = [F.col(c).cast("double") for c in columns]
    # One row of statistics reaches the driver per step.
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    k = range(len(columns))
    vary = [i for i in k if seen[f"n{i}"] and seen[f"lo{i}"] < seen[f"hi{i}"]]
    full = [i for i in vary if seen[f"n{i}"] == seen["n"]]
    value: dict[tuple[int, int], float | None] = {(i, i): 1.0 for i in vary}
    if full:
        # Shifted by the middle of the range and scaled by its width, products do not cancel.
        x = {i: (cols[i] - F.lit((seen[f"lo{i}"] + seen[f"hi{i}"]) / 2)) / F.lit(seen[f"hi{i}"] - seen[f"lo{i}"]) for i in full}
        shifted = df.select(*[x[i].alias(f"x{i}") for i in full])
        sums = shifted.agg(*[F.sum(f"x{i}").alias(f"s{i}") for i in full],
                           *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in full for j in full if i <= j]).first()
        n = seen["n"]

        def covariance(i, j):
            return sums[f"p{i}_{j}"] / n - sums[f"s{i}"] / n * (sums[f"s{j}"] / n)
        for i, j in combinations(full, 2):
            value[i, j] = covariance(i, j) / (covariance(i, i) * covariance(j, j)) ** 0.5
    partly = [(i, j) for i, j in combinations(vary, 2) if (i, j) not in value]
    if partly:
        ones = [i for i in vary if any(i in p for p in partly)]
        sums = df.agg(*[F.stddev_pop(cols[i]).alias(f"sd{i}") for i in ones],
                      *[F.covar_pop(cols[i], cols[j]).alias(f"cv{i}_{j}") for i, j in partly]).first()
        for i, j in partly:
            cv, sd = sums[f"cv{i}_{j}"], sums[f"sd{i}"] * sums[f"sd{j}"]
            value[i, j] = None if cv is None or not sd else cv / sd
    rows = [(a, b, i, j, value.get((min(i, j), max(i, j)))) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(rows, "var1 string, var2 string, pos1 int, pos2 int, corr double")


def target_correlation(matrix: DataFrame, target: str) -> DataFrame:
    """Correlation of every variable with ``target``, ranked by absolute value."""
    rows = matrix.filter((F.col("var2") == target) & (F.col("var1") != target))
    # One row per variable reaches this window (a handful of rows).
    w = Window.orderBy(F.abs(F.col("corr")).desc_nulls_last(), F.col("pos1"))
    return rows.select(
        F.col("var1").alias("variable"), "corr",
        F.row_number().over(w).cast("long").alias("rank"),
        F.when(F.col("corr") > 0, F.lit("+")).when(F.col("corr") < 0, F.lit("-")).alias("direction"))
