"""Single-pass profiles of the episode table: counts, criteria, nulls, medians.

Every profile is one aggregate: Spark computes partial results per input
partition and merges them, so the cost is one scan and a tiny final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions.clinical import tier_rank
from carelens.operators.windows import exact_medians, weighted_medians


def extract_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = (F.approx_count_distinct("DOCUMENTO") if approximate
                else F.count_distinct("DOCUMENTO"))
    return df.agg(distinct.cast("long").alias("n_patients"), F.count(F.lit(1)).alias("n_rows"))


def pressure_profile(prepared: DataFrame) -> DataFrame:
    return prepared.agg(F.count("PRESION_SISTOLICA").alias("n_valid"),
                        F.avg("PRESION_SISTOLICA").alias("mean_systolic"),
                        F.avg("PRESION_DIASTOLICA").alias("mean_diastolic"))


def readmission_rate(prepared: DataFrame) -> DataFrame:
    """Same-cause count, within-15-days count, readmissions and rate (%), plus the
    training-size guard (fewer than 10 positives)."""
    n = F.count(F.lit(1))
    readm = F.sum("REINGRESO").cast("long")
    return prepared.agg(
        n.alias("n_rows"),
        F.count_if("ES_MISMA_CAUSA").alias("n_same_cause"),
        F.count_if("DENTRO_15_DIAS").alias("n_within_15_days"),
        F.coalesce(readm, F.lit(0).cast("long")).alias("n_readmissions"),
        (F.try_divide(readm, n) * 100).alias("rate_pct"),
        (F.coalesce(readm, F.lit(0)) < C.FEW_POSITIVES).alias("few_positives"),
    )


# The criteria and their labels, in order.
CRITERIA = [
    ("Total de registros", "n_rows"),
    ("Pacientes con egreso registrado", "n_with_discharge"),
    ("Pacientes sin egreso (aun hospitalizados)", "n_without_discharge"),
    ("Pacientes con misma causa", "n_same_cause"),
    ("Ingresos dentro de 15 dias del egreso anterior", "n_within_15_days"),
    ("REINGRESOS (misma causa + <=15 dias)", "n_readmissions"),
    ("Tasa de reingreso", "rate_pct"),
]


def criteria_table(prepared: DataFrame) -> DataFrame:
    """The readmission criteria in long form (7 rows), numeric value and display text."""
    n = F.count(F.lit(1))
    readm = F.coalesce(F.sum("REINGRESO").cast("long"), F.lit(0).cast("long"))
    wide = prepared.agg(
        n.cast("double").alias("n_rows"),
        F.count("FECHA_EGRESO_DEL_INGRESO_ACTUAL").cast("double").alias("n_with_discharge"),
        F.count_if(F.col("FECHA_EGRESO_DEL_INGRESO_ACTUAL").isNull()).cast("double").alias("n_without_discharge"),
        F.count_if("ES_MISMA_CAUSA").cast("double").alias("n_same_cause"),
        F.count_if("DENTRO_15_DIAS").cast("double").alias("n_within_15_days"),
        readm.cast("double").alias("n_readmissions"),
        F.coalesce(F.try_divide(readm, n) * 100, F.lit(0.0)).alias("rate_pct"),
    )
    stacked = ", ".join(f"{i}, '{label}', {colname}" for i, (label, colname) in enumerate(CRITERIA))
    long = wide.selectExpr(f"stack({len(CRITERIA)}, {stacked}) AS (position, criterion, value)")
    last = len(CRITERIA) - 1
    return long.withColumn(
        "display",
        F.when(F.col("position") == last, F.concat(F.format_string("%.2f", F.col("value")), F.lit("%")))
         .otherwise(F.format_number(F.col("value"), 0)))


def null_profile(prepared: DataFrame, features: list[str]) -> DataFrame:
    """Missing (NULL or NaN) count and percentage per feature, one scan."""
    n = F.count(F.lit(1))
    wide = prepared.agg(n.alias("__n"), *[
        F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f"__null_{i}") for i, f in enumerate(features)])
    stacked = ", ".join(f"{i}, '{f}', __null_{i}" for i, f in enumerate(features))
    return (wide.selectExpr("__n", f"stack({len(features)}, {stacked}) AS (position, feature, n_null)")
                .withColumn("pct_null", F.try_divide(F.col("n_null"), F.col("__n")) * 100)
                .drop("__n"))


def feature_medians(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact median per feature (NaN treated as missing), long form."""
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    return names.join(exact_medians(df, features), "feature", "left").select("position", "feature", "median")


def score_summary(scored: DataFrame, score: str = "score", by: list[str] = ()) -> DataFrame:
    """Smallest, greatest, mean and exact median score, per group or over all rows.
    ``scored`` is read once: the scores are counted first."""
    by = list(by)
    x = F.col(score).cast("double")
    counts = scored.select(*by, x.alias("score")).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    whole = counts.groupBy(*by).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        (F.sum(F.col("score") * F.col("n")) / F.sum(F.when(F.col("score").isNotNull(), F.col("n")))).alias("mean_score"))
    middle = weighted_medians(counts.withColumnRenamed("score", "value"), by).withColumnRenamed("median", "median_score")
    same = F.lit(True)
    for k in by:
        same = same & whole[k].eqNullSafe(middle[k])
    return whole.join(middle, same, "left").select(*[whole[k] for k in by], "min_score", "max_score", "mean_score", "median_score")


def risk_distribution(scored: DataFrame, tier_col: str = "NIVEL_RIESGO_REINGRESO") -> DataFrame:
    """Episodes per tier with share of all rows, fixed tier order, empty tiers absent."""
    counts = scored.groupBy(tier_col).agg(F.count(F.lit(1)).alias("n_episodes"))
    # At most three rows reach this window.
    total = F.sum("n_episodes").over(Window.partitionBy())
    return (counts.withColumn("pct", F.try_divide(F.col("n_episodes"), total) * 100)
                  .withColumn("tier_order", tier_rank(tier_col))
                  .withColumnRenamed(tier_col, "tier"))
