"""Queries for profiles and aggregates of the prepared episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators import profile as P
from carelens.operators.impute import medians
from carelens.plans import inputs as I
from carelens.plans import sql_twins as S
from carelens.plans.catalog import query, r6, rounded

PREP_B = S.prepared_sql("batch")
PREP_V = S.prepared_sql("service")
FIX = S.EPISODES_DUCKDB.strip()


def _q(name: str) -> str:
    return f'"{name}"'


@query("extract_profile", S.with_steps(FIX) + """
 SELECT CAST(COUNT(DISTINCT DOCUMENTO) AS BIGINT) AS n_patients, CAST(COUNT(*) AS BIGINT) AS n_rows FROM episodes""")
def extract_profile(spark, sf_dir):
    return P.extract_profile(I.episodes(spark, sf_dir))


@query("pressure_profile", S.with_steps(PREP_B) + f"""
 SELECT CAST(COUNT(PRESION_SISTOLICA) AS BIGINT) AS n_valid, {r6('AVG(PRESION_SISTOLICA)')} AS mean_systolic,
   {r6('AVG(PRESION_DIASTOLICA)')} AS mean_diastolic FROM prep_b""")
def pressure_profile(spark, sf_dir):
    return rounded(P.pressure_profile(I.prepared(spark, sf_dir)))


READMISSION_RATE_SQL = f"""
 SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
   CAST(COUNT(*) FILTER (WHERE ES_MISMA_CAUSA) AS BIGINT) AS n_same_cause,
   CAST(COUNT(*) FILTER (WHERE DENTRO_15_DIAS) AS BIGINT) AS n_within_15_days,
   CAST(coalesce(SUM(REINGRESO), 0) AS BIGINT) AS n_readmissions,
   {r6('SUM(REINGRESO) * 100.0 / COUNT(*)')} AS rate_pct,
   coalesce(SUM(REINGRESO), 0) < {C.FEW_POSITIVES} AS few_positives
 FROM """


@query("readmission_rate", S.with_steps(PREP_B) + READMISSION_RATE_SQL + "prep_b")
def readmission_rate(spark, sf_dir):
    """Readmission criteria over every admission type (batch variant)."""
    return rounded(P.readmission_rate(I.prepared(spark, sf_dir)))


@query("readmission_rate_inpatient", S.with_steps(PREP_V) + READMISSION_RATE_SQL + "prep_v")
def readmission_rate_inpatient(spark, sf_dir):
    """Readmission criteria over inpatient admissions (service variant)."""
    return rounded(P.readmission_rate(I.prepared(spark, sf_dir, "service")))


CRITERIA_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{label}' AS criterion, CAST({col} AS DOUBLE) AS value FROM crit_w"
    for i, (label, col) in enumerate(P.CRITERIA))


@query("criteria_table", S.with_steps(PREP_B, f"""crit_w AS (
  SELECT COUNT(*) AS n_rows, COUNT(FECHA_EGRESO_DEL_INGRESO_ACTUAL) AS n_with_discharge,
    COUNT(*) FILTER (WHERE FECHA_EGRESO_DEL_INGRESO_ACTUAL IS NULL) AS n_without_discharge,
    COUNT(*) FILTER (WHERE ES_MISMA_CAUSA) AS n_same_cause,
    COUNT(*) FILTER (WHERE DENTRO_15_DIAS) AS n_within_15_days,
    coalesce(SUM(REINGRESO), 0) AS n_readmissions,
    coalesce(coalesce(SUM(REINGRESO), 0) * 100.0 / NULLIF(COUNT(*), 0), 0) AS rate_pct
  FROM prep_b)""", f"crit_l AS ({CRITERIA_ROWS})") + f"""
 SELECT position, criterion, {r6('value')} AS value,
   CASE WHEN position = {len(P.CRITERIA) - 1} THEN printf('%.2f', value) || '%'
        ELSE format('{{:,}}', CAST(value AS BIGINT)) END AS display
 FROM crit_l""")
def criteria_table(spark, sf_dir):
    return rounded(P.criteria_table(I.prepared(spark, sf_dir)))


def _null_profile_sql(prep: str, features: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{f}' AS feature, CAST(COUNT(*) FILTER (WHERE {_q(f)} IS NULL) AS BIGINT) AS n_null, "
        f"{r6(f'COUNT(*) FILTER (WHERE {_q(f)} IS NULL) * 100.0 / COUNT(*)')} AS pct_null FROM {prep}"
        for i, f in enumerate(features))
    return parts


@query("null_profile", S.with_steps(PREP_B) + _null_profile_sql("prep_b", C.BATCH_FEATURES))
def null_profile(spark, sf_dir):
    return rounded(P.null_profile(I.prepared(spark, sf_dir), C.BATCH_FEATURES))


@query("null_profile_inpatient", S.with_steps(PREP_V) + _null_profile_sql("prep_v", C.SERVICE_FEATURES))
def null_profile_inpatient(spark, sf_dir):
    return rounded(P.null_profile(I.prepared(spark, sf_dir, "service"), C.SERVICE_FEATURES))


def _medians_sql(prep: str, features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{f}' AS feature, {r6(f'median(CAST({_q(f)} AS DOUBLE))')} AS median FROM {prep}"
        for i, f in enumerate(features))


@query("feature_medians", S.with_steps(PREP_B) + _medians_sql("prep_b", C.BATCH_FEATURES))
def feature_medians(spark, sf_dir):
    return rounded(P.feature_medians(I.prepared(spark, sf_dir), C.BATCH_FEATURES))


#: Rank error of ``feature_medians_approx``.
MEDIAN_ERROR = 0.01


@query("feature_medians_approx", S.with_steps(PREP_B) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, COUNT({_q(f)}) AS n, TRUE AS within FROM prep_b" for f in C.BATCH_FEATURES))
def feature_medians_approx(spark, sf_dir):
    """Whether the rank of each sketched median is within MEDIAN_ERROR of the middle."""
    rows = I.prepared(spark, sf_dir).select(*(F.col(f).cast("double").alias(f) for f in C.BATCH_FEATURES)).checkpoint()
    found = medians(rows, C.BATCH_FEATURES, MEDIAN_ERROR)
    counts = rows.agg(*(x for i, f in enumerate(C.BATCH_FEATURES) for x in (
        F.count(f).alias(f"n{i}"), F.count_if(F.col(f) < found[f]).alias(f"b{i}"), F.count_if(F.col(f) <= found[f]).alias(f"u{i}"))))
    # The value's ranks reach from b + 1 to u.
    near = [(F.col(f"b{i}") + 1 <= F.ceil(F.col(f"n{i}") * (0.5 + MEDIAN_ERROR))) & (F.col(f"u{i}") >= F.floor(F.col(f"n{i}") * (0.5 - MEDIAN_ERROR)))
            for i in range(len(C.BATCH_FEATURES))]
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), near[i].alias("within"))
                                             for i, f in enumerate(C.BATCH_FEATURES)))).alias("m")).select("m.*")
