"""Queries for sources, filters, projections and per-patient windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions import clinical as X
from carelens.operators import windows
from carelens.operators.prepare import add_previous_discharge
from carelens.plans import inputs as I
from carelens.plans import sql_twins as S
from carelens.plans.catalog import query, r6, rounded
from carelens.session import ensure_checkpoint_dir
from carelens.sources.episodes import EXTRACT_COLUMNS, inpatient_filter, part_bounds, part_predicates, resolve_columns

PREP_B = S.prepared_sql("batch")
PREP_V = S.prepared_sql("service")
FIX = S.EPISODES_DUCKDB.strip()
EXTRACT_SELECT = ", ".join(f'"{c}"' for c in EXTRACT_COLUMNS)


@query("episodes_scan", S.with_steps(FIX, S.extract_sql("ext_b", False))
       + f" SELECT {EXTRACT_SELECT} FROM ext_b")
def episodes_scan(spark, sf_dir):
    return rounded(I.extracted(spark, sf_dir, "batch"))


@query("inpatient_filter", S.with_steps(FIX, S.extract_sql("ext_v", True))
       + f" SELECT {EXTRACT_SELECT} FROM ext_v")
def inpatient_filter_q(spark, sf_dir):
    return rounded(I.extracted(spark, sf_dir, "service"))


@query("range_guard", S.with_steps(FIX) + f"""
 SELECT INGRESO_ACTUAL, PESO AS PESO_RAW, TALLA AS TALLA_RAW,
   {r6(f"CASE WHEN PESO BETWEEN {C.WEIGHT_RANGE[0]} AND {C.WEIGHT_RANGE[1]} THEN PESO END")} AS PESO,
   {r6(f"CASE WHEN TALLA BETWEEN {C.HEIGHT_RANGE[0]} AND {C.HEIGHT_RANGE[1]} THEN TALLA END")} AS TALLA
 FROM episodes""")
def range_guard_q(spark, sf_dir):
    e = I.episodes(spark, sf_dir)
    return rounded(e.select("INGRESO_ACTUAL", F.col("PESO").alias("PESO_RAW"), F.col("TALLA").alias("TALLA_RAW"),
                            X.range_guard("PESO", *C.WEIGHT_RANGE).alias("PESO"),
                            X.range_guard("TALLA", *C.HEIGHT_RANGE).alias("TALLA")))


@query("encode_categories", S.with_steps(FIX) + f"""
 SELECT INGRESO_ACTUAL, {S.encode('SEXO', C.SEX_CODES)} AS SEXO,
   {S.encode('ESTADO_EGRESO', C.DISCHARGE_STATE_CODES)} AS ESTADO_EGRESO,
   {S.encode('ADHERENCIA_PREVIA', C.ADHERENCE_CODES)} AS ADHERENCIA_PREVIA,
   {S.encode('CAUSA_INGRESO', C.CAUSE_CODES)} AS CAUSA_INGRESO
 FROM episodes""")
def encode_categories(spark, sf_dir):
    e = I.episodes(spark, sf_dir)
    return e.select("INGRESO_ACTUAL",
                    X.encode("SEXO", C.SEX_CODES).alias("SEXO"),
                    X.encode("ESTADO_EGRESO", C.DISCHARGE_STATE_CODES).alias("ESTADO_EGRESO"),
                    X.encode("ADHERENCIA_PREVIA", C.ADHERENCE_CODES).alias("ADHERENCIA_PREVIA"),
                    X.encode("CAUSA_INGRESO", C.CAUSE_CODES).alias("CAUSA_INGRESO"))


def _blind(col: str, codes: dict[str, int]) -> str:
    return "CASE lower(rtrim(x." + col + ")) " + " ".join(f"WHEN lower('{t}') THEN {k}" for t, k in codes.items()) + " ELSE 0 END"


@query("encode_collated", S.with_steps(FIX) + f"""
 SELECT INGRESO_ACTUAL, {_blind('SEXO', C.SEX_CODES)} AS SEXO, {_blind('CAUSA_INGRESO', C.CAUSE_CODES)} AS CAUSA_INGRESO
 FROM (SELECT INGRESO_ACTUAL, lower(SEXO) || '  ' AS SEXO, CASE INGRESO_ACTUAL % 2 WHEN 0 THEN lower(CAUSA_INGRESO) ELSE ' ' || CAUSA_INGRESO END
         AS CAUSA_INGRESO FROM episodes) x""")
def encode_collated_q(spark, sf_dir):
    """Category codes under a collation blind to case and trailing spaces, on texts written otherwise."""
    e = I.episodes(spark, sf_dir).select(
        "INGRESO_ACTUAL", F.concat(F.lower("SEXO"), F.lit("  ")).alias("SEXO"),
        F.when(F.col("INGRESO_ACTUAL") % 2 == 0, F.lower("CAUSA_INGRESO")).otherwise(F.concat(F.lit(" "), "CAUSA_INGRESO")).alias("CAUSA_INGRESO"))
    return e.select("INGRESO_ACTUAL", X.encode("SEXO", C.SEX_CODES, "UTF8_LCASE_RTRIM").alias("SEXO"),
                    X.encode("CAUSA_INGRESO", C.CAUSE_CODES, "UTF8_LCASE_RTRIM").alias("CAUSA_INGRESO"))


@query("decode_labels", S.with_steps(PREP_B) + """
 SELECT INGRESO_ACTUAL, SEXO_TEXTO, ESTADO_EGRESO_TEXTO, ADHERENCIA_TEXTO FROM prep_b""")
def decode_labels(spark, sf_dir):
    return I.prepared(spark, sf_dir).select("INGRESO_ACTUAL", "SEXO_TEXTO", "ESTADO_EGRESO_TEXTO",
                                            "ADHERENCIA_TEXTO")


@query("bmi", S.with_steps(PREP_B) + f"SELECT INGRESO_ACTUAL, PESO, TALLA, {r6('IMC')} AS IMC FROM prep_b")
def bmi_q(spark, sf_dir):
    return rounded(I.prepared(spark, sf_dir).select("INGRESO_ACTUAL", "PESO", "TALLA", "IMC"))


@query("bmi_band", S.with_steps(PREP_B) + "SELECT INGRESO_ACTUAL, CATEGORIA_IMC FROM prep_b")
def bmi_band_q(spark, sf_dir):
    return I.prepared(spark, sf_dir).select("INGRESO_ACTUAL", "CATEGORIA_IMC")


@query("age_band", S.with_steps(PREP_B) + "SELECT INGRESO_ACTUAL, EDAD, GRUPO_EDAD FROM prep_b")
def age_band_q(spark, sf_dir):
    return I.prepared(spark, sf_dir).select("INGRESO_ACTUAL", "EDAD", "GRUPO_EDAD")


@query("blood_pressure", S.with_steps(PREP_B) + f"""
 SELECT INGRESO_ACTUAL, PRESION_ARTERIAL, {r6('PRESION_SISTOLICA')} AS PRESION_SISTOLICA,
   {r6('PRESION_DIASTOLICA')} AS PRESION_DIASTOLICA, {r6('PRESION_ARTERIAL_MEDIA')} AS PRESION_ARTERIAL_MEDIA
 FROM prep_b""")
def blood_pressure(spark, sf_dir):
    return rounded(I.prepared(spark, sf_dir).select(
        "INGRESO_ACTUAL", "PRESION_ARTERIAL", "PRESION_SISTOLICA", "PRESION_DIASTOLICA", "PRESION_ARTERIAL_MEDIA"))


@query("systolic_lenient", S.with_steps(PREP_V) + f"""
 SELECT INGRESO_ACTUAL, {r6('PRESION_ARTERIAL')} AS PRESION_ARTERIAL FROM prep_v""")
def systolic_lenient(spark, sf_dir):
    return rounded(I.prepared(spark, sf_dir, "service").select("INGRESO_ACTUAL", "PRESION_ARTERIAL"))


@query("parse_coerce", S.with_steps(FIX) + f"""
 SELECT INGRESO_ACTUAL,
   TRY_CAST(CAST(FECHA_INGRESO_ACTUAL AS VARCHAR) AS TIMESTAMP) AS FECHA_INGRESO_ACTUAL,
   TRY_CAST(CAST(FECHA_EGRESO_DEL_INGRESO_ACTUAL AS VARCHAR) AS TIMESTAMP) AS FECHA_EGRESO_DEL_INGRESO_ACTUAL,
   {r6(S.num('TIEMPO_ULTIMA_HOSPITALIZACION'))} AS TIEMPO_ULTIMA_HOSPITALIZACION,
   {r6(S.num('PRESION_ARTERIAL'))} AS PRESION_NUMERO
 FROM episodes""")
def parse_coerce(spark, sf_dir):
    """Coercing parses: date text -> timestamp, number text -> double, bad -> NULL."""
    e = I.episodes(spark, sf_dir)
    return rounded(e.select(
        "INGRESO_ACTUAL",
        X.parse_timestamp("FECHA_INGRESO_ACTUAL").cast("timestamp_ntz").alias("FECHA_INGRESO_ACTUAL"),
        X.parse_timestamp("FECHA_EGRESO_DEL_INGRESO_ACTUAL").cast("timestamp_ntz")
         .alias("FECHA_EGRESO_DEL_INGRESO_ACTUAL"),
        X.parse_number("TIEMPO_ULTIMA_HOSPITALIZACION").alias("TIEMPO_ULTIMA_HOSPITALIZACION"),
        X.parse_number("PRESION_ARTERIAL").alias("PRESION_NUMERO")))


@query("readmission_label", S.with_steps(PREP_B) + f"""
 SELECT INGRESO_ACTUAL, DIAS_DESDE_EGRESO_ANTERIOR, {r6('TIEMPO_ULTIMA_HOSPITALIZACION')} AS TIEMPO_ULTIMA_HOSPITALIZACION,
   ES_MISMA_CAUSA, DENTRO_15_DIAS, REINGRESO FROM prep_b""")
def readmission_label(spark, sf_dir):
    return rounded(I.prepared(spark, sf_dir).select(
        "INGRESO_ACTUAL", "DIAS_DESDE_EGRESO_ANTERIOR", "TIEMPO_ULTIMA_HOSPITALIZACION",
        "ES_MISMA_CAUSA", "DENTRO_15_DIAS", "REINGRESO"))


@query("previous_discharge", S.with_steps(FIX) + """
 SELECT INGRESO_ACTUAL, DOCUMENTO,
   CASE WHEN DOCUMENTO IS NULL THEN NULL ELSE
   LAG(FECHA_EGRESO_DEL_INGRESO_ACTUAL) OVER (PARTITION BY DOCUMENTO
       ORDER BY FECHA_INGRESO_ACTUAL ASC NULLS LAST, INGRESO_ACTUAL) END AS FECHA_EGRESO_ANTERIOR
 FROM episodes""")
def previous_discharge(spark, sf_dir):
    e = I.extracted(spark, sf_dir, "batch")
    return add_previous_discharge(e).select("INGRESO_ACTUAL", "DOCUMENTO", "FECHA_EGRESO_ANTERIOR")


#: Rows of a range in ``previous_discharge_hot`` (histories of real size: windows.SLICE_ROWS).
HOT_SLICE = 100


@query("previous_discharge_hot", S.with_steps(FIX) + """, h AS (SELECT INGRESO_ACTUAL, FECHA_EGRESO_DEL_INGRESO_ACTUAL AS e,
   CASE INGRESO_ACTUAL % 3 WHEN 0 THEN 'hot' WHEN 1 THEN DOCUMENTO END AS patient,
   CASE WHEN INGRESO_ACTUAL % 5 > 0 THEN FECHA_INGRESO_ACTUAL + to_microseconds(INGRESO_ACTUAL * 977 % 86400000000) END AS t FROM episodes)
 SELECT INGRESO_ACTUAL, patient, t, CASE WHEN patient IS NOT NULL THEN
   LAG(e) OVER (PARTITION BY patient ORDER BY t ASC NULLS LAST, INGRESO_ACTUAL) END AS FECHA_EGRESO_ANTERIOR FROM h""")
def previous_discharge_hot(spark, sf_dir):
    """Previous discharge where one patient holds a third of all admissions, a fifth of them undated."""
    k = F.col("INGRESO_ACTUAL")
    at = F.make_interval(secs=(k * 977 % 86_400_000_000) / F.lit(1_000_000).cast("decimal(18,6)"))
    e = I.episodes(spark, sf_dir).select(
        "INGRESO_ACTUAL", F.when(k % 3 == 0, "hot").when(k % 3 == 1, F.col("DOCUMENTO")).alias("patient"),
        F.when(k % 5 > 0, F.col("FECHA_INGRESO_ACTUAL") + at).alias("t"), "FECHA_EGRESO_DEL_INGRESO_ACTUAL")
    return windows.lag_by_key(e, "patient", "t", "INGRESO_ACTUAL", {"FECHA_EGRESO_ANTERIOR": "FECHA_EGRESO_DEL_INGRESO_ACTUAL"},
                              slice_rows=HOT_SLICE).drop("FECHA_EGRESO_DEL_INGRESO_ACTUAL")


#: Parts of ``scan_parts``.
PARTS = 7


@query("scan_parts", S.with_steps(FIX, f"""n_e AS (
   SELECT CASE WHEN INGRESO_ACTUAL % 10 > 0 THEN INGRESO_ACTUAL END AS k FROM episodes), m_e AS (
   SELECT min(k) AS lo, (max(k) - min(k) + {PARTS}) // {PARTS} AS step FROM n_e)""") + """
 SELECT CAST(CASE WHEN k IS NULL THEN 0 ELSE 1 + (k - lo) // step END AS INT) AS part, COUNT(*) AS n FROM n_e, m_e GROUP BY ALL""")
def scan_parts(spark, sf_dir):
    """Rows of each part of a database scan, by the predicates that the scan would send;
    a tenth of the rows have no number."""
    k = F.col("INGRESO_ACTUAL")
    e = I.episodes(spark, sf_dir).select(F.when(k % 10 > 0, k).alias("k")).checkpoint()
    bounds = part_bounds([tuple(e.agg(F.min("k"), F.max("k")).first())], PARTS)
    tests = [F.expr(p.replace('"', "`")) for p in part_predicates("k", bounds)]
    met = F.filter(F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(tests))), lambda i: i.isNotNull())
    return e.select(F.explode(met).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


LATEST_SQL = """
 SELECT DOCUMENTO, INGRESO_ACTUAL, FECHA_INGRESO_ACTUAL, "HOSPITALIZACIONES_ULTIMO_AÑO", n_episodes FROM (
   SELECT *, ROW_NUMBER() OVER (PARTITION BY DOCUMENTO
              ORDER BY FECHA_INGRESO_ACTUAL DESC NULLS LAST, INGRESO_ACTUAL DESC) AS rn,
          COUNT(*) OVER (PARTITION BY DOCUMENTO) AS n_episodes
   FROM episodes WHERE DOCUMENTO IS NOT NULL) WHERE rn = 1"""


@query("latest_episode", S.with_steps(FIX) + LATEST_SQL)
def latest_episode(spark, sf_dir):
    e = I.episodes(spark, sf_dir).filter(F.col("DOCUMENTO").isNotNull())
    return windows.latest_by_key(e, "DOCUMENTO", "FECHA_INGRESO_ACTUAL", "INGRESO_ACTUAL",
                                 columns=["INGRESO_ACTUAL", "FECHA_INGRESO_ACTUAL", C.HOSP],
                                 count_as="n_episodes")


@query("alias_resolution", S.with_steps(PREP_B) + """
 SELECT DOCUMENTO AS patient_id, FECHA_INGRESO_ACTUAL AS admission_date,
   "HOSPITALIZACIONES_ULTIMO_AÑO" AS hospitalizations, DIAS_DESDE_EGRESO_ANTERIOR AS days_since_discharge,
   ADHERENCIA_TEXTO AS adherence, CAUSA_INGRESO AS cause, INGRESO_ACTUAL
 FROM prep_b""")
def alias_resolution(spark, sf_dir):
    """Resolve report roles to the first existing column name, then project them."""
    df = I.prepared(spark, sf_dir)
    roles = {k: C.COLUMN_CANDIDATES[k] for k in
             ["patient_id", "admission_date", "hospitalizations", "days_since_discharge", "adherence", "cause"]}
    found = resolve_columns(df, roles, required=["patient_id"])
    return df.select(*[F.col(c).alias(role) for role, c in found.items() if c], "INGRESO_ACTUAL")


@query("saved_results", S.with_steps(FIX) + """, first_r AS (SELECT COUNT(DISTINCT DOCUMENTO) AS n FROM episodes), more_r AS (
   SELECT COUNT(*) AS n FROM (SELECT DISTINCT DOCUMENTO FROM episodes UNION SELECT 'NUEVO'))
 SELECT 1 AS call, 'first' AS what, FALSE AS reused, n FROM first_r UNION ALL SELECT 2, 'again', TRUE, n FROM first_r
 UNION ALL SELECT 3, 'new input', FALSE, n FROM more_r UNION ALL SELECT 4, 'old input', TRUE, n FROM first_r
 UNION ALL SELECT 5, 'too old', FALSE, n FROM first_r""")
def saved_results(spark, sf_dir):
    """The latest admission of each patient, asked for five times: built, read again,
    built for new input, read again for the first input, and built anew when it is too old."""
    from carelens.plans.results import MAX_AGE, Results
    e = I.episodes(spark, sf_dir).select("DOCUMENTO", "FECHA_INGRESO_ACTUAL", "INGRESO_ACTUAL").checkpoint()
    more = e.unionByName(e.limit(1).select(F.lit("NUEVO").alias("DOCUMENTO"), "FECHA_INGRESO_ACTUAL", "INGRESO_ACTUAL")).checkpoint()
    now = [1_000_000.0]
    kept = Results(spark, f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}", clock=lambda: now[0])
    out = []
    for what, source, later in (("first", e, 0), ("again", e, 100), ("new input", more, 1), ("old input", e, 1), ("too old", e, MAX_AGE)):
        now[0] += later
        table = kept.table("latest", source, lambda d: windows.latest_by_key(d, "DOCUMENTO", "FECHA_INGRESO_ACTUAL", "INGRESO_ACTUAL"), variant="batch")
        out.append((len(out) + 1, what, kept.log[-1][1], table.count()))
    return spark.createDataFrame(out, "call int, what string, reused boolean, n long")
