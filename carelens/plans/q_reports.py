"""Queries for lookups and patient reports (on formula scores, DuckDB-checked),
and the trained-model weight report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators import lookup as L
from carelens.operators import profile as P
from carelens.plans import formula as FM
from carelens.plans import inputs as I
from carelens.plans import q_eval  # noqa: F401  (its queries are written and read again below)
from carelens.plans import sql_twins as S
from carelens.plans import train as TR
from carelens.plans.catalog import ORACLES, QUERIES, query, r6, rounded
from carelens.plans.scoring import BATCH_EXPORT, BATCH_RENAMES, export_projection, score_columns
from carelens.session import ensure_checkpoint_dir
from carelens.sources.sinks import write_small_table, write_table

REPORT_COLS = ["INGRESO_ACTUAL", "FECHA_INGRESO_ACTUAL", C.HOSP, "DIAS_DESDE_EGRESO_ANTERIOR",
               "PROB_GB", "PROB_RF", "PROB_LR"]


def _reports(spark, sf_dir):
    latest = L.latest_per_patient(FM.scored(spark, sf_dir), columns=REPORT_COLS)
    return L.prior_discharge_status(L.patient_risk(latest, "PROB_GB", "PROB_RF", "PROB_LR"))


def _requests(spark, sf_dir):
    """Request list derived from the patient registry: each id as text and each name as typed."""
    cust = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    return (cust.select(F.col("c_custkey").cast("string").alias("request"))
                .unionByName(cust.select(F.col("c_name").alias("request"))))


HOSP_Q = S.HOSP_Q
TOP = C.PATIENT_TOP_MODEL_ORDER
LATEST_SQL = f"""latest AS (
  SELECT * FROM (
    SELECT trim(CAST(DOCUMENTO AS VARCHAR)) AS patient_id, INGRESO_ACTUAL, FECHA_INGRESO_ACTUAL, {HOSP_Q},
      DIAS_DESDE_EGRESO_ANTERIOR, PROB_GB, PROB_RF, PROB_LR,
      ROW_NUMBER() OVER (PARTITION BY trim(CAST(DOCUMENTO AS VARCHAR))
                         ORDER BY FECHA_INGRESO_ACTUAL DESC NULLS LAST, INGRESO_ACTUAL DESC) AS rn,
      COUNT(*) OVER (PARTITION BY trim(CAST(DOCUMENTO AS VARCHAR))) AS n_episodes
    FROM scored_b WHERE DOCUMENTO IS NOT NULL) WHERE rn = 1
), reports AS (
  SELECT * EXCLUDE (rn), (PROB_GB + PROB_RF + PROB_LR) / 3 AS mean_probability,
    {S.tier('((PROB_GB + PROB_RF + PROB_LR) / 3)')} AS risk_tier,
    CASE WHEN PROB_GB = greatest(PROB_GB, PROB_RF, PROB_LR) THEN '{TOP[0]}'
         WHEN PROB_RF = greatest(PROB_GB, PROB_RF, PROB_LR) THEN '{TOP[1]}' ELSE '{TOP[2]}' END AS top_model,
    CASE WHEN n_episodes > 1 THEN CAST({HOSP_Q} AS INTEGER) END AS recent_hospitalizations,
    CAST(trunc({S.num('DIAS_DESDE_EGRESO_ANTERIOR')}) AS BIGINT) AS days_since_discharge
  FROM latest
), reports2 AS (
  SELECT *, CASE WHEN days_since_discharge IS NULL THEN '{L.NO_DATA}'
                 WHEN days_since_discharge <= {C.READMISSION_DAYS} THEN '{L.WITHIN}' ELSE '{L.OVER}' END
              AS discharge_status FROM reports
)"""

PATIENT_COLS = ("patient_id, INGRESO_ACTUAL, FECHA_INGRESO_ACTUAL, CAST(n_episodes AS BIGINT) AS n_episodes, "
                f"{r6('PROB_GB')} AS PROB_GB, {r6('PROB_RF')} AS PROB_RF, {r6('PROB_LR')} AS PROB_LR, "
                f"{r6('mean_probability')} AS mean_probability, risk_tier, top_model, recent_hospitalizations")


@query("patient_risk", FM.chain(LATEST_SQL) + f" SELECT {PATIENT_COLS} FROM reports2")
def patient_risk(spark, sf_dir):
    """Per patient: latest admission, mean of the three probabilities, tier from the mean,
    the model with the highest probability, recent stays."""
    r = _reports(spark, sf_dir)
    return rounded(r.select("patient_id", "INGRESO_ACTUAL", "FECHA_INGRESO_ACTUAL", "n_episodes", "PROB_GB",
                            "PROB_RF", "PROB_LR", "mean_probability", "risk_tier", "top_model",
                            "recent_hospitalizations"))


@query("prior_discharge_status", FM.chain(LATEST_SQL) + """
 SELECT patient_id, DIAS_DESDE_EGRESO_ANTERIOR, days_since_discharge, discharge_status FROM reports2""")
def prior_discharge_status(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.select("patient_id", "DIAS_DESDE_EGRESO_ANTERIOR", "days_since_discharge", "discharge_status")


REQUESTS_SQL = """requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS request FROM customer UNION ALL SELECT c_name AS request FROM customer
), req AS (
  SELECT request, regexp_replace(request, '[^a-zA-Z0-9]', '', 'g') AS clean_id,
    coalesce(request = regexp_replace(request, '[^a-zA-Z0-9]', '', 'g'), false) AS is_valid FROM requests
)"""


@query("id_validation", S.with_steps(REQUESTS_SQL) + " SELECT request, clean_id, is_valid FROM req")
def id_validation(spark, sf_dir):
    """Letters-and-digits rule on every request id (registry ids and names as typed)."""
    return L.validate_ids(_requests(spark, sf_dir), "request").select("request", "clean_id", "is_valid")


@query("bulk_lookup", FM.chain(LATEST_SQL, REQUESTS_SQL) + f"""
 SELECT req.request, req.clean_id, req.is_valid,
   CASE WHEN NOT req.is_valid THEN 'INVALID' WHEN r.patient_id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status,
   r.INGRESO_ACTUAL, CAST(r.n_episodes AS BIGINT) AS n_episodes, {r6('r.mean_probability')} AS mean_probability,
   r.risk_tier, r.top_model, r.days_since_discharge, r.discharge_status
 FROM req LEFT JOIN reports2 r ON req.is_valid AND req.clean_id = r.patient_id""")
def bulk_lookup(spark, sf_dir):
    """Every request resolved at once: validation, found / not found, the patient's report."""
    out = L.bulk_lookup(_requests(spark, sf_dir), "request", _reports(spark, sf_dir))
    return rounded(out.select("request", "clean_id", "is_valid", "status", "INGRESO_ACTUAL", "n_episodes",
                              "mean_probability", "risk_tier", "top_model", "days_since_discharge",
                              "discharge_status"))


@query("patient_lookup", FM.chain(REQUESTS_SQL) + f"""
 SELECT e.DOCUMENTO, e.INGRESO_ACTUAL, e.FECHA_INGRESO_ACTUAL, {r6('e.PROB_LR')} AS PROB_LR
 FROM scored_b e WHERE trim(CAST(e.DOCUMENTO AS VARCHAR)) IN (SELECT clean_id FROM req WHERE is_valid)""")
def patient_lookup(spark, sf_dir):
    """All admissions of the requested patients (trimmed-id equality)."""
    out = L.patient_episodes(_requests(spark, sf_dir), "request", FM.scored(spark, sf_dir))
    return rounded(out.select("DOCUMENTO", "INGRESO_ACTUAL", "FECHA_INGRESO_ACTUAL", "PROB_LR"))


NAMES_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in C.VARIABLE_NAMES.items())


@query("variable_names", S.with_steps(S.prepared_sql("batch")) + f"""
 SELECT p.feature, coalesce(n.name, p.feature) AS display_name, p.n_null
 FROM (SELECT * FROM ({' UNION ALL '.join(
    f"SELECT {i} AS position, '{f}' AS feature, CAST(COUNT(*) FILTER (WHERE {S.HOSP_Q if f == C.HOSP else f} IS NULL) AS BIGINT) AS n_null FROM prep_b"
    for i, f in enumerate(C.BATCH_FEATURES))})) p
 LEFT JOIN (VALUES {NAMES_VALUES}) n(var, name) ON p.feature = n.var""")
def variable_names(spark, sf_dir):
    """Feature -> display name (raw name when unmapped), over the feature null profile."""
    prof = P.null_profile(I.prepared(spark, sf_dir), C.BATCH_FEATURES)
    out = L.display_names(prof.withColumnRenamed("feature", "Variable"), "Variable", "display_name")
    return out.select(F.col("Variable").alias("feature"), "display_name", "n_null")


@query("export_projection", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + " SELECT " + ", ".join(
    [f"{'PROB_LR' if c == 'PROB_REINGRESO_LR' else 'PROB_RF' if c == 'PROB_REINGRESO_RF' else 'PROB_GB' if c == 'PROB_REINGRESO_GB' else c} AS {S.HOSP_Q if c == C.HOSP else BATCH_RENAMES.get(c, c)}"
     for c in BATCH_EXPORT if c not in ("PROBABILIDAD_REINGRESO", "PROB_REINGRESO_ENSEMBLE", "NIVEL_RIESGO_REINGRESO",
                                        "PESO", "TALLA", "IMC", "PRESION_SISTOLICA", "PRESION_DIASTOLICA",
                                        "PRESION_ARTERIAL_MEDIA")]
    + [f"{r6('PESO')} AS PESO", f"{r6('TALLA')} AS TALLA", f"{r6('IMC')} AS IMC",
       f"{r6('PRESION_SISTOLICA')} AS PRESION_SISTOLICA", f"{r6('PRESION_DIASTOLICA')} AS PRESION_DIASTOLICA",
       f"{r6('PRESION_ARTERIAL_MEDIA')} AS PRESION_ARTERIAL_MEDIA",
       f"CASE best_model WHEN '{C.MODEL_LR}' THEN PROB_LR WHEN '{C.MODEL_RF}' THEN PROB_RF ELSE PROB_GB END "
       f"AS PROBABILIDAD_REINGRESO_MEJOR_MODELO",
       f"{r6('(PROB_LR + PROB_RF + PROB_GB) / 3')} AS PROBABILIDAD_PROMEDIO_3_MODELOS",
       S.tier(f"CASE best_model WHEN '{C.MODEL_LR}' THEN PROB_LR WHEN '{C.MODEL_RF}' THEN PROB_RF ELSE PROB_GB END")
       + " AS NIVEL_RIESGO_REINGRESO", "best_model AS MODELO_USADO"]) + " FROM scored_b, best")
def export_projection_q(spark, sf_dir):
    """The BI export projection (renames + model used) over formula scores."""
    from carelens.operators import evaluate as E
    s = FM.scored(spark, sf_dir)
    best = E.best_model(E.model_metrics(FM.predictions(spark, sf_dir))).first()["best_model"]
    s = (s.withColumnRenamed("PROB_LR", "PROB_REINGRESO_LR").withColumnRenamed("PROB_RF", "PROB_REINGRESO_RF")
          .withColumnRenamed("PROB_GB", "PROB_REINGRESO_GB"))
    return rounded(export_projection(score_columns(s, best), "batch", best))


@query("weight_report")
def weight_report(spark, sf_dir):
    """Patient-report weight table from the service models (rows-only check)."""
    from carelens.plans.q_models import fitted
    from carelens.plans.train import variable_weights
    return L.weight_report(variable_weights(spark, fitted(spark, sf_dir, "service")))


def _spread_weights_sql() -> str:
    """Weights of the formula scores: |coefficient| times the variable's deviation."""
    def part(model, f):
        coef = dict(FM.FORMULAS[model][1]).get("EDAD_F" if f == "EDAD" else f, 0.0)
        x = "coalesce(CAST(EDAD AS DOUBLE), 50e0)" if f == "EDAD" else f'CAST("{f}" AS DOUBLE)'
        return f"{abs(coef)}e0 * coalesce(stddev_pop({x}), 0)"
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{f}' AS var, " + ", ".join(f"{part(m, f)} AS {FM.SHORT[m]}" for m in FM.FORMULAS) + " FROM prep_b"
        for i, f in enumerate(C.BATCH_FEATURES))
    share = ", ".join(f"{m} / sum({m}) OVER () * 100 AS {m}" for m in ("LR", "RF", "GB"))
    excluded = ", ".join(f"'{v}'" for v in C.REPORT_EXCLUDED_VARIABLES)
    return S.with_steps(S.prepared_sql("batch"), f"w0 AS ({rows})", f"w1 AS (SELECT position, var, {share} FROM w0)",
                        "w2 AS (SELECT *, (LR + RF + GB) / 3 AS mean FROM w1)") + f"""
 SELECT row_number() OVER (ORDER BY mean DESC, position) AS rank, name AS "Descripcion",
   printf('%.2f', mean) || '%' AS "Promedio modelos (%)", printf('%.2f', LR) || '%' AS "(%) Regresion logistica",
   printf('%.2f', RF) || '%' AS "(%) Random Forest", printf('%.2f', GB) || '%' AS "(%) Gradient Boosting",
   {r6('mean')} AS "PesoNum"
 FROM (SELECT w2.*, coalesce(n.name, var) AS name, row_number() OVER (PARTITION BY coalesce(n.name, var) ORDER BY mean DESC, position) AS rn
       FROM w2 LEFT JOIN (VALUES {NAMES_VALUES}) n(var2, name) ON var = n.var2 WHERE var NOT IN ({excluded})) WHERE rn = 1"""


def _formula_weights(spark, sf_dir):
    """(coefficients of the standardised features, shares of the other two) of the
    formula scores, from one aggregate of the episodes."""
    def column(f):
        return F.coalesce(F.col(f).cast("double"), F.lit(50.0)) if f == "EDAD" else F.col(f).cast("double")
    sd = I.prepared(spark, sf_dir).agg(*[F.stddev_pop(column(f)).alias(f"s{i}") for i, f in enumerate(C.BATCH_FEATURES)]).first()
    raw = [[dict(terms).get("EDAD_F" if f == "EDAD" else f, 0.0) * (sd[f"s{i}"] or 0.0) for i, f in enumerate(C.BATCH_FEATURES)]
           for _, terms in FM.FORMULAS.values()]
    total = [sum(map(abs, v)) or float("nan") for v in raw]
    return raw[0], *([abs(x) / t for x in v] for v, t in zip(raw[1:], total[1:], strict=True))


@query("weight_report_formula", _spread_weights_sql())
def weight_report_formula(spark, sf_dir):
    """The weight report over the formula scores' weights."""
    return rounded(L.weight_report(TR.weights_table(spark, C.BATCH_FEATURES, *_formula_weights(spark, sf_dir))))


def _formula_parts_sql() -> str:
    def part(model, f):
        x = "coalesce(CAST(EDAD AS DOUBLE), 50e0)" if f == "EDAD" else f'CAST("{f}" AS DOUBLE)'
        return f"{dict(FM.FORMULAS[model][1]).get('EDAD_F' if f == 'EDAD' else f, 0.0)}e0 * coalesce(stddev_pop({x}), 0)"
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{f}' AS \"Variable\", " + ", ".join(f"{part(m, f)} AS {FM.SHORT[m]}" for m in FM.FORMULAS)
                              + " FROM prep_b" for i, f in enumerate(C.BATCH_FEATURES))
    return S.with_steps(S.prepared_sql("batch"), f"w0 AS ({rows})", """w1 AS (SELECT position, "Variable", LR,
   abs(LR) / sum(abs(LR)) OVER () * 100 AS l, abs(RF) / sum(abs(RF)) OVER () AS r, abs(GB) / sum(abs(GB)) OVER () AS g FROM w0)""")


@query("variable_weights_formula", _formula_parts_sql() + f"""
 SELECT position, "Variable", {r6('LR')} AS "Coef_RegLogistica", {r6('l')} AS "Peso_RegLogistica_%", {r6('r')} AS "Importancia_RandomForest",
   {r6('r * 100')} AS "Peso_RandomForest_%", {r6('g')} AS "Importancia_GradientBoosting", {r6('g * 100')} AS "Peso_GradientBoosting_%",
   {r6('(l + r * 100 + g * 100) / 3')} AS "Peso_Promedio_%", CASE WHEN LR > 0 THEN 'aumenta riesgo' ELSE 'disminuye riesgo' END AS direction FROM w1""")
def variable_weights_formula(spark, sf_dir):
    """The weight table of the formula scores."""
    return rounded(TR.weights_table(spark, C.BATCH_FEATURES, *_formula_weights(spark, sf_dir)))


@query("importance_formula", _formula_parts_sql() + f"""
 SELECT 'lr' AS model, "Variable", {r6('LR')} AS "Coeficiente", {r6('abs(LR)')} AS "Importancia" FROM w1
 UNION ALL SELECT 'rf', "Variable", NULL, {r6('r')} FROM w1 UNION ALL SELECT 'gb', "Variable", NULL, {r6('g')} FROM w1""")
def importance_formula(spark, sf_dir):
    """The three rankings of the formula scores in one table."""
    lr, rf, gb = _formula_weights(spark, sf_dir)
    first = TR.ranking_table(spark, C.BATCH_FEATURES, lr, signed=True).select(F.lit("lr").alias("model"), "Variable", "Coeficiente",
                                                                             F.col("Importancia_Abs").alias("Importancia"))
    for name, values in (("rf", rf), ("gb", gb)):
        first = first.unionByName(TR.ranking_table(spark, C.BATCH_FEATURES, values).select(
            F.lit(name).alias("model"), "Variable", F.lit(None).cast("double").alias("Coeficiente"), "Importancia"))
    return rounded(first)


def _place(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("export_reread_csv", ORACLES["export_projection"])
def export_reread_csv(spark, sf_dir):
    """The scored export, written as CSV with a header and read again."""
    rows = export_projection_q(spark, sf_dir)
    path = _place(spark, "export-csv")
    write_table(rows, path, "csv")
    return spark.read.option("header", True).schema(rows.schema).csv(path)


@query("export_reread_parquet", ORACLES["export_projection"])
def export_reread_parquet(spark, sf_dir):
    """The scored export, written as Parquet by risk tier and read again."""
    rows = export_projection_q(spark, sf_dir)
    path = _place(spark, "export")
    write_table(rows, path, "parquet", partition_by=["NIVEL_RIESGO_REINGRESO"])
    return spark.read.parquet(path).select(*rows.columns)


def _small_csv(spark, name: str, table):
    path = _place(spark, name)
    write_small_table(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


@query("metrics_reread_csv", ORACLES["model_metrics"])
def metrics_reread_csv(spark, sf_dir):
    """The metrics table, written as one CSV file and read again."""
    return _small_csv(spark, "metrics", QUERIES["model_metrics"](spark, sf_dir))


@query("correlation_reread_csv", ORACLES["correlation_matrix"])
def correlation_reread_csv(spark, sf_dir):
    return _small_csv(spark, "correlation", QUERIES["correlation_matrix"](spark, sf_dir))


@query("target_correlation_reread_csv", ORACLES["target_correlation"])
def target_correlation_reread_csv(spark, sf_dir):
    return _small_csv(spark, "target", QUERIES["target_correlation"](spark, sf_dir))


@query("weights_reread_csv", ORACLES["variable_weights_formula"])
def weights_reread_csv(spark, sf_dir):
    return _small_csv(spark, "weights", variable_weights_formula(spark, sf_dir))
