"""Formula scores: deterministic stand-ins for the three models' probabilities.

The evaluation, tier, histogram and report operators are generic over a
predictions table. To check them against DuckDB without training (tree models
can't be reproduced in SQL), they also run on these closed-form scores of the
prepared episodes. Rounded to 6 places so both engines see identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators.split import stratified_split
from carelens.plans import inputs as I
from carelens.plans import sql_twins as S

# model -> (intercept, [(column, coefficient)]); NULL age counts as 50.
FORMULAS = {
    C.MODEL_LR: (-1.5, [("EDAD_F", 0.02), ("DURACION_ESTANCIA_ACTUAL", -0.05), ("ADHERENCIA_PREVIA", 0.3),
                        ("REINGRESO", 0.1)]),
    C.MODEL_RF: (-1.5, [("EDAD_F", 0.01), (C.HOSP, 0.1), ("REINGRESO", 0.5)]),
    C.MODEL_GB: (-1.0, [("DURACION_ESTANCIA_ACTUAL", -0.03), ("ESTADO_EGRESO", 0.2), ("REINGRESO", 0.4)]),
}
SHORT = {C.MODEL_LR: "LR", C.MODEL_RF: "RF", C.MODEL_GB: "GB"}


def _spark_formula(model: str):
    b0, terms = FORMULAS[model]
    z = F.lit(b0)
    for c, w in terms:
        src = F.coalesce(F.col("EDAD").cast("double"), F.lit(50.0)) if c == "EDAD_F" else F.col(c).cast("double")
        z = z + F.lit(w) * src
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)


def _sql_formula(model: str) -> str:
    b0, terms = FORMULAS[model]
    parts = [f"{b0}e0"]
    for c, w in terms:
        src = "coalesce(CAST(EDAD AS DOUBLE), 50e0)" if c == "EDAD_F" else f'CAST("{c}" AS DOUBLE)'
        parts.append(f"{w}e0 * {src}")
    return f"round(1e0 / (1e0 + exp(-({' + '.join(parts)}))), 6)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared batch episodes + one probability column per model."""
    return _with_scores(I.prepared(spark, sf_dir))


def _with_scores(df: DataFrame) -> DataFrame:
    for m in FORMULAS:
        df = df.withColumn(f"PROB_{SHORT[m]}", _spark_formula(m))
    return df


def predictions(spark: SparkSession, sf_dir: str, test_only: bool = True) -> DataFrame:
    """Long table (model, INGRESO_ACTUAL, label, score, prediction)."""
    df = I.prepared(spark, sf_dir)
    if test_only:
        df = stratified_split(df, label="REINGRESO", id_col="INGRESO_ACTUAL").filter("is_test")
    df = _with_scores(df)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"PROB_{SHORT[m]}").alias("score"))
                               for m in FORMULAS]))
    out = df.select("INGRESO_ACTUAL", F.col("REINGRESO").alias("label"), rows.alias("p"))
    return (out.select(F.col("p.model").alias("model"), "INGRESO_ACTUAL", "label", F.col("p.score").alias("score"))
               .withColumn("prediction", (F.col("score") > 0.5).cast("int")))


def dense_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table over every admission with a score of its own per row: 52 bits
    of a hash of model and admission, pulled towards the label. Evaluation must
    not depend on scores having few distinct values."""
    models = F.explode(F.array(*[F.lit(m) for m in FORMULAS]))
    df = I.prepared(spark, sf_dir).select("INGRESO_ACTUAL", F.col("REINGRESO").alias("label"), models.alias("model"))
    digits = F.substring(F.md5(F.concat(F.col("model"), F.lit(":"), F.col("INGRESO_ACTUAL").cast("string"))), 1, 13)
    unit = F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(2.0 ** 52)
    score = unit * 0.75 + F.col("label").cast("double") * 0.25
    return (df.select("model", "INGRESO_ACTUAL", "label", score.alias("score"))
              .withColumn("prediction", (F.col("score") > 0.5).cast("int")))


# ---- DuckDB twins -------------------------------------------------------

SPLIT_B = f"""split_r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY REINGRESO
      ORDER BY substr(md5('{C.SEED}:' || CAST(INGRESO_ACTUAL AS VARCHAR)), 1, 15), INGRESO_ACTUAL) AS _rn,
    COUNT(*) OVER (PARTITION BY REINGRESO) AS _nc
  FROM prep_b
), split_b AS (
  SELECT * EXCLUDE (_rn, _nc), _rn <= (_nc * {int(round(C.TEST_SHARE * 10))} + 5) // 10 AS is_test FROM split_r
)"""

SCORED_B = f"""scored_b AS (
  SELECT *, {_sql_formula(C.MODEL_LR)} AS PROB_LR, {_sql_formula(C.MODEL_RF)} AS PROB_RF,
         {_sql_formula(C.MODEL_GB)} AS PROB_GB
  FROM split_b
)"""

PREDS_ALL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, INGRESO_ACTUAL, REINGRESO AS label, PROB_{SHORT[m]} AS score, "
    f"CAST(PROB_{SHORT[m]} > 0.5 AS INTEGER) AS prediction, is_test FROM scored_b"
    for m in FORMULAS)
PREDS = f"""preds_all AS ({PREDS_ALL}), preds AS (SELECT * EXCLUDE (is_test) FROM preds_all WHERE is_test)"""

# Running counts per distinct score, descending, with the next score's counts.
RUNNING = """counts AS (
  SELECT model, score, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
  FROM preds GROUP BY model, score
), totals AS (
  SELECT model, COUNT(*) FILTER (WHERE label = 1) AS P, COUNT(*) FILTER (WHERE label = 0) AS N FROM preds GROUP BY model
), running AS (
  SELECT c.*, t.P, t.N,
    SUM(pos) OVER (PARTITION BY c.model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
    SUM(neg) OVER (PARTITION BY c.model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
    LEAD(pos) OVER (PARTITION BY c.model ORDER BY score DESC) AS next_pos,
    LEAD(neg) OVER (PARTITION BY c.model ORDER BY score DESC) AS next_neg
  FROM counts c JOIN totals t ON c.model = t.model
)"""

AUC = """auc AS (
  SELECT model, coalesce(SUM(neg * (tps - pos / 2.0)) / NULLIF(ANY_VALUE(P) * ANY_VALUE(N), 0), 0.5) AS roc_auc
  FROM running GROUP BY model
)"""

MODEL_RANK = "(CASE " + " ".join(f"WHEN model = '{m}' THEN {i}" for i, m in enumerate(C.MODEL_ORDER)) + \
    f" ELSE {len(C.MODEL_ORDER)} END)"

METRICS = f"""cm AS (
  SELECT model, COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM preds GROUP BY model
), metrics AS (
  SELECT cm.model,
    (tp + tn) * 100.0 / NULLIF(tp + tn + fp + fn, 0) AS accuracy_pct,
    coalesce(tp * 1.0 / NULLIF(tp + fp, 0), 0) * 100 AS precision_pct,
    coalesce(tp * 1.0 / NULLIF(tp + fn, 0), 0) * 100 AS recall_pct,
    coalesce(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) * 100 AS f1_pct,
    auc.roc_auc * 100 AS roc_auc_pct
  FROM cm LEFT JOIN auc ON cm.model = auc.model
), best AS (
  SELECT model AS best_model FROM metrics ORDER BY roc_auc_pct DESC NULLS LAST, {MODEL_RANK} LIMIT 1
)"""


def chain(*extra: str) -> str:
    return S.with_steps(S.prepared_sql("batch"), SPLIT_B, SCORED_B, PREDS, *extra)


DENSE = f"""dense_r AS (
  SELECT m.model, INGRESO_ACTUAL, REINGRESO AS label,
    CAST(CAST('0x' || substr(md5(m.model || ':' || CAST(INGRESO_ACTUAL AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496e0 * 0.75e0 + CAST(REINGRESO AS DOUBLE) * 0.25e0 AS score
  FROM prep_b, (SELECT unnest([{', '.join(f"'{m}'" for m in FORMULAS)}]) AS model) m
), preds AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS prediction FROM dense_r)"""


def dense_chain(*extra: str) -> str:
    return S.with_steps(S.prepared_sql("batch"), DENSE, *extra)
