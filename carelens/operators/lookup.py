"""Patient lookup and report operators, in bulk.

The analysed app answers one id per click. Here a request table of any size is
validated and joined with one latest row per patient, so every patient report
is one distributed job:

* ``validate_ids``: letters and digits only; anything else is stripped and the
  request is rejected.
* ``latest_per_patient``: latest admission per trimmed patient id (NULL dates
  last, ties to the higher admission number) via a pre-aggregated ``max_by``.
* ``patient_risk``: mean of the three probabilities, tier from that mean, the
  model with the highest probability (ties: GB, RF, LR), recent stays.
* ``prior_discharge_status``: whole days since the previous discharge
  (truncated), <=15 / >15 / no data.
* ``bulk_lookup``: requests left-joined with the patient reports.
* ``weight_report``: variable weights without BMI/weight/height, display names,
  first row per display name, formatted percentages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions import clinical as X
from carelens.operators.windows import latest_by_key

WITHIN, OVER, NO_DATA = "WITHIN_15_DAYS", "OVER_15_DAYS", "NO_DATA"


def validate_ids(requests: DataFrame, raw_col: str) -> DataFrame:
    return (requests.withColumn("clean_id", X.clean_id(raw_col))
                    .withColumn("is_valid", X.is_valid_id(raw_col)))


def latest_per_patient(scored: DataFrame, id_col: str = "DOCUMENTO", date_col: str = "FECHA_INGRESO_ACTUAL",
                       tie_col: str = "INGRESO_ACTUAL", columns: list[str] | None = None) -> DataFrame:
    keyed = scored.withColumn("patient_id", F.trim(F.col(id_col).cast("string"))).filter(
        F.col("patient_id").isNotNull())
    cols = columns or [c for c in scored.columns if c != id_col]
    return latest_by_key(keyed, "patient_id", date_col, tie_col, columns=cols, count_as="n_episodes")


def top_model(gb, rf, lr):
    """Name of the highest probability; ties resolve in GB, RF, LR order."""
    gb, rf, lr = X.col(gb), X.col(rf), X.col(lr)
    best = F.greatest(gb, rf, lr)
    names = C.PATIENT_TOP_MODEL_ORDER
    return F.when(gb == best, F.lit(names[0])).when(rf == best, F.lit(names[1])).otherwise(F.lit(names[2]))


def patient_risk(latest: DataFrame, gb: str, rf: str, lr: str) -> DataFrame:
    mean = X.mean_of(gb, rf, lr)
    return (latest.withColumn("mean_probability", mean)
                  .withColumn("risk_tier", X.risk_tier("mean_probability"))
                  .withColumn("top_model", top_model(gb, rf, lr))
                  .withColumn("recent_hospitalizations",
                              F.when(F.col("n_episodes") > 1, F.col(C.HOSP).cast("int"))))


def prior_discharge_status(df: DataFrame, days_col: str = "DIAS_DESDE_EGRESO_ANTERIOR") -> DataFrame:
    d = X.truncated_days(days_col)
    return (df.withColumn("days_since_discharge", d)
              .withColumn("discharge_status",
                          F.when(F.col("days_since_discharge").isNull(), F.lit(NO_DATA))
                           .when(F.col("days_since_discharge") <= C.READMISSION_DAYS, F.lit(WITHIN))
                           .otherwise(F.lit(OVER))))


def bulk_lookup(requests: DataFrame, raw_col: str, reports: DataFrame) -> DataFrame:
    """One row per request: validation, match status and the patient's report."""
    req = validate_ids(requests, raw_col)
    joined = req.join(reports, on=(req["is_valid"] & (req["clean_id"] == reports["patient_id"])), how="left")
    status = (F.when(~F.col("is_valid"), F.lit("INVALID"))
               .when(F.col("patient_id").isNull(), F.lit("NOT_FOUND"))
               .otherwise(F.lit("FOUND")))
    return joined.withColumn("status", status)


def patient_episodes(requests: DataFrame, raw_col: str, episodes: DataFrame, id_col: str = "DOCUMENTO") -> DataFrame:
    """Every admission of the (valid) requested patients, matched on the trimmed id."""
    req = validate_ids(requests, raw_col).filter("is_valid").select(F.col("clean_id").alias("__rid"))
    eps = episodes.withColumn("__pid", F.trim(F.col(id_col).cast("string")))
    return eps.join(req, on=eps["__pid"] == req["__rid"], how="left_semi").drop("__pid")


def display_names(df: DataFrame, var_col: str = "Variable", out: str = "display_name") -> DataFrame:
    spark = df.sparkSession
    names = spark.createDataFrame(list(C.VARIABLE_NAMES.items()), "__var string, __name string")
    # The name map is a fixed 9-row table.
    j = df.join(F.broadcast(names), on=df[var_col] == names["__var"], how="left")
    return j.withColumn(out, F.coalesce(F.col("__name"), F.col(var_col))).drop("__var", "__name")


def weight_report(weights: DataFrame) -> DataFrame:
    w = weights.filter(~F.col("Variable").isin(*C.REPORT_EXCLUDED_VARIABLES))
    w = display_names(w, "Variable", "Descripcion")
    # One row per model feature reaches these windows.
    first = Window.partitionBy("Descripcion").orderBy(F.col("`Peso_Promedio_%`").desc(), F.col("position"))
    w = w.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") == 1)

    def pct(c):
        return F.concat(F.format_string("%.2f", F.col(f"`{c}`")), F.lit("%"))
    rank = Window.orderBy(F.col("`Peso_Promedio_%`").desc(), F.col("position"))
    return w.select(
        F.row_number().over(rank).alias("rank"), "Descripcion",
        pct("Peso_Promedio_%").alias("Promedio modelos (%)"),
        pct("Peso_RegLogistica_%").alias("(%) Regresion logistica"),
        pct("Peso_RandomForest_%").alias("(%) Random Forest"),
        pct("Peso_GradientBoosting_%").alias("(%) Gradient Boosting"),
        F.col("`Peso_Promedio_%`").alias("PesoNum"))
