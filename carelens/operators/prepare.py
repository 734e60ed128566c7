"""Feature preparation and the readmission label, as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import config as C
from carelens.config import Config
from carelens.functions import clinical as X
from carelens.operators.windows import lag_by_key


def add_label(df: DataFrame) -> DataFrame:
    """Readmission = same cause AND at most 15 days since the previous discharge.

    The raw day text is kept as ``DIAS_DESDE_EGRESO_ANTERIOR`` before parsing.
    """
    return (df.withColumn("DIAS_DESDE_EGRESO_ANTERIOR", F.col("TIEMPO_ULTIMA_HOSPITALIZACION"))
              .withColumn("ES_MISMA_CAUSA", X.same_cause("CAUSA_INGRESO"))
              .withColumn("TIEMPO_ULTIMA_HOSPITALIZACION", X.parse_number("TIEMPO_ULTIMA_HOSPITALIZACION"))
              .withColumn("DENTRO_15_DIAS", X.within_days("TIEMPO_ULTIMA_HOSPITALIZACION"))
              .withColumn("REINGRESO", X.readmission("ES_MISMA_CAUSA", "DENTRO_15_DIAS")))


def add_texts(df: DataFrame) -> DataFrame:
    return (df.withColumn("ADHERENCIA_TEXTO", X.decode("ADHERENCIA_PREVIA", C.ADHERENCE_TEXT))
              .withColumn("SEXO_TEXTO", X.decode("SEXO", C.SEX_TEXT))
              .withColumn("ESTADO_EGRESO_TEXTO", X.decode("ESTADO_EGRESO", C.DISCHARGE_STATE_TEXT)))


def add_previous_discharge(df: DataFrame) -> DataFrame:
    """Previous discharge date per patient by admission date (nulls last), then admission number."""
    return lag_by_key(df, key="DOCUMENTO", order_col="FECHA_INGRESO_ACTUAL", tie_col="INGRESO_ACTUAL",
                      values={"FECHA_EGRESO_ANTERIOR": "FECHA_EGRESO_DEL_INGRESO_ACTUAL"})


def add_pressure(df: DataFrame, src: str = "PRESION_ARTERIAL") -> DataFrame:
    """Systolic, diastolic and mean pressure (batch rules), parsed in stages.

    Each stage is its own projection so the text is stripped, split and parsed
    once per row; Catalyst keeps projections apart when an expensive expression
    is referenced more than once.
    """
    sys_lo, sys_hi = C.SYSTOLIC_RANGE
    dia_lo, dia_hi = C.DIASTOLIC_RANGE
    df = df.withColumn("__ps", F.regexp_replace(F.col(src).cast("string"), X.EDGE_SPACE, ""))
    df = df.withColumn("__parts", F.when(F.col("__ps").contains("/"), F.split("__ps", "/")))
    df = (df.withColumn("__sys", X.parse_number(F.get(F.col("__parts"), 0)))
            .withColumn("__dia", X.parse_number(F.get(F.col("__parts"), 1))))
    df = (df.withColumn("PRESION_SISTOLICA", F.when(F.col("__sys").between(sys_lo, sys_hi), F.col("__sys")))
            .withColumn("PRESION_DIASTOLICA", F.when(F.col("__dia").between(dia_lo, dia_hi), F.col("__dia"))))
    df = df.withColumn("PRESION_ARTERIAL_MEDIA", X.mean_arterial("PRESION_SISTOLICA", "PRESION_DIASTOLICA"))
    return df.drop("__ps", "__parts", "__sys", "__dia")


def prepare(extracted: DataFrame, cfg: Config = Config(), with_previous_discharge: bool = False) -> DataFrame:
    """Extracted episodes -> model-ready rows (features, bands, label, texts)."""
    df = extracted
    if cfg.variant == "service":
        df = df.withColumn("PRESION_ARTERIAL", X.systolic_lenient("PRESION_ARTERIAL"))
    df = (df.withColumn("IMC", X.bmi("PESO", "TALLA"))
            .withColumn("CATEGORIA_IMC", X.bmi_band("IMC"))
            .withColumn("GRUPO_EDAD", X.age_band("EDAD")))
    if cfg.variant == "batch":
        df = add_pressure(df, "PRESION_ARTERIAL")
    if with_previous_discharge:
        df = add_previous_discharge(df)
    return add_texts(add_label(df))
