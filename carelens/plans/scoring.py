"""Scoring columns and the export projections of the two variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions import clinical as X

PROB_COLS = {"lr": "PROB_REINGRESO_LR", "rf": "PROB_REINGRESO_RF", "gb": "PROB_REINGRESO_GB"}


def _best_key(best: str) -> str:
    for key, name in (("lr", C.MODEL_LR), ("rf", C.MODEL_RF), ("gb", C.MODEL_GB)):
        if best == name:
            return key
    if best == "Regresion Logistica":
        return "lr"
    raise ValueError(f"unknown model {best!r}")


def score_columns(df: DataFrame, best: str) -> DataFrame:
    """Main probability = the best model's, ensemble = mean of three, tier from the main one."""
    main = F.col(PROB_COLS[_best_key(best)])
    return (df.withColumn("PROBABILIDAD_REINGRESO", main)
              .withColumn("PROB_REINGRESO_ENSEMBLE", X.mean_of(*PROB_COLS.values()))
              .withColumn("NIVEL_RIESGO_REINGRESO", X.risk_tier("PROBABILIDAD_REINGRESO")))


# Export column lists and renames (fixed output contract).
BATCH_EXPORT = [
    "DOCUMENTO", "SEXO_TEXTO", "EDAD", "GRUPO_EDAD", "ASEGURADOR", "INGRESO_ACTUAL",
    "FECHA_INGRESO_ACTUAL", "FECHA_EGRESO_DEL_INGRESO_ACTUAL", "COD_DX_INGRESO", "NOM_DX_INGRESO",
    "COD_DX_EGRESO", "NOM_DX_EGRESO", "ESTADO_EGRESO_TEXTO", "PESO", "TALLA", "IMC", "CATEGORIA_IMC",
    C.HOSP, "PRESION_ARTERIAL", "PRESION_SISTOLICA", "PRESION_DIASTOLICA", "PRESION_ARTERIAL_MEDIA",
    "DURACION_ESTANCIA_ACTUAL", "NUMERO_MEDICAMENTOS", "ADHERENCIA_TEXTO", "DIAS_DESDE_EGRESO_ANTERIOR",
    "REINGRESO", "PROBABILIDAD_REINGRESO", "PROB_REINGRESO_LR", "PROB_REINGRESO_RF", "PROB_REINGRESO_GB",
    "PROB_REINGRESO_ENSEMBLE", "NIVEL_RIESGO_REINGRESO",
]
BATCH_RENAMES = {
    "SEXO_TEXTO": "SEXO",
    "ESTADO_EGRESO_TEXTO": "ESTADO_EGRESO",
    "ADHERENCIA_TEXTO": "ADHERENCIA_TRATAMIENTO",
    "PROBABILIDAD_REINGRESO": "PROBABILIDAD_REINGRESO_MEJOR_MODELO",
    "PROB_REINGRESO_LR": "PROBABILIDAD_REG_LOGISTICA",
    "PROB_REINGRESO_RF": "PROBABILIDAD_RANDOM_FOREST",
    "PROB_REINGRESO_GB": "PROBABILIDAD_GRADIENT_BOOSTING",
    "PROB_REINGRESO_ENSEMBLE": "PROBABILIDAD_PROMEDIO_3_MODELOS",
}
SERVICE_EXPORT = [
    "DOCUMENTO", "SEXO_TEXTO", "EDAD", "GRUPO_EDAD", "ASEGURADOR", "INGRESO_ACTUAL",
    "FECHA_INGRESO_ACTUAL", "FECHA_EGRESO_DEL_INGRESO_ACTUAL", "COD_DX_INGRESO", "NOM_DX_INGRESO",
    "COD_DX_EGRESO", "NOM_DX_EGRESO", "ESTADO_EGRESO_TEXTO", "PRESION_ARTERIAL", "IMC", "CATEGORIA_IMC",
    C.HOSP, "DURACION_ESTANCIA_ACTUAL", "NUMERO_MEDICAMENTOS", "ADHERENCIA_TEXTO",
    "DIAS_DESDE_EGRESO_ANTERIOR", "REINGRESO", "PROBABILIDAD_REINGRESO", "PROB_REINGRESO_LR",
    "PROB_REINGRESO_RF", "PROB_REINGRESO_GB", "PROB_REINGRESO_ENSEMBLE", "NIVEL_RIESGO_REINGRESO",
    "CAUSA_INGRESO",
]
SERVICE_RENAMES = {
    "SEXO_TEXTO": "SEXO",
    "ESTADO_EGRESO_TEXTO": "ESTADO_EGRESO",
    "ADHERENCIA_TEXTO": "ADHERENCIA_TRATAMIENTO",
    "PROB_REINGRESO_LR": "PROB_LR",
    "PROB_REINGRESO_RF": "PROB_RF",
    "PROB_REINGRESO_GB": "PROB_GB",
}


def export_projection(scored: DataFrame, variant: str = "batch", best: str | None = None) -> DataFrame:
    """Select, rename and (batch) add the ``MODELO_USADO`` literal."""
    cols, renames = (BATCH_EXPORT, BATCH_RENAMES) if variant == "batch" else (SERVICE_EXPORT, SERVICE_RENAMES)
    out = scored.select(*[F.col(c).alias(renames.get(c, c)) for c in cols])
    if variant == "batch" and best is not None:
        out = out.withColumn("MODELO_USADO", F.lit(best))
    return out
