"""Job configuration and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the analysed system's values for the results
# to match; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# Source text -> numeric code (unknown text -> 0).
SEX_CODES = {"MASCULINO": 1, "FEMENINO": 2}
DISCHARGE_STATE_CODES = {
    "MEJOR": 1,
    "IGUAL O PEOR": 2,
    "MUERTO DESPUES DE 48 HORAS": 3,
    "MUERTO ANTES DE 48 HORAS": 4,
}
ADHERENCE_CODES = {"SI": 1, "NO": 2}
CAUSE_CODES = {"DIFERENTE CAUSA": 1, "MISMA CAUSA": 2}
SAME_CAUSE_CODE = 2

# Numeric code -> display text (unknown code -> NULL).
ADHERENCE_TEXT = {0: "Sin dato", 1: "Con tratamiento", 2: "Sin tratamiento"}
SEX_TEXT = {0: "Sin dato", 1: "Masculino", 2: "Femenino"}
DISCHARGE_STATE_TEXT = {
    0: "Sin dato",
    1: "Mejor",
    2: "Igual o Peor",
    3: "Muerto >48h",
    4: "Muerto <48h",
}

# Range guards, inclusive on both ends.
WEIGHT_RANGE = (0.2, 250.0)
HEIGHT_RANGE = (20.0, 225.0)
SYSTOLIC_RANGE = (60.0, 250.0)
DIASTOLIC_RANGE = (30.0, 150.0)

# Bands: (upper bound exclusive, label), the last label is the catch-all.
NO_DATA = "Sin dato"
BMI_BANDS = [(18.5, "Bajo peso"), (25.0, "Normal"), (30.0, "Sobrepeso")]
BMI_TOP = "Obesidad"
AGE_BANDS = [(30, "Joven"), (50, "Adulto"), (65, "Adulto Mayor")]
AGE_TOP = "Tercera Edad"

# Readmission: same cause and at most this many days since the previous discharge.
READMISSION_DAYS = 15

# Risk tiers: (lower bound inclusive, tier), else the last tier.
RISK_TIERS = [(0.7, "ALTO"), (0.4, "MEDIO")]
RISK_BOTTOM = "BAJO"
RISK_ORDER = ["ALTO", "MEDIO", "BAJO"]

INPATIENT = "HOSPITALARIO"

# Model display names, in the tie-break order of the best-AUC choice.
MODEL_LR = "Regresión Logística"
MODEL_RF = "Random Forest"
MODEL_GB = "Gradient Boosting"
MODEL_ORDER = [MODEL_LR, MODEL_RF, MODEL_GB]
# The service variant writes this name without accents.
MODEL_ALIASES = {MODEL_LR: "Regresion Logistica"}
# The patient report's per-patient "top model" ties resolve in this order.
PATIENT_TOP_MODEL_ORDER = ["Gradient Boosting", "Random Forest", "Regresion Logistica"]

# Variable -> display name for the weight report.
VARIABLE_NAMES = {
    "DURACION_ESTANCIA_ACTUAL": "Variable asociada estancia actual",
    "HOSPITALIZACIONES_ULTIMO_AÑO": "Historico hospitalizacion",
    "NUMERO_MEDICAMENTOS": "Suministro de medicamentos",
    "EDAD": "Variables segun clasificacion etaria",
    "SEXO": "Clasificacion del grupo biologico",
    "PRESION_ARTERIAL": "Perfil hemodinámico arterial",
    "ESTADO_EGRESO": "Estado de egreso actual del usuario",
    "ADHERENCIA_PREVIA": "Formulacion de medicamentos al momento del egreso",
    "ADHERENCIA_TRATAMIENTO": "Formulacion de medicamentos al momento del egreso",
}
# Variables left out of the patient weight report.
REPORT_EXCLUDED_VARIABLES = ["IMC", "PESO", "TALLA"]

# Column-name candidates of the patient report, first existing wins.
COLUMN_CANDIDATES = {
    "patient_id": ["CEDULA", "DOCUMENTO", "id"],
    "prob_gb": ["PROB_GB", "PROBABILIDAD_GRADIENT_BOOSTING", "PROB_REINGRESO_GB"],
    "prob_rf": ["PROB_RF", "PROBABILIDAD_RANDOM_FOREST", "PROB_REINGRESO_RF"],
    "prob_lr": ["PROB_LR", "PROBABILIDAD_REG_LOGISTICA", "PROB_REINGRESO_LR"],
    "days_since_discharge": ["DIAS_DESDE_EGRESO_ANTERIOR", "DIAS_EGRESO", "DIAS_DESDE_EGRESO"],
    "admission_date": ["FECHA_INGRESO_ACTUAL", "FECHA_INGRESO", "FEC_INGRESO"],
    "hospitalizations": ["HOSPITALIZACIONES_ULTIMO_AÑO"],
    "adherence": ["ADHERENCIA_TRATAMIENTO", "ADHERENCIA_TEXTO"],
    "cause": ["CAUSA_INGRESO", "CAUSA", "MOTIVO_INGRESO"],
}
REQUIRED_REPORT_COLUMNS = ["patient_id", "prob_gb", "prob_rf", "prob_lr"]

# Model sizes and split.
TEST_SHARE = 0.3
SEED = 42
LR_MAX_ITER = 1000
FOREST_TREES = 100
TREE_DEPTH = 5
BOOST_ROUNDS = 100
BOOST_RATE = 0.1
KNN_NEIGHBOURS = 5
HISTOGRAM_BINS = 30
FEW_POSITIVES = 10

HOSP = "HOSPITALIZACIONES_ULTIMO_AÑO"

BATCH_FEATURES = [
    "SEXO",
    "EDAD",
    HOSP,
    "DURACION_ESTANCIA_ACTUAL",
    "NUMERO_MEDICAMENTOS",
    "ADHERENCIA_PREVIA",
    "ESTADO_EGRESO",
    "IMC",
    "PRESION_ARTERIAL_MEDIA",
]
SERVICE_FEATURES = [
    "SEXO",
    "EDAD",
    HOSP,
    "DURACION_ESTANCIA_ACTUAL",
    "NUMERO_MEDICAMENTOS",
    "ADHERENCIA_PREVIA",
    "ESTADO_EGRESO",
    "PRESION_ARTERIAL",
]


@dataclass(frozen=True)
class Config:
    """Two variants of one pipeline.

    ``batch``: every admission type, pressure split into systolic/diastolic/mean,
    9 features with BMI, median imputation, class weights from training rows,
    unweighted boosting.
    ``service``: inpatients only, systolic text kept as the pressure feature,
    8 features, KNN imputation, class weights from all rows, weighted boosting.
    """

    variant: str = "batch"
    fit_on: str = "all"  # imputation statistics from "all" rows (as analysed) or "train"
    seed: int = SEED
    max_bins: int = 128
    collation: str | None = None  # of category texts in the source; None: exact
    median_error: float | None = None  # rank error of imputed medians, as a share of the rows; None: exact

    def __post_init__(self):
        if self.variant not in ("batch", "service"):
            raise ValueError(f"unknown variant {self.variant!r}")
        if self.fit_on not in ("all", "train"):
            raise ValueError(f"unknown fit_on {self.fit_on!r}")

    @property
    def only_inpatient(self) -> bool:
        return self.variant == "service"

    @property
    def features(self) -> list[str]:
        return list(BATCH_FEATURES if self.variant == "batch" else SERVICE_FEATURES)

    @property
    def weights_from(self) -> str:
        return "train" if self.variant == "batch" else "all"

    @property
    def weighted_boosting(self) -> bool:
        return self.variant == "service"

    @property
    def model_names(self) -> dict[str, str]:
        lr = MODEL_LR if self.variant == "batch" else MODEL_ALIASES[MODEL_LR]
        return {"lr": lr, "rf": MODEL_RF, "gb": MODEL_GB}
