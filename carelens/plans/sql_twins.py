"""DuckDB SQL twins of the Spark operators, used as correctness oracles.

Each oracle is ``WITH <fixture>, <steps> SELECT ...`` over the driver's base
tables. The helpers build the shared CTE chain once; every oracle picks the
steps it needs.
"""

from __future__ import annotations

from carelens import config as C
from carelens.functions.clinical import EDGE_SPACE, NUMBER_TEXT
from carelens.sources.fixture import EPISODES_DUCKDB

HOSP_Q = '"HOSPITALIZACIONES_ULTIMO_AÑO"'


def num(x: str) -> str:
    """Text -> double with the same guard as ``clinical.parse_number``."""
    t = f"CAST({x} AS VARCHAR)"
    return (f"(CASE WHEN regexp_matches({t}, '{NUMBER_TEXT}') "
            f"THEN TRY_CAST(regexp_replace({t}, '{EDGE_SPACE}', '', 'g') AS DOUBLE) END)")


def encode(colname: str, codes: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {colname} = '{t}' THEN {c}" for t, c in codes.items())
    return f"(CASE {whens} ELSE 0 END)"


def decode(colname: str, texts: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {colname} = {c} THEN '{t}'" for c, t in texts.items())
    return f"(CASE {whens} END)"


def band(colname: str, bands, top: str) -> str:
    whens = " ".join(f"WHEN {colname} < {u} THEN '{lab}'" for u, lab in bands)
    return f"(CASE WHEN {colname} IS NULL THEN '{C.NO_DATA}' {whens} ELSE '{top}' END)"


def tier(p: str) -> str:
    whens = " ".join(f"WHEN {p} >= {lo} THEN '{t}'" for lo, t in C.RISK_TIERS)
    return f"(CASE {whens} ELSE '{C.RISK_BOTTOM}' END)"


def tier_rank(t: str) -> str:
    whens = " ".join(f"WHEN {t} = '{x}' THEN {i}" for i, x in enumerate(C.RISK_ORDER))
    return f"(CASE {whens} END)"


def extract_sql(name: str, only_inpatient: bool) -> str:
    where = f"WHERE TIPO_INGRESO = '{C.INPATIENT}'" if only_inpatient else ""
    return f"""{name} AS (
  SELECT DOCUMENTO, {encode('SEXO', C.SEX_CODES)} AS SEXO, EDAD, ASEGURADOR, INGRESO_ACTUAL,
    FECHA_INGRESO_ACTUAL, FECHA_EGRESO_DEL_INGRESO_ACTUAL,
    COD_DX_INGRESO, NOM_DX_INGRESO, COD_DX_EGRESO, NOM_DX_EGRESO,
    {encode('ESTADO_EGRESO', C.DISCHARGE_STATE_CODES)} AS ESTADO_EGRESO,
    ANTECEDENTES_PERSONALES, ANTECEDENTES_FAMILIARES,
    CASE WHEN PESO BETWEEN {C.WEIGHT_RANGE[0]} AND {C.WEIGHT_RANGE[1]} THEN PESO END AS PESO,
    CASE WHEN TALLA BETWEEN {C.HEIGHT_RANGE[0]} AND {C.HEIGHT_RANGE[1]} THEN TALLA END AS TALLA,
    PRESION_ARTERIAL, {HOSP_Q}, TIEMPO_ULTIMA_HOSPITALIZACION, DURACION_ESTANCIA_ACTUAL, NUMERO_MEDICAMENTOS,
    {encode('ADHERENCIA_PREVIA', C.ADHERENCE_CODES)} AS ADHERENCIA_PREVIA,
    {encode('CAUSA_INGRESO', C.CAUSE_CODES)} AS CAUSA_INGRESO
  FROM episodes {where}
)"""


def prepared_sql(variant: str) -> str:
    """CTE chain ending in ``prep_<b|v>``: the DuckDB twin of ``prepare``."""
    v = "b" if variant == "batch" else "v"
    steps = [EPISODES_DUCKDB.strip(), extract_sql(f"ext_{v}", only_inpatient=(v == "v"))]
    if v == "b":
        steps.append(f"""p1_b AS (
  SELECT *, regexp_replace(PRESION_ARTERIAL, '{EDGE_SPACE}', '', 'g') AS _ps FROM ext_b
)""")
        steps.append(f"""p2_b AS (
  SELECT * EXCLUDE (_ps),
    CASE WHEN contains(_ps, '/') AND {num("string_split(_ps, '/')[1]")} BETWEEN {C.SYSTOLIC_RANGE[0]} AND {C.SYSTOLIC_RANGE[1]}
         THEN {num("string_split(_ps, '/')[1]")} END AS PRESION_SISTOLICA,
    CASE WHEN contains(_ps, '/') AND {num("string_split(_ps, '/')[2]")} BETWEEN {C.DIASTOLIC_RANGE[0]} AND {C.DIASTOLIC_RANGE[1]}
         THEN {num("string_split(_ps, '/')[2]")} END AS PRESION_DIASTOLICA
  FROM p1_b
)""")
        src = "p2_b"
        pressure_cols = ", (PRESION_SISTOLICA + 2 * PRESION_DIASTOLICA) / 3 AS PRESION_ARTERIAL_MEDIA"
    else:
        steps.append(f"""p2_v AS (
  SELECT * REPLACE ({num("string_split(CAST(PRESION_ARTERIAL AS VARCHAR), '/')[1]")} AS PRESION_ARTERIAL) FROM ext_v
)""")
        src = "p2_v"
        pressure_cols = ""
    steps.append(f"""p3_{v} AS (
  SELECT *,
    CASE WHEN PESO IS NOT NULL AND TALLA IS NOT NULL AND TALLA > 0 THEN PESO / pow(TALLA / 100.0, 2) END AS IMC
    {pressure_cols}
  FROM {src}
)""")
    steps.append(f"""prep_{v} AS (
  SELECT * REPLACE ({num('TIEMPO_ULTIMA_HOSPITALIZACION')} AS TIEMPO_ULTIMA_HOSPITALIZACION),
    {band('IMC', C.BMI_BANDS, C.BMI_TOP)} AS CATEGORIA_IMC,
    {band('EDAD', C.AGE_BANDS, C.AGE_TOP)} AS GRUPO_EDAD,
    TIEMPO_ULTIMA_HOSPITALIZACION AS DIAS_DESDE_EGRESO_ANTERIOR,
    coalesce(CAUSA_INGRESO = {C.SAME_CAUSE_CODE}, false) AS ES_MISMA_CAUSA,
    coalesce({num('TIEMPO_ULTIMA_HOSPITALIZACION')} <= {C.READMISSION_DAYS}, false) AS DENTRO_15_DIAS,
    CAST(coalesce(CAUSA_INGRESO = {C.SAME_CAUSE_CODE}, false)
         AND coalesce({num('TIEMPO_ULTIMA_HOSPITALIZACION')} <= {C.READMISSION_DAYS}, false) AS INTEGER) AS REINGRESO,
    {decode('ADHERENCIA_PREVIA', C.ADHERENCE_TEXT)} AS ADHERENCIA_TEXTO,
    {decode('SEXO', C.SEX_TEXT)} AS SEXO_TEXTO,
    {decode('ESTADO_EGRESO', C.DISCHARGE_STATE_TEXT)} AS ESTADO_EGRESO_TEXTO
  FROM p3_{v}
)""")
    return ",\n".join(steps)


def with_steps(*steps: str) -> str:
    return "WITH " + ",\n".join(s.strip() for s in steps if s.strip())
