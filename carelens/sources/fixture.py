"""The ``episodes`` test view built from the driver's synthetic tables.

One row per admission: ``orders`` are admissions, ``customer`` are patients.
The same view exists as DuckDB SQL (``EPISODES_DUCKDB``) for the oracle checks;
both follow FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.config import HOSP
from carelens.operators.windows import lag_by_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cycle(k, mapping: dict[int, str | None], default):
    """CASE k WHEN ... chain over a modulus."""
    expr = None
    for value, out in mapping.items():
        cond = k == value
        lit = F.lit(out).cast("string")
        expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
    return expr.otherwise(F.lit(default).cast("string"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admissions table with the source schema of the analysed view."""
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.to_date("o_orderdate").alias("adm"))
    o = o.withColumn("dis", F.date_add("adm", (F.col("k") % 30).cast("int")))
    # Previous discharge per patient, ordered by (admission day, order key).
    o = lag_by_key(o, key="c", order_col="adm", tie_col="k", values={"prev_dis": "dis"})
    cust = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("seg"))
    w = o.join(cust, on="c", how="inner")

    k, c = F.col("k"), F.col("c")
    s = lambda x: x.cast("string")
    ntz = lambda x: x.cast("timestamp_ntz")
    pressure = (F.when(k % 13 == 0, F.lit(None).cast("string"))
                 .when(k % 13 == 1, F.lit("SIN DATO"))
                 .when(k % 13 == 2, F.lit("120"))
                 .when(k % 13 == 3, F.lit("300/80"))
                 .when(k % 13 == 4, F.lit("120/20"))
                 .when(k % 13 == 5, F.lit("120/80 mmHg"))
                 .when(k % 13 == 6, F.lit(" 130/85 "))
                 .otherwise(F.concat(s(90 + k % 80), F.lit("/"), s(50 + k % 50))))
    return w.select(
        s(c).alias("DOCUMENTO"),
        _cycle(c % 7, {0: None, 1: "MASCULINO", 2: "MASCULINO", 3: "MASCULINO"}, "FEMENINO").alias("SEXO"),
        F.when(c % 17 == 0, F.lit(None).cast("int")).otherwise(((c * 37) % 100).cast("int")).alias("EDAD"),
        F.col("seg").alias("ASEGURADOR"),
        k.alias("INGRESO_ACTUAL"),
        ntz(F.col("adm")).alias("FECHA_INGRESO_ACTUAL"),
        F.when(k % 41 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(ntz(F.col("dis")))
         .alias("FECHA_EGRESO_DEL_INGRESO_ACTUAL"),
        F.concat(F.lit("D"), s(k % 50)).alias("COD_DX_INGRESO"),
        F.concat(F.lit("DIAGNOSTICO "), s(k % 50)).alias("NOM_DX_INGRESO"),
        F.concat(F.lit("D"), s(k % 45)).alias("COD_DX_EGRESO"),
        F.concat(F.lit("DIAGNOSTICO "), s(k % 45)).alias("NOM_DX_EGRESO"),
        _cycle(k % 11, {0: "MUERTO DESPUES DE 48 HORAS", 1: "MUERTO ANTES DE 48 HORAS",
                        2: "IGUAL O PEOR", 3: "IGUAL O PEOR", 4: None}, "MEJOR").alias("ESTADO_EGRESO"),
        F.when(k % 5 == 0, F.lit("HTA")).alias("ANTECEDENTES_PERSONALES"),
        F.when(k % 6 == 0, F.lit("DM2")).alias("ANTECEDENTES_FAMILIARES"),
        F.when(k % 4 == 0, F.lit(None).cast("double")).otherwise(((k * 7) % 300).cast("double")).alias("PESO"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).otherwise(((k * 13) % 260).cast("double")).alias("TALLA"),
        pressure.alias("PRESION_ARTERIAL"),
        (k % 6).cast("int").alias(HOSP),
        F.when(F.col("prev_dis").isNull(), F.lit("NO APLICA"))
         .otherwise(s(F.datediff(F.col("adm"), F.col("prev_dis")))).alias("TIEMPO_ULTIMA_HOSPITALIZACION"),
        (k % 30).cast("int").alias("DURACION_ESTANCIA_ACTUAL"),
        F.when(k % 23 == 0, F.lit(None).cast("int")).otherwise((k % 15).cast("int")).alias("NUMERO_MEDICAMENTOS"),
        _cycle(k % 5, {0: None, 1: "NO"}, "SI").alias("ADHERENCIA_PREVIA"),
        F.when(F.col("prev_dis").isNull(), F.lit(None).cast("string"))
         .when(k % 3 == 0, F.lit("DIFERENTE CAUSA")).otherwise(F.lit("MISMA CAUSA")).alias("CAUSA_INGRESO"),
        F.when(k % 8 == 0, F.lit("URGENCIAS")).otherwise(F.lit("HOSPITALARIO")).alias("TIPO_INGRESO"),
    )


# DuckDB twin of ``episodes`` (FIXTURES.md section 2, DuckDB dialect).
EPISODES_DUCKDB = """
o_fx AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, c.c_mktsegment AS seg,
         CAST(o.o_orderdate AS DATE) AS adm,
         CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 30 AS INT) AS dis
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
), w_fx AS (
  SELECT *, LAG(dis) OVER (PARTITION BY c ORDER BY adm, k) AS prev_dis FROM o_fx
), episodes AS (
SELECT
  CAST(c AS VARCHAR) AS DOCUMENTO,
  CASE c % 7 WHEN 0 THEN NULL WHEN 1 THEN 'MASCULINO' WHEN 2 THEN 'MASCULINO' WHEN 3 THEN 'MASCULINO' ELSE 'FEMENINO' END AS SEXO,
  CASE WHEN c % 17 = 0 THEN NULL ELSE CAST((c * 37) % 100 AS INT) END AS EDAD,
  seg AS ASEGURADOR,
  k AS INGRESO_ACTUAL,
  CAST(adm AS TIMESTAMP) AS FECHA_INGRESO_ACTUAL,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(dis AS TIMESTAMP) END AS FECHA_EGRESO_DEL_INGRESO_ACTUAL,
  CONCAT('D', CAST(k % 50 AS VARCHAR)) AS COD_DX_INGRESO,
  CONCAT('DIAGNOSTICO ', CAST(k % 50 AS VARCHAR)) AS NOM_DX_INGRESO,
  CONCAT('D', CAST(k % 45 AS VARCHAR)) AS COD_DX_EGRESO,
  CONCAT('DIAGNOSTICO ', CAST(k % 45 AS VARCHAR)) AS NOM_DX_EGRESO,
  CASE k % 11 WHEN 0 THEN 'MUERTO DESPUES DE 48 HORAS' WHEN 1 THEN 'MUERTO ANTES DE 48 HORAS'
       WHEN 2 THEN 'IGUAL O PEOR' WHEN 3 THEN 'IGUAL O PEOR' WHEN 4 THEN NULL ELSE 'MEJOR' END AS ESTADO_EGRESO,
  CASE WHEN k % 5 = 0 THEN 'HTA' ELSE NULL END AS ANTECEDENTES_PERSONALES,
  CASE WHEN k % 6 = 0 THEN 'DM2' ELSE NULL END AS ANTECEDENTES_FAMILIARES,
  CASE WHEN k % 4 = 0 THEN NULL ELSE CAST((k * 7) % 300 AS DOUBLE) END AS PESO,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST((k * 13) % 260 AS DOUBLE) END AS TALLA,
  CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN 'SIN DATO' WHEN 2 THEN '120' WHEN 3 THEN '300/80'
       WHEN 4 THEN '120/20' WHEN 5 THEN '120/80 mmHg' WHEN 6 THEN ' 130/85 '
       ELSE CONCAT(CAST(90 + k % 80 AS VARCHAR), '/', CAST(50 + k % 50 AS VARCHAR)) END AS PRESION_ARTERIAL,
  CAST(k % 6 AS INT) AS "HOSPITALIZACIONES_ULTIMO_AÑO",
  CASE WHEN prev_dis IS NULL THEN 'NO APLICA' ELSE CAST(date_diff('day', prev_dis, adm) AS VARCHAR) END AS TIEMPO_ULTIMA_HOSPITALIZACION,
  CAST(k % 30 AS INT) AS DURACION_ESTANCIA_ACTUAL,
  CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k % 15 AS INT) END AS NUMERO_MEDICAMENTOS,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NO' ELSE 'SI' END AS ADHERENCIA_PREVIA,
  CASE WHEN prev_dis IS NULL THEN NULL WHEN k % 3 = 0 THEN 'DIFERENTE CAUSA' ELSE 'MISMA CAUSA' END AS CAUSA_INGRESO,
  CASE WHEN k % 8 = 0 THEN 'URGENCIAS' ELSE 'HOSPITALARIO' END AS TIPO_INGRESO
FROM w_fx
)"""
