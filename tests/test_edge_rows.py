"""Hand-made edge rows (FIXTURES.md section 3) through the Spark expressions."""

import pytest
from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions import clinical as X
from carelens.operators import evaluate as E
from carelens.operators.correlation import correlation_matrix
from carelens.operators.lookup import prior_discharge_status, top_model, validate_ids
from carelens.operators.prepare import add_label, add_pressure


def _one_col(spark, values, type_="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")


def test_pressure_batch(spark):
    vals = ["120/80", " 130/85 ", "120/80 mmHg", "120", "", None, "SIN DATO", "300/80", "120/20",
            "60/30", "250/150"]
    df = add_pressure(_one_col(spark, vals).withColumnRenamed("v", "PRESION_ARTERIAL"))
    got = {r.i: (r.PRESION_SISTOLICA, r.PRESION_DIASTOLICA, r.PRESION_ARTERIAL_MEDIA) for r in df.collect()}
    assert got[0][:2] == (120.0, 80.0) and abs(got[0][2] - 93.3333333) < 1e-6
    assert got[1][:2] == (130.0, 85.0)
    assert got[2] == (120.0, None, None)
    for i in (3, 4, 5, 6):
        assert got[i] == (None, None, None)
    assert got[7][:2] == (None, 80.0)
    assert got[8][:2] == (120.0, None)
    assert got[9][:2] == (60.0, 30.0) and got[10][:2] == (250.0, 150.0)


def test_pressure_service(spark):
    df = _one_col(spark, ["120", "300/80", "SIN DATO"]).select("i", X.systolic_lenient("v").alias("p"))
    assert [r.p for r in df.orderBy("i").collect()] == [120.0, 300.0, None]


def test_bmi_and_bands(spark):
    df = spark.createDataFrame([(80.0, 200.0), (None, 170.0), (70.0, None)], "PESO double, TALLA double")
    rows = df.select(X.bmi().alias("b")).select("b", X.bmi_band("b").alias("band")).collect()
    assert abs(rows[0].b - 20.0) < 1e-12 and rows[0].band == "Normal"
    assert rows[1].b is None and rows[1].band == "Sin dato" and rows[2].band == "Sin dato"
    bands = _one_col(spark, [18.5, 25.0, 30.0], "double").select(X.bmi_band("v").alias("b")).orderBy("b")
    assert sorted(r.b for r in bands.collect()) == sorted(["Normal", "Sobrepeso", "Obesidad"])


def test_age_band(spark):
    df = _one_col(spark, [29, 30, 50, 65, None], "int").select("i", X.age_band("v").alias("g")).orderBy("i")
    assert [r.g for r in df.collect()] == ["Joven", "Adulto", "Adulto Mayor", "Tercera Edad", "Sin dato"]


def test_range_guard(spark):
    w = _one_col(spark, [0.2, 250.0, 250.1], "double").select("i", X.range_guard("v", *C.WEIGHT_RANGE).alias("g"))
    assert [r.g for r in w.orderBy("i").collect()] == [0.2, 250.0, None]
    h = _one_col(spark, [20.0, 225.0, 19.9], "double").select("i", X.range_guard("v", *C.HEIGHT_RANGE).alias("g"))
    assert [r.g for r in h.orderBy("i").collect()] == [20.0, 225.0, None]


def test_label(spark):
    rows = [(2, "15"), (2, "15.9"), (2, "-3"), (2, "NO APLICA"), (1, "3")]
    df = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(rows)],
                               "i int, CAUSA_INGRESO int, TIEMPO_ULTIMA_HOSPITALIZACION string")
    got = [r.REINGRESO for r in add_label(df).orderBy("i").collect()]
    assert got == [1, 0, 1, 0, 0]


def test_discharge_status(spark):
    df = _one_col(spark, ["15.9", "16", "NO APLICA", "", None]).withColumnRenamed("v", "DIAS_DESDE_EGRESO_ANTERIOR")
    got = [r.discharge_status for r in prior_discharge_status(df).orderBy("i").collect()]
    assert got == ["WITHIN_15_DAYS", "OVER_15_DAYS", "NO_DATA", "NO_DATA", "NO_DATA"]


def test_risk_tier(spark):
    df = _one_col(spark, [0.7, 0.69, 0.4, 0.39], "double").select("i", X.risk_tier("v").alias("t")).orderBy("i")
    assert [r.t for r in df.collect()] == ["ALTO", "MEDIO", "MEDIO", "BAJO"]


def test_id_rule(spark):
    r = validate_ids(_one_col(spark, ["12-34", "AB12"]), "v").orderBy("i").collect()
    assert (r[0].clean_id, r[0].is_valid) == ("1234", False)
    assert (r[1].clean_id, r[1].is_valid) == ("AB12", True)


def test_patient_top_model_ties(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.3)], "gb double, rf double, lr double")
    assert df.select(top_model("gb", "rf", "lr").alias("m")).first().m == "Gradient Boosting"


def test_best_auc_ties_go_to_lr(spark):
    m = spark.createDataFrame([(name, 70.0) for name in reversed(C.MODEL_ORDER)], "model string, roc_auc_pct double")
    assert E.best_model(m).first().best_model == C.MODEL_LR


def test_metrics_without_predicted_positives(spark):
    df = spark.createDataFrame([("m", 1, 0.1), ("m", 0, 0.2), ("m", 1, 0.3)], "model string, label int, score double")
    r = E.model_metrics(E.with_prediction(df)).first()
    assert r.precision_pct == 0.0 and r.f1_pct == 0.0 and r.recall_pct == 0.0


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    cells = {(r.var1, r.var2): r.corr for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert cells[("a", "b")] is None and cells[("b", "b")] is None and cells[("a", "a")] == 1.0


@pytest.mark.parametrize("text,expected", [("12", 12.0), (" 7 ", 7.0), ("1e2", 100.0), ("120d", None),
                                           ("1_20", None), ("NaN", None), ("Infinity", None), ("0x10", None)])
def test_number_parse(spark, text, expected):
    assert spark.createDataFrame([(text,)], "v string").select(X.parse_number("v").alias("n")).first().n == expected


def test_nan_and_text_dates_through_prepare(spark):
    from carelens.operators.impute import impute_median
    from carelens.operators.prepare import prepare
    from carelens.operators.profile import null_profile
    from carelens.sources.episodes import SOURCE_SCHEMA, extract
    nan = float("nan")
    blank = {f.name: None for f in SOURCE_SCHEMA.fields}
    rows = [blank | {"DOCUMENTO": "1", "INGRESO_ACTUAL": 1.0, "EDAD": nan, "PESO": nan, "TALLA": 170.0, "PRESION_ARTERIAL": "120/80",
                     "FECHA_INGRESO_ACTUAL": "2020-01-10 08:00:00", "FECHA_EGRESO_DEL_INGRESO_ACTUAL": "2020-01-12"},
            blank | {"DOCUMENTO": "1", "INGRESO_ACTUAL": 2.0, "EDAD": 40.0, "PESO": 70.0, "TALLA": 170.0, "PRESION_ARTERIAL": "nan/80",
                     "FECHA_INGRESO_ACTUAL": "2020-02-01 08:00:00", "FECHA_EGRESO_DEL_INGRESO_ACTUAL": "bad"}]
    types = {"INGRESO_ACTUAL": "double", "EDAD": "double", "PESO": "double", "TALLA": "double"}
    schema = ", ".join(f"`{f.name}` {types.get(f.name, 'string')}" for f in SOURCE_SCHEMA.fields)
    raw = spark.createDataFrame([tuple(r[f.name] for f in SOURCE_SCHEMA.fields) for r in rows], schema)
    out = prepare(extract(raw), with_previous_discharge=True).orderBy("INGRESO_ACTUAL").collect()
    assert (out[0].GRUPO_EDAD, out[0].CATEGORIA_IMC, out[0].IMC) == ("Sin dato", "Sin dato", None)
    assert out[0].FECHA_INGRESO_ACTUAL.isoformat() == "2020-01-10T08:00:00"
    assert out[1].FECHA_EGRESO_ANTERIOR.isoformat() == "2020-01-12T00:00:00" and out[1].FECHA_EGRESO_DEL_INGRESO_ACTUAL is None
    assert out[1].PRESION_SISTOLICA is None
    prepared = prepare(extract(raw))
    missing = {r.feature: r.n_null for r in null_profile(prepared, C.BATCH_FEATURES).collect()}
    filled = impute_median(prepared, C.BATCH_FEATURES)
    for f in ("EDAD", "IMC", "PRESION_ARTERIAL_MEDIA"):
        assert missing[f] == 1 and filled.filter(F.col(f).isNull()).count() == 0
    with pytest.raises(ValueError, match="EDAD"):
        extract(raw.withColumn("EDAD", F.array("EDAD")))


def test_jdbc_options():
    from carelens.sources.episodes import jdbc_options
    with pytest.raises(ValueError, match="lower_bound"):
        jdbc_options("jdbc:x", "t", "id", 1, None, 8)
    assert jdbc_options("jdbc:x", "t", "id", 1, 9, 8, {"user": "u"}) == {
        "url": "jdbc:x", "dbtable": "t", "user": "u", "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "8"}
    assert "numPartitions" not in jdbc_options("jdbc:x", "t", "id", None, None, 1)


def test_overall_histogram_and_service_name(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "score double")
    assert sum(r.n for r in E.score_histogram(df, []).collect()) == 3
    m = spark.createDataFrame([("Regresion Logistica", 70.0), (C.MODEL_RF, 70.0)], "model string, roc_auc_pct double")
    assert E.best_model(m).first().best_model == "Regresion Logistica"


def test_collation_option(spark):
    df = _one_col(spark, ["MISMA CAUSA", "misma causa  ", " MISMA CAUSA", "Diferente Causa", None, "x"])
    exact = [r.c for r in df.select("i", X.encode("v", C.CAUSE_CODES).alias("c")).orderBy("i").collect()]
    blind = [r.c for r in df.select("i", X.encode("v", C.CAUSE_CODES, "UTF8_LCASE_RTRIM").alias("c")).orderBy("i").collect()]
    assert exact == [2, 0, 0, 0, 0, 0] and blind == [2, 2, 0, 1, 0, 0]


def test_report_columns(spark):
    from carelens.sources.episodes import resolve_report_columns
    df = spark.createDataFrame([("1", 0.1, 0.2, 0.3)], "DOCUMENTO string, PROB_GB double, PROB_RF double, PROB_REINGRESO_LR double")
    assert resolve_report_columns(df)["prob_lr"] == "PROB_REINGRESO_LR"
    with pytest.raises(ValueError, match="prob_lr"):
        resolve_report_columns(df.drop("PROB_REINGRESO_LR"))
