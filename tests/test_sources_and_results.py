"""Database scan parts, sketched medians, saved results, uncertainty of AUC."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators import delong
from carelens.operators.impute import medians
from carelens.plans.results import Results, fingerprint
from carelens.sources.episodes import bounds_query, part_bounds, part_predicates, source_query


@pytest.mark.parametrize("by", ["range", "quantiles"])
@pytest.mark.parametrize("ids", [[5], [None], [], [None, -7, -7, 3, 10 ** 12], [*range(1000), None, None], [*range(50), *range(10 ** 9, 10 ** 9 + 50)]])
def test_scan_parts_are_disjoint_and_complete(by, ids):
    db = duckdb.connect()
    db.sql("CREATE TABLE admissions (id BIGINT)")
    if ids:
        db.executemany("INSERT INTO admissions VALUES (?)", [(i,) for i in ids])
    found = db.sql(bounds_query('SELECT "id" FROM admissions', "id", 8, by)).fetchall()
    predicates = part_predicates("id", part_bounds(found, 8, by))
    assert len(predicates) <= 9
    met = db.sql("SELECT " + " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in predicates) + " FROM admissions").fetchall()
    assert [m for m, in met] == [1] * len(ids)
    if by == "quantiles" and len(ids) > 90:
        sizes = [db.sql(f"SELECT count(*) FROM admissions WHERE {p}").fetchall()[0][0] for p in predicates[1:]]
        assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)


def test_source_query_names_columns_and_filter():
    assert source_query("v", ["A", 'B"x']) == 'SELECT "A", "B""x" FROM v'
    text = source_query("v", only_inpatient=True)
    assert text.startswith('SELECT "DOCUMENTO", ') and text.endswith(f"FROM v WHERE \"TIPO_INGRESO\" = '{C.INPATIENT}'")
    with pytest.raises(ValueError, match="range or by quantiles"):
        bounds_query("q", "id", 3, "guess")


def test_sketched_medians(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=60_000), np.full(40_000, 9.0)))
    df = spark.createDataFrame(pd.DataFrame({"x": rng.permutation(x), "y": np.nan})).repartition(7)
    found = medians(df, ["x", "y"], 0.001)
    assert found["y"] is None
    assert abs((x <= found["x"]).mean() - 0.5) < 0.002
    assert medians(df.filter("x > 99"), ["x"], 0.01) == {"x": None}
    assert medians(df, ["x"]) == {"x": pytest.approx(np.median(x))}
    with pytest.raises(ValueError, match="rank error"):
        medians(df, ["x"], 0.0)


def test_results_are_reused_until_input_parameters_or_age_change(spark, tmp_path):
    now, built = [50.0], []
    kept = Results(spark, str(tmp_path), max_age=360, clock=lambda: now[0])

    def build(d):
        built.append(1)
        return d.groupBy("k").agg(F.sum("v").alias("v"))
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("a", 3, None)], "k string, v long, n string")

    def ask(d, **params):
        return sorted(tuple(r) for r in kept.table("sums", d, build, **params).collect())
    assert ask(df) == [("a", 4), ("b", 2)] == ask(df.repartition(3).orderBy(F.desc("v"))) and len(built) == 1
    assert ask(df, variant="service") == [("a", 4), ("b", 2)] and len(built) == 2
    assert ask(df.filter("v < 3")) == [("a", 1), ("b", 2)] and len(built) == 3
    now[0] += 360
    ask(df)
    assert len(built) == 3
    now[0] += 1
    ask(df)
    assert len(built) == 4 and [hit for _, hit in kept.log] == [False, True, False, False, True, False]
    other = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("a", 3, None)], "k string, v long, n string")
    prints = {fingerprint(d) for d in (df, other, df.unionAll(df), df.limit(0), df.withColumnRenamed("k", "q"), df.withColumn("v", F.col("v").cast("int")))}
    assert len(prints) == 6


def test_a_lost_job_leaves_no_table(spark, tmp_path):
    kept = Results(spark, str(tmp_path))
    df = spark.range(3)
    with pytest.raises(Exception, match="no_such_column"):
        kept.table("t", df, lambda d: d.select("no_such_column"))
    assert kept.table("t", df, lambda d: d).count() == 3 and kept.log == [("t", False), ("t", False)]


def _delong(y, a, b=None):
    """Placement values by comparing every pair."""
    def placed(s):
        over = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
        return over.mean(1), over.mean(0)
    pa, na = placed(a)
    pb, nb = placed(b) if b is not None else (0, 0)
    return pa.mean(), np.sqrt(np.var(pa - pb, ddof=1) / len(pa) + np.var(na - nb, ddof=1) / len(na))


def test_auc_uncertainty_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(700) < .3).astype(int)
    scores = {"m1": np.round(y * .4 + rng.normal(size=700), 1), "m2": np.round(y * .5 + rng.normal(size=700), 2), "m3": np.full(700, .5)}
    pdf = pd.concat([pd.DataFrame({"model": m, "INGRESO_ACTUAL": range(700), "label": y, "score": s}) for m, s in scores.items()])
    df = spark.createDataFrame(pdf).repartition(5)
    for r in delong.auc_intervals(df).collect():
        auc, se = _delong(y, scores[r.model])
        assert abs(r.auc - auc) < 1e-12 and abs(r.se - se) < 1e-12
        assert abs(r.low - (auc - 1.959963984540054 * se)) < 1e-9 and r.low <= r.auc <= r.high and (r.n_pos, r.n_neg) == (y.sum(), 700 - y.sum())
    rows = {(r.model_a, r.model_b): r for r in delong.auc_differences(df, ["m1", "m2", "m3"]).collect()}
    assert set(rows) == {("m1", "m2"), ("m1", "m3"), ("m2", "m3")}
    for (a, b), r in rows.items():
        se = _delong(y, scores[a], scores[b])[1]
        assert abs(r.se - se) < 1e-12 and abs(r.difference - (r.auc_a - r.auc_b)) < 1e-12 and r.distinct == (abs(r.difference / se) > 1.96)


def test_auc_uncertainty_of_few_rows(spark):
    rows = [("one", 1, 1, .5), ("one", 2, 0, .5), ("pos", 1, 1, .5), ("pos", 2, 1, .6), ("none", 1, 0, .1)]
    df = spark.createDataFrame(rows, "model string, INGRESO_ACTUAL long, label int, score double")
    got = {r.model: (r.auc, r.se, r.low) for r in delong.auc_intervals(df).collect()}
    assert got == {"one": (.5, None, None), "pos": (None, None, None), "none": (None, None, None)}
    assert delong.auc_intervals(df.limit(0)).collect() == []
    same = df.filter("model = 'one'").unionAll(df.filter("model = 'one'").withColumn("model", F.lit("two")))
    assert [(r.difference, r.z) for r in delong.auc_differences(same, ["one", "two"]).collect()] == [(0.0, None)]


def test_csv_keeps_blanks_and_nulls(spark, tmp_path):
    from carelens.sources.sinks import write_table
    rows = [(1, " 130/85 ", 0.1 + 0.2), (2, None, None), (3, 'a "quoted", text', -0.0), (4, "\ttab ", 1e-300)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    write_table(df, str(tmp_path / "t"), "csv")
    again = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "t"))
    assert sorted(again.collect()) == sorted(df.collect())
