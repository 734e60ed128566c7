"""Property checks of the distributed operators against straightforward references."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelens.operators.correlation import correlation_matrix
from carelens.operators.evaluate import roc_auc
from carelens.operators.knn import impute_knn
from carelens.operators.split import stratified_split
from carelens.operators.windows import lag_by_key, latest_by_key, ordered_scan
from carelens.plans import formula as FM
from carelens.plans import inputs as I

from conftest import SF0001


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else f"k{i % 50}"          # one key holds two thirds of the rows
        day = None if i % 97 == 0 else f"2020-01-{1 + (i * 7) % 28:02d} {(i * 13) % 24:02d}:00:00"
        rows.append((key, day, i, float(i % 11)))
    return spark.createDataFrame(rows, "k string, d string, t long, v double").withColumn(
        "d", F.to_timestamp("d"))


def test_lag_by_key_matches_plain_window(spark):
    df = _skewed(spark)
    got = lag_by_key(df, "k", "d", "t", {"prev": "v"}).select("t", "prev")
    w = Window.partitionBy("k").orderBy(F.col("d").asc_nulls_last(), "t")
    want = df.select("t", F.lag("v").over(w).alias("prev"))
    assert sorted(got.collect()) == sorted(want.collect())


def _plain_lag(df):
    w = Window.partitionBy("k").orderBy(F.col("d").asc_nulls_last(), "t")
    return df.select("t", F.when(F.col("k").isNotNull(), F.lag("v").over(w)).alias("prev"))


@pytest.mark.parametrize("date", ["distinct", "one_instant", "few_days", "undated", "mixed"])
def test_long_histories_are_cut_evenly(spark, date):
    """A million rows of one id (a tenth of it but for distinct instants), whatever their dates."""
    from carelens.operators.windows import history_ranges
    n = 1_000_000 if date == "distinct" else 100_000
    t = F.col("id")
    second = {"distinct": (t * 7919 % n) / 1e6, "one_instant": F.lit(5.0), "few_days": (t % 3) * 86400.0,
              "undated": F.lit(None).cast("double"), "mixed": F.when(t % 4 > 0, F.when(t % 4 == 1, 1.0).otherwise(t / 1e6))}[date]
    df = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_seconds(second).alias("d"), t.alias("t"), (t % 11).cast("double").alias("v"))
    df = df.unionAll(spark.range(500).select(F.when(t % 2 == 0, (t % 50).cast("string")), F.timestamp_seconds(t % 9), -t - 1, F.lit(0.5)))
    sizes = [r.n for r in history_ranges(df, "k", "d", "t", n // 20).filter("k = 'hot'").groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * sorted(sizes)[10]
    got = lag_by_key(df, "k", "d", "t", {"prev": "v"}, slice_rows=n // 20).select("t", "prev")
    assert got.exceptAll(_plain_lag(df)).isEmpty() and got.count() == n + 500


def test_lag_plans(spark):
    """Without a long history: one exchange of the rows. Rows without a key are dealt out."""
    df = _skewed(spark).withColumn("k", F.when(F.col("t") % 5 > 0, F.col("k")))
    out = lag_by_key(df, "k", "d", "t", {"prev": "v", "prev_t": "t"})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert out.columns == [*df.columns, "prev", "prev_t"]
    for size in (10, 400):
        assert sorted(lag_by_key(df, "k", "d", "t", {"prev": "v"}, slice_rows=size).select("t", "prev").collect()) == sorted(_plain_lag(df).collect())
    empty = lag_by_key(df.filter("t < 0"), "k", "d", "t", {"prev": "v"})
    assert empty.collect() == [] and empty.columns == [*df.columns, "prev"]


def test_latest_by_key_matches_row_number(spark):
    df = _skewed(spark)
    got = latest_by_key(df, "k", "d", "t", columns=["t"], count_as="n").select("k", "t", "n")
    w = Window.partitionBy("k").orderBy(F.col("d").desc_nulls_last(), F.col("t").desc())
    want = (df.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k")))
              .filter("rn = 1").select("k", "t", "n"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_ordered_scan_matches_running_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000).astype(str), "s": rng.random(2000), "x": rng.integers(0, 5, 2000)})
    df = spark.createDataFrame(pdf).dropDuplicates(["g", "s"])
    got = ordered_scan(df, ["g"], "s", sums={"cx": "x"}, leads={"nx": "x"}, num_partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("s").desc())
    want = df.select("g", "s", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cx"),
                     F.lead("x").over(w).alias("nx"))
    assert sorted(got.select("g", "s", "cx", "nx").collect()) == sorted(want.collect())


def test_auc_matches_rank_formula(spark):
    preds = FM.predictions(spark, SF0001)
    pdf = preds.toPandas()
    for model, g in pdf.groupby("model"):
        r = g["score"].rank(method="average")
        n1 = (g["label"] == 1).sum()
        n0 = len(g) - n1
        want = (r[g["label"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        got = roc_auc(preds).filter(F.col("model") == model).first().roc_auc
        assert abs(got - want) < 1e-12


def test_split_properties(spark):
    df = I.prepared(spark, SF0001)
    s = stratified_split(df).select("INGRESO_ACTUAL", "REINGRESO", "is_test").toPandas()
    assert len(s) == df.count() and s["INGRESO_ACTUAL"].is_unique
    for _, g in s.groupby("REINGRESO"):
        assert abs(g["is_test"].sum() - 0.3 * len(g)) <= 1
    again = stratified_split(df).select("INGRESO_ACTUAL", "is_test").toPandas()
    assert (again.sort_values("INGRESO_ACTUAL")["is_test"].values ==
            s.sort_values("INGRESO_ACTUAL")["is_test"].values).all()


def test_tiers_sum_to_total(spark):
    from carelens.operators.profile import risk_distribution
    from carelens.functions.clinical import risk_tier
    s = FM.scored(spark, SF0001).withColumn("NIVEL_RIESGO_REINGRESO", risk_tier("PROB_LR"))
    dist = risk_distribution(s).collect()
    assert sum(r.n_episodes for r in dist) == s.count()
    assert abs(sum(r.pct for r in dist) - 100.0) < 1e-9


def test_correlation_symmetric_unit_diagonal(spark):
    from carelens.operators.impute import impute_median
    from carelens import config as C
    df = impute_median(I.prepared(spark, SF0001), C.BATCH_FEATURES)
    cells = {(r.var1, r.var2): r.corr for r in correlation_matrix(df, C.BATCH_FEATURES + ["REINGRESO"]).collect()}
    for (a, b), v in cells.items():
        assert (v is None and cells[(b, a)] is None) or abs(v - cells[(b, a)]) < 1e-12
        if a == b and v is not None:
            assert v == 1.0


def _knn_brute(pdf, feats, k=5):
    x = pdf[feats].astype(float).to_numpy()
    mu, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    sd[sd == 0] = 1.0
    z = (x - mu) / sd
    out = x.copy()
    ids = pdf["id"].to_numpy()
    for i in range(len(x)):
        for f in np.flatnonzero(np.isnan(x[i])):
            best = []
            for j in range(len(x)):
                if np.isnan(x[j, f]):
                    continue
                both = ~np.isnan(z[i]) & ~np.isnan(z[j])
                if not both.any():
                    continue
                d = np.sqrt(len(feats) / both.sum() * ((z[i, both] - z[j, both]) ** 2).sum())
                best.append((round(d, 9), ids[j], d, x[j, f]))
            if not best:
                out[i, f] = mu[f]
                continue
            best.sort()
            top = best[:k]
            if any(t[2] == 0 for t in top):
                vals = [t[3] for t in top if t[2] == 0]
                out[i, f] = sum(vals) / len(vals)
            else:
                out[i, f] = sum(t[3] / t[2] for t in top) / sum(1 / t[2] for t in top)
    return out


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 4, n).astype(float),
                        "b": rng.normal(50, 10, n).round(1), "c": rng.integers(0, 30, n).astype(float)})
    for col, frac in (("a", 0.1), ("b", 0.2), ("c", 0.05)):
        pdf.loc[rng.random(n) < frac, col] = np.nan
    pdf.loc[0, ["a", "b", "c"]] = np.nan  # nothing to compare: falls back to the mean
    pdf.loc[5, ["a", "b"]] = pdf.loc[6, ["a", "b"]].values  # exact twins: zero distance
    feats = ["a", "b", "c"]
    df = spark.createDataFrame(pdf)
    got = impute_knn(df, feats, id_col="id").toPandas().sort_values("id")
    want = _knn_brute(pdf, feats)
    assert np.allclose(got[feats].to_numpy(), want, atol=1e-9)


def test_knn_grid_matches_brute_force(spark):
    """The grid search (own cell, neighbouring cells, packed buckets, split big
    cells, fallback) gives the brute-force answer."""
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 4, n).astype(float),
                        "b": rng.normal(50, 10, n).round(1), "c": rng.integers(0, 30, n).astype(float)})
    for col, frac in (("a", 0.1), ("b", 0.2), ("c", 0.05)):
        pdf.loc[rng.random(n) < frac, col] = np.nan
    pdf.loc[0, ["a", "b", "c"]] = np.nan
    pdf.loc[7, ["a", "b", "c"]] = pdf.loc[8, ["a", "b", "c"]].values  # duplicate vector
    feats = ["a", "b", "c"]
    df = spark.createDataFrame(pdf)
    want = _knn_brute(pdf, feats)
    # Narrow cells and small chunks: several levels, packed buckets and cut cells.
    for width, chunk in ((0.5, 16), (0.1, 16)):
        got = impute_knn(df, feats, id_col="id", cell_width=width, chunk_rows=chunk).toPandas().sort_values("id")
        assert np.allclose(got[feats].to_numpy(), want, atol=1e-9), (width, chunk)


def test_knn_outliers_match_brute_force(spark):
    """Coordinates a thousand deviations out, donors a hair apart."""
    rng = np.random.default_rng(5)
    n = 3000
    a = rng.normal(0, 1, n)
    a[:40] = 5e6 + np.arange(40) * 1e-3
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": rng.integers(0, 50, n).astype(float)})
    pdf.loc[:19, "b"] = np.nan
    pdf.loc[100:104, "b"] = np.nan
    mu, sd = pdf[["a", "b"]].mean().to_numpy(), pdf[["a", "b"]].std(ddof=0).to_numpy()
    z = (pdf[["a", "b"]].to_numpy() - mu) / sd
    got = impute_knn(spark.createDataFrame(pdf), ["a", "b"], id_col="id").toPandas().sort_values("id")
    donors = np.flatnonzero(~np.isnan(z[:, 1]))
    for i in [*range(20), *range(100, 105)]:
        d = np.sqrt(2 * (z[donors, 0] - z[i, 0]) ** 2)
        top = donors[np.lexsort((donors, np.round(d, 9)))[:5]]
        dist = np.sqrt(2 * (z[top, 0] - z[i, 0]) ** 2)
        want = pdf["b"].to_numpy()[top][dist == 0].mean() if (dist == 0).any() else np.average(pdf["b"].to_numpy()[top], weights=1 / dist)
        assert abs(got["b"].to_numpy()[i] - want) < 1e-6 * max(1, abs(want)), i


def _dense(spark, n=200_000):
    return spark.range(n).select(
        F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 13), 16, 10).cast("double") / 2.0 ** 52
         + (F.col("id") % 3 == 0).cast("double") * 0.1).alias("score"))


def test_ranking_metrics_do_not_depend_on_partitions(spark):
    df = _dense(spark)
    pdf = df.toPandas()
    assert pdf["score"].nunique() == len(pdf)
    r = pdf["score"].rank()
    n1 = pdf["label"].sum()
    want = (r[pdf["label"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(pdf) - n1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts in ("4", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            auc = roc_auc(df)
            assert "SPARK_PARTITION_ID" not in auc._jdf.queryExecution().toString().upper()
            got += [auc.first().roc_auc, roc_auc(df).first().roc_auc]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert max(got) - min(got) < 1e-12 and abs(got[0] - want) < 1e-12


def test_exact_medians(spark):
    from carelens.operators.windows import exact_medians
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.where(rng.random(5001) < .7, "a", "b"), "x": rng.normal(size=5001), "y": rng.integers(0, 5, 5001).astype(float),
                        "z": np.nan})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("x") > 2, F.lit(None)).otherwise(F.col("x")))
    pdf.loc[pdf["x"] > 2, "x"] = np.nan
    got = {r.feature: r.median for r in exact_medians(df, ["x", "y", "z"]).collect()}
    assert got == {"x": pdf["x"].median(), "y": pdf["y"].median()}
    by = {(r.g, r.feature): r.median for r in exact_medians(df, ["x"], by=["g"]).collect()}
    assert by == {(g, "x"): m for g, m in pdf.groupby("g")["x"].median().items()}


def test_split_share_is_exact(spark):
    df = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("y"))
    for share, per_class in ((0.25, 250), (0.33, 330), (0.3, 300), (0.001, 1)):
        s = stratified_split(df, label="y", id_col="i", share=share).filter("is_test").groupBy("y").count().collect()
        assert {r["y"]: r["count"] for r in s} == {0: per_class, 1: per_class}


def test_lag_splits_hot_slices(spark):
    rows = [("hot", None, i, float(i)) for i in range(700)]                              # no date at all
    rows += [("hot", "2020-05-05 00:00:00", 1000 + i, float(i)) for i in range(600)]       # one placeholder time
    rows += [("hot", f"2020-05-06 {i % 24:02d}:{i % 60:02d}:00", 3000 + i, float(i)) for i in range(500)]
    rows += [("cold", "2020-05-06 01:00:00", 9000, 1.0), (None, None, 9001, 2.0), ("cold", None, 9002, 3.0)]
    df = spark.createDataFrame(rows, "k string, d string, t long, v double").withColumn("d", F.to_timestamp("d")).repartition(5)
    w = Window.partitionBy("k").orderBy(F.col("d").asc_nulls_last(), "t")
    want = df.select("t", F.when(F.col("k").isNotNull(), F.lag("v").over(w)).alias("prev"))
    for size in (50, 100_000):
        got = lag_by_key(df, "k", "d", "t", {"prev": "v"}, slice_rows=size)
        assert got.columns == [*df.columns, "prev"]
        assert sorted(got.select("t", "prev").collect()) == sorted(want.collect())
