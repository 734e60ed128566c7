"""KNN imputation query and its brute-force DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators.knn import impute_knn, neighbours, points
from carelens.plans import inputs as I
from carelens.plans import sql_twins as S
from carelens.plans.catalog import query, r6, rounded

FEATS = C.SERVICE_FEATURES
NF = len(FEATS)


def _q(c):
    return f'"{c}"'


def _knn_sql() -> str:
    stats = "kstats AS (SELECT " + ", ".join(
        f"avg(CAST({_q(f)} AS DOUBLE)) AS m{i}, coalesce(NULLIF(stddev_pop(CAST({_q(f)} AS DOUBLE)), 0), 1) AS s{i}"
        for i, f in enumerate(FEATS)) + " FROM prep_v)"
    kz = ("kz AS (SELECT INGRESO_ACTUAL AS id, " +
          ", ".join(f"CAST({_q(f)} AS DOUBLE) AS x{i}" for i, f in enumerate(FEATS)) + ", " +
          ", ".join(f"(CAST({_q(f)} AS DOUBLE) - m{i}) / s{i} AS z{i}" for i, f in enumerate(FEATS)) +
          " FROM prep_v, kstats)")
    any_null = " OR ".join(f"x{i} IS NULL" for i in range(NF))
    krec = (f"krec AS (SELECT DISTINCT " + ", ".join(f"x{i}, z{i}" for i in range(NF)) +
            f" FROM kz WHERE {any_null})")
    shared = " + ".join(f"CAST(r.z{i} IS NOT NULL AND d.z{i} IS NOT NULL AS INTEGER)" for i in range(NF))
    sq = " + ".join(f"coalesce((r.z{i} - d.z{i}) * (r.z{i} - d.z{i}), 0)" for i in range(NF))
    rcols = ", ".join(f"r.x{i} AS rx{i}" for i in range(NF))
    arms = " UNION ALL ".join(
        f"SELECT {rcols}, {i} AS feature, d.id AS did, d.x{i} AS value, "
        f"sqrt({NF}.0 / ({shared}) * ({sq})) AS dist "
        f"FROM krec r JOIN kz d ON r.x{i} IS NULL AND d.x{i} IS NOT NULL AND ({shared}) > 0"
        for i in range(NF))
    rkey = ", ".join(f"rx{i}" for i in range(NF))
    pairs = f"kpairs AS ({arms})"
    top = (f"ktop AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {rkey}, feature "
           f"ORDER BY round(dist, 9), did) AS rn FROM kpairs) WHERE rn <= {C.KNN_NEIGHBOURS})")
    imp = (f"kimp AS (SELECT {rkey}, feature, "
           f"CASE WHEN max(CAST(dist = 0 AS INTEGER)) = 1 "
           f"THEN sum(CASE WHEN dist = 0 THEN value ELSE 0 END) / sum(CAST(dist = 0 AS INTEGER)) "
           f"ELSE sum(value / dist) / sum(1.0 / dist) END AS value FROM ktop GROUP BY {rkey}, feature)")
    match = " AND ".join(f"t.x{i} IS NOT DISTINCT FROM k.rx{i}" for i in range(NF))
    outs = []
    for i, f in enumerate(FEATS):
        fill = f"(SELECT k.value FROM kimp k WHERE k.feature = {i} AND {match})"
        outs.append(f"{r6(f'coalesce(t.x{i}, {fill}, kstats.m{i})')} AS {_q(f)}")
    final = "SELECT t.id AS INGRESO_ACTUAL, " + ", ".join(outs) + " FROM kz t, kstats"
    return S.with_steps(S.prepared_sql("service"), stats, kz, krec, pairs, top, imp) + " " + final


@query("impute_knn", _knn_sql())
def impute_knn_q(spark, sf_dir):
    """KNN imputation (k=5, inverse-distance) of the 8 inpatient features."""
    prepared = I.prepared(spark, sf_dir, "service")
    return rounded(impute_knn(prepared, FEATS, id_col="INGRESO_ACTUAL").select("INGRESO_ACTUAL", *FEATS))


@query("knn_lsh_recall")
def knn_lsh_recall(spark, sf_dir):
    """Per feature: receivers, their nearest donors by the exact search, and how many of
    them random projections find too (as near, if several donors are equally far)."""
    pts = points(I.prepared(spark, sf_dir, "service"), FEATS, "INGRESO_ACTUAL", C.KNN_NEIGHBOURS)
    exact = neighbours(pts).checkpoint()
    last = exact.groupBy("rkey", "feature").agg(F.max(F.round("dist", 9)).alias("reach"), F.count(F.lit(1)).alias("n"))
    found = neighbours(pts, method="lsh").select("rkey", "feature", F.round("dist", 9).alias("dist"))
    hits = last.join(found, ["rkey", "feature"], "left").groupBy("rkey", "feature").agg(
        F.first("n").alias("n"), F.count_if(F.col("dist") <= F.col("reach")).alias("hits"))
    return hits.groupBy("feature").agg(F.count(F.lit(1)).alias("receivers"), F.sum("n").alias("nearest"), F.sum("hits").alias("found"),
                                       F.round(F.sum("hits") / F.sum("n"), 4).alias("recall"))


@query("impute_knn_lsh")
def impute_knn_lsh_q(spark, sf_dir):
    """KNN imputation with random projections in place of the exact search."""
    prepared = I.prepared(spark, sf_dir, "service")
    return rounded(impute_knn(prepared, FEATS, id_col="INGRESO_ACTUAL", method="lsh").select("INGRESO_ACTUAL", *FEATS))
