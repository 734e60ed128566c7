"""Queries for imputation, correlation, split, scaling and evaluation operators
(the evaluation ones on formula scores, so DuckDB can check them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelens import config as C
from carelens.functions import clinical as X
from carelens.operators import correlation as CORR
from carelens.operators import delong as DL
from carelens.operators import evaluate as E
from carelens.operators import profile as P
from carelens.operators.deal import deal, partition_count
from carelens.operators.impute import impute_median
from carelens.operators.split import class_weights, scaler_stats, standardize, stratified_split
from carelens.plans import formula as FM
from carelens.plans import inputs as I
from carelens.plans import sql_twins as S
from carelens.plans.catalog import query, r6, rounded

FEATS = C.BATCH_FEATURES
CORR_VARS = C.BATCH_FEATURES + ["REINGRESO"]


def _q(c):
    return f'"{c}"'


def _imputed_spark(spark, sf_dir):
    return impute_median(I.prepared(spark, sf_dir), FEATS)


IMPUTED_SQL = "imputed_b AS (SELECT * REPLACE (" + ", ".join(
    f"coalesce(CAST({_q(f)} AS DOUBLE), (SELECT median(CAST({_q(f)} AS DOUBLE)) FROM prep_b)) AS {_q(f)}"
    for f in FEATS) + ") FROM prep_b)"


@query("impute_median", S.with_steps(S.prepared_sql("batch"), IMPUTED_SQL)
       + " SELECT INGRESO_ACTUAL, " + ", ".join(f"{r6(_q(f))} AS {_q(f)}" for f in FEATS) + " FROM imputed_b")
def impute_median_q(spark, sf_dir):
    """Median imputation of the 9 batch features, medians from all rows."""
    return rounded(_imputed_spark(spark, sf_dir).select("INGRESO_ACTUAL", *FEATS))


def _corr_sql():
    cells = []
    for i, a in enumerate(CORR_VARS):
        for j, b in enumerate(CORR_VARS):
            varies = (f"(min({_q(a)}) < max({_q(a)}) AND min({_q(b)}) < max({_q(b)}))")
            value = "1.0" if i == j else f"corr({_q(a)}, {_q(b)})"
            if i == j:
                value = f"CASE WHEN min({_q(a)}) < max({_q(a)}) THEN 1.0 END"
            else:
                value = f"CASE WHEN {varies} THEN corr({_q(a)}, {_q(b)}) END"
            cells.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {i} AS pos1, {j} AS pos2, {r6(value)} AS corr "
                         f"FROM imputed_b")
    return " UNION ALL ".join(cells)


CORR_SQL = _corr_sql()


@query("correlation_matrix", S.with_steps(S.prepared_sql("batch"), IMPUTED_SQL) + CORR_SQL)
def correlation_matrix(spark, sf_dir):
    """Pearson matrix of the 9 imputed features and the label (100 cells)."""
    return rounded(CORR.correlation_matrix(_imputed_spark(spark, sf_dir), CORR_VARS))


@query("target_correlation", S.with_steps(S.prepared_sql("batch"), IMPUTED_SQL, f"cm_l AS ({CORR_SQL})") + """
 SELECT var1 AS variable, corr,
   ROW_NUMBER() OVER (ORDER BY abs(corr) DESC NULLS LAST, pos1) AS rank,
   CASE WHEN corr > 0 THEN '+' WHEN corr < 0 THEN '-' END AS direction
 FROM cm_l WHERE var2 = 'REINGRESO' AND var1 <> 'REINGRESO'""")
def target_correlation(spark, sf_dir):
    m = CORR.correlation_matrix(_imputed_spark(spark, sf_dir), CORR_VARS)
    return rounded(CORR.target_correlation(rounded(m), "REINGRESO"))


#: Rows of a training partition in ``training_partitions`` (fits use more).
DEALT_ROWS = 500


@query("training_partitions", FM.chain() + f""", train_d AS (SELECT INGRESO_ACTUAL, REINGRESO,
   CAST('0x' || substr(md5('{C.SEED}:' || CAST(INGRESO_ACTUAL AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM split_b WHERE NOT is_test)
 SELECT CAST(h % (SELECT (count(*) + {DEALT_ROWS - 1}) // {DEALT_ROWS} FROM train_d) AS INT) AS partition, count(*) AS n,
   CAST(sum(REINGRESO) AS BIGINT) AS positives, min(INGRESO_ACTUAL) AS first_id, max(INGRESO_ACTUAL) AS last_id,
   md5(string_agg(CAST(INGRESO_ACTUAL AS VARCHAR), ',' ORDER BY INGRESO_ACTUAL)) AS ids_md5
 FROM train_d GROUP BY ALL""")
def training_partitions_q(spark, sf_dir):
    """Where the training rows stand when the tree learners read them."""
    train = stratified_split(I.prepared(spark, sf_dir), label="REINGRESO", id_col="INGRESO_ACTUAL").filter(~F.col("is_test"))
    train = train.select("INGRESO_ACTUAL", "REINGRESO").checkpoint()
    dealt = deal(train, "INGRESO_ACTUAL", partition_count(train.count(), DEALT_ROWS))
    ids = F.transform(F.sort_array(F.collect_list("INGRESO_ACTUAL")), lambda i: i.cast("string"))      # a partition's rows
    return dealt.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("REINGRESO").cast("long").alias("positives"), F.min("INGRESO_ACTUAL").alias("first_id"),
        F.max("INGRESO_ACTUAL").alias("last_id"), F.md5(F.array_join(ids, ",")).alias("ids_md5"))


@query("stratified_split", FM.chain() + " SELECT INGRESO_ACTUAL, REINGRESO, is_test FROM split_b")
def stratified_split_q(spark, sf_dir):
    s = stratified_split(I.prepared(spark, sf_dir), label="REINGRESO", id_col="INGRESO_ACTUAL")
    return s.select("INGRESO_ACTUAL", "REINGRESO", "is_test")


CW_SQL = f"""
 SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) FILTER (WHERE REINGRESO = 0) AS BIGINT) AS n0,
   CAST(COUNT(*) FILTER (WHERE REINGRESO = 1) AS BIGINT) AS n1,
   {r6('COUNT(*) / NULLIF(2.0 * COUNT(*) FILTER (WHERE REINGRESO = 0), 0)')} AS w0,
   {r6('COUNT(*) / NULLIF(2.0 * COUNT(*) FILTER (WHERE REINGRESO = 1), 0)')} AS w1
 FROM """


@query("class_weights", FM.chain() + CW_SQL + "split_b WHERE NOT is_test")
def class_weights_q(spark, sf_dir):
    """Balanced class weights from the training rows (batch variant)."""
    s = stratified_split(I.prepared(spark, sf_dir), label="REINGRESO", id_col="INGRESO_ACTUAL")
    return rounded(class_weights(s.filter(~F.col("is_test"))))


@query("class_weights_inpatient", S.with_steps(S.prepared_sql("service")) + CW_SQL + "prep_v")
def class_weights_inpatient(spark, sf_dir):
    """Balanced class weights from all inpatient rows (service variant)."""
    return rounded(class_weights(I.prepared(spark, sf_dir, "service")))


STD_SQL = S.with_steps(S.prepared_sql("batch"), IMPUTED_SQL, FM.SPLIT_B.replace("FROM prep_b", "FROM imputed_b"),
                       "stats AS (SELECT " + ", ".join(
                           f"avg({_q(f)}) AS m{i}, coalesce(NULLIF(stddev_pop({_q(f)}), 0), 1) AS s{i}"
                           for i, f in enumerate(FEATS)) + " FROM split_b WHERE NOT is_test)") + \
    " SELECT INGRESO_ACTUAL, is_test, " + ", ".join(
        f"{r6(f'({_q(f)} - m{i}) / s{i}')} AS {_q(f)}" for i, f in enumerate(FEATS)) + " FROM split_b, stats"


@query("standardize", STD_SQL)
def standardize_q(spark, sf_dir):
    """Features scaled with the training rows' mean and population deviation."""
    s = stratified_split(_imputed_spark(spark, sf_dir), label="REINGRESO", id_col="INGRESO_ACTUAL")
    stats = scaler_stats(s.filter(~F.col("is_test")), FEATS)
    return rounded(standardize(s, stats).select("INGRESO_ACTUAL", "is_test", *FEATS))


# ---- evaluation on formula scores ----------------------------------------

@query("roc_auc", FM.chain(FM.RUNNING, FM.AUC) + f" SELECT model, {r6('roc_auc')} AS roc_auc FROM auc")
def roc_auc_q(spark, sf_dir):
    return rounded(E.roc_auc(FM.predictions(spark, sf_dir)))


@query("average_precision", FM.chain(FM.RUNNING) + f"""
 SELECT model, {r6("coalesce(SUM((pos * 1.0 / NULLIF(P, 0)) * (tps * 1.0 / NULLIF(tps + fps, 0))), 0)")}
   AS average_precision FROM running GROUP BY model""")
def average_precision_q(spark, sf_dir):
    return rounded(E.average_precision(FM.predictions(spark, sf_dir)))


@query("roc_points", FM.chain(FM.RUNNING) + f"""
 SELECT model, score AS threshold, {r6('fps * 1.0 / NULLIF(N, 0)')} AS fpr, {r6('tps * 1.0 / NULLIF(P, 0)')} AS tpr
 FROM running
 WHERE (tps = pos AND fps = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
 UNION ALL
 SELECT model, NULL AS threshold, 0.0 AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr FROM totals""")
def roc_points_q(spark, sf_dir):
    return rounded(E.roc_points(FM.predictions(spark, sf_dir)))


@query("pr_points", FM.chain(FM.RUNNING) + f"""
 SELECT model, score AS threshold, {r6('coalesce(tps * 1.0 / NULLIF(tps + fps, 0), 0)')} AS precision,
   {r6('CASE WHEN P = 0 THEN 1.0 ELSE tps * 1.0 / P END')} AS recall FROM running
 UNION ALL
 SELECT model, NULL AS threshold, 1.0 AS precision, 0.0 AS recall FROM totals""")
def pr_points_q(spark, sf_dir):
    return rounded(E.pr_points(FM.predictions(spark, sf_dir)))


@query("confusion_matrix", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + """
 SELECT model, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
   CAST(tp AS BIGINT) AS tp FROM cm""")
def confusion_matrix_q(spark, sf_dir):
    return E.confusion(FM.predictions(spark, sf_dir))


@query("model_metrics", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + f"""
 SELECT model, {r6('accuracy_pct')} AS accuracy_pct, {r6('precision_pct')} AS precision_pct,
   {r6('recall_pct')} AS recall_pct, {r6('f1_pct')} AS f1_pct, {r6('roc_auc_pct')} AS roc_auc_pct FROM metrics""")
def model_metrics_q(spark, sf_dir):
    return rounded(E.model_metrics(FM.predictions(spark, sf_dir)))


@query("best_model", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + f"""
 SELECT model AS best_model, {r6('roc_auc_pct')} AS value FROM metrics
 ORDER BY roc_auc_pct DESC NULLS LAST, {FM.MODEL_RANK} LIMIT 1""")
def best_model_q(spark, sf_dir):
    return rounded(E.best_model(rounded(E.model_metrics(FM.predictions(spark, sf_dir)))))


@query("best_per_metric", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + f"""
 SELECT metric, best_model, {r6('value')} AS value FROM (
   SELECT metric, model AS best_model, value,
     ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, {FM.MODEL_RANK}) AS rn
   FROM (SELECT model, 'accuracy_pct' AS metric, round(accuracy_pct, 6) AS value FROM metrics
         UNION ALL SELECT model, 'f1_pct', round(f1_pct, 6) FROM metrics
         UNION ALL SELECT model, 'roc_auc_pct', round(roc_auc_pct, 6) FROM metrics)) WHERE rn = 1""")
def best_per_metric_q(spark, sf_dir):
    return rounded(E.best_per_metric(rounded(E.model_metrics(FM.predictions(spark, sf_dir)))))


@query("score_histogram", FM.chain("""rng AS (SELECT model, label, min(score) AS lo, max(score) AS hi
   FROM preds GROUP BY model, label)""") + f"""
 SELECT model, label, bin, {r6('bin_start')} AS bin_start, CAST(COUNT(*) AS BIGINT) AS n FROM (
   SELECT p.model, p.label,
     CAST(CASE WHEN hi > lo THEN least(floor((score - lo) / (hi - lo) * {C.HISTOGRAM_BINS}) + 1, {C.HISTOGRAM_BINS})
          ELSE {C.HISTOGRAM_BINS // 2 + 1} END AS INTEGER) AS bin,
     lo, hi
   FROM preds p JOIN rng r ON p.model = r.model AND p.label = r.label) t
   CROSS JOIN LATERAL (SELECT CASE WHEN hi > lo THEN lo + (bin - 1) * (hi - lo) / {C.HISTOGRAM_BINS}
                            ELSE lo - 0.5 + (bin - 1) * 1.0 / {C.HISTOGRAM_BINS} END AS bin_start)
 GROUP BY model, label, bin, bin_start""")
def score_histogram_q(spark, sf_dir):
    """30-bin histogram of the test probabilities per (model, class)."""
    return rounded(E.score_histogram(FM.predictions(spark, sf_dir), ["model", "label"]))


@query("score_summary", FM.chain() + f"""
 SELECT {r6('min(PROB_LR)')} AS min_score, {r6('max(PROB_LR)')} AS max_score,
   {r6('avg(PROB_LR)')} AS mean_score, {r6('median(PROB_LR)')} AS median_score FROM scored_b""")
def score_summary_q(spark, sf_dir):
    """Min / max / mean / median of the main probability over every admission."""
    return rounded(P.score_summary(FM.scored(spark, sf_dir), score="PROB_LR"))


@query("risk_tier", FM.chain() + f"""
 SELECT INGRESO_ACTUAL, PROB_LR AS probability, {S.tier('PROB_LR')} AS NIVEL_RIESGO_REINGRESO FROM scored_b""")
def risk_tier_q(spark, sf_dir):
    s = FM.scored(spark, sf_dir)
    return rounded(s.select("INGRESO_ACTUAL", F.col("PROB_LR").alias("probability"),
                            X.risk_tier("PROB_LR").alias("NIVEL_RIESGO_REINGRESO")))


@query("risk_distribution", FM.chain() + f"""
 SELECT tier, CAST(n_episodes AS BIGINT) AS n_episodes, {r6('n_episodes * 100.0 / SUM(n_episodes) OVER ()')} AS pct,
   {S.tier_rank('tier')} AS tier_order
 FROM (SELECT {S.tier('PROB_LR')} AS tier, COUNT(*) AS n_episodes FROM scored_b GROUP BY 1)""")
def risk_distribution_q(spark, sf_dir):
    s = FM.scored(spark, sf_dir).withColumn("NIVEL_RIESGO_REINGRESO", X.risk_tier("PROB_LR"))
    return rounded(P.risk_distribution(s))


@query("ensemble", FM.chain(FM.RUNNING, FM.AUC, FM.METRICS) + f"""
 SELECT INGRESO_ACTUAL, PROB_LR AS PROB_REINGRESO_LR, PROB_RF AS PROB_REINGRESO_RF, PROB_GB AS PROB_REINGRESO_GB,
   {r6('(PROB_LR + PROB_RF + PROB_GB) / 3')} AS PROB_REINGRESO_ENSEMBLE,
   CASE best_model WHEN '{C.MODEL_LR}' THEN PROB_LR WHEN '{C.MODEL_RF}' THEN PROB_RF ELSE PROB_GB END
     AS PROBABILIDAD_REINGRESO,
   {S.tier(f"CASE best_model WHEN '{C.MODEL_LR}' THEN PROB_LR WHEN '{C.MODEL_RF}' THEN PROB_RF ELSE PROB_GB END")}
     AS NIVEL_RIESGO_REINGRESO, best_model AS MODELO_USADO
 FROM scored_b, best""")
def ensemble_q(spark, sf_dir):
    """Three probabilities, their mean, the best-AUC model's one as main, and its tier."""
    from carelens.plans.scoring import score_columns
    s = FM.scored(spark, sf_dir)
    best = E.best_model(E.model_metrics(FM.predictions(spark, sf_dir))).first()["best_model"]
    out = score_columns(s.withColumnRenamed("PROB_LR", "PROB_REINGRESO_LR")
                         .withColumnRenamed("PROB_RF", "PROB_REINGRESO_RF")
                         .withColumnRenamed("PROB_GB", "PROB_REINGRESO_GB"), best)
    return rounded(out.select("INGRESO_ACTUAL", "PROB_REINGRESO_LR", "PROB_REINGRESO_RF", "PROB_REINGRESO_GB",
                              "PROB_REINGRESO_ENSEMBLE", "PROBABILIDAD_REINGRESO", "NIVEL_RIESGO_REINGRESO",
                              F.lit(best).alias("MODELO_USADO")))


# ---- the same operators on a score of its own per row ----------------------

@query("roc_auc_dense", FM.dense_chain(FM.RUNNING, FM.AUC) + f" SELECT model, {r6('roc_auc')} AS roc_auc FROM auc")
def roc_auc_dense(spark, sf_dir):
    return rounded(E.roc_auc(FM.dense_predictions(spark, sf_dir)))


@query("average_precision_dense", FM.dense_chain(FM.RUNNING) + f"""
 SELECT model, {r6("coalesce(SUM((pos * 1.0 / NULLIF(P, 0)) * (tps * 1.0 / NULLIF(tps + fps, 0))), 0)")}
   AS average_precision FROM running GROUP BY model""")
def average_precision_dense(spark, sf_dir):
    return rounded(E.average_precision(FM.dense_predictions(spark, sf_dir)))


@query("roc_points_dense", FM.dense_chain(FM.RUNNING) + f"""
 SELECT model, {r6('score')} AS threshold, {r6('fps * 1.0 / NULLIF(N, 0)')} AS fpr, {r6('tps * 1.0 / NULLIF(P, 0)')} AS tpr
 FROM running
 WHERE (tps = pos AND fps = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
 UNION ALL
 SELECT model, NULL AS threshold, 0.0 AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr FROM totals""")
def roc_points_dense(spark, sf_dir):
    return rounded(E.roc_points(FM.dense_predictions(spark, sf_dir)))


@query("pr_points_dense", FM.dense_chain(FM.RUNNING) + f"""
 SELECT model, {r6('score')} AS threshold, {r6('coalesce(tps * 1.0 / NULLIF(tps + fps, 0), 0)')} AS precision,
   {r6('CASE WHEN P = 0 THEN 1.0 ELSE tps * 1.0 / P END')} AS recall FROM running
 UNION ALL
 SELECT model, NULL AS threshold, 1.0 AS precision, 0.0 AS recall FROM totals""")
def pr_points_dense(spark, sf_dir):
    return rounded(E.pr_points(FM.dense_predictions(spark, sf_dir)))


@query("model_metrics_dense", FM.dense_chain(FM.RUNNING, FM.AUC, FM.METRICS) + f"""
 SELECT model, {r6('accuracy_pct')} AS accuracy_pct, {r6('precision_pct')} AS precision_pct,
   {r6('recall_pct')} AS recall_pct, {r6('f1_pct')} AS f1_pct, {r6('roc_auc_pct')} AS roc_auc_pct FROM metrics""")
def model_metrics_dense(spark, sf_dir):
    return rounded(E.model_metrics(FM.dense_predictions(spark, sf_dir)))


@query("score_summary_dense", FM.dense_chain() + f"""
 SELECT model, {r6('min(score)')} AS min_score, {r6('max(score)')} AS max_score,
   {r6('avg(score)')} AS mean_score, {r6('median(score)')} AS median_score FROM preds GROUP BY model""")
def score_summary_dense(spark, sf_dir):
    return rounded(P.score_summary(FM.dense_predictions(spark, sf_dir), by=["model"]))


@query("score_histogram_overall", FM.chain("rng AS (SELECT min(PROB_LR) AS lo, max(PROB_LR) AS hi FROM scored_b)") + f"""
 SELECT bin, {r6(f'lo + (bin - 1) * (hi - lo) / {C.HISTOGRAM_BINS}')} AS bin_start, CAST(COUNT(*) AS BIGINT) AS n FROM (
   SELECT CAST(least(floor((PROB_LR - lo) / (hi - lo) * {C.HISTOGRAM_BINS}) + 1, {C.HISTOGRAM_BINS}) AS INTEGER) AS bin, lo, hi
   FROM scored_b, rng) GROUP BY bin, lo, hi""")
def score_histogram_overall(spark, sf_dir):
    """One 30-bin histogram of a probability over every admission."""
    return rounded(E.score_histogram(FM.scored(spark, sf_dir), [], score="PROB_LR"))


# Placement values row by row, from plain windows.
PLACED = """placed AS (
  SELECT *, CASE WHEN label = 1 THEN (negs - neg_ties / 2.0) / nullif(N, 0) ELSE (P - poss + pos_ties / 2.0) / nullif(P, 0) END AS v FROM (
    SELECT *, COUNT(*) FILTER (WHERE label = 0) OVER up AS negs, COUNT(*) FILTER (WHERE label = 1) OVER up AS poss,
      COUNT(*) FILTER (WHERE label = 0) OVER ties AS neg_ties, COUNT(*) FILTER (WHERE label = 1) OVER ties AS pos_ties,
      COUNT(*) FILTER (WHERE label = 1) OVER whole AS P, COUNT(*) FILTER (WHERE label = 0) OVER whole AS N
    FROM preds WINDOW up AS (PARTITION BY model ORDER BY score RANGE UNBOUNDED PRECEDING), ties AS (PARTITION BY model, score),
      whole AS (PARTITION BY model)))"""
VARIANCE = "sqrt(var_samp(v) FILTER (WHERE label = 1) / COUNT(*) FILTER (WHERE label = 1) + var_samp(v) FILTER (WHERE label = 0) / COUNT(*) FILTER (WHERE label = 0))"
INTERVALS = f"""intervals AS (SELECT model, avg(v) FILTER (WHERE label = 1) AS auc, {VARIANCE} AS se,
  COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg FROM placed GROUP BY model)"""
INTERVAL_SELECT = f""" SELECT model, {r6('auc')} AS auc, {r6('se')} AS se, {r6(f'greatest(0, auc - {DL.Z95} * se)')} AS low,
   {r6(f'least(1, auc + {DL.Z95} * se)')} AS high, n_pos, n_neg FROM intervals"""
DIFFERENCES = f"""rank_m AS (SELECT model, {FM.MODEL_RANK} AS r FROM intervals), matched AS (
  SELECT a.model AS model_a, b.model AS model_b, a.label AS label, a.v - b.v AS v FROM placed a JOIN placed b
    ON a.INGRESO_ACTUAL = b.INGRESO_ACTUAL JOIN rank_m x ON x.model = a.model JOIN rank_m y ON y.model = b.model WHERE x.r < y.r),
 diffs AS (SELECT model_a, model_b, {VARIANCE} AS se FROM matched GROUP BY ALL)"""
DIFFERENCE_SELECT = f""" SELECT model_a, model_b, {r6('a.auc')} AS auc_a, {r6('b.auc')} AS auc_b, {r6('a.auc - b.auc')} AS difference, {r6('d.se')} AS se,
   {r6('(a.auc - b.auc) / d.se')} AS z, abs((a.auc - b.auc) / d.se) > {DL.Z95} AS "distinct"
 FROM diffs d JOIN intervals a ON a.model = model_a JOIN intervals b ON b.model = model_b"""


@query("auc_intervals", FM.chain(PLACED, INTERVALS) + INTERVAL_SELECT)
def auc_intervals_q(spark, sf_dir):
    """ROC AUC of each model with its standard error and 95 % interval."""
    return rounded(DL.auc_intervals(FM.predictions(spark, sf_dir)))


@query("auc_intervals_dense", FM.dense_chain(PLACED, INTERVALS) + INTERVAL_SELECT)
def auc_intervals_dense(spark, sf_dir):
    return rounded(DL.auc_intervals(FM.dense_predictions(spark, sf_dir)))


@query("auc_differences", FM.chain(PLACED, INTERVALS, DIFFERENCES) + DIFFERENCE_SELECT)
def auc_differences_q(spark, sf_dir):
    """Whether one model's AUC is above another's by more than its uncertainty."""
    return rounded(DL.auc_differences(FM.predictions(spark, sf_dir), C.MODEL_ORDER))


@query("auc_differences_dense", FM.dense_chain(PLACED, INTERVALS, DIFFERENCES) + DIFFERENCE_SELECT)
def auc_differences_dense(spark, sf_dir):
    return rounded(DL.auc_differences(FM.dense_predictions(spark, sf_dir), C.MODEL_ORDER))
