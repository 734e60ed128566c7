"""Queries over the trained models (rows-only checks: tree models have no SQL twin).

Models are fitted once per (Spark application, data folder, variant) and shared
by every query key that needs them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators import evaluate as E
from carelens.plans import inputs as I
from carelens.plans import train as TR
from carelens.plans.catalog import query
from carelens.plans.scoring import export_projection
from carelens.session import ensure_checkpoint_dir

_FITTED: dict = {}


def fitted(spark, sf_dir: str, variant: str = "batch") -> TR.Fitted:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), variant)
    if key not in _FITTED:
        ensure_checkpoint_dir(spark)
        _FITTED[key] = TR.fit(spark, I.prepared(spark, sf_dir, variant), I.cfg_of(variant))
    return _FITTED[key]


@query("train_lr")
def train_lr(spark, sf_dir):
    """Logistic regression coefficients (ascending by |coef|)."""
    return TR.importance_table(spark, fitted(spark, sf_dir), "lr")


@query("train_rf")
def train_rf(spark, sf_dir):
    """Random forest feature importances (ascending)."""
    return TR.importance_table(spark, fitted(spark, sf_dir), "rf")


@query("train_gbt")
def train_gbt(spark, sf_dir):
    """Gradient boosting feature importances (ascending)."""
    return TR.importance_table(spark, fitted(spark, sf_dir), "gb")


@query("score_all")
def score_all(spark, sf_dir):
    """Three model probabilities for every admission."""
    fm = fitted(spark, sf_dir)
    return TR.probabilities(fm, fm.data).select(
        "INGRESO_ACTUAL", "REINGRESO", "is_test", "PROB_REINGRESO_LR", "PROB_REINGRESO_RF", "PROB_REINGRESO_GB")


@query("trained_metrics")
def trained_metrics(spark, sf_dir):
    """Accuracy / precision / recall / F1 / ROC-AUC (%) of the three trained models on the test rows."""
    return E.model_metrics(TR.test_predictions(fitted(spark, sf_dir)))


@query("trained_best_model")
def trained_best_model(spark, sf_dir):
    fm = fitted(spark, sf_dir)
    return E.best_model(E.model_metrics(TR.test_predictions(fm)))


@query("trained_roc_points")
def trained_roc_points(spark, sf_dir):
    return E.roc_points(TR.test_predictions(fitted(spark, sf_dir)))


@query("trained_pr_points")
def trained_pr_points(spark, sf_dir):
    return E.pr_points(TR.test_predictions(fitted(spark, sf_dir)))


@query("trained_average_precision")
def trained_average_precision(spark, sf_dir):
    return E.average_precision(TR.test_predictions(fitted(spark, sf_dir)))


@query("trained_confusion_matrix")
def trained_confusion_matrix(spark, sf_dir):
    return E.confusion(TR.test_predictions(fitted(spark, sf_dir)))


@query("variable_weights")
def variable_weights(spark, sf_dir):
    """LR |coef| share, RF and GB importance (%), their mean, ranked (batch variant)."""
    return TR.variable_weights(spark, fitted(spark, sf_dir)).orderBy(F.col("`Peso_Promedio_%`").desc())


@query("scored_episodes")
def scored_episodes(spark, sf_dir):
    """The BI export: every admission with probabilities, ensemble, tier and model used."""
    fm = fitted(spark, sf_dir)
    return export_projection(TR.score_all(fm), "batch", fm.best)


@query("predictions")
def predictions(spark, sf_dir):
    """The service variant's published predictions table (inpatients, KNN-imputed)."""
    fm = fitted(spark, sf_dir, "service")
    return export_projection(TR.score_all(fm), "service")


@query("service_variable_weights")
def service_variable_weights(spark, sf_dir):
    fm = fitted(spark, sf_dir, "service")
    return TR.variable_weights(spark, fm).orderBy(F.col("`Peso_Promedio_%`").desc())


@query("trained_risk_distribution")
def trained_risk_distribution(spark, sf_dir):
    from carelens.operators.profile import risk_distribution
    return risk_distribution(TR.score_all(fitted(spark, sf_dir)))


@query("trained_score_histogram")
def trained_score_histogram(spark, sf_dir):
    return E.score_histogram(TR.test_predictions(fitted(spark, sf_dir)), ["model", "label"])



@query("trained_score_histogram_overall")
def trained_score_histogram_overall(spark, sf_dir):
    """One histogram of the main probability over every admission."""
    return E.score_histogram(TR.score_all(fitted(spark, sf_dir)), [], score="PROBABILIDAD_REINGRESO")


@query("importance_tables")
def importance_tables(spark, sf_dir):
    """The three models' variable rankings in one long table."""
    fm = fitted(spark, sf_dir)
    lr = TR.importance_table(spark, fm, "lr").select(F.lit("lr").alias("model"), "Variable", F.col("Importancia_Abs").alias("Importancia"))
    trees = [TR.importance_table(spark, fm, k).select(F.lit(k).alias("model"), "Variable", "Importancia") for k in ("rf", "gb")]
    return lr.unionByName(trees[0]).unionByName(trees[1])


@query("lr_stationarity", """
 SELECT unnest([""" + ", ".join(f"'{f}'" for f in [*C.BATCH_FEATURES, "(intercept)"]) + """]) AS feature, 0.0 AS gradient""")
def lr_stationarity(spark, sf_dir):
    """The penalised mean loss' gradient at the fitted coefficients, per feature: 0 at the optimum."""
    return TR.lr_gradient(spark, fitted(spark, sf_dir))
