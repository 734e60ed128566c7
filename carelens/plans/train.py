"""Model training, evaluation and scoring with ``pyspark.ml``.

Job shape: prepare -> impute -> split -> (checkpoint) -> fit LR, RF, GBT ->
predict the test rows -> metrics and best model -> score every row.

* The prepared table is read by the medians and the split, the split one by three fits,
  evaluation and scoring, so each is checkpointed once into ``spark.checkpoint.dir``:
  lineage is cut and a lost executor re-reads the checkpoint instead of recomputing the
  fixture. Weights and standardised features are projections of it.
* So are the dealt training rows, since every task of some 500 stages carries the lineage of
  what it reads, and the test rows' probabilities, which every evaluation reads.
* The three fits do not depend on each other and run at the same time: boosting's several
  hundred short jobs leave cores idle between them.
* LR reproduces an L2 penalty of C=1 on the sum of losses: Spark minimises the
  weighted mean loss + regParam/2 * |w|^2, so regParam = 1 / sum(weights).
  Features are standardised with the training rows' mean and population
  deviation beforehand (``standardization=False``).
* Tree models run on raw features; class weights through ``weightCol``. Training rows
  are dealt by a hash of their id (``operators/deal.py``), so a fit can be repeated.
"""

from __future__ import annotations

import json
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens import config as C
from carelens.config import Config
from carelens.operators import evaluate as E
from carelens.operators.deal import deal, exact_weight, partition_count
from carelens.operators.impute import impute_median, medians
from carelens.operators.split import class_weights, scaler_stats, standardize, stratified_split, weight_column
from carelens.plans.scoring import PROB_COLS, score_columns
from carelens.session import ensure_checkpoint_dir, jit_sized_methods

Z = "__z"
TREE_WEIGHT = "tree_weight"
#: Rows of a training partition, partitions that more rows than that are spread over
#: first, and rows of a partition from which on there are more of them.
TRAIN_ROWS_PER_PARTITION, TRAIN_PARTITIONS, TRAIN_ROWS_AT_MOST = 15_000, 36, 500_000


@dataclass
class Fitted:
    cfg: Config
    features: list[str]
    stats: dict
    weights: dict
    reg_param: float
    lr: PipelineModel
    rf: PipelineModel
    gb: PipelineModel
    data: DataFrame | None  # imputed, split (checkpointed), weighted, scaled (None after load)
    medians: dict | None = None  # imputation values (batch variant)
    tested: DataFrame | None = None  # test rows' label and probabilities (checkpointed)
    aucs: dict = field(default_factory=dict)
    best: str = ""


def model_ready(prepared: DataFrame, cfg: Config, knn_imputed: DataFrame | None = None):
    """(imputed features + ``is_test`` + ``weight``, class weights, imputation values)."""
    feats = cfg.features
    # The rows feed the medians and the split (class counts, hash histogram, cut), and the
    # split ones class weights, scaling, fits and scoring: both are materialised once in the
    # checkpoint folder, so the source is read once and a row's hash computed once more.
    if cfg.variant == "batch":
        with jit_sized_methods(prepared.sparkSession):
            rows = prepared.checkpoint(eager=True)
        if cfg.fit_on == "train":
            split = stratified_split(rows).checkpoint(eager=True)
            fill = medians(split.filter(~F.col("is_test")), feats, cfg.median_error)
            imputed = impute_median(split, feats, values=fill)
        else:
            fill = medians(rows, feats, cfg.median_error)
            imputed = stratified_split(impute_median(rows, feats, values=fill)).checkpoint(eager=True)
    else:
        if knn_imputed is None:
            from carelens.operators.knn import impute_knn
            knn_imputed = impute_knn(prepared, feats, id_col="INGRESO_ACTUAL")
        imputed = stratified_split(knn_imputed.checkpoint(eager=True)).checkpoint(eager=True)
        fill = None
    weights_from = imputed.filter(~F.col("is_test")) if cfg.weights_from == "train" else imputed
    w = class_weights(weights_from).first().asDict()
    return weight_column(imputed, w), w, fill


def _assemblers(features: list[str]):
    raw = VectorAssembler(inputCols=features, outputCol="features_raw", handleInvalid="keep")
    scaled = VectorAssembler(inputCols=[f + Z for f in features], outputCol="features_z", handleInvalid="keep")
    return raw, scaled


def training_partition_count(n_train: int) -> int:
    """Partitions of the training rows, from their number alone. Tree learners run a job
    per level and round, with two stages of as many tasks as there are partitions: small
    inputs do not pay for idle tasks, and larger ones fill their partitions up to
    TRAIN_ROWS_AT_MOST rows before they get more than TRAIN_PARTITIONS of them."""
    spread = partition_count(n_train, TRAIN_ROWS_PER_PARTITION)
    return min(spread, max(TRAIN_PARTITIONS, partition_count(n_train, TRAIN_ROWS_AT_MOST)))


def training_rows(train: DataFrame, features: list[str], n_train: int) -> DataFrame:
    """The training rows as the learners read them, and the columns that they read: dealt
    by a hash of the id into ``training_partition_count`` partitions, whatever the
    cluster's size, and sorted; with weights for the trees whose sums are exact."""
    train = train.withColumn(TREE_WEIGHT, exact_weight("weight")).select(
        "INGRESO_ACTUAL", "REINGRESO", "weight", TREE_WEIGHT, *features, *(f + Z for f in features))
    return deal(train, "INGRESO_ACTUAL", training_partition_count(n_train), ["REINGRESO", *features])


def fit_together(estimators: list[Pipeline], train: DataFrame) -> list[PipelineModel]:
    """The estimators' models on the same rows (persisted), fitted at the same time."""
    train.count()                                   # fills the persisted rows once, for all of them
    with ThreadPoolExecutor(len(estimators)) as pool:
        fits = [pool.submit(inheritable_thread_target(train.sparkSession)(e.fit), train) for e in estimators]
        return [f.result() for f in fits]


def fit(spark: SparkSession, prepared: DataFrame, cfg: Config = Config(), knn_imputed: DataFrame | None = None,
        trees: int = C.FOREST_TREES, rounds: int = C.BOOST_ROUNDS) -> Fitted:
    ensure_checkpoint_dir(spark)
    feats = cfg.features
    data, w, fill = model_ready(prepared, cfg, knn_imputed)
    train_rows = data.filter(~F.col("is_test"))
    stats = scaler_stats(train_rows, feats)
    data = standardize(data, stats, suffix=Z)
    train = data.filter(~F.col("is_test"))
    n_train, n_pos, sum_w = train.agg(F.count(F.lit(1)), F.sum("REINGRESO"), F.sum("weight")).first()
    if not n_pos or n_pos == n_train:
        raise ValueError(f"training needs rows of both classes; {n_pos or 0} of {n_train} training rows are readmissions")
    if n_pos < C.FEW_POSITIVES:
        warnings.warn(f"only {n_pos} readmissions among {n_train} training rows; results may be unreliable", stacklevel=2)
    train = training_rows(train, feats, n_train).checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    raw, scaled = _assemblers(feats)

    lr = LogisticRegression(featuresCol="features_z", labelCol="REINGRESO", weightCol="weight",
                            regParam=1.0 / sum_w, elasticNetParam=0.0, standardization=False,
                            maxIter=C.LR_MAX_ITER, tol=1e-8, probabilityCol="p_lr", rawPredictionCol="r_lr",
                            predictionCol="y_lr")
    rf = RandomForestClassifier(featuresCol="features_raw", labelCol="REINGRESO", weightCol=TREE_WEIGHT,
                                numTrees=trees, maxDepth=C.TREE_DEPTH, featureSubsetStrategy="sqrt",
                                maxBins=cfg.max_bins, seed=cfg.seed, probabilityCol="p_rf",
                                rawPredictionCol="r_rf", predictionCol="y_rf")
    gb_params = dict(featuresCol="features_raw", labelCol="REINGRESO", maxIter=rounds, maxDepth=C.TREE_DEPTH,
                     stepSize=C.BOOST_RATE, seed=cfg.seed, maxBins=cfg.max_bins,
                     checkpointInterval=10, predictionCol="y_gb")
    if cfg.weighted_boosting:
        gb_params["weightCol"] = TREE_WEIGHT
    gb = GBTClassifier(**gb_params).setProbabilityCol("p_gb").setRawPredictionCol("r_gb")

    lr_m, rf_m, gb_m = fit_together([Pipeline(stages=[scaled, lr]), Pipeline(stages=[raw, rf]), Pipeline(stages=[raw, gb])], train)
    train.unpersist()
    fitted = Fitted(cfg, feats, stats, w, 1.0 / sum_w, lr_m, rf_m, gb_m, data, medians=fill)
    fitted.tested = test_probabilities(fitted).checkpoint(eager=True)
    metrics = E.model_metrics(test_predictions(fitted))
    rows = {r["model"]: r for r in metrics.collect()}  # one row per model
    fitted.aucs = {m: rows[m]["roc_auc_pct"] / 100.0 for m in rows}
    names = cfg.model_names
    order = [names["lr"], names["rf"], names["gb"]]
    fitted.best = max(order, key=lambda m: (fitted.aucs.get(m, float("-inf")), -order.index(m)))
    fitted.metrics_rows = rows
    return fitted


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """The three models, and as one row of JSON everything else scoring needs:
    variant, features, imputation values, scaler statistics, weights, best model."""
    for key in ("lr", "rf", "gb"):
        getattr(fitted, key).write().overwrite().save(f"{path}/{key}")
    state = {"cfg": asdict(fitted.cfg), "features": fitted.features, "stats": fitted.stats, "weights": fitted.weights,
             "reg_param": fitted.reg_param, "medians": fitted.medians, "aucs": fitted.aucs, "best": fitted.best}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load(spark: SparkSession, path: str) -> Fitted:
    """A fit saved by ``save``, ready for ``score_new``."""
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    models = {key: PipelineModel.load(f"{path}/{key}") for key in ("lr", "rf", "gb")}
    return Fitted(Config(**state["cfg"]), state["features"], {k: tuple(v) for k, v in state["stats"].items()},
                  state["weights"], state["reg_param"], data=None, medians=state["medians"], aucs=state["aucs"],
                  best=state["best"], **models)


def score_new(fitted: Fitted, prepared: DataFrame) -> DataFrame:
    """Prepared admissions scored with a fit (batch variant: medians of the fit;
    service variant: rows must be imputed already)."""
    if fitted.medians is not None:
        prepared = impute_median(prepared, fitted.features, values=fitted.medians)
    return score_columns(probabilities(fitted, standardize(prepared, fitted.stats, suffix=Z)), fitted.best)


def probabilities(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Adds PROB_REINGRESO_LR/RF/GB (positive-class probability of each model)."""
    out = fitted.lr.transform(df)
    out = fitted.rf.transform(out).drop("features_raw")
    out = fitted.gb.transform(out)
    out = (out.withColumn(PROB_COLS["lr"], vector_to_array("p_lr")[1])
              .withColumn(PROB_COLS["rf"], vector_to_array("p_rf")[1])
              .withColumn(PROB_COLS["gb"], vector_to_array("p_gb")[1]))
    drop = [c for c in out.columns if c in ("features_raw", "features_z", "p_lr", "r_lr", "y_lr", "p_rf", "r_rf",
                                            "y_rf", "p_gb", "r_gb", "y_gb") or c.endswith(Z)]
    return out.drop(*drop)


def test_probabilities(fitted: Fitted) -> DataFrame:
    """The test rows' id, label and three probabilities."""
    scored = probabilities(fitted, fitted.data.filter(F.col("is_test")))
    return scored.select("INGRESO_ACTUAL", "REINGRESO", *(PROB_COLS[k] for k in ("lr", "rf", "gb")))


def test_predictions(fitted: Fitted) -> DataFrame:
    """Long predictions table of the test rows: (model, INGRESO_ACTUAL, label, score, prediction)."""
    scored = fitted.tested if fitted.tested is not None else test_probabilities(fitted)
    names = fitted.cfg.model_names
    rows = F.explode(F.array(*[F.struct(F.lit(names[k]).alias("model"), F.col(PROB_COLS[k]).alias("score"))
                               for k in ("lr", "rf", "gb")]))
    out = scored.select("INGRESO_ACTUAL", F.col("REINGRESO").alias("label"), rows.alias("p"))
    return (out.select(F.col("p.model").alias("model"), "INGRESO_ACTUAL", "label", F.col("p.score").alias("score"))
               .withColumn("prediction", (F.col("score") > 0.5).cast("int")))


def score_all(fitted: Fitted) -> DataFrame:
    """Every row (training rows included, as analysed) with three probabilities,
    the best model's, the ensemble mean and the tier."""
    return score_columns(probabilities(fitted, fitted.data), fitted.best)


def ranking_table(spark: SparkSession, names: list[str], values: list[float], signed: bool = False) -> DataFrame:
    """One model's ranking, ascending: importances, or (``signed``) coefficients by their size."""
    if signed:
        rows = [(f, float(v), float(abs(v))) for f, v in zip(names, values, strict=True)]
        return spark.createDataFrame(rows, "Variable string, Coeficiente double, Importancia_Abs double").orderBy("Importancia_Abs")
    rows = [(f, float(v)) for f, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "Variable string, Importancia double").orderBy("Importancia")


def importance_table(spark: SparkSession, fitted: Fitted, which: str) -> DataFrame:
    """One model's ranking: LR coefficients by their size, tree importances."""
    if which == "lr":
        return ranking_table(spark, fitted.features, fitted.lr.stages[-1].coefficients.toArray(), signed=True)
    return ranking_table(spark, fitted.features, (fitted.rf if which == "rf" else fitted.gb).stages[-1].featureImportances.toArray())


def weights_table(spark: SparkSession, features: list[str], coef: list[float], rf_imp: list[float], gb_imp: list[float]) -> DataFrame:
    """Per feature: LR coefficient and |coef| share, RF and GB importance (x100), their
    mean. One row per feature: model attributes, not data."""
    total = sum(abs(c) for c in coef) or float("nan")
    rows = []
    for i, f in enumerate(features):
        lr_pct = abs(coef[i]) / total * 100
        rows.append((i, f, float(coef[i]), float(lr_pct), float(rf_imp[i]), float(rf_imp[i] * 100),
                     float(gb_imp[i]), float(gb_imp[i] * 100),
                     float((lr_pct + rf_imp[i] * 100 + gb_imp[i] * 100) / 3)))
    schema = ("position int, Variable string, Coef_RegLogistica double, `Peso_RegLogistica_%` double, "
              "Importancia_RandomForest double, `Peso_RandomForest_%` double, Importancia_GradientBoosting double, "
              "`Peso_GradientBoosting_%` double, `Peso_Promedio_%` double")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("direction", F.when(F.col("Coef_RegLogistica") > 0, F.lit("aumenta riesgo"))
                                       .otherwise(F.lit("disminuye riesgo")))


def variable_weights(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """``weights_table`` of the fitted models."""
    return weights_table(spark, fitted.features, list(fitted.lr.stages[-1].coefficients.toArray()),
                         list(fitted.rf.stages[-1].featureImportances.toArray()), list(fitted.gb.stages[-1].featureImportances.toArray()))


def lr_gradient(spark: SparkSession, fitted: Fitted, places: int = 4) -> DataFrame:
    """(feature, gradient): the gradient of the weighted mean loss plus penalty at
    the fitted logistic regression, over the training rows, rounded. One aggregate."""
    model = fitted.lr.stages[-1]
    coef, intercept = model.coefficients.toArray(), float(model.intercept)
    rows = fitted.data.filter(~F.col("is_test"))
    z = F.lit(intercept)
    for f, b in zip(fitted.features, coef, strict=True):
        z = z + F.lit(float(b)) * F.col(f + Z)
    miss = (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("REINGRESO")) * F.col("weight")
    sums = rows.agg(F.sum("weight").alias("w"), F.sum(miss).alias("g"),
                    *[F.sum(miss * F.col(f + Z)).alias(f"g{i}") for i, f in enumerate(fitted.features)]).first()
    out = [(f, sums[f"g{i}"] / sums["w"] + fitted.reg_param * float(coef[i])) for i, f in enumerate(fitted.features)]
    out.append(("(intercept)", sums["g"] / sums["w"]))
    return spark.createDataFrame([(f, abs(round(g, places))) for f, g in out], "feature string, gradient double")
