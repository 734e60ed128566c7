"""The end-to-end job: read -> prepare -> impute -> split -> fit -> evaluate -> score -> write.

    python -m carelens.plans.pipeline <episodes parquet | sf_dir | jdbc:...> <out_dir> [batch|service] [JSON of read_jdbc arguments]

Outputs (under ``out_dir``):
  scored/                 every admission scored, Parquet partitioned by risk tier
  scored_csv/             the same rows as CSV parts for BI tools
  correlation_matrix/, target_correlation/, variable_weights/, model_metrics/,
  importance_rf/, importance_gb/, coefficients_lr/    small CSV tables
  models/{lr,rf,gb,state}/  the fitted PipelineModels and what else scoring needs
"""

from __future__ import annotations

import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.config import Config
from carelens.operators import evaluate as E
from carelens.operators.correlation import correlation_matrix, target_correlation
from carelens.operators.knn import impute_knn
from carelens.operators.prepare import prepare
from carelens.plans import train as TR
from carelens.plans.scoring import export_projection
from carelens.sources import fixture
from carelens.sources.episodes import extract, read_jdbc, read_parquet
from carelens.sources.sinks import write_small_table, write_table


def load(spark: SparkSession, source: str, jdbc: dict | None = None) -> DataFrame:
    """An episode Parquet table, a database view (``source`` is a ``jdbc:`` URL,
    ``jdbc`` the arguments of ``read_jdbc``), or a folder of the driver's tables (fixture view)."""
    if source.startswith("jdbc:"):
        return read_jdbc(spark, source, **(jdbc or {}))
    try:
        return read_parquet(spark, source)
    except (AnalysisException, ValueError):
        return fixture.episodes(spark, source)


def run(spark: SparkSession, episodes: DataFrame, out_dir: str, cfg: Config = Config()) -> TR.Fitted:
    prepared = prepare(extract(episodes, cfg.only_inpatient, cfg.collation), cfg)
    fitted = TR.fit(spark, prepared, cfg)
    out = out_dir.rstrip("/")

    export = export_projection(TR.score_all(fitted), cfg.variant, fitted.best if cfg.variant == "batch" else None)
    write_table(export, f"{out}/scored", "parquet", partition_by=["NIVEL_RIESGO_REINGRESO"])
    # The CSV copy reads the rows just written instead of scoring them again.
    write_table(spark.read.parquet(f"{out}/scored").select(*export.columns), f"{out}/scored_csv", "csv")

    if cfg.variant == "batch":
        corr = correlation_matrix(fitted.data, cfg.features + ["REINGRESO"]).checkpoint()
        write_small_table(corr, f"{out}/correlation_matrix")
        write_small_table(target_correlation(corr, "REINGRESO"), f"{out}/target_correlation")
    weights = TR.variable_weights(spark, fitted).orderBy(F.col("`Peso_Promedio_%`").desc())
    write_small_table(weights, f"{out}/variable_weights")
    write_small_table(TR.importance_table(spark, fitted, "rf"), f"{out}/importance_rf")
    write_small_table(TR.importance_table(spark, fitted, "gb"), f"{out}/importance_gb")
    write_small_table(TR.importance_table(spark, fitted, "lr"), f"{out}/coefficients_lr")
    write_small_table(E.model_metrics(TR.test_predictions(fitted)), f"{out}/model_metrics")
    TR.save(spark, fitted, f"{out}/models")
    return fitted


def score_saved(spark: SparkSession, episodes: DataFrame, models_dir: str) -> DataFrame:
    """The export of admissions scored with a saved fit."""
    fitted = TR.load(spark, models_dir)
    prepared = prepare(extract(episodes, fitted.cfg.only_inpatient, fitted.cfg.collation), fitted.cfg)
    if fitted.medians is None:
        prepared = impute_knn(prepared, fitted.features, id_col="INGRESO_ACTUAL")
    return export_projection(TR.score_new(fitted, prepared), fitted.cfg.variant, fitted.best if fitted.cfg.variant == "batch" else None)


def main(argv):
    from carelens.session import get_spark
    source, out_dir = argv[1], argv[2]
    variant = argv[3] if len(argv) > 3 else "batch"
    jdbc = json.loads(argv[4]) if len(argv) > 4 else None
    spark = get_spark()
    fitted = run(spark, load(spark, source, jdbc), out_dir, Config(variant))
    print({"best_model": fitted.best, "auc": fitted.aucs, "out": out_dir})


if __name__ == "__main__":
    main(sys.argv)
