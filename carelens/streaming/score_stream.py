"""Score admissions as they arrive, with models fitted by the batch job.

Structured Streaming reads new episode files, applies the same stateless
projections as the batch job (extract, prepare, median imputation with the
fitted values, scaling with the fitted statistics, the three models, tiers)
and writes each micro-batch to its own folder with ``foreachBatch``. The stream's
progress lives in ``checkpoint_location``, a stable folder of the caller's.
Only the batch variant streams: KNN imputation needs the whole donor table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from carelens.operators.impute import impute_median
from carelens.operators.prepare import prepare
from carelens.operators.split import standardize
from carelens.plans import train as TR
from carelens.plans.scoring import export_projection, score_columns
from carelens.sources.episodes import SOURCE_SCHEMA, extract


def scored_stream(spark: SparkSession, fitted: TR.Fitted, source_dir: str) -> DataFrame:
    if fitted.cfg.variant != "batch" or fitted.medians is None:
        raise NotImplementedError("streaming scoring needs the median-imputed batch variant")
    stream = spark.readStream.schema(SOURCE_SCHEMA).parquet(source_dir)
    prepared = prepare(extract(stream, fitted.cfg.only_inpatient), fitted.cfg)
    imputed = impute_median(prepared, fitted.features, values=fitted.medians)
    scaled = standardize(imputed, fitted.stats, suffix=TR.Z)
    scored = score_columns(TR.probabilities(fitted, scaled), fitted.best)
    return export_projection(scored, "batch", fitted.best)


def score_stream(spark: SparkSession, fitted: TR.Fitted, source_dir: str, sink_dir: str,
                 checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query. ``checkpoint_location`` must outlive the application: a
    restart with the same folder goes on where it stopped. A batch is written to a
    folder of its own (``batch_id=N``), replacing it, so a retried batch leaves no row twice."""
    out = scored_stream(spark, fitted, source_dir)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("NIVEL_RIESGO_REINGRESO").parquet(f"{sink_dir}/batch_id={epoch_id}")

    writer = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
