"""The corpus pipeline: ``STAGES`` over ``documents``, each stage on all that
its predecessor kept, written as Parquet in the shared folder and read again.

1. toxicity: rows scored 1/2 or more go; the model is fitted on labelled rows.
2. near_duplicates: one row of each SimHash component stays.
3. benchmark: rows that hold a ten-word window of a benchmark item go.
4. pii: personal data in the texts becomes surrogates; ``n_chars`` follows.
5. mixing: rows are chosen for the target weights; ``mix_copies`` says how often
   each is taken, ``mix_domain`` and ``mix_tokens`` from what it was chosen.

Defined cases, the same in every stage: nulls in any column pass (a null text is not
toxic, has no words of a benchmark and no personal data; all texts without words are
one near-duplicate component, so one of them stays); texts are read whole, whatever
their length; rows repeated with their id count as one component, of which one stays;
an empty table gives no rows; columns beyond those of documents pass through, unless
named like those that mixing adds, which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm.decontaminate import decontaminate
from carelens.llm.mixing import BUDGET_SHARE, MAX_EPOCHS, SEED, WEIGHTS, default_levels, mix_sources
from carelens.llm.simhash import drop_near_duplicates
from carelens.llm.surrogates import with_surrogates
from carelens.llm.toxicity import drop_toxic, fit_toxicity
from carelens.session import ensure_checkpoint_dir, ship_package

#: The pipeline's key for surrogates; a user sets a secret of their own.
SURROGATE_KEY = b"corpus-pipeline"


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


@_prepared
def toxicity(spark, docs, sf_dir):
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_prepared
def near_duplicates(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


@_prepared
def benchmark(spark, docs, sf_dir):
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_prepared
def pii(spark, docs, sf_dir):
    return with_surrogates(docs, SURROGATE_KEY, length_col="n_chars")


@_prepared
def mixing(spark, docs, sf_dir):
    out = mix_sources(docs, default_levels(), WEIGHTS, budget_share=BUDGET_SHARE, max_epochs=MAX_EPOCHS, seed=SEED)
    added = {"mix_domain": F.col("branch.domain"), "mix_tokens": F.col("tokens"), "mix_copies": F.col("copies")}
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in added), *(v.alias(k) for k, v in added.items()))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pii", pii), ("mixing", mixing)]

#: SQL has neither the trained model, nor XXH64 fingerprints, nor keyed surrogates;
#: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
