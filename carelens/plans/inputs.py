"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelens.config import Config
from carelens.operators.prepare import prepare
from carelens.sources import fixture
from carelens.session import ensure_checkpoint_dir
from carelens.sources.episodes import extract

BATCH = Config("batch")
SERVICE = Config("service")


def cfg_of(variant: str) -> Config:
    return BATCH if variant == "batch" else SERVICE


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)  # queries checkpoint intermediate tables
    return fixture.episodes(spark, sf_dir)


def extracted(spark: SparkSession, sf_dir: str, variant: str = "batch") -> DataFrame:
    return extract(episodes(spark, sf_dir), only_inpatient=cfg_of(variant).only_inpatient)


def prepared(spark: SparkSession, sf_dir: str, variant: str = "batch", **kw) -> DataFrame:
    return prepare(extracted(spark, sf_dir, variant), cfg_of(variant), **kw)
