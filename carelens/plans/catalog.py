"""Registered queries: one Spark DataFrame and (where SQL can say it) one
DuckDB oracle per operator of the survey's inventory.

Each query reads the driver's tables under ``sf_dir`` whole. Double columns are
rounded to 6 places on both sides so that last-bit differences between the
engines do not count as mismatches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"
