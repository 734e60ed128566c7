"""Result tables that are kept, found again, and built anew when they are out of date.

A saved table stands under ``<folder>/<name>/<fingerprint>/<time>``. The fingerprint is
of the input's rows (their number and a sum of row hashes: one aggregate, any order,
any partitions) and of the parameters, so new or changed input is never answered from an
old table. A table also ends with its age. ``meta`` is written after the rows: a job
that was lost half way leaves no table. Old tables are left for whoever still reads them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a saved table is used.
MAX_AGE = 360


def fingerprint(df: DataFrame, **params) -> str:
    """Of the columns, the rows whatever their order, and the parameters."""
    columns = sorted(df.columns)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    # A null adds nothing to a row's hash: where the nulls stand is hashed too.
    nulls = F.xxhash64(F.concat_ws("", *(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in columns)))
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.sum(F.xxhash64(row, nulls).cast("decimal(20,0)"))).first()
    types = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return sha256(json.dumps([types, n, str(a), str(b), params], sort_keys=True, default=str).encode()).hexdigest()[:32]


@dataclass
class Results:
    """Saved tables in a folder that all executors share."""
    spark: SparkSession
    folder: str
    max_age: float = MAX_AGE
    clock: Callable[[], float] = time.time
    log: list[tuple[str, bool]] = field(default_factory=list)

    def _saved(self, place: str) -> str | None:
        """The newest whole table of a place that is young enough."""
        try:
            found = self.spark.read.text(f"{place}/*/meta").agg(F.max(F.get_json_object("value", "$.at").cast("double"))).first()[0]
        except AnalysisException:
            return None
        return f"{place}/{self._stamp(found)}" if found is not None and self.clock() - found <= self.max_age else None

    @staticmethod
    def _stamp(at: float) -> str:
        return str(round(at * 1000))

    def table(self, name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame], **params) -> DataFrame:
        """``build(source)``, read from its saved copy if there is one for this source,
        these parameters and no greater age."""
        place = f"{self.folder.rstrip('/')}/{name}/{fingerprint(source, **params)}"
        path = self._saved(place)
        self.log.append((name, path is not None))
        if path is None:
            at = round(self.clock(), 3)
            path = f"{place}/{self._stamp(at)}"
            build(source).write.parquet(f"{path}/rows")
            self.spark.createDataFrame([(json.dumps({"at": at, "name": name}),)], "value string").coalesce(1).write.text(f"{path}/meta")
        return self.spark.read.parquet(f"{path}/rows")
