"""Missing-value treatment.

``impute_median``: exact medians, or sketched ones where the caller passes them in (``windows.exact_medians``: values counted and
ranked in slices, one row per feature comes back to the driver), then ``coalesce(col, median)`` in the projection.
``impute_knn``: see ``carelens.operators.knn``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.windows import approximate_medians, exact_medians


def medians(df: DataFrame, features: list[str], error: float | None = None) -> dict[str, float | None]:
    """Median per feature, NaN counted as missing (None: no value): exact, or with
    ``error`` a value whose rank is that close to the middle. One row per feature
    comes back to the driver."""
    rows = exact_medians(df, features) if error is None else approximate_medians(df, features, error)
    found = {r["feature"]: r["median"] for r in rows.collect()}
    return {f: found.get(f) for f in features}


def impute_median(df: DataFrame, features: list[str], fit_rows: DataFrame | None = None,
                  values: dict[str, float | None] | None = None) -> DataFrame:
    """Replace NULL/NaN in ``features`` by the median of ``fit_rows`` (default: ``df``),
    or by given ``values``. Features become doubles (a column with no value stays NULL)."""
    m = values if values is not None else medians(fit_rows if fit_rows is not None else df, features)
    out = df
    for f in features:
        c = F.col(f).cast("double")
        c = F.when(~F.isnan(c), c)
        out = out.withColumn(f, F.coalesce(c, F.lit(m[f]).cast("double")))
    return out
