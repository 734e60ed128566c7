"""Rows dealt to partitions so that every run sees the same partitions.

Tree learners draw bootstrap samples and candidate splits per partition, so a fit can
only be repeated if the same rows stand in the same partitions in the same order.
``repartitionByRange`` samples its bounds and does not give that. Here a row's
partition is a function of its id alone (``hash_key``, as in the split), whatever the
cluster, the input's partitions or its row order, and rows are sorted inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens import config as C
from carelens.operators.split import hash_key

#: Binary places that tree weights are rounded to: sums of so rounded weights are
#: exact up to 2^37, and so do not depend on the order in which partitions are added.
WEIGHT_BITS = 16


def partition_count(rows: int, rows_per_partition: int) -> int:
    return max(1, -(-rows // rows_per_partition))


def partition_number(id_col: str, parts: int, seed: int = C.SEED) -> Column:
    """The partition of a row, from its id; rows without an id: the first."""
    return F.coalesce(hash_key(id_col, seed) % parts, F.lit(0)).cast("int")


def deal(df: DataFrame, id_col: str, parts: int, ties: list[str] = (), seed: int = C.SEED) -> DataFrame:
    """df in ``parts`` partitions by ``partition_number``, sorted by id and ``ties``."""
    return (df.repartitionById(parts, partition_number(id_col, parts, seed))
            .sortWithinPartitions(id_col, *(t for t in ties if t != id_col)))


def exact_weight(weight: str) -> Column:
    """The weight on a grid of 2^-WEIGHT_BITS, at least one step."""
    grid = float(1 << WEIGHT_BITS)
    return F.greatest(F.round(F.col(weight) * grid), F.lit(1.0)) / grid
