"""Writers for the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

def write_table(df: DataFrame, target: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a result table as Parquet, CSV (with header) or a catalog table.

    Large tables keep their partitioning (many files, written in parallel).
    """
    if fmt == "table":
        w = df.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.saveAsTable(target)
        return
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # Texts as they are: the writer would otherwise cut blanks at their ends.
        w = (w.option("header", True).option("encoding", "UTF-8")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(target)


def write_small_table(df: DataFrame, target: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table that is small by what it holds (one row per model, variable
    or pair of variables) as one file. Tables that grow with the data: ``write_table``."""
    write_table(df.coalesce(1), target, fmt, mode)
