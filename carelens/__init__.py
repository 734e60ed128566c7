"""carelens: hospital-readmission analytics as Spark DataFrame operators.

Layers
------
sources    read the episode table (Parquet, JDBC, test fixture) and write results
functions  column expressions (codes, bands, pressure, label, tiers) - all built-in, no UDF
operators  DataFrame -> DataFrame steps: profiles, windows, imputation, split,
           correlation, evaluation, lookups and reports
plans      the end-to-end jobs: prepare -> impute -> split -> fit -> score -> publish
streaming  incremental scoring of newly arriving admissions with a saved model
"""

from carelens.config import Config

__all__ = ["Config"]
