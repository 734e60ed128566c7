"""The episode fixture's known counts, and every registered query against its DuckDB oracle."""

import pytest
from pyspark.sql import functions as F

from carelens.operators import profile as P
from carelens.plans import all_oracles, all_queries, inputs as I
from carelens.plans.oracle_check import compare

from conftest import SF0001, SF001


def test_fixture_counts_sf001(spark):
    prof = P.extract_profile(I.episodes(spark, SF001)).first()
    assert (prof.n_rows, prof.n_patients) == (15000, 1500)
    r = P.readmission_rate(I.prepared(spark, SF001)).first()
    assert (r.n_same_cause, r.n_within_15_days, r.n_readmissions) == (9001, 1753, 1181)
    assert I.extracted(spark, SF001).agg(F.median("PESO")).first()[0] is not None
    raw_median = I.episodes(spark, SF001).agg(F.median("PESO")).first()[0]
    assert raw_median == 150.0
    v = P.readmission_rate(I.prepared(spark, SF001, "service")).first()
    assert (v.n_rows, v.n_readmissions) == (13125, 1030)
    v1 = P.readmission_rate(I.prepared(spark, SF0001, "service")).first()
    assert (v1.n_rows, v1.n_readmissions) == (1312, 86)


def test_every_query_has_key_and_oracles_are_subset():
    qs, os_ = all_queries(), all_oracles()
    assert set(os_) <= set(qs)
    assert len(os_) >= 50


ORACLE_KEYS = sorted(all_oracles())


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle(spark, key):
    res = compare(spark, SF0001, [key], verbose=False)[key]
    assert res["cols"], key
    assert res["rows"] == res["oracle_rows"], key
    assert res["values"], key
