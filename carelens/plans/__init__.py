"""End-to-end jobs and the registry of queries with their DuckDB oracles."""

from __future__ import annotations


def _load():
    # Importing the query modules registers them in the catalog.
    from carelens.plans import q_eval, q_features, q_knn, q_models, q_profiles, q_reports  # noqa: F401
    from carelens.plans import catalog
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
