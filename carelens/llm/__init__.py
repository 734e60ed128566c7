"""Training-data operators: ten dealt operators, one module each, their queries
(``queries.py``) and the DuckDB twins. Nothing else in the library imports this
subpackage."""
