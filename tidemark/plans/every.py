"""All queries of the library but those of the text operators, and their SQL."""

from tidemark.plans import catalog, event_catalog, model_catalog, training_catalog

QUERIES = catalog.QUERIES | event_catalog.QUERIES | model_catalog.QUERIES | training_catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | event_catalog.ORACLE_SQL | model_catalog.ORACLE_SQL
