"""Registry of the queries and of their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, corpus, extras, features, logs, pipelines, replies, roundtrips, search

#: Modules of queries; each has QUERIES and ORACLE.
MODULES = (search, corpus, features, answers, logs, pipelines, extras, replies, roundtrips)

FLAGSHIP = "bm_document_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: statement for module in MODULES for name, statement in module.ORACLE.items()}
