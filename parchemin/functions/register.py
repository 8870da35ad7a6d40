"""Functions for SQL text: temporary SQL functions, so that Catalyst inlines them and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import vocab


def register(spark: SparkSession) -> None:
    """``url_key``, ``tokenize_fr``, ``similarity`` and ``rrf`` as temporary functions of the session."""
    stops = ", ".join("'" + w + "'" for w in sorted(set(vocab.STOP_WORDS)))
    pattern = vocab.TOKEN
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION url_key(url STRING) RETURNS STRING RETURN substring(md5(url), 1, 12)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION similarity(distance DOUBLE) RETURNS DOUBLE RETURN 1.0D / (1.0D + distance)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize_fr(text STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(coalesce(text, '')), '{pattern}', 0), t -> length(t) > 1 AND NOT array_contains(array({stops}), t))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf(ranks ARRAY<INT>) RETURNS DOUBLE RETURN round(aggregate(ranks, 0D, (s, r) -> s + 1.0D / (60 + r)), 9)")
