"""Query-log statistics, alerts and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_events(responses: DataFrame) -> DataFrame:
    """Log rows of responses: answer preview, hash, rounded times and counts."""
    return responses.select(
        "query_id", F.col("logged_at").alias("timestamp"), "question", F.substring("answer", 1, 200).alias("answer_preview"), F.substring(F.md5("answer"), 1, 8).alias("answer_hash"),
        *(F.round(c, 2).alias(c) for c in ("retrieval_time", "generation_time", "total_time")), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_cited", F.lit(0)).alias("n_cited"), "model", "error",
    )


def statistics(entries: DataFrame, feedback: DataFrame, now: Column | None = None, hours: int = 24) -> DataFrame:
    """One row of statistics in one pass over each log; zeros, and no satisfaction, for empty logs.

    ``now`` ends the recent window; the default is the last entry's time.
    Times that are null or zero are left out of the mean total time but count
    as zero in the others.
    """
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    uncited = F.coalesce("n_cited", F.lit(0)) == 0
    timed = F.coalesce(F.col("total_time") != 0, F.lit(False))
    if now is None:
        entries = entries.join(F.broadcast(entries.agg(F.max("logged_at").alias("_now"))))
        now = F.col("_now")
    recent = F.coalesce(F.col("logged_at") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    mean = lambda c, n: F.coalesce(F.round(F.sum(F.coalesce(c, F.lit(0))) / F.nullif(F.count("*"), F.lit(0)), n), F.lit(0.0))
    pct = lambda c: F.coalesce(F.round(F.count_if(c) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0))
    log = entries.agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.round(F.avg(F.when(timed, F.col("total_time"))), 2), F.lit(0.0)).alias("avg_total_time"),
        mean("retrieval_time", 2).alias("avg_retrieval_time"),
        mean("generation_time", 2).alias("avg_generation_time"),
        F.count_if(failed).alias("error_count"),
        pct(failed).alias("error_rate"),
        mean("n_cited", 1).alias("avg_sources_cited"),
        mean("n_sources", 1).alias("avg_sources_total"),
        pct(~uncited).alias("citation_rate"),
        F.count_if(recent).alias("recent_queries"),
        F.coalesce(F.round(F.avg(F.when(recent & timed, F.col("total_time"))), 2), F.lit(0.0)).alias("recent_avg_time"),
        F.count_if(recent & failed).alias("recent_errors"),
        F.count_if(uncited & ~failed).alias("zero_citation_queries"),
    )
    votes = feedback.agg(F.count_if(F.col("rating") > 0).alias("feedback_positive"), F.count_if(F.col("rating") < 0).alias("feedback_negative"))
    votes = votes.withColumn("feedback_total", F.col("feedback_positive") + F.col("feedback_negative")).withColumn("satisfaction_rate", F.round(F.try_divide(F.col("feedback_positive") * 100.0, F.col("feedback_total")), 1))
    return log.join(F.broadcast(votes))


#: Thresholds of the alerts.
THRESHOLDS = {"error_rate": 20.0, "slow_response": 60.0, "low_satisfaction": 50.0, "zero_citations": 30.0}


def alerts(stats: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(type, severity, value, threshold) of the thresholds passed; equality doesn't pass, and without queries nothing does."""
    zero = F.try_divide(F.col("zero_citation_queries") * 100.0, F.col("total_queries"))
    values = {"error_rate": F.col("error_rate"), "slow_response": F.col("avg_total_time"), "low_satisfaction": F.col("satisfaction_rate"), "zero_citations": F.round(zero, 1)}
    rows = F.array(*(F.struct(F.lit(name).alias("type"), value.cast("double").alias("value"), F.lit(thresholds[name]).alias("threshold")) for name, value in values.items()))
    flat = stats.where("total_queries > 0").select(F.inline(rows))
    passed = F.when(F.col("type") == "low_satisfaction", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    severity = F.when((F.col("type") == "error_rate") & (F.col("value") > F.col("threshold") * 2), "critical").otherwise("warning")
    return flat.where(passed).select("type", severity.alias("severity"), "value", "threshold")


def as_json(rows: DataFrame, *columns: str) -> Column:
    """JSON line of the columns, null ones left out."""
    return F.to_json(F.struct(*columns))
