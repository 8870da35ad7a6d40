"""Observability and windowed log queries (sections H, R, S of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..session import table
from ..streaming import logs as streams
from . import sql as S
from .features import responses


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.statistics(responses(spark, sf_dir), table(spark, sf_dir, "answer_feedback").distinct(), hours=24 * 30)


def ob_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_events(responses(spark, sf_dir)).select("query_id", "answer_preview", "answer_hash", "total_time", "n_sources", "n_cited")


def ob_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


def ob_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alerts(_stats(spark, sf_dir), {"error_rate": 5.0, "slow_response": 3.0, "low_satisfaction": 99.0, "zero_citations": 90.0})


def ob_zero_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 sound queries without citation."""
    rows = responses(spark, sf_dir).where("coalesce(n_cited, 0) = 0 AND coalesce(error, '') = ''")
    return rows.orderBy(F.desc("logged_at"), "query_id").limit(5).select("query_id", F.substring("question", 1, 100).alias("question"), "logged_at")


def ob_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).orderBy(F.desc("logged_at"), "query_id").limit(10).select("query_id", "logged_at", "model")


def ob_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines read back; null fields are left out."""
    rows = responses(spark, sf_dir)
    line = logs.as_json(rows, "query_id", "error", "model", "n_cited")
    return rows.select("query_id", F.get_json_object(line, "$.model").alias("model"), F.contains(line, F.lit('"error"')).alias("has_error"))


def ob_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How late log rows arrive, by model."""
    late = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("logged_at").cast("timestamp"))) / 3.6e9
    rows = responses(spark, sf_dir).where("received_at IS NOT NULL AND logged_at IS NOT NULL").select(F.coalesce("model", F.lit("")).alias("model"), late.alias("hours"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("hours") > 1).alias("n_late"), F.round(F.max("hours"), 3).alias("max_hours"))


def ob_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("total_time"), 4).alias("avg_time"), F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("n_errors"))
    return rows


def st_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "2 hours", ["event_type"])


def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed(table(spark, sf_dir, "events"), "ts", "1 day", "2 days", ["event_type"], slide="12 hours")


def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", "1 hour", "user_id")


QUERIES = {f.__name__: f for f in (ob_log, ob_statistics, ob_alerts, ob_zero_citations, ob_recent, ob_json, ob_late, ob_by_model, st_windows, st_sliding, st_sessions)}

_FAILED = "coalesce(error <> '', false)"
_UNCITED = "coalesce(n_cited, 0) = 0"
_RECENT = "coalesce(logged_at >= (SELECT max(logged_at) FROM rag_responses) - INTERVAL 720 HOURS, false)"
_STATS = f"""SELECT * FROM (SELECT count(*) AS total_queries, coalesce(round(avg(total_time) FILTER (total_time <> 0), 2), 0) AS avg_total_time, coalesce(round(sum(coalesce(retrieval_time, 0)) / count(*), 2), 0) AS avg_retrieval_time,
coalesce(round(sum(coalesce(generation_time, 0)) / count(*), 2), 0) AS avg_generation_time, count(*) FILTER ({_FAILED}) AS error_count, round(count(*) FILTER ({_FAILED}) * 100.0 / count(*), 1) AS error_rate, round(sum(coalesce(n_cited, 0)) / count(*), 1) AS avg_sources_cited,
round(sum(coalesce(n_sources, 0)) / count(*), 1) AS avg_sources_total, round(count(*) FILTER (NOT {_UNCITED}) * 100.0 / count(*), 1) AS citation_rate, count(*) FILTER ({_RECENT}) AS recent_queries,
coalesce(round(avg(total_time) FILTER ({_RECENT} AND total_time <> 0), 2), 0) AS recent_avg_time, count(*) FILTER ({_RECENT} AND {_FAILED}) AS recent_errors, count(*) FILTER ({_UNCITED} AND NOT {_FAILED}) AS zero_citation_queries FROM {S.RESPONSES}),
(SELECT *, feedback_positive + feedback_negative AS feedback_total, round(feedback_positive * 100.0 / nullif(feedback_positive + feedback_negative, 0), 1) AS satisfaction_rate FROM
(SELECT count(*) FILTER (rating > 0) AS feedback_positive, count(*) FILTER (rating < 0) AS feedback_negative FROM (SELECT DISTINCT * FROM answer_feedback)))"""
_WINDOW = "SELECT window_start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, round(sum(value), 4) AS total FROM {0} GROUP BY ALL"

ORACLE = {
    "ob_log": f"SELECT query_id, substr(answer, 1, 200) AS answer_preview, substr(md5(answer), 1, 8) AS answer_hash, round(total_time::DECIMAL(18, 6), 2)::DOUBLE AS total_time, coalesce(n_sources, 0) AS n_sources, coalesce(n_cited, 0) AS n_cited FROM {S.RESPONSES}",
    "ob_statistics": _STATS,
    "ob_alerts": f"""WITH s AS ({_STATS}), v(type, value, threshold) AS (SELECT 'error_rate', error_rate::DOUBLE, 5.0::DOUBLE FROM s UNION ALL SELECT 'slow_response', avg_total_time, 3.0 FROM s UNION ALL SELECT 'low_satisfaction', satisfaction_rate, 99.0 FROM s
UNION ALL SELECT 'zero_citations', round(zero_citation_queries * 100.0 / total_queries, 1), 90.0 FROM s)
SELECT type, CASE WHEN type = 'error_rate' AND value > threshold * 2 THEN 'critical' ELSE 'warning' END AS severity, value, threshold FROM v WHERE CASE WHEN type = 'low_satisfaction' THEN value < threshold ELSE value > threshold END""",
    "ob_zero_citations": f"SELECT query_id, substr(question, 1, 100) AS question, logged_at FROM {S.RESPONSES} WHERE {_UNCITED} AND NOT {_FAILED} ORDER BY logged_at DESC NULLS LAST, query_id LIMIT 5",
    "ob_recent": f"SELECT query_id, logged_at, model FROM {S.RESPONSES} ORDER BY logged_at DESC NULLS LAST, query_id LIMIT 10",
    "ob_json": f"SELECT query_id, model, error IS NOT NULL AS has_error FROM {S.RESPONSES}",
    "ob_late": f"SELECT model, count(*) AS n, count(*) FILTER (hours > 1) AS n_late, round(max(hours), 3) AS max_hours FROM (SELECT coalesce(model, '') AS model, (epoch_us(received_at) - epoch_us(logged_at)) / 3.6e9::DOUBLE AS hours FROM {S.RESPONSES} WHERE received_at IS NOT NULL AND logged_at IS NOT NULL) GROUP BY ALL",
    "ob_by_model": f"SELECT model, count(*) AS n, round(avg(total_time), 4) AS avg_time, count(*) FILTER ({_FAILED}) AS n_errors FROM {S.RESPONSES} GROUP BY ALL",
    "st_windows": _WINDOW.replace("{0}", "(SELECT *, date_trunc('hour', ts) AS window_start FROM events)"),
    "st_sliding": _WINDOW.replace("{0}", "(SELECT *, unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS window_start FROM events)"),
    "st_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, no""",
}
