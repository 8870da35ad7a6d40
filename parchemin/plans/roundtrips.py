"""Readers, writers and streams over whole tables: each query writes a table to the shared folder and gives what comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..sources import io
from ..streaming import logs
from . import sql as S
from .corpus import chunks
from .features import responses


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks as JSON lines, every eleventh of its document cut in the middle, read again."""
    path = _place(spark, "jsonl")
    line = F.to_json(F.struct("chunk_id", "document_id", "text", "confidence", "sectors"))
    ordinal = F.element_at(F.split("chunk_id", "_"), -1).cast("int")
    cut = F.when(F.pmod(ordinal, F.lit(11)) == 10, F.substr(line, F.lit(1), (F.length(line) / 2).cast("int"))).otherwise(line)
    chunks(spark, sf_dir).select(cut.alias("value")).write.text(path)
    return io.read_jsonl(spark, path, io.CHUNK)


def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of JSON lines that can be read."""
    return _lines(spark, sf_dir)[0].select("chunk_id", "document_id", F.md5("text").alias("text_md5"), "confidence", F.array_join("sectors", ",").alias("sectors"))


def src_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that can't be read, by their document."""
    bad = _lines(spark, sf_dir)[1].select(F.regexp_extract("value", '"chunk_id":"([^"]*)"', 1).alias("chunk_id"))
    return bad.groupBy(F.regexp_replace("chunk_id", "_[0-9]+$", "").alias("document_id")).agg(F.count("*").alias("n_bad"))


def snk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of chunks reset, appended to, updated by key and cleared by a condition."""
    path = _place(spark, "index")
    rows = chunks(spark, sf_dir).where("chunk_nature IS NOT NULL").select("chunk_id", "chunk_nature", F.length("text").alias("n_chars"))
    io.write_index(rows.where("chunk_nature = 'GUIDE'"), path, "chunk_id", "reset")
    io.write_index(rows.where("chunk_nature <> 'GUIDE'"), path, "chunk_id")
    io.write_index(rows.where("n_chars > 1000").withColumn("chunk_nature", F.lit("LONG")), path, "chunk_id", "update")
    io.delete_rows(spark, path, "chunk_nature = 'SANCTION'")
    return spark.read.parquet(path)


def snk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows appended in two runs as JSON lines, a file cut after so many rows."""
    path = _place(spark, "log")
    rows = responses(spark, sf_dir).select("query_id", "model", "n_sources", F.pmod(F.substr("query_id", F.lit(2)).cast("long"), F.lit(2)).alias("run"))
    for run in (0, 1):
        io.append_jsonl(rows.where(F.col("run") == run).drop("run"), path, 1000)
    return spark.read.schema("query_id string, model string, n_sources int").json(path)


def st_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as a stream, each query once, appended to a table exactly once."""
    source, out, state = (_place(spark, x) for x in ("stream", "seen", "state"))
    table(spark, sf_dir, "rag_responses").where("received_at IS NOT NULL").select("query_id", F.col("received_at").cast("timestamp").alias("received_at"), "model").write.parquet(source)
    stream = logs.first_seen(logs.read_stream(spark, source, "query_id string, received_at timestamp, model string"), ["query_id"], "received_at", "3650 days")
    logs.append_to(stream.select("query_id", "model"), out, state)
    return spark.read.parquet(out)


QUERIES = {f.__name__: f for f in (src_jsonl, src_bad_lines, snk_index, snk_log, st_first_seen)}

_NO = "CAST(string_split(chunk_id, '_')[-1] AS INTEGER)"
ORACLE = {
    "src_jsonl": f"SELECT chunk_id, document_id, md5(text) AS text_md5, confidence, array_to_string(sectors, ',') AS sectors FROM {S.CHUNKS} WHERE {_NO} % 11 <> 10",
    "src_bad_lines": f"SELECT document_id, count(*) AS n_bad FROM {S.CHUNKS} WHERE {_NO} % 11 = 10 GROUP BY ALL",
    "snk_index": f"SELECT chunk_id, CASE WHEN length(text) > 1000 THEN 'LONG' ELSE chunk_nature END AS chunk_nature, CAST(length(text) AS INTEGER) AS n_chars FROM {S.CHUNKS} WHERE chunk_nature IS NOT NULL AND (chunk_nature <> 'SANCTION' OR coalesce(length(text) > 1000, false))",
    "snk_log": f"SELECT query_id, model, n_sources FROM {S.RESPONSES}",
    "st_first_seen": f"SELECT query_id, model FROM {S.RESPONSES} WHERE received_at IS NOT NULL",
}
