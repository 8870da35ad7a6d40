"""Readers and writers of corpora, logs and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import merge

# Schemas of the stored tables.
CHUNK = "chunk_id string, document_id string, document_path string, document_nature string, chunk_nature string, chunk_index string, sectors array<string>, text string, heading string, page_info string, confidence double, method string, file_type string, source_url string, parent_url string, title string"
METADATA = "url string, url_hash string, file_type string, extension string, file_path string, file_size_bytes bigint, content_hash string, source_url string, http_last_modified timestamp, published_at date, page_dates array<date>, scraped_at timestamp, scraper_version string"
QUERY_LOG = "timestamp timestamp, question string, answer_preview string, answer_hash string, retrieval_time double, generation_time double, total_time double, n_sources int, n_cited int, model string, error string, enterprise_tags array<string>, depth string, filter_nature array<string>"
FEEDBACK_LOG = "timestamp timestamp, question string, answer_hash string, rating int, comment string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents with a fixed schema; missing fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines (value) that can't be read; blank lines are neither."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    return parsed.where("x._corrupt IS NULL").select("x.*").drop("_corrupt"), parsed.where("x._corrupt IS NOT NULL").select("value")


def read_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A text column of JSON as a struct ``parsed``; null where it isn't valid."""
    return df.withColumn("parsed", F.from_json(column, schema))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, extension, size, modified[, content_hash]): files below a folder; content is read only if its hash is asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    columns = ["path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return found.select(*columns, *([F.sha2("content", 256).alias("content_hash")] if content else []))


def write_index(df: DataFrame, path: str, key: str, mode: str = "append", partition: str | None = None) -> None:
    """``reset`` replaces the table, ``append`` adds rows, ``update`` replaces rows of the same key and adds the rest.

    An update is written beside the table and then takes its place, so that a
    lost executor leaves the old one whole.
    """
    spark = df.sparkSession
    if mode == "append":
        writer = df.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return
    if mode not in ("reset", "update"):
        raise ValueError(f"unknown mode {mode}")
    rows = merge(spark.read.parquet(path), df, key) if mode == "update" else df
    _replace(spark, rows, path, partition)


def delete_rows(spark: SparkSession, path: str, condition: str, partition: str | None = None) -> None:
    """Drop the rows that meet a condition; rows for which it is unknown stay."""
    rows = spark.read.parquet(path)
    _replace(spark, rows.where(~F.coalesce(F.expr(condition), F.lit(False))), path, partition)


def _replace(spark: SparkSession, rows: DataFrame, path: str, partition: str | None) -> None:
    """Write to a folder beside the table, then rename both; between the renames, which move no data, a reader finds no table."""
    jvm = spark.sparkContext._jvm
    fresh, old = f"{path}.new", f"{path}.old"
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(fresh)
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(at(old), True)
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(fresh), at(path))
    files.delete(at(old), True)


def append_jsonl(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append log rows as JSON lines; files are cut by rows, null fields left out."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(path)


def route(df: DataFrame, path: str, by: str = "disposition") -> None:
    """One folder for each value."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
