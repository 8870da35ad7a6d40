"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, table
from . import boilerplate, encode, mixing, neardup, pairs, sitelines, split, truncation, unify


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text) of all chunks, and of ranked rows whose chunk is not in the chunk table.

    Only ids are compared; the ranked texts are read again where an id is missing.
    """
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("doc"), "text")
    ranked = table(spark, sf_dir, "ranked_chunks").select(F.col("chunk_id").alias("doc"), "text")
    missing = checkpoint(ranked.select("doc").distinct().join(chunks.select("doc"), "doc", "left_anti"))
    return chunks if missing.isEmpty() else chunks.unionByName(ranked.join(missing, "doc", "left_semi"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = split.split_oversized(table(spark, sf_dir, "chunks"))
    return cut.where("piece_no = 1 AND n_pieces > 1").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_all(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.similar_pairs(chunk_texts(spark, sf_dir), 0.6, 3)
    return pairs.select(F.col("doc_a").alias("chunk_id_a"), F.col("doc_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(chunk_texts(spark, sf_dir), 0.6, 3).withColumnRenamed("doc", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "rag_responses"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture(table(spark, sf_dir, "page_texts"))


def p4_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_body(table(spark, sf_dir, "page_texts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.occurrences(table(spark, sf_dir, "chunks")).select("chunk_id", "line_no")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.remove_repeated(table(spark, sf_dir, "chunks"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.corpus_records(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "rag_responses"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unify(_records(spark, sf_dir), changed_only=True).select("record_type", "record_id").distinct()


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unify(_records(spark, sf_dir)).dropDuplicates(["record_type", "record_id"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.incomplete(table(spark, sf_dir, "documents")).where("reason IS NOT NULL").select("doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p3_found, p4_found, p4_body, p5_found, p5_clean, p6_found, p6_unified, p7_ids, p8_mix, p8_shares, p8_totals, p9_found, p9_report)}
