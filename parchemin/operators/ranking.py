"""Fusion, top-k and reranking over rows keyed (query_id, chunk_id); ties are broken by the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Catalyst keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def fuse(rankings: list[tuple[DataFrame, float]], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, key, rank): sum of weight / (k + rank), and in how many rankings a row is."""
    parts = [df.select("query_id", key, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in rankings]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("rrf_score"), F.count("*").alias("n_rankings"))


def keep_relevant(rows: DataFrame, passes: Column, by: str = "query_id") -> DataFrame:
    """Rows that pass; all rows of a group in which none passes."""
    group = Window.partitionBy(by)
    marked = rows.withColumn("_pass", F.coalesce(passes, F.lit(False)))
    return marked.withColumn("_any", F.max("_pass").over(group)).where("_pass OR NOT _any").drop("_pass", "_any")


def keep_with_floor(rows: DataFrame, score: str, least: float, floor: int, k: int, by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The k best rows at or above ``least``; where fewer than ``floor`` are, the ``floor`` best."""
    best = Window.partitionBy(by).orderBy(F.desc_nulls_last(score), key)
    ranked = rows.withColumn("new_rank", F.row_number().over(best)).where(F.col("new_rank") <= max(k, floor))
    passing = F.count_if((F.col(score) >= least) & (F.col("new_rank") <= k)).over(Window.partitionBy(by))
    return ranked.withColumn("_n", passing).where(F.when(F.col("_n") >= floor, (F.col(score) >= least) & (F.col("new_rank") <= k)).otherwise(F.col("new_rank") <= floor)).drop("_n")


def top_up(rows: DataFrame, inside: Column, least: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """All rows inside; where they are fewer than ``least``, the best others up to that number."""
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    position = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("inside"), *order))
    return placed.withColumn("position", position).where(F.col("inside") | (F.col("position") <= least))


def group_documents(rows: DataFrame, chunks_each: int, documents: int, score: str = "hybrid_score") -> DataFrame:
    """(query_id, document_path, n_chunks, avg_similarity, best_score, primary_nature, doc_rank): the best chunks of each document, then the documents by mean similarity.

    Rows without path are left out; the nature is the most frequent one, the smallest if tied.
    """
    own = rows.where("document_path IS NOT NULL")
    best = top_k(own, ["query_id", "document_path"], [F.desc(score), F.col("chunk_id")], chunks_each)
    natures = best.groupBy("query_id", "document_path", "chunk_nature").agg(F.count("*").alias("n"), F.sum(F.lit(1.0) / (1.0 + F.col("distance"))).alias("s"), F.max(score).alias("top"))
    documents_of = natures.groupBy("query_id", "document_path").agg(
        F.sum("n").alias("n_chunks"), F.round(F.sum("s") / F.sum("n"), 6).alias("avg_similarity"), F.round(F.max("top"), 6).alias("best_score"), F.min_by("chunk_nature", F.struct(-F.col("n"), "chunk_nature")).alias("primary_nature")
    )
    return top_k(documents_of, ["query_id"], [F.desc("avg_similarity"), F.col("document_path")], documents, "doc_rank")
