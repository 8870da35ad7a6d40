"""Search, fusion and reranking queries (sections K, L, M of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import providers
from ..operators import answers as A
from ..operators import bm25, dense, ranking
from ..session import broadcast_if_small, checkpoint, stored, table, unique
from . import sql as S


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): the stated query set, every logged question whose number is divisible by 20."""
    rows = table(spark, sf_dir, "rag_responses").select("query_id", F.col("question").alias("text")).where("text IS NOT NULL")
    return rows.where(F.substring("query_id", 2, 12).try_cast("long") % 20 == 0).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text) of the summary index: title, text and URL; empty and failed summaries are skipped."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> '' AND NOT startswith(text, 'ERREUR')")
    return rows.select(F.col("doc_id").alias("key"), F.concat_ws(" ", F.coalesce("title", F.lit("")), "text", F.coalesce("url", F.lit(""))).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("key"), "text")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, "ranked_chunks")


def bm_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.tokens(F.col("text"))
    return documents(spark, sf_dir).select(F.col("key").alias("doc_id"), F.size(found).alias("n_tokens"), F.array_join(F.slice(found, 1, 12), " ").alias("first_tokens"))


def bm_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _ = bm25.term_weights(bm25.tokenised(documents(spark, sf_dir)))
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


def bm_index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.tokenised(chunks(spark, sf_dir)).agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("tokens")), 6).alias("avg_len"))


def bm_document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(documents(spark, sf_dir), questions(spark, sf_dir), 10).withColumnRenamed("key", "doc_id")


def bm_summary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(summaries(spark, sf_dir), questions(spark, sf_dir), 20).withColumnRenamed("key", "doc_id")


def bm_summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(summaries(spark, sf_dir), questions(spark, sf_dir), 40).select(F.col("key").alias("doc_id")).distinct()


def bm_chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(chunks(spark, sf_dir), questions(spark, sf_dir), 10).withColumnRenamed("key", "chunk_id")


def bm_chunk_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of technical documents only, restricted before ranking."""
    asked = questions(spark, sf_dir)
    kept = table(spark, sf_dir, "chunks").where("document_nature = 'TECHNIQUE'").select(F.col("chunk_id").alias("key")).distinct()
    return bm25.search(chunks(spark, sf_dir), asked, 10, allowed=kept).withColumnRenamed("key", "chunk_id")


def vec_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return dense.nearest(vectors, vectors.where("key % 20 = 0"), 10).select("query_id", F.col("key").alias("vec_id"), "distance", "rank")


def vec_nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-filtered on the label before the search; similarity 1 / (1 + distance)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")
    found = dense.nearest(rows.where("label IN (1, 3, 5)"), rows.where("key % 20 = 0"), 5)
    return found.select("query_id", F.col("key").alias("vec_id"), "distance", F.round(X.similarity(F.col("distance")), 6).alias("similarity"), "rank")


def vec_first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 3 different labels among each query's 10 nearest vectors."""
    near = vec_nearest(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    first = ranking.top_k(near.select("query_id", "label", "vec_id", F.col("rank").alias("near_rank")), ["query_id", "label"], [F.col("near_rank")], 1, "n")
    return ranking.top_k(first.drop("n"), ["query_id"], [F.col("near_rank")], 3, "position").select("query_id", "label", "vec_id", "near_rank", "position")


def vec_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and its successor, clamped to [0, 1], and the boost it gives."""
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cosine = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.dot(F.col("embedding"), F.col("other")))), 6)
    return rows.join(other, "vec_id").select("vec_id", cosine.alias("similarity")).withColumn("boost", F.round(boost(F.col("similarity"), 0.2), 6))


def boost(similarity: Column, threshold: float = 0.65, most: float = 0.15) -> Column:
    """Nothing below the threshold, then linear up to ``most`` at 1."""
    return F.when(similarity < threshold, 0.0).otherwise(F.lit(most) * (similarity - threshold) / (1.0 - threshold))


def _by(rows: DataFrame, score: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.where(F.col(score).isNotNull()).select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))


def rk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse rankings fused with weights 2 and 3."""
    rows = ranked(spark, sf_dir)
    fused = ranking.fuse([(_by(rows, "semantic_score"), 2.0), (_by(rows, "bm25_score"), 3.0)])
    return ranking.top_k(fused, ["query_id"], [F.desc("rrf_score"), F.col("chunk_id")], 10)


def rk_fusion_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    return ranking.fuse([(_by(rows, "semantic_score"), 1.0), (_by(rows, "bm25_score"), 1.0)])


def rk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid score: the fused one where a chunk is in both rankings, else its semantic score."""
    fused = rk_fusion_unweighted(spark, sf_dir)
    rows = ranked(spark, sf_dir).select("query_id", "chunk_id", "semantic_score")
    return rows.join(fused, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.round(F.when(F.col("n_rankings") > 1, F.col("rrf_score")).otherwise(F.col("semantic_score")), 6).alias("score"))


def rk_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk over all its queries: least distance, best scores."""
    return ranked(spark, sf_dir).groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("distance"), F.round(F.max("semantic_score"), 6).alias("semantic_score"), F.round(F.max("bm25_score"), 6).alias("bm25_score")
    )


def rk_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the guides of each query, topped up to 5 with the best others."""
    rows = ranking.top_up(ranked(spark, sf_dir), F.col("chunk_nature") == "GUIDE", 5, [F.desc("hybrid_score"), F.col("chunk_id")])
    return rows.select("query_id", "chunk_id", "inside", "position")


def rk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_documents(ranked(spark, sf_dir), 3, 5)


def rk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank score, the similarity where there is none; the 5 best from 0.5 on, at least 3; movement against the old rank."""
    score = F.round(F.coalesce("rerank_score", X.similarity(F.col("distance"))), 6)
    kept = ranking.keep_with_floor(ranked(spark, sf_dir).withColumn("score", score), "score", 0.5, 3, 5)
    return kept.select("query_id", "chunk_id", "score", "new_rank", (F.col("original_rank") - F.col("new_rank")).alias("movement"))


def rk_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked chunks by document, documents by their best chunk."""
    rows = ranked(spark, sf_dir).where("rerank_score IS NOT NULL AND document_path IS NOT NULL")
    grouped = rows.groupBy("query_id", "document_path").agg(F.count("*").alias("n_chunks"), F.round(F.max("rerank_score"), 6).alias("best_score"), F.array_join(F.sort_array(F.collect_set("chunk_id")), ",").alias("chunk_ids"))
    return ranking.top_k(grouped, ["query_id"], [F.desc("best_score"), F.col("document_path")], 10, "doc_rank")


def rk_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each normalised URL in rank order; chunks without URL are all kept."""
    urls = table(spark, sf_dir, "chunks").select("chunk_id", "source_url").distinct()
    rows = ranked(spark, sf_dir).join(urls, "chunk_id", "left").withColumn("url", F.coalesce(X.normal_url(F.col("source_url")), F.lit("")))
    key = F.when(F.col("url") == "", F.col("chunk_id")).otherwise(F.col("url"))
    return ranking.top_k(rows.withColumn("_key", key), ["query_id", "_key"], [F.col("original_rank"), F.col("chunk_id")], 1, "n").select("query_id", "chunk_id", "url", "original_rank")


def flt_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks within the distance 0.3; all chunks of a query that has none."""
    kept = ranking.keep_relevant(ranked(spark, sf_dir), F.col("distance") <= 0.3)
    return kept.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


def agg_primary_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).groupBy("query_id", "chunk_nature").agg(F.count("*").alias("n"), F.sum(X.similarity(F.col("distance"))).alias("s"))
    return rows.groupBy("query_id").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("avg_similarity"), F.min_by("chunk_nature", F.struct(-F.col("n"), "chunk_nature")).alias("primary_nature"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its statement says: the 50 best chunks by BM25 fused with the stored semantic ranks, of the questions that have any; ``hybrid_retrieval`` is the search end to end."""
    asked = questions(spark, sf_dir)
    sparse = bm25.search(chunks(spark, sf_dir), asked, 50).select("query_id", F.col("key").alias("chunk_id"), "rank", "score")
    dense_side = ranked(spark, sf_dir).join(asked.select("query_id"), "query_id", "left_semi")
    fused = ranking.fuse([(sparse.select("query_id", "chunk_id", "rank"), 3.0), (_by(dense_side, "semantic_score"), 2.0)])
    return ranking.top_k(fused, ["query_id"], [F.desc("rrf_score"), F.col("chunk_id")], 10)


def retrieve(
    rows: DataFrame, asked: DataFrame, expansions: DataFrame, index: DataFrame, fetch: int = 50, summaries_kept: int = 40, least: int = 5, chunks_each: int = 3, n_documents: int = 5, kept: DataFrame | None = None
) -> DataFrame:
    """Documents of questions: a summary search restricts them, their chunks are searched sparsely and densely, fused, and grouped.

    ``rows`` are (chunk_id, text, document_path, chunk_nature), ``asked``
    (query_id, text), ``expansions`` (query_id, n, text) with n from 1, and
    ``index`` (key, text) the summaries by document_path; ``kept`` (query_id,
    document_path) is their search, where it has been made.  Every question and
    expansion is searched densely over all chunks; of what is found, chunks of
    the kept documents come first, topped up to ``least`` with the nearest
    others.  A question without any summary is not restricted.  Weights: 2 for
    a question, dense and sparse, 1 for an expansion, dense only.
    """
    if kept is None:
        kept = checkpoint(bm25.search(index, asked, summaries_kept).select("query_id", F.col("key").alias("document_path")))
    docs = rows.select(F.col("chunk_id").alias("key"), "text", F.col("document_path").alias("part"))
    sparse = bm25.search(docs, asked, fetch, within=kept.select("query_id", F.col("document_path").alias("part"))).select("query_id", F.col("key").alias("chunk_id"), "rank")

    every = asked.select("query_id", F.lit(0).alias("n"), "text").unionByName(expansions.select("query_id", "n", "text")).where("text IS NOT NULL")
    every = checkpoint(providers.with_embedding(every.withColumn("key", F.xxhash64("query_id", "n")), "text", ["key", "query_id", "n"]))
    vectors = providers.with_embedding(docs.select(F.xxhash64("key").alias("key"), "text"), "text", ["key"])
    known = rows.select(F.xxhash64("chunk_id").alias("key"), "chunk_id", "document_path")
    near = dense.nearest(vectors, every, fetch, tasks=bm25.tasks(rows)).withColumnRenamed("query_id", "asked").join(every.select(F.col("key").alias("asked"), "query_id", "n"), "asked").join(known, "key")
    inside = near.join(kept.withColumn("kept", F.lit(True)), ["query_id", "document_path"], "left").join(kept.select("query_id").distinct().withColumn("restricted", F.lit(True)), "query_id", "left")
    near = checkpoint(ranking.top_up(inside, F.col("kept").isNotNull() | F.col("restricted").isNull(), least, [F.col("rank")], "asked").select("query_id", "n", "chunk_id", "distance", F.col("position").alias("rank")))

    fused = ranking.fuse([(near.where("n = 0"), 2.0), (near.where("n > 0"), 1.0), (sparse, 2.0)]).withColumnRenamed("rrf_score", "hybrid_score")
    distance = near.groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance"))
    found = fused.join(distance, ["query_id", "chunk_id"], "left").na.fill({"distance": 1.0}).join(rows.select("chunk_id", "document_path", "chunk_nature"), "chunk_id")
    return ranking.group_documents(found, chunks_each, n_documents)


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions end to end over all chunks, see ``retrieve``; summaries are the documents put together again, expansions what the provider makes of the question and its best document.

    The rows of ``documents`` share no key with the chunks, so they cannot restrict them; a chunk without path stands under its document_id.
    """
    own = table(spark, sf_dir, "chunks").withColumn("document_path", F.coalesce("document_path", "document_id"))
    rows = stored(own.groupBy("chunk_id").agg(*(F.min_by(c, F.struct("document_path", "text")).alias(c) for c in ("text", "document_path", "chunk_nature", "title", "source_url"))))
    index = whole_documents(rows)
    asked = questions(spark, sf_dir).withColumn("text", A.expanded(F.col("text")))
    kept = checkpoint(bm25.search(index, asked, 40).select("query_id", F.col("key").alias("document_path"), "rank"))
    best = kept.where("rank = 1").select("query_id", "document_path")
    # Only the documents that are some question's best are put together a second time.
    few = rows.join(broadcast_if_small(best.select("document_path").distinct()), "document_path", "left_semi")
    context = best.join(whole_documents(few).toDF("document_path", "context"), "document_path").select("query_id", "context")
    made = providers.with_answer(asked.join(context, "query_id"), "text", "context", ["query_id"])
    expansions = made.select("query_id", F.posexplode(A.parsed_questions(F.col("answer"))).alias("n", "text")).withColumn("n", F.col("n") + 1)
    return retrieve(rows, asked, checkpoint(expansions), index, kept=kept.drop("rank"))


def whole_documents(rows: DataFrame) -> DataFrame:
    """(key, text) by document_path: title, chunks in the order of their ordinals, URL."""
    ordinal = F.substring_index("chunk_id", "_", -1).try_cast("int")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal.alias("k"), "chunk_id", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("document_path").agg(F.concat_ws(" ", F.min("title"), whole, F.min("source_url")).alias("text")).withColumnRenamed("document_path", "key")


QUERIES = {
    f.__name__: f
    for f in (
        bm_tokens, bm_term_weights, bm_index_size, bm_document_search, bm_summary_search, bm_summary_documents, bm_chunk_search, bm_chunk_search_filtered, vec_nearest, vec_nearest_labelled, vec_first_labels, vec_pair_similarity,
        rk_fusion, rk_fusion_unweighted, rk_single, rk_best_of, rk_top_up, rk_documents, rk_rerank, rk_regroup, rk_distinct_urls, flt_relevance, agg_primary_nature, hybrid_search, hybrid_retrieval,
    )
}

_DOCS = "(SELECT doc_id AS key, text FROM documents)"
_SUMMARIES = "(SELECT doc_id AS key, concat_ws(' ', coalesce(title, ''), text, coalesce(url, '')) AS text FROM documents WHERE text <> '' AND NOT starts_with(text, 'ERREUR'))"
_CHUNKS = "(SELECT DISTINCT chunk_id AS key, text FROM chunks)"
_NEAR = """near AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {where}),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM near)"""


def _fused(dense: float, sparse: float) -> str:
    return f"""r AS {S.RANKED},
ranks AS (
  SELECT query_id, chunk_id, {dense} / (60 + row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, chunk_id)) AS part FROM r WHERE semantic_score IS NOT NULL
  UNION ALL SELECT query_id, chunk_id, {sparse} / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id)) FROM r WHERE bm25_score IS NOT NULL),
fused AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf_score, count(*) AS n_rankings FROM ranks GROUP BY ALL)"""


_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER)"
ORACLE = {
    "bm_tokens": f"SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok[1:12], ' ') AS first_tokens FROM (SELECT doc_id, {S.tokens('text')} AS tok FROM documents)",
    "bm_term_weights": S.bm25(_DOCS, S.QUESTIONS, 1).split("asked AS")[0].rstrip().rstrip(",") + " SELECT term, df, round(idf, 6) AS idf FROM weights JOIN freq USING (term)",
    "bm_index_size": f"SELECT count(*) AS n_docs, round(avg(len(tok)), 6) AS avg_len FROM (SELECT {S.tokens('text')} AS tok FROM {_CHUNKS}) WHERE len(tok) > 0",
    "bm_document_search": S.bm25(_DOCS, S.QUESTIONS, 10, "doc_id"),
    "bm_summary_search": S.bm25(_SUMMARIES, S.QUESTIONS, 20, "doc_id"),
    "bm_summary_documents": f"SELECT DISTINCT doc_id FROM ({S.bm25(_SUMMARIES, S.QUESTIONS, 40, 'doc_id')})",
    "bm_chunk_search": S.bm25(_CHUNKS, S.QUESTIONS, 10, "chunk_id"),
    "bm_chunk_search_filtered": S.bm25(_CHUNKS, S.QUESTIONS, 10, "chunk_id", "SEMI JOIN (SELECT chunk_id AS key FROM chunks WHERE document_nature = 'TECHNIQUE') ok USING (key)"),
    "vec_nearest": f"WITH {_NEAR.format(where='')} SELECT * FROM best WHERE rank <= 10",
    "vec_nearest_labelled": f"WITH {_NEAR.format(where='AND v.label IN (1, 3, 5)')} SELECT query_id, vec_id, distance, round(1 / (1 + distance), 6) AS similarity, rank FROM best WHERE rank <= 5",
    "vec_first_labels": f"""WITH {_NEAR.format(where='')}, first AS (SELECT query_id, label, min(rank) AS near_rank FROM best JOIN embeddings USING (vec_id) WHERE rank <= 10 GROUP BY ALL),
placed AS (SELECT f.query_id, f.label, b.vec_id, near_rank, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY near_rank) AS INTEGER) AS position FROM first f JOIN best b ON b.query_id = f.query_id AND b.rank = near_rank)
SELECT * FROM placed WHERE position <= 3""",
    "vec_pair_similarity": """SELECT vec_id, similarity, round(CASE WHEN similarity < 0.2 THEN 0.0 ELSE 0.15 * (similarity - 0.2) / 0.8 END, 6) AS boost FROM (
SELECT a.vec_id, round(greatest(0, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "rk_fusion": f"WITH {_fused(2.0, 3.0)} SELECT * FROM (SELECT *, {_RANK.format(order='rrf_score DESC, chunk_id')} AS rank FROM fused) WHERE rank <= 10",
    "rk_fusion_unweighted": f"WITH {_fused(1.0, 1.0)} SELECT * FROM fused",
    "rk_single": f"WITH {_fused(1.0, 1.0)} SELECT query_id, chunk_id, round(CASE WHEN n_rankings > 1 THEN rrf_score ELSE semantic_score END, 6) AS score FROM r LEFT JOIN fused USING (query_id, chunk_id)",
    "rk_best_of": f"SELECT chunk_id, count(*) AS n, round(min(distance), 6) AS distance, round(max(semantic_score), 6) AS semantic_score, round(max(bm25_score), 6) AS bm25_score FROM {S.RANKED} GROUP BY ALL",
    "rk_top_up": f"SELECT * FROM (SELECT query_id, chunk_id, coalesce(chunk_nature = 'GUIDE', false) AS inside, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(chunk_nature = 'GUIDE', false) DESC, hybrid_score DESC NULLS LAST, chunk_id) AS INTEGER) AS position FROM {S.RANKED}) WHERE inside OR position <= 5",
    "rk_documents": f"""WITH best AS (SELECT * FROM {S.RANKED} WHERE document_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, document_path ORDER BY hybrid_score DESC NULLS LAST, chunk_id) <= 3),
n AS (SELECT query_id, document_path, chunk_nature, count(*) AS n, sum(1 / (1 + distance)) AS s, max(hybrid_score) AS top FROM best GROUP BY ALL),
d AS (SELECT query_id, document_path, CAST(sum(n) AS BIGINT) AS n_chunks, round(sum(s) / sum(n), 6) AS avg_similarity, round(max(top), 6) AS best_score, first(chunk_nature ORDER BY n DESC, chunk_nature) AS primary_nature FROM n GROUP BY ALL)
SELECT * FROM (SELECT *, {_RANK.format(order='avg_similarity DESC, document_path')} AS doc_rank FROM d) WHERE doc_rank <= 5""",
    "rk_rerank": f"""WITH s AS (SELECT *, round(coalesce(rerank_score, 1 / (1 + distance)), 6) AS score FROM {S.RANKED}), o AS (SELECT *, {_RANK.format(order='score DESC, chunk_id')} AS new_rank FROM s),
c AS (SELECT *, count(*) FILTER (score >= 0.5 AND new_rank <= 5) OVER (PARTITION BY query_id) AS n FROM o)
SELECT query_id, chunk_id, score, new_rank, original_rank - new_rank AS movement FROM c WHERE CASE WHEN n >= 3 THEN score >= 0.5 AND new_rank <= 5 ELSE new_rank <= 3 END""",
    "rk_regroup": f"""WITH g AS (SELECT query_id, document_path, count(*) AS n_chunks, round(max(rerank_score), 6) AS best_score, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM {S.RANKED} WHERE rerank_score IS NOT NULL AND document_path IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, {_RANK.format(order='best_score DESC, document_path')} AS doc_rank FROM g) WHERE doc_rank <= 10""",
    "rk_distinct_urls": f"""WITH u AS (SELECT DISTINCT chunk_id, source_url FROM chunks), r AS (SELECT *, coalesce(replace(replace(replace(lower(source_url), 'https://', ''), 'http://', ''), 'www.', ''), '') AS url FROM {S.RANKED} LEFT JOIN u USING (chunk_id))
SELECT query_id, chunk_id, url, original_rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN url = '' THEN chunk_id ELSE url END ORDER BY original_rank, chunk_id) = 1""",
    "flt_relevance": f"SELECT query_id, chunk_id, round(distance, 6) AS distance FROM (SELECT *, bool_or(coalesce(distance <= 0.3, false)) OVER (PARTITION BY query_id) AS any_pass FROM {S.RANKED}) WHERE coalesce(distance <= 0.3, false) OR NOT any_pass",
    "agg_primary_nature": f"WITH n AS (SELECT query_id, chunk_nature, count(*) AS n, sum(1 / (1 + distance)) AS s FROM {S.RANKED} GROUP BY ALL) SELECT query_id, round(sum(s) / sum(n), 6) AS avg_similarity, first(chunk_nature ORDER BY n DESC, chunk_nature) AS primary_nature FROM n GROUP BY ALL",
    "hybrid_search": f"""WITH sparse AS ({S.bm25(_CHUNKS, S.QUESTIONS, 50, 'chunk_id')}), r AS {S.RANKED},
ranks AS (SELECT query_id, chunk_id, 3.0 / (60 + rank) AS part FROM sparse
  UNION ALL SELECT query_id, chunk_id, 2.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, chunk_id)) FROM r WHERE semantic_score IS NOT NULL),
fused AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf_score, count(*) AS n_rankings FROM ranks SEMI JOIN {S.QUESTIONS} q USING (query_id) GROUP BY ALL)
SELECT * FROM (SELECT *, {_RANK.format(order='rrf_score DESC, chunk_id')} AS rank FROM fused) WHERE rank <= 10""",
}
