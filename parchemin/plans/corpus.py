"""Identity, lookup, deduplication, incremental and statistics queries (sections A, B, C, G, H, I, S of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X
from ..operators import corpus, ranking
from ..session import table, unique
from . import sql as S


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, "chunks")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, "doc_metadata")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scraped row of each document."""
    return corpus.latest(metadata(spark, sf_dir), ["url_hash"], [F.desc("scraped_at"), F.col("content_hash"), F.col("url"), F.col("file_size_bytes")])


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, normal form, file type, title and short form of each URL."""
    url = F.col("url")
    return (
        metadata(spark, sf_dir)
        .select("url")
        .where("url IS NOT NULL")
        .distinct()
        .select(
            "url",
            X.url_key(url).alias("url_key"),
            X.normal_url(url).alias("normal_url"),
            F.substring(X.title_of_url(url), 1, 100).alias("title"),
            X.shortened(url, 41).alias("short_url"),
            F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"),
        )
    )


def url_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    rows = metadata(spark, sf_dir).select("file_path").where("file_path IS NOT NULL").distinct()
    hashed = F.regexp_extract(path, r"([a-f0-9]{12})\.(html|pdf|docx|odt|xlsx)", 1)
    return rows.select(
        "file_path", X.extension(path).alias("extension"), X.file_type(F.lit(None).cast("string"), path).alias("file_type"), hashed.alias("hash"), X.extension(path).isin(vocab.SUPPORTED).alias("supported"), F.replace(path, F.lit("\\"), F.lit("/")).alias("normal_path")
    )


def url_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin of a path and whether it is a priority source."""
    path = F.lower("document_path")
    internal = path.rlike("entreprise|custom|internal")
    return chunks(spark, sf_dir).where("document_path IS NOT NULL").select("document_path").distinct().select("document_path", F.when(internal, "ENTREPRISE").otherwise("PUBLIC").alias("origin"), path.rlike("/pdf/|guide").alias("is_priority"))


def url_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256, MD5 and the ids made of them."""
    text = F.col("text")
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.sha2(text, 256).alias("sha256"), F.md5(text).alias("md5"), F.concat(F.lit("ent_"), F.substring(F.sha2(text, 256), 1, 12)).alias("file_id"), F.substring(F.md5(text), 1, 8).alias("short_id"))


def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written the mail way and parsed back; null where there is none."""
    written = F.concat(F.date_format("http_last_modified", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return current(spark, sf_dir).select("url_hash", X.mail_date(written).alias("modified_at"))


def url_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields filled from what is there."""
    return current(spark, sf_dir).select(
        "url_hash",
        F.coalesce("content_hash", F.md5("url")).alias("content_hash"),
        F.coalesce("published_at", F.get("page_dates", F.lit(0)), F.to_date("http_last_modified")).alias("published_at"),
        F.coalesce("scraper_version", F.lit("v2")).alias("scraper_version"),
        F.coalesce("source_url", "url").alias("source_url"),
    )


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scraped rows, numbered by equal content within a type."""
    return corpus.deduplicate(metadata(spark, sf_dir), "content_hash", corpus.canonical_order(F.col("url"), F.struct("url_hash", "scraped_at")), ["file_type"])


def dd_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of several documents, with the canonical one."""
    rows = _copies(spark, sf_dir)
    return rows.where("copies > 1").groupBy("file_type", "content_hash").agg(F.count("*").alias("n"), F.max(F.when(F.col("copy_no") == 1, F.col("url"))).alias("canonical_url"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("copy_no") > 1, F.col("url_hash")))), ",").alias("removed"))


def dd_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _copies(spark, sf_dir)
    return rows.where("copy_no = 1").select("url_hash", "url", "copies")


def dd_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _copies(spark, sf_dir)
    first = rows.where("copy_no = 1 AND copies > 1").select("file_type", "content_hash", F.col("url").alias("canonical_url"))
    return rows.where("copy_no > 1").join(first, ["file_type", "content_hash"]).select("url_hash", "url", "canonical_url")


def dd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the hash of their text; texts under 20 characters have none and are all kept."""
    hashed = documents(spark, sf_dir).select("doc_id", F.when(F.length("text") >= 20, F.md5("text")).alias("text_hash"))
    return corpus.deduplicate(hashed, "text_hash", [F.col("doc_id")]).where("copy_no = 1").select("doc_id", "copies")


def dd_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before and after by type."""
    rows = _copies(spark, sf_dir)
    counts = rows.groupBy("file_type").agg(F.count("*").alias("n_before"), F.count_if(F.col("copy_no") == 1).alias("n_after"))
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_after")).withColumn("pct_removed", F.round(F.col("n_removed") * 100.0 / F.col("n_before"), 1))


def dd_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first snapshot against its last."""
    rows = metadata(spark, sf_dir)
    first = corpus.latest(rows, ["url_hash"], [F.col("scraped_at"), F.col("content_hash"), F.col("url"), F.col("file_size_bytes")])
    late = F.col("scraped_at") >= F.lit("2022-06-01").cast("timestamp")
    return corpus.snapshot_changes(first.where(~late), current(spark, sf_dir), "url_hash", "content_hash")


def jn_chunks_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document's row; those without are dropped."""
    rows = current(spark, sf_dir).select(F.col("url_hash").alias("document_id"), F.col("file_type").alias("stored_type"), "file_size_bytes")
    return chunks(spark, sf_dir).select("chunk_id", "document_id").join(rows, "document_id")


def jn_url_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL of a chunk: its own, its document's, else its path."""
    cache = current(spark, sf_dir).select(F.col("url_hash").alias("document_id"), F.col("url").alias("cached"))
    rows = chunks(spark, sf_dir).join(cache, "document_id", "left")
    return rows.select("chunk_id", F.coalesce(F.nullif("source_url", F.lit("")), "cached", "document_path", F.lit("URL inconnue")).alias("url"))


def jn_kept_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found on a page that leads to a guide."""
    pages = chunks(spark, sf_dir).where("document_nature = 'GUIDE' AND parent_url IS NOT NULL").select(F.col("parent_url").alias("source_url")).distinct()
    return metadata(spark, sf_dir).join(pages, "source_url", "left_semi").select("url_hash").distinct()


def jn_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of chunks without a metadata row."""
    return chunks(spark, sf_dir).select("document_id").distinct().join(metadata(spark, sf_dir).select(F.col("url_hash").alias("document_id")), "document_id", "left_anti")


def jn_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent page with its resources, by type."""
    rows = chunks(spark, sf_dir).where("parent_url IS NOT NULL").select("parent_url", "document_id", "file_type").distinct()
    counts = rows.groupBy("parent_url").agg(F.count("*").alias("n"), F.count_if(F.col("file_type") == "pdf").alias("n_pdf"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "file_type", "document_id"))), ",").alias("resources"))
    return counts


def jn_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on either side: with chunks, with metadata, or both."""
    one = chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    two = metadata(spark, sf_dir).groupBy(F.col("url_hash").alias("document_id")).agg(F.count("*").alias("n_rows"))
    return one.join(two, "document_id", "full").select("document_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def jn_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their feedback, by hash."""
    answers = table(spark, sf_dir, "rag_responses").select("query_id", "answer_hash").distinct()
    votes = table(spark, sf_dir, "answer_feedback").distinct().groupBy("answer_hash").agg(F.count("*").alias("n"), F.sum("rating").alias("sum_rating"))
    return answers.join(votes, "answer_hash", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum_rating", F.lit(0)).alias("sum_rating"))


def jn_best_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of the vocabulary that shares most words with a question, exact containment first; the first of tied ones."""
    topics = spark.createDataFrame([(k, t.lower()) for k, t in enumerate(vocab.TOPICS)], "topic_no int, topic string")
    asked = table(spark, sf_dir, "rag_responses").select("query_id", F.lower("question").alias("q")).where("q IS NOT NULL").distinct()
    pairs = asked.join(F.broadcast(topics)).withColumn("hit", F.contains("q", F.col("topic")).cast("int") * 10 + F.size(F.array_intersect(F.split("q", " "), F.split("topic", " "))))
    return pairs.where("hit > 0").groupBy("query_id").agg(F.min_by("topic", F.struct(-F.col("hit"), "topic_no")).alias("topic"), F.max("hit").alias("hit"))


def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shares(chunks(spark, sf_dir), ["chunk_nature", "method"])


def agg_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, documents and mean length by file type."""
    return chunks(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def agg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the attributes of their first chunk, their chunks and sorted sectors."""
    rows = chunks(spark, sf_dir).withColumn("ordinal", F.element_at(F.split("chunk_id", "_"), -1).cast("int"))
    flat = rows.select("document_id", F.explode("sectors").alias("sector")).groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("sector")), ",").alias("sectors"))
    heads = rows.groupBy("document_id").agg(F.min_by("title", "ordinal").alias("title"), F.min_by("document_nature", "ordinal").alias("document_nature"), F.count("*").alias("n_chunks"))
    return heads.join(flat, "document_id", "left").select("document_id", "title", "document_nature", "n_chunks", F.coalesce("sectors", F.lit("")).alias("sectors"))


def agg_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.reassembled(chunks(spark, sf_dir), "document_id", F.element_at(F.split("chunk_id", "_"), -1).cast("int"))
    return found.select("document_id", "n_chunks", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def agg_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent tokens of French documents and their part of all such documents."""
    rows = documents(spark, sf_dir).where("lang = 'fr' AND text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    whole = documents(spark, sf_dir).where("lang = 'fr' AND text IS NOT NULL").agg(F.count("*").alias("whole"))
    counted = rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(30)
    return counted.join(F.broadcast(whole)).select("token", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 2).alias("pct"))


def agg_active_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_responses").distinct().select(F.explode("enterprise_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def agg_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in all, with a hash, and scraped within 30 days of the last scrape."""
    rows = current(spark, sf_dir)
    last = rows.agg(F.max("scraped_at").alias("now"))
    return rows.join(F.broadcast(last)).agg(F.count("*").alias("total"), F.count("content_hash").alias("with_hash"), F.count_if(F.col("scraped_at") > F.col("now") - F.expr("INTERVAL 30 DAYS")).alias("recent"))


def agg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the chunk table: what part of the rows passes, and whether that is enough."""
    rows = chunks(spark, sf_dir)
    tests = {"has_path": F.col("document_path").isNotNull(), "has_title": F.col("title").isNotNull(), "has_index": F.col("chunk_index").isin("FONDAMENTAUX", "OPERATIONNEL", "SANCTIONS", "TECHNIQUE"), "confident": F.col("confidence") >= 0.6}
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(test).alias(name) for name, test in tests.items()))
    stacked = counts.select("n", F.explode(F.array(*(F.struct(F.lit(name).alias("test"), F.col(name).alias("passed")) for name in tests))).alias("x"))
    return stacked.select("x.test", "x.passed", F.round(F.col("x.passed") * 100.0 / F.col("n"), 1).alias("pct"), (F.col("x.passed") * 10 >= F.col("n") * 9).alias("ok"))


def agg_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the words of a chunk by file type: the row at half the count, from 0, found by rank."""
    lengths = chunks(spark, sf_dir).select("file_type", X.word_count(F.col("text")).alias("n_words")).groupBy("file_type", "n_words").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("file_type").orderBy("n_words")
    placed = lengths.withColumn("upto", F.sum("n").over(upto)).withColumn("whole", F.sum("n").over(Window.partitionBy("file_type")))
    return placed.where(F.col("upto") > F.floor(F.col("whole") / 2)).groupBy("file_type").agg(F.min("n_words").alias("median_words"))


def agg_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with all of the keywords against chunks with any."""
    text = F.lower("text")
    keys = ["registre", "contrôle"]
    any_, all_ = X.any_of(text, keys), F.contains(text, F.lit(keys[0])) & F.contains(text, F.lit(keys[1]))
    rows = chunks(spark, sf_dir).groupBy("file_type").agg(F.count_if(any_).alias("n_any"), F.count_if(all_).alias("n_all"))
    return rows.withColumn("concentration", F.round(F.try_divide(F.col("n_all").cast("double"), F.col("n_any")), 4))


def st_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks not yet ranked for any query."""
    return corpus.pending(chunks(spark, sf_dir).select("chunk_id", "document_id"), table(spark, sf_dir, "ranked_chunks"), "chunk_id")


def st_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshots updated with the last ones, by key."""
    rows = metadata(spark, sf_dir)
    order = [F.col("scraped_at"), F.col("content_hash"), F.col("url"), F.col("file_size_bytes")]
    first = corpus.latest(rows, ["url_hash"], order).select("url_hash", "content_hash")
    late = current(spark, sf_dir).where("file_type = 'html'").select("url_hash", "content_hash")
    return corpus.merge(first, late, "url_hash")


def st_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done once for each distinct question and joined back."""
    asked = table(spark, sf_dir, "rag_responses").select("query_id", "question").where("question IS NOT NULL").distinct()
    done = asked.select("question").distinct().withColumn("n_tokens", F.size(X.tokens(F.col("question"))))
    return asked.join(done, "question").select("query_id", "n_tokens")


def snk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left after deleting a nature and a key set."""
    gone = metadata(spark, sf_dir).where("file_type = 'html' AND file_size_bytes < 3000").select(F.col("url_hash").alias("document_id")).distinct()
    return chunks(spark, sf_dir).where("chunk_nature <> 'SANCTION' OR chunk_nature IS NULL").join(gone, "document_id", "left_anti").select("chunk_id")


def snk_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes: kept, archived as too small, or unsupported."""
    small = ((F.col("file_type") == "pdf") & (F.col("file_size_bytes") < 3 * 1024)) | ((F.col("file_type") == "image") & (F.col("file_size_bytes") < 476 * 1024))
    kind = F.when(~F.col("file_type").isin("html", "pdf", "docx", "odt", "xlsx", "image"), "unsupported").when(small, "archive").otherwise("keep")
    return current(spark, sf_dir).select("url_hash", kind.alias("disposition"))


QUERIES = {
    f.__name__: f
    for f in (
        url_keys, url_file_types, url_sources, url_content_ids, url_dates, url_backfill, dd_groups, dd_kept, dd_removed, dd_texts, dd_report, dd_changes, jn_chunks_metadata, jn_url_fallback, jn_kept_parents, jn_orphans, jn_relationships,
        jn_full_outer, jn_feedback, jn_best_tag, agg_counts, agg_collection, agg_documents, agg_reassembled, agg_tags, agg_active_tags, agg_state, agg_quality, agg_upper_median, agg_concentration, st_pending, st_merge, st_cache, snk_delete, snk_routes,
    )
}

_META = "(SELECT DISTINCT * FROM doc_metadata)"
_LATEST = f"(SELECT * FROM {_META} QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY scraped_at DESC NULLS LAST, content_hash NULLS FIRST, url NULLS FIRST, file_size_bytes NULLS FIRST) = 1)"
_FIRST = f"(SELECT * FROM {_META} QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY scraped_at NULLS FIRST, content_hash NULLS FIRST, url NULLS FIRST, file_size_bytes NULLS FIRST) = 1)"
_COPIES = f"""copies AS (SELECT *, CASE WHEN content_hash IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY file_type, content_hash ORDER BY CASE WHEN starts_with(url, 'https://') THEN 0 ELSE 1 END, CASE WHEN contains(url, '?') THEN 1 ELSE 0 END, length(url) NULLS FIRST, url_hash NULLS FIRST, scraped_at NULLS FIRST) END AS copy_no,
CASE WHEN content_hash IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY file_type, content_hash) END AS copies FROM {_META})"""
_EXT = "lower(regexp_extract(regexp_replace({0}, '[?#].*$', ''), '\\.([A-Za-z0-9]{{1,5}})$', 1))"
_ORDINAL = "CAST(string_split(chunk_id, '_')[-1] AS INTEGER)"


def _case(value: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


ORACLE = {
    "url_keys": f"""SELECT url, substr(md5(url), 1, 12) AS url_key, replace(replace(replace(lower(url), 'https://', ''), 'http://', ''), 'www.', '') AS normal_url,
substr(array_to_string(list_transform(string_split(replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 1, 100) AS title,
CASE WHEN length(url) <= 41 THEN url ELSE substr(url, 1, 19) || '...' || right(url, 19) END AS short_url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM (SELECT DISTINCT url FROM doc_metadata WHERE url IS NOT NULL)""",
    "url_file_types": f"""SELECT file_path, {_EXT.format('file_path')} AS extension, {_case(_EXT.format('file_path'), vocab.EXTENSIONS, "'html'")} AS file_type, regexp_extract(file_path, '([a-f0-9]{{12}})\\.(html|pdf|docx|odt|xlsx)', 1) AS hash,
list_contains({S.listed(vocab.SUPPORTED)}, {_EXT.format('file_path')}) AS supported, replace(file_path, '\\', '/') AS normal_path FROM (SELECT DISTINCT file_path FROM doc_metadata WHERE file_path IS NOT NULL)""",
    "url_sources": "SELECT DISTINCT document_path, CASE WHEN regexp_matches(lower(document_path), 'entreprise|custom|internal') THEN 'ENTREPRISE' ELSE 'PUBLIC' END AS origin, regexp_matches(lower(document_path), '/pdf/|guide') AS is_priority FROM chunks WHERE document_path IS NOT NULL",
    "url_content_ids": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, 'ent_' || substr(sha256(text), 1, 12) AS file_id, substr(md5(text), 1, 8) AS short_id FROM documents WHERE text IS NOT NULL",
    "url_dates": f"SELECT url_hash, date_trunc('second', http_last_modified) AS modified_at FROM {_LATEST}",
    "url_backfill": f"SELECT url_hash, coalesce(content_hash, md5(url)) AS content_hash, coalesce(published_at, page_dates[1], CAST(http_last_modified AS DATE)) AS published_at, coalesce(scraper_version, 'v2') AS scraper_version, coalesce(source_url, url) AS source_url FROM {_LATEST}",
    "dd_groups": f"WITH {_COPIES} SELECT file_type, content_hash, count(*) AS n, max(url) FILTER (copy_no = 1) AS canonical_url, string_agg(url_hash, ',' ORDER BY url_hash) FILTER (copy_no > 1) AS removed FROM copies WHERE copies > 1 GROUP BY ALL",
    "dd_kept": f"WITH {_COPIES} SELECT url_hash, url, copies FROM copies WHERE copy_no = 1",
    "dd_removed": f"WITH {_COPIES} SELECT c.url_hash, c.url, k.url AS canonical_url FROM copies c JOIN copies k ON k.copy_no = 1 AND k.copies > 1 AND c.copy_no > 1 AND c.file_type = k.file_type AND c.content_hash = k.content_hash",
    "dd_texts": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE length(text) >= 20 GROUP BY md5(text) UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL OR length(text) < 20",
    "dd_report": f"WITH {_COPIES}, c AS (SELECT file_type, count(*) AS n_before, count(*) FILTER (copy_no = 1) AS n_after FROM copies GROUP BY ALL) SELECT *, n_before - n_after AS n_removed, round((n_before - n_after) * 100.0 / n_before, 1) AS pct_removed FROM c",
    "dd_changes": f"""WITH a AS (SELECT url_hash, content_hash, true AS was FROM {_FIRST} WHERE scraped_at < TIMESTAMP '2022-06-01'), b AS (SELECT url_hash, content_hash, true AS now FROM {_LATEST})
SELECT url_hash, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b USING (url_hash)""",
    "jn_chunks_metadata": f"SELECT chunk_id, document_id, m.file_type AS stored_type, file_size_bytes FROM {S.CHUNKS} c JOIN {_LATEST} m ON url_hash = document_id",
    "jn_url_fallback": f"SELECT chunk_id, coalesce(nullif(c.source_url, ''), m.url, document_path, 'URL inconnue') AS url FROM {S.CHUNKS} c LEFT JOIN {_LATEST} m ON url_hash = document_id",
    "jn_kept_parents": "SELECT DISTINCT url_hash FROM doc_metadata WHERE source_url IN (SELECT parent_url FROM chunks WHERE document_nature = 'GUIDE')",
    "jn_orphans": "SELECT DISTINCT document_id FROM chunks WHERE document_id NOT IN (SELECT url_hash FROM doc_metadata WHERE url_hash IS NOT NULL)",
    "jn_relationships": "SELECT parent_url, count(*) AS n, count(*) FILTER (file_type = 'pdf') AS n_pdf, string_agg(file_type || ':' || document_id, ',' ORDER BY file_type || ':' || document_id) AS resources FROM (SELECT DISTINCT parent_url, document_id, file_type FROM chunks WHERE parent_url IS NOT NULL) GROUP BY ALL",
    "jn_full_outer": f"SELECT document_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_rows, 0) AS n_rows FROM (SELECT document_id, count(*) AS n_chunks FROM {S.CHUNKS} GROUP BY ALL) FULL JOIN (SELECT url_hash AS document_id, count(*) AS n_rows FROM {_META} GROUP BY ALL) USING (document_id)",
    "jn_feedback": "SELECT query_id, coalesce(n, 0) AS n, CAST(coalesce(s, 0) AS BIGINT) AS sum_rating FROM (SELECT DISTINCT query_id, answer_hash FROM rag_responses) LEFT JOIN (SELECT answer_hash, count(*) AS n, sum(rating) AS s FROM (SELECT DISTINCT * FROM answer_feedback) GROUP BY ALL) USING (answer_hash)",
    "jn_best_tag": f"""WITH t AS (SELECT lower(x) AS topic, k FROM (SELECT unnest({S.listed(vocab.TOPICS)}) AS x, unnest(range(0, {len(vocab.TOPICS)})) AS k)), q AS (SELECT DISTINCT query_id, lower(question) AS q FROM rag_responses WHERE question IS NOT NULL),
p AS (SELECT query_id, topic, k, CAST(contains(q, topic)::INTEGER * 10 + len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(topic, ' ')))) AS INTEGER) AS hit FROM q, t)
SELECT query_id, first(topic ORDER BY hit DESC, k) AS topic, max(hit) AS hit FROM p WHERE hit > 0 GROUP BY ALL""",
    "agg_counts": f"SELECT *, round(n * 100.0 / sum(n) OVER (), 1) AS pct FROM (SELECT chunk_nature, method, count(*) AS n FROM {S.CHUNKS} GROUP BY ALL)",
    "agg_collection": f"SELECT file_type, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, round(avg(length(text)), 4) AS avg_chars, round(avg(confidence), 4) AS avg_confidence FROM {S.CHUNKS} GROUP BY ALL",
    "agg_documents": f"""WITH c AS (SELECT *, {_ORDINAL} AS o FROM {S.CHUNKS}), f AS (SELECT document_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sectors FROM (SELECT document_id, unnest(sectors) AS s FROM c) GROUP BY ALL),
h AS (SELECT document_id, arg_min_null(title, o) AS title, arg_min_null(document_nature, o) AS document_nature, count(*) AS n_chunks FROM c GROUP BY ALL) SELECT h.*, coalesce(sectors, '') AS sectors FROM h LEFT JOIN f USING (document_id)""",
    "agg_reassembled": f"""WITH t AS (SELECT document_id, count(*) AS n_chunks, substr(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY {_ORDINAL}), 1, 8000) AS text FROM {S.CHUNKS} GROUP BY ALL) SELECT document_id, n_chunks, length(text) AS n_chars, md5(text) AS text_md5 FROM t""",
    "agg_tags": f"WITH d AS (SELECT doc_id, {S.tokens('text')} AS tok FROM documents WHERE lang = 'fr' AND text IS NOT NULL) SELECT token, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM d), 2) AS pct FROM (SELECT unnest(list_distinct(tok)) AS token FROM d) GROUP BY ALL ORDER BY n DESC, token LIMIT 30",
    "agg_active_tags": f"SELECT tag, count(*) AS n FROM (SELECT unnest(enterprise_tags) AS tag FROM {S.RESPONSES}) GROUP BY ALL",
    "agg_state": f"SELECT count(*) AS total, count(content_hash) AS with_hash, count(*) FILTER (scraped_at > (SELECT max(scraped_at) FROM doc_metadata) - INTERVAL 30 DAYS) AS recent FROM {_LATEST}",
    "agg_quality": f"""WITH c AS {S.CHUNKS}, t AS (SELECT 'has_path' AS test, count(document_path) AS passed FROM c UNION ALL SELECT 'has_title', count(title) FROM c UNION ALL SELECT 'has_index', count(*) FILTER (chunk_index IN ('FONDAMENTAUX', 'OPERATIONNEL', 'SANCTIONS', 'TECHNIQUE')) FROM c
UNION ALL SELECT 'confident', count(*) FILTER (confidence >= 0.6) FROM c) SELECT test, passed, round(passed * 100.0 / (SELECT count(*) FROM c), 1) AS pct, passed * 10 >= (SELECT count(*) FROM c) * 9 AS ok FROM t""",
    "agg_upper_median": f"SELECT file_type, CAST(list_sort(list(n))[len(list(n)) // 2 + 1] AS INTEGER) AS median_words FROM (SELECT file_type, len({S.words('text')}) AS n FROM {S.CHUNKS}) GROUP BY ALL",
    "agg_concentration": f"SELECT *, round(n_all / nullif(n_any, 0), 4) AS concentration FROM (SELECT file_type, count(*) FILTER (contains(lower(text), 'registre') OR contains(lower(text), 'contrôle')) AS n_any, count(*) FILTER (contains(lower(text), 'registre') AND contains(lower(text), 'contrôle')) AS n_all FROM {S.CHUNKS} GROUP BY ALL)",
    "st_pending": f"SELECT chunk_id, document_id FROM {S.CHUNKS} WHERE chunk_id NOT IN (SELECT chunk_id FROM ranked_chunks)",
    "st_merge": f"WITH late AS (SELECT url_hash, content_hash FROM {_LATEST} WHERE file_type = 'html') SELECT url_hash, content_hash FROM {_FIRST} WHERE url_hash NOT IN (SELECT url_hash FROM late) UNION ALL SELECT * FROM late",
    "st_cache": f"SELECT query_id, CAST(len({S.tokens('question')}) AS INTEGER) AS n_tokens FROM (SELECT DISTINCT query_id, question FROM rag_responses WHERE question IS NOT NULL)",
    "snk_delete": f"SELECT chunk_id FROM {S.CHUNKS} WHERE chunk_nature IS DISTINCT FROM 'SANCTION' AND document_id NOT IN (SELECT url_hash FROM doc_metadata WHERE file_type = 'html' AND file_size_bytes < 3000)",
    "snk_routes": f"SELECT url_hash, CASE WHEN file_type NOT IN ('html', 'pdf', 'docx', 'odt', 'xlsx', 'image') THEN 'unsupported' WHEN (file_type = 'pdf' AND file_size_bytes < 3072) OR (file_type = 'image' AND file_size_bytes < 487424) THEN 'archive' ELSE 'keep' END AS disposition FROM {_LATEST}",
}
