"""Extraction, chunking and end-to-end flows (sections D, J, T, U of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import chunks as C
from ..functions import expressions as X
from ..functions import html as H
from ..functions import providers
from ..operators import answers as A
from ..operators import bm25, chunking, features, ranking
from ..session import checkpoint, table
from . import sql as S
from .search import chunks as chunk_texts
from .search import questions


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_texts").select("page_id", "source_url", "text").distinct()


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, base, html): page texts as HTML, headings and paragraphs in a main block with furniture around."""
    line = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = F.transform(lines, lambda x, k: F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("<h2>"), line(x), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), line(x), F.lit("</p>"))))
    head = F.lit('<html><body><nav><a href="/menu#top">Menu</a></nav><main><div class="breadcrumb">Accueil</div><script>x()</script>')
    # One of three forms of date, another day on each page.
    day, month, year = F.pmod("page_id", F.lit(28)).cast("int") + 1, F.pmod("page_id", F.lit(12)).cast("int") + 1, F.pmod("page_id", F.lit(15)).cast("int") + 2010
    named = F.concat(F.lit('<p class="date">'), day.cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, vocab.MONTHS)), month), F.lit(" "), year.cast("string"), F.lit("</p>"))
    span = F.concat(F.lit('<p><span class="element-date">'), F.format_string("%02d/%02d/%d", day, month, year), F.lit("</span></p>"))
    time = F.concat(F.lit('<p><time datetime="'), F.format_string("%d-%02d-%02dT08:00:00", year, month, day), F.lit('">.</time></p>'))
    dated = F.when(F.pmod("page_id", F.lit(3)) == 0, named).when(F.pmod("page_id", F.lit(3)) == 1, span).otherwise(F.concat(span, named, time))
    tail = F.lit('<a href="/suite?p=1#a">.</a><img src="img/a.png"></main><footer>Pied</footer></body></html>')
    base = F.coalesce("source_url", F.lit("https://site.example/a/b"))
    return _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("key"), base.alias("base"), F.concat(head, F.array_join(body, ""), dated, tail).alias("html"))


def ht_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _html(spark, sf_dir)
    text = chunking.explode_rows(rows, ["key", "html"], lambda key, html: [(key, H.main_text(html, None))], "key string, main_text string")
    return text.select("key", F.md5(F.regexp_replace("main_text", f"{X.SPACE}+", " ")).alias("text_md5"))


def ht_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and the first 800 words of the whole main block."""
    return chunking.explode_rows(_html(spark, sf_dir), ["key", "html"], lambda key, html: [(key, H.preview(html))], "key string, preview string")


def ht_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    expand = lambda key, html: [(key, k, s["heading"], C.n_words(s["text"])) for k, s in enumerate(H.sections(html))]
    return chunking.explode_rows(_html(spark, sf_dir), ["key", "html"], expand, "key string, section_no int, heading string, n_words int")


def ht_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_rows(_html(spark, sf_dir), ["key", "base", "html"], lambda key, base, html: [(key, kind, url) for kind, url in H.links(html, base)], "key string, kind string, url string")


def ht_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_rows(_html(spark, sf_dir), ["key", "html"], lambda key, html: [(key, k, d) for k, d in enumerate(H.page_dates(html))], "key string, position int, page_date string")


def ch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.with_ids(chunking.chunk_pages(_html(spark, sf_dir)))
    return found.select("chunk_id", "chunk_no", "heading", F.length("stored").alias("n_chars"))


def ch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    found = chunking.with_ids(chunking.chunk_texts(rows))
    return found.select("chunk_id", "chunk_no", X.word_count(F.col("text")).alias("n_words"))


def ch_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return chunking.explode_rows(rows, ["doc_id", "text"], lambda key, text: [(key, k, C.n_words(x)) for k, x in enumerate(C.by_paragraph(text, 200))], "doc_id long, part_no int, n_words int")


def ch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a query's ranked chunks in batches of at most 5000 characters."""
    best = ranking.top_k(table(spark, sf_dir, "ranked_chunks").distinct(), ["query_id"], [F.col("original_rank"), F.col("chunk_id")], 10)
    packed = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    return chunking.explode_rows(packed, ["query_id", "texts"], lambda key, texts: [(key, k, len(b), sum(map(len, b))) for k, b in enumerate(C.batches([t or "" for t in texts]))], "query_id string, batch_no int, n_texts int, n_chars int")


def ch_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of pages in zones, as sentences."""

    def expand(key: int, text: str | None) -> list[tuple]:
        rows = [line.split(" | ") if " | " in line else [] for line in (text or "").split("\n")]
        return [(key, k, len(z), C.as_sentences(C.zone_text(z, "page"))) for k, z in enumerate(C.zones(rows))]

    return chunking.explode_rows(_pages(spark, sf_dir), ["page_id", "text"], expand, "page_id long, zone_no int, n_rows int, sentences string")


def val_clean_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers quoted in malformed JSON, cleaned and parsed."""

    def expand(key: str, question: str | None) -> list[tuple]:
        raw = "Voici :\n```json\n" + '{"raison": "' + (question or "").replace("\n", " ").replace("\\", "") + ' dit "oui" ici", "secteur": "RH" | "Santé",}' + "\n```"
        found = C.parsed_json(raw.removeprefix("Voici :\n"), ("raison",))
        return [(key, found["raison"] if found else None, ",".join(found.get("secteurs") or []) if found else None)]

    rows = table(spark, sf_dir, "rag_responses").select("query_id", "question").distinct()
    return chunking.explode_rows(rows, ["query_id", "question"], expand, "query_id string, reason string, sectors string")


def cx_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rag_responses").where("answer IS NOT NULL").select("query_id", "answer").distinct()
    return chunking.explode_rows(rows, ["query_id", "answer"], lambda key, text: [(key, C.listed(text))], "query_id string, answer string")


def udf_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the distinct titles, made once each and joined back."""
    titles = table(spark, sf_dir, "chunks").where("title IS NOT NULL").select("title").distinct()
    made = providers.with_embedding(titles, "title", ["title"])
    norm = F.round(X.dot(F.col("embedding"), F.col("embedding")), 6)
    return table(spark, sf_dir, "chunks").select("chunk_id", "title").distinct().join(made, "title").select("chunk_id", norm.alias("norm"))


def udf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked chunks of the query set scored again by the provider; the five best."""
    rows = table(spark, sf_dir, "ranked_chunks").select("query_id", "chunk_id", F.substring("text", 1, 2048).alias("chunk")).distinct()
    asked = questions(spark, sf_dir)
    scored = providers.with_score(rows.join(asked, "query_id"), "text", "chunk", ["query_id", "chunk_id"])
    return ranking.top_k(scored.withColumn("rerank_score", F.round("rerank_score", 6)), ["query_id"], [F.desc("rerank_score"), F.col("chunk_id")], 5)


def udf_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the first 8000 characters; too short ones get an error code."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.substring("text", 1, 8000).alias("text"))
    made = providers.with_answer(rows, "title", "text", ["doc_id"])
    return made.select("doc_id", F.when(F.length("answer") >= 30, F.col("answer")).alias("summary"), F.when(F.length("answer") < 30, "too_short").alias("error"))


#: Words that mark questions which are refused.
REFUSED = ["contourner", "éviter", "refuser"]


def answer_questions(spark: SparkSession, sf_dir: str, rounds: int = 1) -> DataFrame:
    """A batch of questions end to end: expand, route refusals, retrieve, generate, check, and ask again with more context where the check fails."""
    asked = questions(spark, sf_dir).withColumn("expanded", A.expanded(F.col("text")))
    refused = X.any_of(F.lower("text"), REFUSED)
    turned_away = asked.where(refused).select("query_id", F.lit("Cette question sort du périmètre des documents.").alias("answer"), F.lit("refused").alias("route"), F.lit(0).alias("n_sources"), F.lit("").alias("issues"))
    open_ = asked.where(~refused)
    docs = chunk_texts(spark, sf_dir)
    hits = bm25.search(docs, open_.select("query_id", F.col("expanded").alias("text")), 4 * (rounds + 1)).select("query_id", "key", "rank")
    # Each attempt reads the texts found, so they are joined once.
    hits = checkpoint(hits.join(docs, "key"))
    done = None
    for attempt in range(rounds + 1):
        k = 4 * (attempt + 1)
        context = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"), F.count("*").cast("int").alias("n_sources"))
        pending = open_ if done is None else open_.join(done.where("issues <> ''").select("query_id"), "query_id", "left_semi")
        given = pending.join(context, "query_id", "left").na.fill({"context": "", "n_sources": 0})
        made = providers.with_answer(given, "expanded", "context", ["query_id", "n_sources", "context"]).withColumn("answer", F.when(F.col("answer") != "", F.concat("answer", F.lit(" [Source 1]"))).otherwise("answer"))
        found = A.issues(F.col("answer"), F.sequence(F.lit(1), F.greatest("n_sources", F.lit(1))), F.col("context"))
        now = made.select("query_id", "answer", F.lit("answered").alias("route"), "n_sources", F.array_join(found, ",").alias("issues"))
        done = checkpoint(now if done is None else done.where("issues = ''").unionByName(now))
    return done.unionByName(turned_away)


def ag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_questions(spark, sf_dir)


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents to classified, indexed chunks in one plan: relevance, deduplication, chunking, features, classification."""
    documents = table(spark, sf_dir, "documents")
    kept = documents.where("text IS NOT NULL").withColumn("reason", features.excluded(F.col("url"), F.col("text"))).where("reason IS NULL AND length(text) >= 20")
    unique = kept.groupBy(F.md5("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    pieces = chunking.with_ids(chunking.chunk_texts(unique.select(F.col("doc_id").cast("string").alias("key"), "text")))
    told = features.classified(features.with_features(pieces.select("chunk_id", "text").withColumn("document_nature", F.lit("GUIDE"))))
    return told.select("chunk_id", "nature", "rule", "rule_confidence", features.index_of(F.col("nature")).alias("chunk_index"), "word_count")


QUERIES = {
    f.__name__: f
    for f in (ht_main_text, ht_preview, ht_sections, ht_links, ht_dates, ch_pages, ch_documents, ch_paragraphs, ch_batches, ch_zones, val_clean_json, cx_listed, udf_embeddings, udf_rerank, udf_summaries, ag_answers, corpus_build)
}

_P = "(SELECT DISTINCT page_id, source_url, text, page_id % 28 + 1 AS d, page_id % 12 + 1 AS m, page_id % 15 + 2010 AS y, page_id % 3 AS form FROM page_texts)"
_NAMED = f"d || ' ' || {S.listed(vocab.MONTHS)}[m] || ' ' || y"
_SLASHED = "printf('%02d/%02d/%d', d, m, y)"
_DATED = f"CASE form WHEN 0 THEN {_NAMED} WHEN 1 THEN {_SLASHED} ELSE {_SLASHED} || ' ' || {_NAMED} || ' .' END"
ORACLE = {
    "ht_main_text": f"SELECT CAST(page_id AS VARCHAR) AS key, md5(trim(regexp_replace(replace(text, chr(10), ' ') || ' ' || {_DATED} || ' .', '{S.SPACE}+', ' ', 'g'))) AS text_md5 FROM {_P}",
    "ht_dates": f"SELECT CAST(page_id AS VARCHAR) AS key, CAST(unnest(range(0, CASE WHEN form = 2 THEN 3 ELSE 1 END)) AS INTEGER) AS position, printf('%d-%02d-%02d', y, m, d) AS page_date FROM {_P}",
}
