"""Crawl frontier, page layout, knowledge lookups, context and maintenance queries (rest of sections A to S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X
from ..operators import answers as A
from ..operators import corpus, graph, ranking
from ..session import table
from . import sql as S
from .corpus import chunks, current
from .features import responses


def src_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and chunks reached in three steps from the query set, over ranking rows as links both ways."""
    rows = table(spark, sf_dir, "ranked_chunks").select("query_id", "chunk_id").distinct()
    edges = rows.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b")).union(rows.select("chunk_id", "query_id"))
    start = rows.where(F.substring("query_id", 2, 12).try_cast("long") % 20 == 0).select(F.col("query_id").alias("node"))
    return graph.reachable(edges, start, 3)


def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties read as JSON, bad ones set aside and counted by type."""
    from ..sources.io import read_json_column

    broken = F.when(F.col("event_id") % 10 == 0, F.lit("{oops")).otherwise(F.col("props"))
    rows = read_json_column(table(spark, sf_dir, "events").withColumn("props", broken), "props", "k int")
    return rows.groupBy("event_type").agg(F.count("parsed.k").alias("n_good"), F.count_if(F.col("parsed.k").isNull()).alias("n_bad"), F.sum("parsed.k").alias("sum_k"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no, line, size): page lines with a font size that short lines have larger."""
    rows = table(spark, sf_dir, "page_texts").select("page_id", "text").distinct().select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return rows.withColumn("size", F.when(F.length("line") < 40, F.lit(14.0)).when(F.length("line") < 70, F.lit(11.0)).otherwise(F.lit(10.0)))


def ht_font_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by font: a line under 200 characters and above 1.2 times the page's upper median size opens one."""
    lines = _lines(spark, sf_dir)
    page = Window.partitionBy("page_id")
    by_size = lines.withColumns({"r": F.row_number().over(page.orderBy("size", "line_no")), "n": F.count("*").over(page)})
    median = by_size.where("r = floor(n / 2) + 1").select("page_id", F.col("size").alias("median"))
    heading = (F.col("size") > F.col("median") * 1.2) & (F.length("line") < 200)
    running = F.sum(F.col("heading").cast("int")).over(page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.join(median, "page_id").withColumn("heading", heading).withColumn("section_no", running)
    return numbered.groupBy("page_id", "section_no").agg(F.count("*").alias("n_lines"), F.min_by("line", "line_no").alias("first_line"))


#: Pages of a block in which the entry of a page is sought.
PAGES = 1000


def ht_toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by a table of contents: from each entry's page to the one before the next entry, joined with the pages between."""
    toc = chunks(spark, sf_dir).withColumn("page", F.element_at(F.split("chunk_id", "_"), -1).cast("int")).where("page % 3 = 0").select("document_id", "page", "title")
    entries = toc.select("document_id", "page", F.col("page").alias("entry")).distinct()
    pages = chunks(spark, sf_dir).select("document_id", F.element_at(F.split("chunk_id", "_"), -1).cast("int").alias("page"), F.length("text").alias("n"))
    # The entry of a page is the last one up to it: sought in blocks of pages, then carried over the blocks, so a long document is shared among tasks.
    placed = pages.join(entries, ["document_id", "page"], "left").withColumn("block", F.floor(F.col("page") / PAGES))
    before = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("document_id", "block").agg(F.max("entry").alias("most")).select("document_id", "block", F.max("most").over(before).alias("carried"))
    upto = F.max("entry").over(Window.partitionBy("document_id", "block").orderBy("page").rangeBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("within", upto).join(carried, ["document_id", "block"]).withColumn("first", F.coalesce("within", "carried")).where("first IS NOT NULL")
    found = placed.groupBy("document_id", "first").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))
    return found.select("document_id", F.col("first").alias("first_page"), "n_pages", "n_chars")


def ht_image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts made of what is known of an image; those under 5 words are dropped."""
    described = F.concat_ws("\n", F.concat(F.lit("Image : "), F.col("title")), F.concat(F.lit("Page : "), F.col("source_url")), F.concat(F.lit("Nature : "), F.col("document_nature")))
    rows = chunks(spark, sf_dir).select("chunk_id", described.alias("text"))
    return rows.where(X.word_count(F.col("text")) >= 5).select("chunk_id", F.md5("text").alias("text_md5"))


def prj_image_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision by the number of words read: few are decoration, many a diagram, others are looked at."""
    words = X.word_count(F.coalesce("title", F.lit("")))
    return chunks(spark, sf_dir).select("chunk_id", F.when(words < 5, "PHOTO_DECO").when(words >= 9, "SCHEMA").otherwise("VISION").alias("decision"))


def prj_sector_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector line of several values becomes the general one."""
    line = F.concat(F.lit("NATURE: x\nSECTEUR: "), F.array_join("sectors", ", "), F.lit("\nFIN"))
    return chunks(spark, sf_dir).select("chunk_id", F.regexp_replace(line, r"(?m)^SECTEUR: [^\n]*,[^\n]*$", "SECTEUR: générique").alias("summary"))


def agg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a line of each page and the batch size that follows, 5 to 20."""
    rows = _lines(spark, sf_dir).groupBy("page_id").agg((F.sum(X.word_count(F.col("line"))) / F.count("*")).alias("d"))
    return rows.select("page_id", F.round("d", 4).alias("words_a_line"), F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.lit(250) / F.greatest("d", F.lit(1.0))))).cast("int").alias("batch_size"))


def jn_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with each topic whose keyword they contain, the first three in the vocabulary's order."""
    keys = ["conservation", "sous-traitance", "traceurs", "biométrie", "droit d'accès", "violations", "télétravail"]
    known = spark.createDataFrame(list(enumerate(keys)), "key_no int, key string")
    asked = responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", F.lower("question").alias("q"))
    hits = asked.join(F.broadcast(known), F.contains("q", F.col("key")))
    return ranking.top_k(hits, ["query_id"], [F.col("key_no")], 3, "position").select("query_id", "key", "position")


def jn_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 5 documents that share a document's parent page, without itself."""
    rows = chunks(spark, sf_dir).where("parent_url IS NOT NULL").select("parent_url", "document_id").distinct()
    # The first 6 of a parent hold the first 5 other than any document, so a parent of any size gives 6 rows a document.
    first = ranking.top_k(rows.withColumnRenamed("document_id", "related_id"), ["parent_url"], [F.col("related_id")], 6, "n").drop("n")
    pairs = rows.join(first, "parent_url").where("document_id <> related_id").select("document_id", "related_id").distinct()
    return ranking.top_k(pairs, ["document_id"], [F.col("related_id")], 5, "position")


def flt_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose id contains one of the given parts."""
    return responses(spark, sf_dir).where(X.any_of(F.col("query_id"), ["00001", "77"])).select("query_id", "depth")


def cx_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 questions of each depth as a block, oldest first."""
    rows = responses(spark, sf_dir).where("question IS NOT NULL AND depth IS NOT NULL")
    last = ranking.top_k(rows, ["depth"], [F.desc("logged_at"), F.col("query_id")], 5)
    block = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), F.substring("question", 1, 80).alias("q")))), lambda x: x["q"]), "\n")
    return last.groupBy("depth").agg(block.alias("history"))


def cx_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source numbers with the cited ones first in ascending order, then the others."""
    ids = A.cited_ids(F.col("answer"), r"\[(\d+)\]")
    available = F.sequence(F.lit(1), F.greatest(F.col("n_sources"), F.lit(1)))
    cited = F.array_sort(F.array_intersect(ids, available))
    return responses(spark, sf_dir).where("answer IS NOT NULL").select("query_id", F.array_join(F.concat(cited, F.array_except(available, cited)), ",").alias("order"))


def cx_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool block of the heading put before a chunk where it fits a budget of 1500 characters, cut where at least 200 are left, else skipped."""
    block = F.concat(F.lit("Outil : "), F.repeat(F.coalesce("heading", F.lit("")), 5))
    room = F.lit(1500) - F.length("text")
    taken = F.when(F.length(block) <= room, F.length(block)).when(room >= 200, room).otherwise(0)
    return chunks(spark, sf_dir).where("text IS NOT NULL").select("chunk_id", F.length(block).alias("block_chars"), taken.alias("taken_chars"))


def cx_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two answers to the same question the one to give: the longer if they agree in stance, a cautious mark if not."""
    from ..operators.features import stance

    rows = responses(spark, sf_dir).where("question IS NOT NULL AND answer IS NOT NULL").select("question", "query_id", stance(F.col("answer")).alias("stance"), F.length("answer").alias("n"))
    two = rows.groupBy("question").agg(F.count("*").alias("n_answers"), F.max_by("query_id", F.struct("n", "query_id")).alias("best"), F.count_distinct("stance").alias("stances"))
    return two.where("n_answers > 1").select("question", F.when(F.col("stances") == 1, F.col("best")).otherwise("differs").alias("chosen"))


def snk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags updated by key: new ones where there are any, else the old ones."""
    fresh = chunks(spark, sf_dir).where("chunk_nature = 'GUIDE'").select("chunk_id", F.array(F.lit("guide")).alias("fresh"))
    return chunks(spark, sf_dir).select("chunk_id", "sectors").join(fresh, "chunk_id", "left").select("chunk_id", F.array_join(F.coalesce("fresh", "sectors"), ",").alias("tags"))


def st_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks to tag in each mode: untagged ones not yet done, all, and failed ones."""
    rows = chunks(spark, sf_dir).select("chunk_id", "confidence", (F.size("sectors") > 0).alias("tagged"))
    done = table(spark, sf_dir, "ranked_chunks").select("chunk_id").distinct().withColumn("done", F.lit(True))
    marked = rows.join(done, "chunk_id", "left")
    normal, failed = ~F.coalesce("tagged", F.lit(False)) & F.col("done").isNull(), F.coalesce(F.col("confidence") < 0.6, F.lit(True))
    return marked.agg(F.count_if(normal).alias("normal"), F.count("*").alias("force"), F.count_if(failed).alias("retry_failed"))


def st_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type before and after the last scrape, with the difference."""
    rows = table(spark, sf_dir, "doc_metadata").distinct()
    first = corpus.latest(rows, ["url_hash"], [F.col("scraped_at"), F.col("content_hash"), F.col("url"), F.col("file_size_bytes")])
    before = first.where(F.col("scraped_at") < F.lit("2022-06-01").cast("timestamp_ntz")).groupBy("file_type").agg(F.count("*").alias("n_before"))
    after = current(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("n_after"))
    both = before.join(after, "file_type", "full").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("diff", F.col("n_after") - F.col("n_before"))


def dd_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of an answer, each once in order, three at most."""
    tags = F.slice(F.array_distinct(F.concat(F.coalesce("enterprise_tags", F.array().cast("array<string>")), F.coalesce("filter_nature", F.array().cast("array<string>")), F.array(F.lit("marketing")))), 1, 3)
    return responses(spark, sf_dir).select("query_id", F.array_join(tags, ",").alias("tags"))


def udf_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions registered for SQL."""
    from ..functions.register import register

    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("parchemin_documents")
    return spark.sql("SELECT doc_id, url_key(url) AS key, array_join(slice(tokenize_fr(text), 1, 3), ' ') AS first_tokens, rrf(array(1, 3)) AS fused FROM parchemin_documents WHERE url IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (
        src_frontier, src_json, ht_font_sections, ht_toc_sections, ht_image_chunks, prj_image_decision, prj_sector_line, agg_density, jn_knowledge, jn_related, flt_questions, cx_history, cx_compacted, cx_injected, cx_selected, snk_tags, st_modes,
        st_diff, dd_tag_lists, udf_registered,
    )
}

_LINES = "lines AS (SELECT *, CASE WHEN length(line) < 40 THEN 14.0 WHEN length(line) < 70 THEN 11.0 ELSE 10.0 END AS size FROM (SELECT page_id, parts[k] AS line, k - 1 AS line_no FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT DISTINCT page_id, string_split(text, chr(10)) AS parts FROM page_texts WHERE text IS NOT NULL))) WHERE trim(line, ' ') <> '')"
_PAGE = "CAST(string_split(chunk_id, '_')[-1] AS INTEGER)"
_META = "(SELECT DISTINCT * FROM doc_metadata)"
_ORDER = "content_hash NULLS FIRST, url NULLS FIRST, file_size_bytes NULLS FIRST"



def _hits(patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches(lower(substr(answer, 1, 300)), {S.text(p)})::INTEGER" for p in patterns)


ORACLE = {
    "src_frontier": """WITH RECURSIVE e AS (SELECT query_id AS a, chunk_id AS b FROM ranked_chunks UNION SELECT chunk_id, query_id FROM ranked_chunks),
r AS (SELECT DISTINCT query_id AS node, 0 AS depth FROM ranked_chunks WHERE CAST(substr(query_id, 2) AS BIGINT) % 20 = 0 UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""",
    "src_json": "SELECT event_type, count(k) AS n_good, count(*) - count(k) AS n_bad, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events) GROUP BY ALL",
    "ht_font_sections": f"""WITH {_LINES}, m AS (SELECT page_id, size AS median FROM lines QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size, line_no) = count(*) OVER (PARTITION BY page_id) // 2 + 1),
s AS (SELECT *, CAST(sum(CASE WHEN size > median * 1.2 AND length(line) < 200 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) AS BIGINT) AS section_no FROM lines JOIN m USING (page_id))
SELECT page_id, section_no, count(*) AS n_lines, arg_min(line, line_no) AS first_line FROM s GROUP BY ALL""",
    "ht_toc_sections": f"""WITH p AS (SELECT document_id, {_PAGE} AS page, length(text) AS n FROM {S.CHUNKS}), t AS (SELECT document_id, page AS first, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY page) - 1, 1073741824) AS last FROM p WHERE page % 3 = 0)
SELECT t.document_id, first AS first_page, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM t JOIN p ON p.document_id = t.document_id AND page BETWEEN first AND last GROUP BY ALL""",
    "ht_image_chunks": f"SELECT chunk_id, md5(t) AS text_md5 FROM (SELECT chunk_id, concat_ws(chr(10), 'Image : ' || title, 'Page : ' || source_url, 'Nature : ' || document_nature) AS t FROM {S.CHUNKS}) WHERE len({S.words('t')}) >= 5",
    "prj_image_decision": f"SELECT chunk_id, CASE WHEN n < 5 THEN 'PHOTO_DECO' WHEN n >= 9 THEN 'SCHEMA' ELSE 'VISION' END AS decision FROM (SELECT chunk_id, len({S.words('coalesce(title, chr(32))')}) AS n FROM {S.CHUNKS})",
    "prj_sector_line": f"SELECT chunk_id, 'NATURE: x' || chr(10) || CASE WHEN len(sectors) > 1 THEN 'SECTEUR: générique' ELSE 'SECTEUR: ' || array_to_string(sectors, ', ') END || chr(10) || 'FIN' AS summary FROM {S.CHUNKS}",
    "agg_density": f"WITH {_LINES}, d AS (SELECT page_id, sum(len({S.words('line')})) / count(*) AS d FROM lines GROUP BY ALL) SELECT page_id, round(d, 4) AS words_a_line, CAST(greatest(5, least(20, floor(250 / greatest(d, 1)))) AS INTEGER) AS batch_size FROM d",
    "jn_knowledge": f"""WITH k AS (SELECT unnest(['conservation', 'sous-traitance', 'traceurs', 'biométrie', 'droit d''accès', 'violations', 'télétravail']) AS key, unnest(range(0, 7)) AS key_no)
SELECT * FROM (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY key_no) AS INTEGER) AS position FROM {S.RESPONSES}, k WHERE contains(lower(question), key)) WHERE position <= 3""",
    "jn_related": """WITH r AS (SELECT DISTINCT parent_url, document_id FROM chunks WHERE parent_url IS NOT NULL), p AS (SELECT DISTINCT a.document_id, b.document_id AS related_id FROM r a JOIN r b USING (parent_url) WHERE a.document_id <> b.document_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY related_id) AS INTEGER) AS position FROM p) WHERE position <= 5""",
    "flt_questions": f"SELECT query_id, depth FROM {S.RESPONSES} WHERE contains(query_id, '00001') OR contains(query_id, '77')",
    "cx_history": f"SELECT depth, string_agg(substr(question, 1, 80), chr(10) ORDER BY rank DESC) AS history FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY logged_at DESC NULLS LAST, query_id) AS rank FROM {S.RESPONSES} WHERE question IS NOT NULL AND depth IS NOT NULL) WHERE rank <= 5 GROUP BY ALL",
    "cx_compacted": f"""WITH c AS (SELECT query_id, range(1, greatest(n_sources, 1) + 1) AS av, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS ids FROM {S.RESPONSES} WHERE answer IS NOT NULL)
SELECT query_id, array_to_string(list_concat(list_filter(av, lambda x: list_contains(ids, x)), list_filter(av, lambda x: NOT list_contains(ids, x))), ',') AS "order" FROM c""",
    "cx_selected": f"""WITH r AS (SELECT question, query_id, length(answer) AS n, CASE WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive' ELSE 'neutral' END AS stance FROM (SELECT *, {_hits(vocab.NEGATIVE)} AS neg, {_hits(vocab.POSITIVE)} AS pos FROM {S.RESPONSES} WHERE question IS NOT NULL AND answer IS NOT NULL))
SELECT question, CASE WHEN count(DISTINCT stance) = 1 THEN first(query_id ORDER BY n DESC, query_id DESC) ELSE 'differs' END AS chosen FROM r GROUP BY question HAVING count(*) > 1""",
    "cx_injected": f"SELECT chunk_id, b AS block_chars, CASE WHEN b <= 1500 - n THEN b WHEN 1500 - n >= 200 THEN 1500 - n ELSE 0 END AS taken_chars FROM (SELECT chunk_id, length('Outil : ' || repeat(coalesce(heading, ''), 5)) AS b, length(text) AS n FROM {S.CHUNKS} WHERE text IS NOT NULL)",
    "snk_tags": f"SELECT chunk_id, CASE WHEN chunk_nature = 'GUIDE' THEN 'guide' ELSE array_to_string(sectors, ',') END AS tags FROM {S.CHUNKS}",
    "st_modes": f"SELECT count(*) FILTER (NOT coalesce(len(sectors) > 0, false) AND chunk_id NOT IN (SELECT chunk_id FROM ranked_chunks)) AS normal, count(*) AS force, count(*) FILTER (coalesce(confidence < 0.6, true)) AS retry_failed FROM {S.CHUNKS}",
    "st_diff": f"""WITH f AS (SELECT * FROM {_META} QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY scraped_at NULLS FIRST, {_ORDER}) = 1), l AS (SELECT * FROM {_META} QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY scraped_at DESC NULLS LAST, {_ORDER}) = 1),
b AS (SELECT file_type, count(*) AS n FROM f WHERE scraped_at < TIMESTAMP '2022-06-01' GROUP BY ALL), a AS (SELECT file_type, count(*) AS n FROM l GROUP BY ALL)
SELECT file_type, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM b FULL JOIN a USING (file_type)""",
    "dd_tag_lists": f"WITH t AS (SELECT query_id, list_concat(coalesce(enterprise_tags, []), coalesce(filter_nature, []), ['marketing']) AS v FROM {S.RESPONSES}) SELECT query_id, array_to_string((list_filter(v, lambda x, i: list_position(v, x) = i))[1:3], ',') AS tags FROM t",
    "udf_registered": f"SELECT doc_id, substr(md5(url), 1, 12) AS key, array_to_string(({S.tokens('text')})[1:3], ' ') AS first_tokens, round(1.0 / 61 + 1.0 / 63, 9)::DOUBLE AS fused FROM documents WHERE url IS NOT NULL",
}
