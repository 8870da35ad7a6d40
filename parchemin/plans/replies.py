"""Queries on model replies and on the decisions after them; the replies are made of the tables' columns, in turn sound, cut and unreadable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replies
from ..session import broadcast_if_small
from . import features as feature_plans
from . import sql as S
from .corpus import chunks, current, documents, metadata
from .features import responses

# The prompt of each intent, and the intents whose instruction has room for topics to avoid.
PROMPTS = {"factuel": "SYSTEM_PROMPT", "methodologique": "SYSTEM_PROMPT_METHODOLOGIQUE", "organisationnel": "SYSTEM_PROMPT_ORGANISATIONNEL", "cas_pratique": "SYSTEM_PROMPT_CAS_PRATIQUE", "comparaison": "SYSTEM_PROMPT_COMPARAISON", "liste_exhaustive": "SYSTEM_PROMPT_LISTE", "refus": "SYSTEM_PROMPT_REFUS"}
AVOIDING = ["methodologique", "organisationnel", "cas_pratique"]
IMAGES = ["png", "jpg", "jpeg", "gif", "webp"]


def _number() -> Column:
    return F.substr("query_id", F.lit(2)).cast("long")


def _case(n: int) -> Column:
    return F.pmod(_number(), F.lit(n))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", F.regexp_replace("question", r'["\\\r\n\t\[\]{}]', " ").alias("question"))


def qr_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sub-questions of each question, itself where the reply gives none."""
    raw = (
        F.when(_case(4) == 0, F.concat(F.lit('JSON : ["'), F.col("question"), F.lit('", " Quelles sont les étapes ? ", "court"] fin')))
        .when(_case(4) == 1, F.lit("[]"))
        .when(_case(4) == 2, F.lit("aucune liste"))
        .otherwise(F.lit('["a", "Première question assez longue ?", "Deuxième question assez longue ?", "Troisième question assez longue ?"]'))
    )
    return _asked(spark, sf_dir).select("query_id", F.posexplode(replies.sub_questions(raw, F.col("question"))).alias("position", "question"))


def _completeness() -> Column:
    return F.when(_case(3) == 0, F.concat(F.lit('Voici {"is_complete": false, "coverage_pct": '), F.pmod(_number(), F.lit(100)).cast("string"), F.lit(', "missing_aspects": ["délais"], "suggested_queries": ["délais de réponse"]} fin'))).when(_case(3) == 1, F.lit('{"coverage_pct": 90}')).otherwise(F.lit("rien"))


def qr_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of each answer, and whether another retrieval round follows."""
    rows = _asked(spark, sf_dir).withColumn("c", replies.completeness(_completeness()))
    return rows.select("query_id", "c.is_complete", "c.coverage_pct", F.size("c.missing_aspects").alias("n_missing"), replies.retried(F.col("c"), F.lit(0)).alias("retried"))


def qr_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    raw = F.when(_case(4) == 0, F.concat(F.lit('"'), q, F.lit(' en détail"'))).when(_case(4) == 1, F.lit("abc")).when(_case(4) == 2, q).otherwise(F.concat(F.lit("'Reformulée "), q, F.lit("'")))
    return _asked(spark, sf_dir).select("query_id", replies.rewritten(raw, q).alias("question"))


def ev_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.pmod(_number(), F.lit(130)).cast("string")
    head = F.concat(F.lit('{"score": '), score)
    raw = (
        F.when(_case(5) == 0, F.concat(head, F.lit(', "erreur_factuelle": false, "justification": "bien"}')))
        .when(_case(5) == 1, F.concat(head, F.lit(', "erreur_factuelle": true, "justification": "faux"}')))
        .when(_case(5) == 2, F.concat(head, F.lit(', "erreur_factuelle": false, "justification": "coup')))
        .when(_case(5) == 3, F.concat(F.lit('Note : "score" : '), score, F.lit(" sans objet")))
        .otherwise(F.lit("illisible"))
    )
    return responses(spark, sf_dir).select("query_id", replies.judged(raw).alias("score"))


def prj_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nature of a chunk as one of two options, given a model's choice and confidence."""
    choice = F.when(F.pmod(F.length("chunk_id"), F.lit(3)) == 0, F.lit("AUTRE")).otherwise(F.col("chunk_nature"))
    rows = chunks(spark, sf_dir).where("document_nature IS NOT NULL")
    return rows.select("chunk_id", replies.constrained(choice, F.col("confidence"), F.col("chunk_nature"), F.lit("GUIDE"), F.col("document_nature")).alias("c")).select("chunk_id", "c.chunk_nature", "c.confidence")


def src_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 800 words of the first of title, URL and text with more than 100 characters."""
    rows = documents(spark, sf_dir).select("doc_id", replies.first_long([F.col("title"), F.col("url"), F.col("text")]).alias("preview"))
    return rows.select("doc_id", F.md5("preview").alias("preview_md5"), F.length("preview").alias("n_chars"))


def _name(column: str) -> Column:
    return F.regexp_extract(F.replace(F.col(column), F.lit("\\"), F.lit("/")), r"([^/]+)$", 1)


def url_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's file is kept, by its suffix."""
    name = _name("file_path")
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    kept = F.when(suffix == "html", F.concat(F.lit("html/"), stem, F.lit(".html"))).when(suffix == "pdf", F.concat(F.lit("pdf/"), stem, F.lit(".pdf"))).when(suffix.isin(IMAGES), F.concat(F.lit("images/"), name)).otherwise(F.concat(F.lit("docs/"), name))
    return metadata(spark, sf_dir).where("file_path IS NOT NULL").select("file_path").distinct().select("file_path", kept.alias("stored"))


def jn_kept_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of the parent pages that are still there as web pages."""
    pages = current(spark, sf_dir).where("file_type = 'html' AND source_url IS NOT NULL").select(F.col("source_url").alias("parent_url")).distinct()
    return chunks(spark, sf_dir).where("parent_url IS NOT NULL").select("parent_url", "document_id").distinct().join(pages, "parent_url", "left_semi")


def flt_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of parent pages, those of one type only if they were judged pertinent."""
    kept = current(spark, sf_dir).where("file_size_bytes >= 3000").select(F.col("url_hash").alias("document_id")).distinct().withColumn("pertinent", F.lit(True))
    rows = chunks(spark, sf_dir).where("parent_url IS NOT NULL").select("parent_url", "document_id", "file_type").distinct().join(kept, "document_id", "left")
    return rows.where("coalesce(file_type, '') <> 'pdf' OR pertinent").select("parent_url", "document_id", "file_type")


def jn_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the record of the same file name, empty values where there is none."""
    records = current(spark, sf_dir).where("file_path IS NOT NULL").select(_name("file_path").alias("name"), "extension", "file_size_bytes").groupBy("name").agg(F.min("extension").alias("extension"), F.max("file_size_bytes").alias("n_bytes"))
    rows = chunks(spark, sf_dir).where("document_path IS NOT NULL").select("document_path", _name("document_path").alias("name")).distinct()
    return rows.join(records, "name", "left").select("document_path", F.coalesce("extension", F.lit("")).alias("extension"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


def prj_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of each question's intent, and the sentence on topics to avoid where the intent's instruction has room for it."""
    lookup = broadcast_if_small(spark.createDataFrame([(k, v, k in AVOIDING) for k, v in PROMPTS.items()], "intent string, prompt string, avoiding boolean"))
    intents = F.array(*map(F.lit, [*PROMPTS, "inconnu"]))
    topics = F.array_join(F.coalesce("enterprise_tags", F.array().cast("array<string>")), ", ")
    rows = responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", F.element_at(intents, (F.pmod(_number(), F.lit(len(PROMPTS) + 1)) + 1).cast("int")).alias("intent"), topics.alias("topics"))
    avoid = F.when(F.col("avoiding") & (F.col("topics") != ""), F.concat(F.lit("IMPORTANT : Ne parle PAS de "), F.col("topics"), F.lit(" sauf si la question le demande explicitement. "))).otherwise("")
    return rows.join(lookup, "intent", "left").select("query_id", F.coalesce("prompt", F.lit(PROMPTS["factuel"])).alias("prompt"), avoid.alias("avoid"))


def agg_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each phase of the filter excludes, with their percentage."""
    rows = feature_plans.flt_exclusion(spark, sf_dir)
    phase = F.when(F.startswith("reason", F.lit("URL")), "url").when(F.col("reason") != "", "keywords").otherwise("model")
    counts = rows.groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("phase", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


QUERIES = {f.__name__: f for f in (qr_decomposed, qr_completeness, qr_rewritten, ev_judged, prj_constrained, src_preview, url_stored, jn_kept_relations, flt_relations, jn_file_records, prj_instruction, agg_phases)}

_N = "CAST(substr(query_id, 2) AS BIGINT)"
_ASKED = rf"(SELECT query_id, regexp_replace(question, '[\"\\\r\n\t\[\]{{}}]', ' ', 'g') AS question FROM {S.RESPONSES} WHERE question IS NOT NULL)"
_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY scraped_at DESC NULLS LAST, content_hash NULLS FIRST, url NULLS FIRST, file_size_bytes NULLS FIRST) AS r FROM (SELECT DISTINCT * FROM doc_metadata)) WHERE r = 1)"
_NAME = r"regexp_extract(replace({}, '\', '/'), '([^/]+)$', 1)"
_PROMPTS = "(VALUES " + ", ".join(f"({k}, '{name}', '{prompt}', {str(name in AVOIDING).lower()})" for k, (name, prompt) in enumerate(PROMPTS.items())) + ") v(k, intent, prompt, avoiding)"
_JUDGED = f"""CASE {_N} % 5 WHEN 4 THEN 'illisible' WHEN 3 THEN 'Note : "score" : ' || {_N} % 130 || ' sans objet' ELSE '{{"score": ' || {_N} % 130 || ', "erreur_factuelle": ' || ({_N} % 5 = 1)::VARCHAR || ', "justification": "' END"""

ORACLE = {
    "qr_decomposed": f"""
WITH raw AS (SELECT query_id, question, CASE {_N} % 4 WHEN 0 THEN 'JSON : ["' || question || '", " Quelles sont les étapes ? ", "court"] fin' WHEN 1 THEN '[]' WHEN 2 THEN 'aucune liste'
  ELSE '["a", "Première question assez longue ?", "Deuxième question assez longue ?", "Troisième question assez longue ?"]' END AS raw FROM {_ASKED}),
parsed AS (SELECT query_id, question, list_filter(list_transform(coalesce(CAST(nullif(regexp_extract(raw, '\\[.*?\\]', 0, 's'), '') AS JSON)::VARCHAR[], [])[1:3], lambda q: trim(q)), lambda q: length(q) >= 10) AS q FROM raw),
kept AS (SELECT query_id, CASE WHEN len(q) > 0 THEN q ELSE [question] END AS q FROM parsed)
SELECT query_id, CAST(k - 1 AS INTEGER) AS position, q[k] AS question FROM (SELECT *, unnest(range(1, len(q) + 1)) AS k FROM kept)""",
    "qr_completeness": f"SELECT query_id, {_N} % 3 <> 0 AS is_complete, CAST(CASE {_N} % 3 WHEN 0 THEN {_N} % 100 WHEN 1 THEN 90 ELSE 100 END AS INTEGER) AS coverage_pct, CASE WHEN {_N} % 3 = 0 THEN 1 ELSE 0 END AS n_missing, {_N} % 3 = 0 AND {_N} % 100 < 80 AS retried FROM {_ASKED}",
    "qr_rewritten": f"SELECT query_id, CASE {_N} % 4 WHEN 0 THEN question || ' en détail' WHEN 3 THEN 'Reformulée ' || question ELSE question END AS question FROM {_ASKED}",
    "ev_judged": f"""WITH raw AS (SELECT query_id, {_JUDGED} AS raw FROM {S.RESPONSES}), p AS (SELECT query_id, TRY_CAST(nullif(regexp_extract(raw, '"score"\\s*:\\s*(\\d+)', 1), '') AS INTEGER) AS score, contains(raw, '"erreur_factuelle": true') AS wrong FROM raw)
SELECT query_id, CASE WHEN score IS NULL THEN 0.5::DOUBLE WHEN wrong THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, score / 100.0::DOUBLE)) END AS score FROM p""",
    "prj_constrained": f"""WITH c AS (SELECT chunk_id, document_nature AS nature, chunk_nature AS one, coalesce(CASE WHEN length(chunk_id) % 3 = 0 THEN 'AUTRE' ELSE chunk_nature END, document_nature) AS said, coalesce(confidence, 0.7) AS sure FROM {S.CHUNKS} WHERE document_nature IS NOT NULL),
d AS (SELECT *, coalesce(said = one OR said = 'GUIDE', false) AS inside FROM c), e AS (SELECT *, CASE WHEN inside THEN sure ELSE 0.6 END AS final FROM d)
SELECT chunk_id, CASE WHEN final < 0.6 THEN nature WHEN inside THEN said ELSE one END AS chunk_nature, CASE WHEN final < 0.6 THEN 0.5 ELSE final END::DOUBLE AS confidence FROM e""",
    "src_preview": r"""WITH p AS (SELECT doc_id, coalesce(CASE WHEN length(title) > 100 THEN title END, CASE WHEN length(url) > 100 THEN url END, CASE WHEN length(text) > 100 THEN text END, '') AS t FROM documents),
w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(t, '[ \t\n\x{0B}\f\r]+'), lambda w: w <> '')[1:800], ' ') AS t FROM p) SELECT doc_id, md5(t) AS preview_md5, CAST(length(t) AS INTEGER) AS n_chars FROM w""",
    "url_stored": rf"""WITH n AS (SELECT DISTINCT file_path, {_NAME.format('file_path')} AS name FROM doc_metadata WHERE file_path IS NOT NULL), s AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS suffix FROM n)
SELECT file_path, CASE WHEN suffix = 'html' THEN 'html/' || stem || '.html' WHEN suffix = 'pdf' THEN 'pdf/' || stem || '.pdf' WHEN list_contains({S.listed(IMAGES)}, suffix) THEN 'images/' || name ELSE 'docs/' || name END AS stored FROM s""",
    "jn_kept_relations": f"SELECT DISTINCT parent_url, document_id FROM chunks WHERE parent_url IN (SELECT source_url FROM {_CURRENT} WHERE file_type = 'html' AND source_url IS NOT NULL)",
    "flt_relations": f"SELECT DISTINCT parent_url, document_id, file_type FROM chunks WHERE parent_url IS NOT NULL AND (coalesce(file_type, '') <> 'pdf' OR document_id IN (SELECT url_hash FROM {_CURRENT} WHERE file_size_bytes >= 3000))",
    "jn_file_records": f"""WITH r AS (SELECT {_NAME.format('file_path')} AS name, min(extension) AS extension, max(file_size_bytes) AS n_bytes FROM {_CURRENT} WHERE file_path IS NOT NULL GROUP BY ALL),
c AS (SELECT DISTINCT document_path, {_NAME.format('document_path')} AS name FROM chunks WHERE document_path IS NOT NULL) SELECT document_path, coalesce(extension, '') AS extension, coalesce(n_bytes, 0) AS n_bytes FROM c LEFT JOIN r USING (name)""",
    "prj_instruction": f"""SELECT query_id, coalesce(prompt, 'SYSTEM_PROMPT') AS prompt, CASE WHEN avoiding AND t <> '' THEN 'IMPORTANT : Ne parle PAS de ' || t || ' sauf si la question le demande explicitement. ' ELSE '' END AS avoid
FROM (SELECT query_id, {_N} % {len(PROMPTS) + 1} AS n, coalesce(array_to_string(enterprise_tags, ', '), '') AS t FROM {S.RESPONSES} WHERE question IS NOT NULL) LEFT JOIN {_PROMPTS} ON n = k""",
    "agg_phases": f"WITH r AS ({feature_plans.ORACLE['flt_exclusion']}), c AS (SELECT CASE WHEN starts_with(reason, 'URL') THEN 'url' WHEN reason <> '' THEN 'keywords' ELSE 'model' END AS phase, count(*) AS n FROM r GROUP BY ALL) SELECT phase, n, round(n * 100.0 / sum(n) OVER (), 1)::DOUBLE AS pct FROM c",
}
