"""Filter, scoring and classification queries (sections E and F of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X
from ..operators import features, where
from ..session import table, unique
from . import sql as S
from .corpus import chunks, documents


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(spark, sf_dir, "rag_responses")


#: Frequent phrases of the corpus, so that the checks have something to find.
PHRASES = ["durées de conservation", "sous-traitance"]


def flt_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = features.excluded(F.col("url"), F.col("text"), [*vocab.EXCLUDED_URLS, "/d/[0-9]*7$"], [*vocab.EXCLUDED_PHRASES, *PHRASES])
    return documents(spark, sf_dir).select("doc_id", F.coalesce(reason, F.lit("")).alias("reason"))


def flt_keyword_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = features.keyword_score(F.col("text"), F.col("url"))
    return documents(spark, sf_dir).select("doc_id", F.round(score, 4).alias("score")).where("score >= 1.4")


def flt_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested filter on the columns of documents."""
    condition = {"$and": [{"$or": [{"lang": {"$in": ["fr", "es"]}}, {"source": "brumaline"}]}, {"n_chars": {"$gte": 300, "$lt": 3000}}, {"source": {"$ne": "labo-hestia"}}]}
    return documents(spark, sf_dir).where(where.compile_where(condition)).select("doc_id", "lang", "source")


def flt_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard questions, and deep ones with one of two tags."""
    condition = where.tags_or_public(["marketing", "juridique"], {"n_sources": {"$gte": 4}}, "depth", "deep", "enterprise_tags")
    return responses(spark, sf_dir).where(where.compile_where(condition)).select("query_id", "depth")


def flt_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_texts").distinct()
    return rows.select("page_id", features.navigation(F.col("text"), F.col("document_path").endswith(".html"), [*vocab.NAVIGATION, "Lire aussi", "Dernières publications", "Contact"]).alias("is_navigation"))


def flt_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", X.word_count(F.col("text")).alias("n_words")).where("n_words >= 100")


def flt_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's lines with an action word; to be asked again where few of many lines have one or the answer is short."""
    lines = F.filter(F.split("answer", "\n"), lambda x: F.regexp_replace(x, X.SPACE, "") != "")
    verbs = ["doit", "peut", "must", "contrôle", "vérifie", "documente", "muss", "debe"]
    acting = F.size(F.filter(lines, lambda x: X.any_of(F.lower(x), verbs)))
    rows = responses(spark, sf_dir).where("answer IS NOT NULL").select("query_id", F.size(lines).alias("n_lines"), acting.alias("n_acting"), F.length(F.trim("answer")).alias("n_chars"))
    ratio = F.try_divide(F.col("n_acting").cast("double"), F.col("n_lines"))
    return rows.select("query_id", "n_lines", F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("ratio"), ((F.col("n_lines") > 3) & (ratio < 0.3) | (F.col("n_chars") < 50)).alias("ask_again"))


def flt_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions routed by the first group of keywords that occurs."""
    q = F.lower("question")
    groups = {"delay": ["combien de temps", "délai", "how long"], "obligation": ["doit", "must", "muss"], "risk": ["risque", "risks"]}
    route = F.coalesce(*(F.when(X.any_of(q, words), F.lit(name)) for name, words in groups.items()), F.lit("other"))
    return responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", route.alias("route"))


def flt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 questions of each model, newest first, cut to 60 characters."""
    from ..operators.ranking import top_k

    rows = responses(spark, sf_dir).where("question IS NOT NULL AND model IS NOT NULL")
    last = top_k(rows, ["model"], [F.desc("logged_at"), F.col("query_id")], 5, "turn")
    return last.select("model", "turn", "query_id", F.substring("question", 1, 60).alias("question"))


def prj_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(features.keyword_score(F.col("text"), F.col("url"), {3: ["registre", "sous-traitant"], 2: PHRASES, -2: ["usager"], -1: ["recrutement"]}), 4)
    return documents(spark, sf_dir).select("doc_id", score.alias("score"), features.band(score).alias("band"))


def prj_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_features(chunks(spark, sf_dir).select("chunk_id", "text"))
    return rows.drop("text").withColumn("detected_sectors", F.array_join("detected_sectors", ","))


def prj_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.classified(features.with_features(chunks(spark, sf_dir).select("chunk_id", "document_nature", "text")))
    return rows.select("chunk_id", "nature", "rule", "rule_confidence", features.index_of(F.col("nature")).alias("chunk_index"))


def prj_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of a chunk after the correction rules, with the sectors found."""
    rows = chunks(spark, sf_dir)
    index = features.validated_index(features.index_of(F.col("document_nature")), F.col("text"), F.col("title"))
    found = features.sectors(F.substring(F.lower("text"), 1, 2000), vocab.VALIDATED_SECTORS)
    return rows.select("chunk_id", index.alias("validated_index"), F.array_join(found, ",").alias("found_sectors"), F.array_join(features.secondary_indexes(F.col("document_nature"), found), ",").alias("secondary"))


def prj_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).where("answer IS NOT NULL").select("query_id", features.stance(F.col("answer")).alias("stance"))


def prj_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.md5(X.truncated(text, 500, "...")).alias("cut_500"), F.md5(X.first_words(text, 30)).alias("words_30"), F.md5(F.substring(text, 1, 200)).alias("cut_200"))


def prj_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is indexed: heading, blank line, text; metadata cut to their lengths."""
    heading = F.coalesce("heading", F.lit(""))
    body = F.when(heading != "", F.concat(heading, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return chunks(spark, sf_dir).select("chunk_id", F.md5(body).alias("indexed_md5"), F.length(body).alias("n_chars"), F.substring(heading, 1, 200).alias("heading"), F.substring(F.coalesce("title", F.lit("")), 1, 40).alias("title"))


def prj_exploded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking rows nested into parallel arrays of a query and taken apart again with defaults."""
    rows = table(spark, sf_dir, "ranked_chunks").distinct()
    packed = F.sort_array(F.collect_list(F.struct("original_rank", "chunk_id", F.coalesce("distance", F.lit(1.0)).alias("distance"))))
    nested = rows.groupBy("query_id").agg(packed.alias("p"))
    arrays = nested.select("query_id", F.transform("p", lambda x: x["chunk_id"]).alias("ids"), F.transform("p", lambda x: x["distance"]).alias("distances"))
    flat = arrays.select("query_id", F.posexplode(F.arrays_zip("ids", "distances")).alias("position", "x"))
    return flat.select("query_id", "position", F.col("x.ids").alias("chunk_id"), F.round("x.distances", 6).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        flt_exclusion, flt_keyword_threshold, flt_where, flt_tags, flt_navigation, flt_min_words, flt_actionable, flt_routes, flt_history, prj_keyword_score, prj_features, prj_classified, prj_validated, prj_stance, prj_truncated, prj_index_text,
        prj_exploded_hits,
    )
}


def _excluded(url: str, text: str, patterns: list[str], phrases: list[str]) -> str:
    urls = [f"WHEN regexp_matches({url}, {S.text('(?i)' + p)}) THEN {S.text('URL pattern: ' + p)}" for p in patterns]
    said = [f"WHEN {S.occurrences(f'lower({text})', p)} >= 2 THEN {S.text('Strong keyword: ' + p)}" for p in phrases]
    return "CASE " + " ".join(urls + said) + " ELSE '' END"


def _score(keywords: dict[int, list[str]]) -> str:
    text, url = "lower(coalesce(text, ''))", "coalesce(url, '')"
    by_text = " + ".join(f"{weight} * ({S.occurrences(text, word)})" for weight, words in keywords.items() for word in words)
    by_url = " + ".join(f"CASE WHEN {S.any_of(url, parts)} THEN {weight} ELSE 0 END" for weight, parts in vocab.URL_SCORES.items())
    return f"round(0.7 * ({by_text}) + 0.3 * ({by_url}), 4)"


def _sectors(text: str, groups: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {S.any_of(text, words)} THEN {S.text(name)} END" for name, words in groups.items()) + "], lambda x: x IS NOT NULL)"


_NAV = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), {S.text('(?i)' + p)}))" for p in [*vocab.NAVIGATION, "Lire aussi", "Dernières publications", "Contact"])
_FEATURES = (
    "SELECT chunk_id, document_nature, "
    + ", ".join(f"regexp_matches(t, {S.text('(?i)' + p)}) AS {n}" for n, p in vocab.FEATURES.items())
    + f", regexp_matches(t, {S.text(vocab.NUMBERED_LIST)}) AS has_numbered_list, {S.present('lower(t)', vocab.DOCTRINE)} AS doctrine_score, {S.present('lower(t)', vocab.OPERATIONAL)} AS operational_score, {_sectors('lower(t)', vocab.SECTORS)} AS detected_sectors, CAST(len({S.words('t')}) AS INTEGER) AS word_count FROM (SELECT *, coalesce(text, '') AS t FROM {S.CHUNKS})"
)
_INDEX = "CASE {0} " + " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in vocab.NATURE_INDEX.items()) + f" ELSE {S.text(vocab.DEFAULT_INDEX)} END"
_START = "lower(substr(coalesce(answer, ''), 1, 300))"

ORACLE = {
    "flt_exclusion": f"SELECT doc_id, {_excluded('url', 'text', [*vocab.EXCLUDED_URLS, '/d/[0-9]*7$'], [*vocab.EXCLUDED_PHRASES, *PHRASES])} AS reason FROM documents",
    "flt_keyword_threshold": f"SELECT * FROM (SELECT doc_id, {_score(vocab.KEYWORDS)} AS score FROM documents) WHERE score >= 1.4",
    "flt_where": "SELECT doc_id, lang, source FROM documents WHERE (lang IN ('fr', 'es') OR source = 'brumaline') AND n_chars >= 300 AND n_chars < 3000 AND source <> 'labo-hestia'",
    "flt_tags": f"SELECT query_id, depth FROM {S.RESPONSES} WHERE n_sources >= 4 AND (depth <> 'deep' OR list_contains(enterprise_tags, 'marketing') OR list_contains(enterprise_tags, 'juridique'))",
    "flt_navigation": f"SELECT page_id, ends_with(document_path, '.html') AND CASE WHEN n < 100 THEN true WHEN n > 2000 THEN false WHEN hits >= 3 AND n < 1000 THEN true ELSE n < 500 AND hits >= 1 END AS is_navigation FROM (SELECT *, length(trim(coalesce(text, ''))) AS n, {_NAV} AS hits FROM (SELECT DISTINCT * FROM page_texts))",
    "flt_min_words": f"SELECT * FROM (SELECT chunk_id, CAST(len({S.words('text')}) AS INTEGER) AS n_words FROM {S.CHUNKS}) WHERE n_words >= 100",
    "flt_actionable": f"""WITH l AS (SELECT query_id, list_filter(string_split(answer, chr(10)), lambda x: regexp_replace(x, '{S.SPACE}', '', 'g') <> '') AS ls, length(trim(answer)) AS n FROM {S.RESPONSES} WHERE answer IS NOT NULL),
r AS (SELECT query_id, CAST(len(ls) AS INTEGER) AS n_lines, n, len(list_filter(ls, lambda x: {S.any_of('lower(x)', ['doit', 'peut', 'must', 'contrôle', 'vérifie', 'documente', 'muss', 'debe'])})) / nullif(len(ls), 0) AS ratio FROM l)
SELECT query_id, n_lines, round(coalesce(ratio, 0), 4) AS ratio, (n_lines > 3 AND ratio < 0.3) OR n < 50 AS ask_again FROM r""",
    "flt_routes": f"SELECT query_id, CASE WHEN {S.any_of('lower(question)', ['combien de temps', 'délai', 'how long'])} THEN 'delay' WHEN {S.any_of('lower(question)', ['doit', 'must', 'muss'])} THEN 'obligation' WHEN {S.any_of('lower(question)', ['risque', 'risks'])} THEN 'risk' ELSE 'other' END AS route FROM {S.RESPONSES} WHERE question IS NOT NULL",
    "flt_history": f"SELECT model, turn, query_id, substr(question, 1, 60) AS question FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY logged_at DESC NULLS LAST, query_id) AS INTEGER) AS turn FROM {S.RESPONSES} WHERE question IS NOT NULL AND model IS NOT NULL) WHERE turn <= 5",
    "prj_keyword_score": f"SELECT doc_id, score, CASE WHEN score >= 8 THEN 'essentiel' WHEN score >= 6 THEN 'utile' WHEN score >= 4 THEN 'contexte' WHEN score >= 2 THEN 'marginal' ELSE 'hors sujet' END AS band FROM (SELECT doc_id, {_score({3: ['registre', 'sous-traitant'], 2: PHRASES, -2: ['usager'], -1: ['recrutement']})} AS score FROM documents)",
    "prj_features": f"SELECT * EXCLUDE (document_nature) REPLACE (array_to_string(detected_sectors, ',') AS detected_sectors) FROM ({_FEATURES})",
    "prj_classified": f"""WITH f AS ({_FEATURES}), s AS (SELECT *, doctrine_score + has_article::INTEGER + has_legal_ref::INTEGER AS d, operational_score + has_steps::INTEGER + has_numbered_list::INTEGER AS g, 2 * has_technical::INTEGER AS t FROM f),
o AS (SELECT *, greatest(d, g, t) AS top, list_sort([d, g, t, 0], 'DESC')[2] AS second, CASE WHEN d >= g AND d >= t THEN 'DOCTRINE' WHEN g >= t THEN 'GUIDE' ELSE 'TECHNIQUE' END AS best FROM s),
r AS (SELECT *, CASE WHEN has_sanction THEN 'rule_sanction' WHEN has_template THEN 'rule_template' WHEN has_steps AND has_numbered_list THEN 'rule_procedure' WHEN has_article AND NOT has_steps AND word_count > 100 THEN 'rule_article'
  WHEN NOT (top = 0 OR (second >= 2 AND top = second AND word_count > 150)) THEN 'score_' || lower(best) WHEN d >= 2 AND g >= 2 AND word_count < 200 THEN 'mixed_short' WHEN word_count >= 60 AND NOT has_steps AND NOT has_technical THEN 'default_doctrine' WHEN word_count >= 100 THEN 'open' ELSE 'document' END AS rule FROM o),
n AS (SELECT *, CASE WHEN rule = 'rule_sanction' THEN 'SANCTION' WHEN rule IN ('rule_template', 'rule_procedure') THEN 'GUIDE' WHEN rule IN ('rule_article', 'default_doctrine') THEN 'DOCTRINE' WHEN starts_with(rule, 'score_') THEN best ELSE document_nature END AS nature FROM r)
SELECT chunk_id, nature, rule, round(CASE WHEN rule = 'rule_sanction' THEN 1.0 WHEN rule IN ('rule_template', 'rule_procedure') THEN 0.95 WHEN rule = 'rule_article' THEN 0.9 WHEN starts_with(rule, 'score_') THEN least(0.85, top * 0.1 + 0.55) WHEN rule = 'mixed_short' THEN 0.6 WHEN rule = 'default_doctrine' THEN 0.65 ELSE 0.5 END::DOUBLE, 4) AS rule_confidence,
{_INDEX.format('nature')} AS chunk_index FROM n""",
    "prj_validated": f"""WITH c AS (SELECT *, {_INDEX.format('document_nature')} AS i0, substr(concat_ws(' ', lower(coalesce(text, '')), lower(coalesce(title, ''))), 1, 2000) AS combined, concat_ws(' ', lower(coalesce(title, '')), substr(lower(coalesce(text, '')), 1, 500)) AS start,
{_sectors('substr(lower(text), 1, 2000)', vocab.VALIDATED_SECTORS)} AS found FROM {S.CHUNKS}),
a AS (SELECT *, CASE WHEN contains(combined, 'san-') OR (contains(combined, 'délibération') AND {S.any_of('combined', ['amende', 'mise en demeure', 'condamnation'])}) THEN 'SANCTIONS' ELSE i0 END AS i1 FROM c),
b AS (SELECT *, CASE WHEN i1 = 'FONDAMENTAUX' AND {S.any_of('start', ['comment', 'guide pratique', "mode d'emploi", 'tutoriel'])} THEN 'OPERATIONNEL' ELSE i1 END AS i2 FROM a)
SELECT chunk_id, CASE WHEN i2 = 'OPERATIONNEL' AND ({S.occurrences('combined', 'article ')} >= 5 OR {S.any_of('combined', ['règlement (ue)', 'directive'])}) AND NOT {S.any_of('start', ['comment', 'guide'])} THEN 'FONDAMENTAUX' ELSE i2 END AS validated_index,
array_to_string(found, ',') AS found_sectors, concat_ws(',', CASE WHEN document_nature = 'MIXTE' THEN 'OPERATIONNEL' END, CASE WHEN len(found) BETWEEN 1 AND 2 THEN 'SECTORIELS' END) AS secondary FROM b""",
    "prj_stance": f"""WITH s AS (SELECT query_id, {' + '.join(f"regexp_matches({_START}, {S.text(p)})::INTEGER" for p in vocab.NEGATIVE)} AS neg, {' + '.join(f"regexp_matches({_START}, {S.text(p)})::INTEGER" for p in vocab.POSITIVE)} AS pos FROM {S.RESPONSES} WHERE answer IS NOT NULL)
SELECT query_id, CASE WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive' ELSE 'neutral' END AS stance FROM s""",
    "prj_truncated": f"SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS cut_500, md5(array_to_string({S.words('text')}[1:30], ' ')) AS words_30, md5(substr(text, 1, 200)) AS cut_200 FROM documents WHERE text IS NOT NULL",
    "prj_index_text": f"SELECT chunk_id, md5(b) AS indexed_md5, length(b) AS n_chars, substr(coalesce(heading, ''), 1, 200) AS heading, substr(coalesce(title, ''), 1, 40) AS title FROM (SELECT *, CASE WHEN coalesce(heading, '') <> '' THEN heading || chr(10) || chr(10) || text ELSE text END AS b FROM {S.CHUNKS})",
    "prj_exploded_hits": f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY original_rank NULLS FIRST, chunk_id, distance) - 1 AS INTEGER) AS position, chunk_id, round(coalesce(distance, 1.0), 6) AS distance FROM {S.RANKED}",
}
