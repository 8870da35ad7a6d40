"""Query rewriting, context, grounding and evaluation queries (sections N, O, P, Q of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X
from ..operators import answers as A
from ..session import table
from . import sql as S
from .features import responses


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their numbers written as source citations, and the sources there were."""
    rows = responses(spark, sf_dir).where("answer IS NOT NULL")
    return rows.withColumns({"answer": F.regexp_replace("answer", r"\[(\d+)\]", r"[Source $1]"), "available": F.sequence(F.lit(1), F.greatest(F.col("n_sources"), F.lit(1)))})


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, context): the texts of a query's three best chunks, a bounded list."""
    from ..operators.ranking import top_k

    best = top_k(table(spark, sf_dir, "ranked_chunks").distinct(), ["query_id"], [F.col("original_rank"), F.col("chunk_id")], 3)
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))


def whole_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, context): the texts of all ranked chunks of a query; the ranking itself bounds the list."""
    rows = table(spark, sf_dir, "ranked_chunks").distinct()
    texts = F.array_sort(F.collect_list(F.struct("original_rank", "chunk_id", "text")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("context"))


def qr_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an acronym put before them, expanded."""
    acronym = F.element_at(F.array(*map(F.lit, ["AIPD", "DPO", "xyz"])), F.pmod(F.length("question"), F.lit(3)) + 1)
    rows = responses(spark, sf_dir).where("question IS NOT NULL")
    return rows.select("query_id", A.expanded(F.concat(acronym, F.lit(" "), F.col("question"))).alias("expanded"))


def qr_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Voici :\n[TAGS] "), F.array_join("enterprise_tags", ", "), F.lit("; Registre!, ab, registre"))
    return responses(spark, sf_dir).select("query_id", F.array_join(A.parsed_tags(raw), "|").alias("tags"))


def qr_reformulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Voici des questions :\n1. "), F.col("question"), F.lit("\n2) "), F.upper("question"), F.lit("\n- court\ntexte libre sans suite\n• "), F.lower("question"))
    return responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", F.posexplode(A.parsed_questions(raw)).alias("position", "question"))


def qr_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents parsed out of fenced JSON with a trailing comma; unknown ones get the default."""
    raw = F.concat(F.lit('Réponse :\n```json\n{"intent": "'), F.element_at(F.array(*map(F.lit, ["factuel", "refus", "autre"])), F.pmod(F.length("question"), F.lit(3)) + 1), F.lit('", "confidence": 0.5,}\n```'))
    parsed = F.from_json(A.outer_json(raw), "intent string, confidence double")
    known = parsed["intent"].isin(list(vocab.INTENT_FACTORS))
    rows = responses(spark, sf_dir).where("question IS NOT NULL")
    return rows.select("query_id", F.when(known, parsed["intent"]).otherwise("factuel").alias("intent"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"))


def qr_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article numbers named in answers, 1 to 99, each once, five at most in order of appearance."""
    numbers = F.transform(F.regexp_extract_all(F.lower("answer"), F.lit(r"(?:article|artikel|artículo|art\.)\s+(\d{1,3})"), F.lit(1)), lambda x: x.cast("int"))
    kept = F.slice(F.array_distinct(F.filter(numbers, lambda x: x.between(1, 99))), 1, 5)
    return responses(spark, sf_dir).where("answer IS NOT NULL").select("query_id", F.posexplode(kept).alias("position", "article"))


def qr_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of a term of 72 hours or 30 days from the log time, against a given now."""
    now = F.lit("2024-06-30 12:00:00").cast("timestamp")
    terms = F.explode(F.array(F.struct(F.lit("72h").alias("term"), F.lit(72).alias("hours")), F.struct(F.lit("30d").alias("term"), F.lit(720).alias("hours")))).alias("x")
    rows = responses(spark, sf_dir).where("logged_at IS NOT NULL").select("query_id", "logged_at", terms)
    end = F.col("logged_at") + F.make_interval(hours=F.col("x.hours"))
    return rows.select("query_id", "x.term", end.alias("end_at"), (end < now).alias("expired"))


def cx_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids in order of appearance, the answer renumbered, and whether all sources are shown for lack of citations."""
    ids = A.cited_ids(F.col("answer"))
    return cited(spark, sf_dir).select("query_id", F.array_join(ids, ",").alias("cited"), F.md5(A.renumbered(F.col("answer"))).alias("renumbered"), (F.size(ids) == 0).alias("show_all"))


def cx_source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each document of a query: number, path, URL, best score, chunks."""
    from .search import rk_regroup

    urls = table(spark, sf_dir, "chunks").groupBy("document_path").agg(F.min("source_url").alias("url"), F.min("title").alias("title"))
    cards = rk_regroup(spark, sf_dir).join(urls, "document_path", "left")
    return cards.select("query_id", F.col("doc_rank").alias("source_no"), "document_path", F.coalesce(F.nullif("url", F.lit("")), "document_path").alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.col("best_score").alias("score"))


def cx_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its statement says: length of the context of three chunks, and whether 3000 characters cut it; ``cx_context_whole`` is the context of all."""
    rows = contexts(spark, sf_dir)
    return rows.select("query_id", F.length("context").alias("n_chars"), (F.length("context") > 3000).alias("is_cut"), F.md5(F.substring("context", 1, 3000)).alias("context_md5"))


#: Characters of a context, and what stands after a longer one.
GATE, CUT = 32_000, "\n\n[...contexte tronqué...]"


def cx_context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the context of all ranked chunks of each query, whether the gate cuts it, and what is given."""
    long = F.length("context") > GATE
    given = F.when(long, F.concat(F.substring("context", 1, GATE), F.lit(CUT))).otherwise(F.col("context"))
    return whole_contexts(spark, sf_dir).select("query_id", F.length("context").alias("n_chars"), long.alias("is_cut"), F.md5(given).alias("context_md5"))


def cx_without_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = A.without_sources(F.col("answer"))
    return responses(spark, sf_dir).where("answer IS NOT NULL").select("query_id", F.md5(clean).alias("answer_md5"), (F.length(clean) < F.length("answer")).alias("shortened"))


def cx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("intro\n### un\n"), F.col("question"), F.lit("\n### deux\nfin"))
    return responses(spark, sf_dir).where("question IS NOT NULL").select("query_id", F.posexplode(A.sections(text, 3)).alias("position", "body"))


def val_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks and score of each answer against its sources and, as the statement says, three chunks; ``val_grounding_whole`` takes all."""
    return _grounding(spark, sf_dir, contexts(spark, sf_dir))


def val_grounding_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks and score of each answer against its sources and all its ranked chunks."""
    return _grounding(spark, sf_dir, whole_contexts(spark, sf_dir))


def _grounding(spark: SparkSession, sf_dir: str, context: DataFrame) -> DataFrame:
    rows = cited(spark, sf_dir).join(context, "query_id", "left")
    found = A.issues(F.col("answer"), F.col("available"), F.col("context"))
    return rows.select("query_id", F.array_join(found, ",").alias("issues"), A.grounding_score(found).alias("score"))


def val_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupported details against three chunks, as the statement says; ``val_unsupported_whole`` takes all."""
    return _unsupported(spark, sf_dir, contexts(spark, sf_dir))


def val_unsupported_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, articles and dates of each answer that none of its ranked chunks has."""
    return _unsupported(spark, sf_dir, whole_contexts(spark, sf_dir))


def _unsupported(spark: SparkSession, sf_dir: str, context: DataFrame) -> DataFrame:
    rows = cited(spark, sf_dir).join(context, "query_id", "left")
    found = A.unsupported(F.col("answer"), F.col("context"))
    return rows.select("query_id", F.size(found).alias("n"), F.array_join(F.slice(found, 1, 3), " ; ").alias("first_three"))


def val_invented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without citations above 3."""
    clean = A.without_invented(F.col("answer"), F.array(*map(F.lit, (1, 2, 3))))
    return cited(spark, sf_dir).select("query_id", F.md5(clean).alias("answer_md5"), F.length(clean).alias("n_chars"))


def val_polished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal that drops the second half is taken only where it loses nothing."""
    proposal = F.substring(F.col("answer"), F.lit(1), F.floor(F.length("answer") / 2).cast("int"))
    return cited(spark, sf_dir).select("query_id", (A.polished(F.col("answer"), proposal) != F.col("answer")).alias("taken"))


def val_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties parsed with a default for what is missing."""
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


MUST = ["durée", "finalité|durées de conservation", "responsable de traitement", "deux"]
MUST_NOT = ["relevés de badge", "images"]


def ev_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness by required items, faithfulness by forbidden ones, conciseness, citations, and the weighted whole."""
    rows = cited(spark, sf_dir)
    answer = A.normalised(F.col("answer"))
    category = F.when(F.col("question").startswith("Combien"), "definition").when(F.contains(F.lower("question"), F.lit("doit")), "obligation").otherwise("autre")
    intent = F.when(F.contains(F.lower("question"), F.lit("comment")), "methodologique").otherwise("factuel")
    scored = rows.select(
        "query_id",
        A.included(F.array(*map(F.lit, MUST)), answer).alias("correctness"),
        A.absent(F.array(*map(F.lit, MUST_NOT)), answer).alias("faithfulness"),
        A.conciseness(X.word_count(F.col("answer")), F.coalesce(category, F.lit("autre")), F.coalesce(intent, F.lit("factuel"))).alias("conciseness"),
        A.source_quality(F.col("answer"), F.lit(False)).alias("sources"),
    )
    whole = F.col("correctness") * 0.55 + F.col("faithfulness") * 0.25 + F.col("sources") * 0.2
    return scored.select("query_id", *(F.round(c, 4).alias(c) for c in ("correctness", "faithfulness", "conciseness", "sources")), F.round(whole, 4).alias("score"))


def ev_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by depth, and the mean of these means."""
    rows = ev_scores(spark, sf_dir).join(responses(spark, sf_dir).select("query_id", "depth"), "query_id").where("depth IS NOT NULL")
    means = rows.groupBy("depth").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    whole = means.agg(F.lit("*").alias("depth"), F.sum("n").alias("n"), F.avg("m").alias("m"))
    return means.unionByName(whole).select("depth", "n", F.round("m", 4).alias("mean_score"))


def ev_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best and the three worst answers."""
    rows = ev_scores(spark, sf_dir).select("query_id", "score")
    best = rows.orderBy(F.desc("score"), "query_id").limit(3).withColumn("side", F.lit("best"))
    return best.unionByName(rows.orderBy("score", "query_id").limit(3).withColumn("side", F.lit("worst")))


def ev_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event values as repeated runs: mean, sample deviation (0 for one run), spread and stability."""
    runs = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"), F.min("value").alias("low"), F.max("value").alias("high"))
    spread = F.round(F.col("high") - F.col("low"), 4)
    return runs.select("user_id", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), spread.alias("spread"), F.when(spread < 5, "stable").when(spread < 50, "varying").otherwise("unstable").alias("stability"))


QUERIES = {
    f.__name__: f
    for f in (
        qr_expanded, qr_tags, qr_reformulations, qr_intents, qr_articles, qr_deadlines, cx_citations, cx_source_cards, cx_context, cx_without_sources, cx_sections, val_grounding, val_unsupported, val_invented, val_polished, val_json, ev_scores,
        ev_report, ev_extremes, ev_runs, cx_context_whole, val_grounding_whole, val_unsupported_whole,
    )
}



def _of(template: str, column: str) -> str:
    return template.replace("{0}", column)


_CITED = f"(SELECT * REPLACE (regexp_replace(answer, '\\[(\\d+)\\]', '[Source \\1]', 'g') AS answer), range(1, greatest(n_sources, 1) + 1) AS available FROM {S.RESPONSES} WHERE answer IS NOT NULL)"
_IDS = "list_transform(regexp_extract_all({0}, '\\[Source\\s+(\\d+)\\]', 1), lambda x: x::INTEGER)"
#: Distinct values in order of first appearance.
_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_CONTEXTS = f"(SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY original_rank NULLS FIRST, chunk_id) AS rank FROM {S.RANKED}) WHERE rank <= 3 GROUP BY ALL)"
_MONTHS = "|".join(vocab.MONTHS)
_UNSUPPORTED = f"""list_concat(
list_transform(list_filter(list_transform(regexp_extract_all(lower(answer), '(\\d[\\d ]*)(?:millions? |milliards? )?(?:d''euros?|€)', 1), lambda x: trim(x)), lambda x: NOT contains(lower(coalesce(context, '')), x) AND length(x) > 2), lambda x: 'amount ' || x),
list_transform(list_filter(regexp_extract_all(lower(answer), '(?:article|art\\.?)\\s+(\\d+(?:[.\\-]\\d+)?)', 1), lambda x: NOT contains(lower(coalesce(context, '')), x)), lambda x: 'article ' || x),
list_transform(list_filter(regexp_extract_all(lower(answer), '(\\d{{1,2}}\\s+(?:{_MONTHS})\\s+\\d{{4}})', 1), lambda x: NOT contains(lower(coalesce(context, '')), x) AND x NOT IN ({', '.join(map(S.text, vocab.KNOWN_DATES))})), lambda x: 'date ' || x))"""
_GROUNDED = f"(SELECT c.*, x.context, {_UNSUPPORTED} AS unsupported, {_of(_IDS, 'answer')} AS ids FROM {_CITED} c LEFT JOIN {_CONTEXTS} x USING (query_id))"
_WHOLE = f"(SELECT query_id, string_agg(text, chr(10) ORDER BY original_rank NULLS FIRST, chunk_id) AS context FROM {S.RANKED} GROUP BY ALL)"
_NORM = f"trim(regexp_replace(lower(coalesce({{0}}, '')), '{S.SPACE}+', ' ', 'g'))"
_NUMBERS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: CASE w " + " ".join(f"WHEN {S.text(k)} THEN {S.text(v)}" for k, v in vocab.NUMBER_WORDS.items()) + " ELSE w END), ' ')"


def _match(item: str) -> str:
    """Match of one literal alternative, its word forms written out."""
    import itertools

    def forms(w: str) -> list[str]:
        out = [w, w + "s", w + "es"]
        out += [w[:-2]] if w.endswith("es") and len(w) > 3 else []
        out += [w[:-1]] if w.endswith("s") and len(w) > 2 else []
        out += [w + "e"] if w.endswith("é") else []
        out += [w[:-1]] if w.endswith("ée") else []
        return out + ([w[:-2], w[:-3]] if w.endswith("ées") else [])

    words = item.split()
    loose = " AND ".join(S.any_of("padded", [f" {f} " for f in forms(w)]) for w in words) if len(words) > 1 else "false"
    digits = " ".join(vocab.NUMBER_WORDS.get(w, w) for w in itertools.chain(words))
    return f"(contains(a, {S.text(item)}) OR contains(numbered, {S.text(digits)}) OR ({loose}))"


_SCORES = f"""n AS (SELECT *, {_of(_NORM, 'answer')} AS a, len({S.words('answer')}) AS w FROM {_CITED}),
m AS (SELECT *, ' ' || regexp_replace(a, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS padded, {_of(_NUMBERS, 'a')} AS numbered,
  CASE WHEN starts_with(question, 'Combien') THEN [150, 400, 600] ELSE [200, 500, 800] END AS base, CASE WHEN contains(lower(question), 'comment') THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END AS factor, {_of(_IDS, 'answer')} AS ids FROM n),
l AS (SELECT *, floor(base[1] * factor) AS ideal, floor(base[2] * factor) AS soft, floor(base[3] * factor) AS hard FROM m),
p AS (SELECT query_id, depth, ({' + '.join('(' + ' OR '.join(_match(x) for x in item.split('|')) + ')::INTEGER' for item in MUST)}) / {len(MUST)} AS correctness,
  1 - ({' + '.join(f"contains(a, {S.text(x)})::INTEGER" for x in MUST_NOT)}) / {len(MUST_NOT)} AS faithfulness,
  CASE WHEN w <= ideal THEN 1.0::DOUBLE WHEN w <= soft THEN 1.0::DOUBLE - 0.3::DOUBLE * (w - ideal) / (soft - ideal) WHEN w <= hard THEN 0.7::DOUBLE - 0.3::DOUBLE * (w - soft) / (hard - soft) ELSE 0.3::DOUBLE END AS conciseness,
  CASE WHEN len(ids) = 0 THEN 0.5::DOUBLE WHEN list_max(ids) > 12 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS sources FROM l),
s AS (SELECT query_id, depth, round(correctness, 4) AS correctness, round(faithfulness, 4) AS faithfulness, round(conciseness, 4) AS conciseness, round(sources, 4) AS sources, round(correctness * 0.55::DOUBLE + faithfulness * 0.25::DOUBLE + sources * 0.2::DOUBLE, 4) AS score FROM p)"""

ORACLE = {
    "qr_tags": f"""WITH t AS (SELECT query_id, list_transform(regexp_split_to_array('[TAGS] ' || array_to_string(enterprise_tags, ', ') || '; Registre!, ab, registre', '[,;]'), lambda x: regexp_replace(lower(trim(x)), '[.;:!?]+$', '')) AS tags FROM {S.RESPONSES}),
f AS (SELECT query_id, list_filter(tags, lambda x: length(x) BETWEEN 3 AND 60) AS tags FROM t) SELECT query_id, array_to_string(({_of(_FIRSTS, 'tags')})[1:3], '|') AS tags FROM f""",
    "qr_reformulations": f"SELECT query_id, CAST(k - 1 AS INTEGER) AS position, q[k] AS question FROM (SELECT query_id, [trim(question), trim(upper(question)), trim(lower(question))] AS q, unnest([1, 2, 3]) AS k FROM {S.RESPONSES} WHERE question IS NOT NULL)",
    "qr_intents": f"SELECT query_id, CASE WHEN length(question) % 3 = 1 THEN 'refus' ELSE 'factuel' END AS intent, 0.5::DOUBLE AS confidence FROM {S.RESPONSES} WHERE question IS NOT NULL",
    "qr_articles": f"""WITH a AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(lower(answer), '(?:article|artikel|artículo|art\\.)\\s+(\\d{{1,3}})', 1), lambda x: x::INTEGER), lambda x: x BETWEEN 1 AND 99) AS n FROM {S.RESPONSES} WHERE answer IS NOT NULL),
f AS (SELECT query_id, ({_of(_FIRSTS, 'n')})[1:5] AS n FROM a) SELECT query_id, CAST(unnest(range(0, len(n))) AS INTEGER) AS position, unnest(n) AS article FROM f""",
    "qr_deadlines": f"SELECT query_id, term, logged_at + to_hours(h) AS end_at, logged_at + to_hours(h) < TIMESTAMP '2024-06-30 12:00:00' AS expired FROM {S.RESPONSES}, (VALUES ('72h', 72), ('30d', 720)) v(term, h) WHERE logged_at IS NOT NULL",
    "cx_citations": f"""WITH c AS (SELECT *, {_of(_IDS, 'answer')} AS ids FROM {_CITED}), f AS (SELECT *, {_of(_FIRSTS, 'ids')} AS firsts FROM c)
SELECT query_id, array_to_string(firsts, ',') AS cited, md5(list_reduce(list_prepend(answer, list_transform(firsts, lambda x: x::VARCHAR)), lambda t, x: replace(t, '[Source ' || x || ']', '[' || chr(1) || list_position(firsts, x::INTEGER) || ']')).replace('[' || chr(1), '[Source ')) AS renumbered, len(firsts) = 0 AS show_all FROM f""",
    "cx_source_cards": f"""WITH g AS (SELECT query_id, document_path, round(max(rerank_score), 6) AS best_score FROM {S.RANKED} WHERE rerank_score IS NOT NULL AND document_path IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, document_path) AS INTEGER) AS source_no FROM g), u AS (SELECT document_path, min(source_url) AS url, min(title) AS title FROM chunks GROUP BY ALL)
SELECT query_id, source_no, document_path, coalesce(nullif(url, ''), document_path) AS url, coalesce(title, '') AS title, best_score AS score FROM r LEFT JOIN u USING (document_path) WHERE source_no <= 10""",
    "cx_context": f"SELECT query_id, length(context) AS n_chars, length(context) > 3000 AS is_cut, md5(substr(context, 1, 3000)) AS context_md5 FROM {_CONTEXTS}",
    "cx_without_sources": f"SELECT query_id, md5(c) AS answer_md5, length(c) < length(answer) AS shortened FROM (SELECT query_id, answer, regexp_replace(regexp_replace(answer, '(?is)\\s+(sources|références|liste des sources|fuentes|quellen)\\s*:\\s*(\\[?\\d+\\]?[\\s,]*)*$', ''), '{S.SPACE}+$', '') AS c FROM {S.RESPONSES} WHERE answer IS NOT NULL)",
    "cx_sections": f"SELECT query_id, CAST(k - 1 AS INTEGER) AS position, b[k] AS body FROM (SELECT query_id, [trim(question), 'fin', ''] AS b, unnest([1, 2, 3]) AS k FROM {S.RESPONSES} WHERE question IS NOT NULL)",
    "val_grounding": f"""WITH g AS (SELECT *, list_filter([CASE WHEN NOT contains(answer, 'Source ') THEN 'no_citation' END, CASE WHEN len(list_filter(ids, lambda x: NOT list_contains(available, x))) > 0 THEN 'invented' END, CASE WHEN length(trim(answer)) < 50 THEN 'short' END,
CASE WHEN {S.any_of('lower(answer)', vocab.EVASIVE)} THEN 'evasive' END, CASE WHEN len(unsupported) > 0 THEN 'unsupported' END], lambda x: x IS NOT NULL) AS f FROM {_GROUNDED}) SELECT query_id, array_to_string(f, ',') AS issues, greatest(0.0, 1.0 - len(f) * 0.25)::DOUBLE AS score FROM g""",
    "val_unsupported": f"SELECT query_id, CAST(len(unsupported) AS INTEGER) AS n, array_to_string(unsupported[1:3], ' ; ') AS first_three FROM {_GROUNDED}",
    "val_invented": f"SELECT query_id, md5(c) AS answer_md5, length(c) AS n_chars FROM (SELECT query_id, trim(regexp_replace(regexp_replace(answer, '\\[Source ([4-9]|[1-9]\\d+)\\]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') AS c FROM {_CITED})",
    "val_polished": f"""WITH p AS (SELECT query_id, answer, substr(answer, 1, (length(answer) // 2)::INTEGER) AS half FROM {_CITED}) SELECT query_id, NOT (length(half) < 50 OR len(list_filter({_of(_IDS, 'answer')}, lambda x: NOT list_contains({_of(_IDS, 'half')}, x))) > 0) AND half <> answer AS taken FROM p""",
    "val_json": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k FROM events",
    "ev_scores": f"WITH {_SCORES} SELECT * EXCLUDE (depth) FROM s",
    "ev_report": f"WITH {_SCORES}, means AS (SELECT depth, count(*) AS n, avg(score) AS v FROM s WHERE depth IS NOT NULL GROUP BY ALL) SELECT depth, n, round(v, 4) AS mean_score FROM (SELECT * FROM means UNION ALL SELECT '*', CAST(sum(n) AS BIGINT), avg(v) FROM means)",
    "ev_extremes": f"WITH {_SCORES} (SELECT query_id, score, 'best' AS side FROM s ORDER BY score DESC, query_id LIMIT 3) UNION ALL (SELECT query_id, score, 'worst' FROM s ORDER BY score, query_id LIMIT 3)",
    "ev_runs": """WITH r AS (SELECT user_id, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, round(max(value) - min(value), 4) AS spread FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, n, round(m, 6) AS mean, round(s, 6) AS std, spread, CASE WHEN spread < 5 THEN 'stable' WHEN spread < 50 THEN 'varying' ELSE 'unstable' END AS stability FROM r""",
}

ORACLE |= {
    "val_grounding_whole": ORACLE["val_grounding"].replace(_CONTEXTS, _WHOLE),
    "val_unsupported_whole": ORACLE["val_unsupported"].replace(_CONTEXTS, _WHOLE),
    "cx_context_whole": f"SELECT query_id, length(context) AS n_chars, length(context) > {GATE} AS is_cut, md5(CASE WHEN length(context) > {GATE} THEN substr(context, 1, {GATE}) || {S.text(CUT).replace(chr(10), "' || chr(10) || '")} ELSE context END) AS context_md5 FROM {_WHOLE}",
}
