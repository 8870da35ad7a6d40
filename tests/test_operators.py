"""Operators on small fixtures: nulls, ties, repeated rows, empty tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from parchemin.functions import expressions as X
from parchemin.functions import providers
from parchemin.operators import answers as A
from parchemin.operators import bm25, corpus, dense, features, logs, ranking, where


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_formula_and_ties(spark):
    docs = spark.createDataFrame([(1, "chat noir"), (2, "chat blanc"), (3, "noir noir corbeau"), (4, None), (5, "le la"), (6, "autre texte"), (7, "encore autre chose")], "key long, text string")
    asked = spark.createDataFrame([("q1", "corbeau"), ("q2", "chat"), ("q3", "le la les"), ("q4", None)], "query_id string, text string")
    found = {(r.query_id, r.key): (r.score, r["rank"]) for r in bm25.search(docs, asked, 10).collect()}
    n, average = 5, 9 / 5
    idf = math.log(n - 1 + 0.5) - math.log(1.5)
    assert found[("q1", 3)][0] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / average)), abs=1e-5)
    assert [found[("q2", k)][1] for k in (1, 2)] == [1, 2]
    assert {q for q, _ in found} == {"q1", "q2"}


def test_bm25_repeated_terms_and_floor(spark):
    docs = spark.createDataFrame([(k, "commun " + "abc"[k % 3] * 3) for k in range(9)], "key long, text string")
    one, two = (bm25.search(docs, spark.createDataFrame([("q", t)], "query_id string, text string"), 3).collect() for t in ("aaa", "aaa aaa"))
    assert [r.key for r in one] == [0, 3, 6] and two[0].score == pytest.approx(2 * one[0].score, abs=1e-5)
    common = bm25.search(docs, spark.createDataFrame([("q", "commun")], "query_id string, text string"), 3)
    weights, _ = bm25.term_weights(bm25.tokenised(docs))
    raw = {r.term: r for r in weights.collect()}
    mean = sum(math.log(9 - r.df + 0.5) - math.log(r.df + 0.5) for r in raw.values()) / len(raw)
    assert raw["commun"].idf == pytest.approx(0.25 * mean) and (common.count() > 0) == (mean > 0)


def test_bm25_allowed_documents(spark):
    docs = spark.createDataFrame([(1, "chat"), (2, "chat"), (3, "chien"), (4, "loup"), (5, "ours"), (6, "lynx")], "key long, text string")
    asked = spark.createDataFrame([("q", "chat")], "query_id string, text string")
    some, none = spark.createDataFrame([(2,)], "key long"), spark.createDataFrame([], "key long")
    assert [r.key for r in bm25.search(docs, asked, 5, allowed=some).collect()] == [2]
    assert bm25.search(docs, asked, 5, allowed=none).count() == 0
    assert bm25.search(docs.limit(0), asked, 5).count() == 0


def test_nearest_vectors_in_blocks(spark):
    data = [(k, [math.cos(k), math.sin(k)]) for k in range(20)] + [(20, None)]
    vectors = spark.createDataFrame(data, "key long, embedding array<double>")
    asked = vectors.where("key < 6")
    whole, blocks = dense.nearest(vectors, asked, 3), dense.nearest(vectors.repartition(7), asked, 3, block=2)
    assert rows(whole.select("query_id", "rank", "key")) == rows(blocks.select("query_id", "rank", "key"))
    assert whole.where("rank = 1 AND query_id <> key").count() == 0 and whole.count() == 18
    assert dense.nearest(vectors, asked.limit(0), 3).count() == 0


def test_fusion_weights_and_missing_ids(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, chunk_id string, rank int")
    assert rows(ranking.fuse([(a, 1.0), (b, 2.0)])) == [("q", "x", round(1 / 61, 9), 1), ("q", "y", round(1 / 62 + 2 / 61, 9), 2)]


def test_relevance_keeps_all_where_none_passes(spark):
    df = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 0.9), ("b", "3", 0.9), ("b", "4", None)], "query_id string, chunk_id string, distance double")
    assert [r.chunk_id for r in ranking.keep_relevant(df, F.col("distance") <= 0.3).orderBy("chunk_id").collect()] == ["1", "3", "4"]


def test_floor_of_three(spark):
    df = spark.createDataFrame([("a", str(k), s) for k, s in enumerate([0.9, 0.2, 0.1, 0.05, None])], "query_id string, chunk_id string, score double")
    assert [r.chunk_id for r in ranking.keep_with_floor(df, "score", 0.5, 3, 5).orderBy("new_rank").collect()] == ["0", "1", "2"]
    assert ranking.keep_with_floor(df, "score", 0.08, 3, 5).count() == 3
    assert ranking.keep_with_floor(df, "score", 0.01, 3, 5).count() == 4


def test_top_up(spark):
    df = spark.createDataFrame([("a", str(k), k < 2, k) for k in range(8)] + [("b", str(k), k < 6, k) for k in range(8)], "query_id string, chunk_id string, own boolean, rank int")
    found = ranking.top_up(df, F.col("own"), 5, [F.col("rank")])
    assert rows(found.groupBy("query_id").count()) == [("a", 5), ("b", 6)]


def test_deduplicate_order_and_null_hash(spark):
    df = spark.createDataFrame([("http://a", "h"), ("https://a?x", "h"), ("https://abc", "h"), ("https://ab", "h"), ("https://n", None), ("https://m", None)], "url string, hash string")
    kept = corpus.deduplicate(df, "hash", corpus.canonical_order(F.col("url"), F.col("url"))).where("copy_no = 1")
    assert rows(kept.select("url", "copies")) == [("https://ab", 4), ("https://m", 1), ("https://n", 1)]
    again = corpus.deduplicate(kept.drop("copy_no", "copies"), "hash", corpus.canonical_order(F.col("url"), F.col("url"))).where("copy_no = 1")
    assert rows(again.select("url")) == rows(kept.select("url"))


def test_snapshots_and_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4")], "k string, h string")
    assert rows(corpus.snapshot_changes(old, new, "k", "h")) == [("a", "unchanged"), ("b", "modified"), ("c", "unchanged"), ("d", "new")]
    assert rows(corpus.merge(old, new.where("k IN ('b', 'd')"), "k").na.fill("")) == [("a", "1"), ("b", "3"), ("c", ""), ("d", "4")]
    assert rows(corpus.pending(new, old, "k")) == [("d", "4")]


def test_reassembled_is_bounded(spark):
    df = spark.createDataFrame([("d", k, "x" * 10) for k in range(50)], "document string, n int, text string")
    row = corpus.reassembled(df, "document", F.col("n"), most=25).first()
    assert row.n_chunks == 50 and row.text == "x" * 10 + "\n\n" + "x" * 10 + "\n\n" + "x"


def test_where_compiler(spark):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"]), ("c", None, None)], "s string, n int, tags array<string>")
    found = lambda w: [r.s for r in df.where(where.compile_where(w)).orderBy("s").collect()]
    assert found(None) == ["a", "b", "c"] and found({"s": "a"}) == ["a"] and found({"n": {"$ne": 1}}) == ["b"]
    assert found({"$or": [{"s": {"$in": ["a", "c"]}}, {"n": {"$gt": 1}}]}) == ["a", "b", "c"]
    assert found({"$and": [{"n": {"$gte": 1, "$lt": 2}}, {"tags": {"$contains": "x"}}]}) == ["a"]
    assert found(where.tags_or_public(["y"], None, "s", "b")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        where.compile_where({"n": {"$near": 1}})


def classify(spark, text, nature="DOC"):
    df = features.classified(features.with_features(spark.createDataFrame([(text, nature)], "text string, document_nature string")))
    return tuple(df.select("nature", "rule_confidence", "rule").first())


def test_every_rule_of_the_classifier(spark):
    assert classify(spark, "une AMENDE") == ("SANCTION", 1.0, "rule_sanction")
    assert classify(spark, "un Modèle") == ("GUIDE", 0.95, "rule_template")
    assert classify(spark, "étape\n 4. faire") == ("GUIDE", 0.95, "rule_procedure")
    assert classify(spark, "article 5 " + "mot " * 100) == ("DOCTRINE", 0.9, "rule_article")
    assert classify(spark, "le principe et la notion") == ("DOCTRINE", 0.75, "score_doctrine")
    assert classify(spark, "le chiffrement") == ("TECHNIQUE", 0.75, "score_technique")
    assert classify(spark, "principe définition vérifier exemple " + "mot " * 150)[2] == "mixed_short"
    assert classify(spark, "mot " * 60) == ("DOCTRINE", 0.65, "default_doctrine")
    assert classify(spark, "principe notion mesure exemple " + "mot " * 300)[2] == "default_doctrine"
    assert classify(spark, "principe notion chiffrement " + "mot " * 150) == ("DOC", 0.5, "open")
    assert classify(spark, "court") == ("DOC", 0.5, "document")
    assert classify(spark, None) == ("DOC", 0.5, "document")


def test_navigation_ladder(spark):
    data = [("a" * 99, True), ("x" * 390 + " Lire la suite", True), ("x" * 900 + " Consulter Voir aussi Rechercher", True), ("Consulter " * 210, True), ("court", False), ("x" * 600 + " Consulter", True), (None, True)]
    df = spark.createDataFrame(data, "text string, html boolean")
    assert [r.n for r in df.select(features.navigation(F.col("text"), F.col("html")).alias("n")).collect()] == [True, True, True, False, False, False, True]


def one(spark, value, **columns):
    """A single expression over literal columns."""
    df = spark.createDataFrame([tuple(columns.values()) or (0,)], ", ".join(f"{c} {'array<int>' if isinstance(v, list) else 'string'}" for c, v in columns.items()) or "n int")
    return df.select(value.alias("v")).first().v


def test_citations(spark):
    c = F.col
    assert one(spark, A.renumbered(c("a")), a="[Source 7] x [Source 1] y [Source 7] [Source 10]") == "[Source 1] x [Source 2] y [Source 1] [Source 3]"
    assert one(spark, A.cited_ids(c("a")), a="rien") == [] and one(spark, A.cited_ids(c("a")), a=None) == []
    assert one(spark, A.without_invented(c("a"), c("s")), a="x [Source 1] [Source 10] y", s=[1]) == "x [Source 1] y"


def test_grounding(spark):
    c = F.col
    long = "Réponse assez longue pour ne pas être jugée trop courte ici. "
    found = lambda a, ctx="": one(spark, A.issues(c("a"), c("s"), c("x")), a=a, s=[1, 2], x=ctx)
    assert found(long + "[Source 1]") == []
    assert found(long + "[Source 9]") == ["invented"]
    assert found("non") == ["no_citation", "short"]
    assert found(long + "[Source 1] article 12 du 25 mai 2018") == ["unsupported"]
    assert found(long + "[Source 1] article 12", "selon l'article 12") == []
    assert found(long + "[Source 1] amende de 20 000 €", "amende de 20 000 €") == []
    assert found(long + "[Source 1] le 3 mars 2021") == ["unsupported"]
    assert found(long + "Contactez votre DPO [Source 1]") == ["evasive"]


def test_flexible_matching(spark):
    hit = lambda item, answer: one(spark, A.matches_any(F.col("i"), A.normalised(F.col("a"))), i=item, a=answer)
    assert hit("risque élevé", "des Risques  élevés") and hit("deux ans", "2 ans") and hit("rien|contrat", "un contrat")
    assert not hit("risque élevé", "un risque faible") and not hit("an", "") and hit("données traitées", "une donnée traité")


def test_conciseness_edges(spark):
    score = lambda n, cat="definition", intent="factuel": round(one(spark, A.conciseness(F.lit(n), F.lit(cat), F.lit(intent))), 4)
    assert [score(n) for n in (150, 400, 600, 601)] == [1.0, 0.7, 0.4, 0.3]
    assert score(240, "definition", "methodologique") == 1.0 and score(200, "inconnu", "inconnu") == 1.0 and score(45, "piège", "refus") < 1.0


def test_parsers(spark):
    c = F.col
    assert one(spark, A.parsed_tags(c("a")), a="[TAGS] Sécurité; AIPD., ab, aipd, quatre, cinq") == ["sécurité", "aipd", "quatre"]
    assert one(spark, A.parsed_tags(c("a")), a="Voici\nun, deux\nfin") == ["deux"]
    assert one(spark, A.parsed_tags(c("a")), a="") == []
    assert one(spark, A.parsed_questions(c("a")), a="1. Première question\n2) non\n- Voici autre chose\nlibre sans marque\n• Troisième question") == ["Première question", "Troisième question"]
    assert one(spark, A.outer_json(c("a")), a='x {"a": [1, 2,], } y') == '{"a": [1, 2]}' and one(spark, A.outer_json(c("a")), a="x") is None
    assert one(spark, A.sections(c("a"), 2), a="intro ### a\nx\n### b\ny\n### c") == ["y", ""]
    assert one(spark, A.sections(c("a"), 2), a="sans titre") == ["sans titre"] * 2


def test_acronyms(spark):
    table = {"AB": "Alpha Beta", "CD": "Gamma"}
    put = lambda q: one(spark, A.expanded(F.col("q"), table), q=q)
    assert put("le AB et (CD)?") == "le AB Alpha Beta et (CD)?"
    assert put("AB ?") == "AB Alpha Beta ?" and put("ab cd") == "ab cd" and put("AB AB x") == "AB Alpha Beta AB Alpha Beta x"
    assert put("le AB Alpha Beta") == "le AB Alpha Beta"


def test_polishing_guard(spark):
    a = "x" * 60 + " [Source 1]"
    taken = lambda p: one(spark, A.polished(F.col("a"), F.col("p")), a=a, p=p)
    assert taken("y" * 60 + " [Source 1]").startswith("y") and taken("y" * 80) == a and taken("y [Source 1]") == a and taken("y" * 200 + " [Source 1]") == a and taken(None) == a


def log(spark, data):
    return spark.createDataFrame(data, "logged_at timestamp_ntz, total_time double, retrieval_time double, generation_time double, n_cited int, n_sources int, error string")


def test_statistics_of_empty_logs(spark):
    votes = spark.createDataFrame([], "rating int")
    row = logs.statistics(log(spark, []), votes).first()
    assert row is None or (row.total_queries == 0 and row.satisfaction_rate is None)
    assert logs.alerts(logs.statistics(log(spark, []), votes, F.lit("2024-01-01").cast("timestamp_ntz"))).count() == 0


def test_alert_thresholds_are_strict(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    entries = log(spark, [(at, 1.0, 0.5, 0.5, 1, 2, "e"), *[(at, 1.0, 0.5, 0.5, 1, 2, None)] * 4])
    stats = logs.statistics(entries, spark.createDataFrame([(1,), (-1,)], "rating int"))
    limits = {"error_rate": 20.0, "slow_response": 1.0, "low_satisfaction": 50.0, "zero_citations": 0.0}
    assert logs.alerts(stats, limits).count() == 0
    assert rows(logs.alerts(stats, limits | {"error_rate": 9.0, "low_satisfaction": 60.0}).select("type", "severity")) == [("error_rate", "critical"), ("low_satisfaction", "warning")]


def test_url_expressions(spark):
    u = lambda e, v: one(spark, e(F.col("u")), u=v)
    assert u(X.url_key, "https://a") == "1a7fcd3b0c8e"[:0] + u(lambda c: F.substring(F.md5(c), 1, 12), "https://a")
    assert u(X.normal_url, "HTTPS://www.A.fr/x") == "a.fr/x" and u(X.extension, "a/b.PDF?x=1") == "pdf" and u(X.extension, "a/b") == ""
    assert u(X.title_of_url, "https://s/a-propos-de/mon-titre/") == "Mon Titre"
    assert one(spark, X.file_type(F.col("m"), F.col("u")), m="application/pdf; x=1", u="a.html") == "pdf"
    assert one(spark, X.file_type(F.col("m"), F.col("u")), m=None, u="a.docx") == "docx" and one(spark, X.file_type(F.col("m"), F.col("u")), m=None, u="a") == "html"
    assert str(one(spark, X.mail_date(F.col("d")), d="Tue, 15 Nov 1994 12:45:26 GMT")) == "1994-11-15 12:45:26" and one(spark, X.mail_date(F.col("d")), d="hier") is None


def test_default_provider_is_deterministic(spark):
    p = providers.Deterministic()
    assert (p.embed(["données de santé"]) == p.embed(["données de santé"])).all() and abs((p.embed(["données"])[0] ** 2).sum() - 1) < 1e-9
    assert p.score(["registre contrôle"], ["le contrôle"]) == [0.5] and p.score([""], ["x"]) == [0.0]
    df = spark.createDataFrame([("a", None), ("b", "registre")], "id string, text string")
    assert [sum(map(abs, r.embedding)) for r in providers.with_embedding(df, "text", ["id"]).orderBy("id").collect()] == [0.0, 1.0]


def test_plans_are_pruned_and_pushed_down(spark, tables, capsys):
    spark.read.parquet(f"{tables}/documents.parquet").where(where.compile_where({"lang": "fr", "n_chars": {"$gte": 300}})).select("doc_id").explain()
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(lang,fr)" in plan and "text" not in plan.split("ReadSchema")[1]
    from parchemin.plans import search

    search.rk_documents(spark, tables).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
