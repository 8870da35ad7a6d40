"""Parsing of model replies: nulls, empty and broken ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchemin.operators import replies as R
from parchemin import session


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sub_questions(spark):
    q, lit = F.lit("La question ?"), F.lit
    assert one(spark, R.sub_questions(lit('x ["Une première question ?", "b"] y'), q)) == ["Une première question ?"]
    for raw in ("", "[]", "[1", '["court"]', None):
        assert one(spark, R.sub_questions(lit(raw).cast("string"), q)) == ["La question ?"]


def test_completeness_and_retry(spark):
    low = R.completeness(F.lit('{"is_complete": false, "coverage_pct": 40, "suggested_queries": ["a"]}'))
    assert one(spark, R.retried(low, F.lit(0))) and not one(spark, R.retried(low, F.lit(1)))
    for raw in ("", "rien", "{", None):
        got = one(spark, R.completeness(F.lit(raw).cast("string")))
        assert (got.is_complete, got.coverage_pct, got.missing_aspects) == (True, 100, [])


def test_rewritten(spark):
    q = F.lit("Combien ?")
    assert one(spark, R.rewritten(F.lit(' "Combien de temps ?" '), q)) == "Combien de temps ?"
    for raw in ("", '"', "abc", "COMBIEN ?", None):
        assert one(spark, R.rewritten(F.lit(raw).cast("string"), q)) == "Combien ?"


def test_judged(spark):
    cases = {'{"score": 80, "erreur_factuelle": false}': 0.8, '{"score": 80, "erreur_factuelle": true}': 0.0, '{"score": 250}': 1.0, '{"score": 70, "justification": "cou': 0.7, "illisible": 0.5, "": 0.5}
    for raw, score in cases.items():
        assert one(spark, R.judged(F.lit(raw))) == score
    assert one(spark, R.judged(F.lit(None).cast("string"))) == 0.5


def test_constrained(spark):
    got = lambda choice, sure: tuple(one(spark, R.constrained(F.lit(choice).cast("string"), F.lit(sure).cast("double"), F.lit("A"), F.lit("B"), F.lit("D"))))
    assert got("B", 0.9) == ("B", 0.9) and got("X", 0.9) == ("A", 0.6) and got("B", 0.3) == ("D", 0.5) and got("B", None) == ("B", 0.7)


def test_lookup_takes_hot_keys_out_of_the_shuffle(spark):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 50)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, w string")
    hot = session.hot_keys(left, "k", 10)
    assert [r.k for r in hot.collect()] == [1] and session.hot_keys(left, "k", 100) is None
    assert sorted(map(tuple, session.lookup(left, right, "k", hot).collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_broadcasts_are_measured_in_bytes(spark):
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert session.measured(df)[1] and not session.measured(df, limit=99)[1] and not session.measured(df, limit_bytes=50_000)[1]
