"""Searches over several partitions and batches against a plain computation, and what they shuffle."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parchemin.operators import bm25, dense


def plain(docs, asked, k, may=lambda q, key: True):
    """{(query_id, key): (score, rank)} with k1 = 1.5, b = 0.75; as in the statement, occurrences of documents of one key and length are counted together, and what lengths of a key give is added up."""
    n, average = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t.split()))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    out, counted = {}, defaultdict(Counter)
    for key, body in docs:
        counted[key, len(body.split())].update(body.split())
    for query, text in asked:
        by = defaultdict(float)
        for (key, length), words in counted.items():
            for w, times in Counter(text.split()).items():
                if w in words:
                    by[key] += times * (raw[w] if raw[w] >= 0 else 0.25 * mean) * words[w] * 2.5 / (words[w] + 1.5 * (0.25 + 0.75 * length / average))
        best = sorted((-round(s, 6), key) for key, s in by.items() if round(s, 6) > 0 and may(query, key))[:k]
        out |= {(query, key): (pytest.approx(-s, abs=2e-6), i + 1) for i, (s, key) in enumerate(best)}
    return out


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(7)
    words = ["commun"] * 5 + [f"mot{k}" for k in range(30)]
    docs = [(f"d{pick.randrange(10**6):06d}", " ".join(pick.choices(words, k=pick.randrange(3, 12)))) for _ in range(400)]
    docs = list({k: (k, t) for k, t in docs}.values()) + [(f"e{k}", "commun mot1 mot1") for k in range(30)]  # tied
    return docs, [(f"q{k}", " ".join(pick.choices(words, k=4))) for k in range(40)] + [("tied", "mot1")]


def frames(spark, docs, asked, parts=6):
    return spark.createDataFrame(docs, "key string, text string").repartition(parts), spark.createDataFrame(asked, "query_id string, text string")


def told(df):
    return {(r.query_id, r.key): (r.score, r["rank"]) for r in df.collect()}


def test_packed_search_equals_plain_computation(spark, texts, monkeypatch):
    docs, asked = texts
    monkeypatch.setattr(bm25, "BLOCK", 15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        assert told(bm25.search(*frames(spark, docs, asked), 5)) == plain(docs, asked, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_keys_are_added_up(spark, texts):
    docs, asked = texts[0][:60], texts[1][:10]
    docs = docs + [docs[0], docs[1], (docs[2][0], "mot1 mot2 mot3")]
    assert told(bm25.search(*frames(spark, docs, asked), 5)) == plain(docs, asked, 5)


def test_restriction_by_part(spark, texts):
    docs, asked = texts[0], texts[1][:10]
    part = {key: f"p{i % 7}" for i, (key, _) in enumerate(docs)}
    within = [("q0", "p1"), ("q0", "p3"), ("q1", "p9"), ("q2", "p0")]
    limits = {q: {p for x, p in within if x == q} for q, _ in within}
    found, queries = frames(spark, docs, asked)
    named = found.withColumn("part", F.element_at(F.create_map(*(F.lit(x) for pair in part.items() for x in pair)), F.col("key")))
    told_ = told(bm25.search(named, queries, 5, within=spark.createDataFrame(within, "query_id string, part string")))
    assert told_ == plain(docs, asked, 5, lambda q, key: q not in limits or part[key] in limits[q])


def test_nearest_over_many_batches(spark):
    pick = random.Random(3)
    angles = [pick.uniform(0, 6.3) for _ in range(300)] + [1.0] * 30
    vectors = spark.createDataFrame([(k, [math.cos(a), math.sin(a)]) for k, a in enumerate(angles)], "key long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = {(r.query_id, r["rank"]): r.key for r in dense.nearest(vectors.repartition(5), vectors.where("key % 30 = 0"), 7, tasks=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for q in range(0, 330, 30):
        near = sorted((round(1 - math.cos(angles[q]) * math.cos(a) - math.sin(angles[q]) * math.sin(a), 6) + 0.0, k) for k, a in enumerate(angles))[:7]
        expected |= {(q, i + 1): k for i, (_, k) in enumerate(near)}
    assert found == expected


def shuffled(spark, df) -> int:
    """Bytes that the query writes to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    began = written()
    df().write.format("noop").mode("overwrite").save()
    return written() - began


def test_shuffle_does_not_grow_with_pairs_that_share_a_term(spark):
    docs = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("commun autre mot"), F.col("id") % 50).alias("text"))
    asked = spark.range(300).select(F.col("id").cast("string").alias("query_id"), F.concat(F.lit("commun mot"), F.col("id") % 50).alias("text"))
    # 1.2 million pairs share a term; a pair takes some bytes even compressed.
    assert shuffled(spark, lambda: bm25.search(docs, asked, 5)) < 1_200_000


def test_answers_search_once(spark, tables):
    from parchemin.plans import pipelines

    # What the attempts read is there already: the plan neither searches nor joins the chunks' texts again.
    assert not [f for f in pipelines.ag_answers(spark, tables).inputFiles() if "chunks.parquet" in f]
