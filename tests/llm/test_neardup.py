"""Near duplicates against brute force, with copies, skew and odd texts."""

from __future__ import annotations

import itertools
import random
import re

from parchemin.llm import neardup as N


def brute(docs: dict[str, str], threshold: float, size: int) -> set[tuple[str, str]]:
    sets = {}
    for key, text in docs.items():
        words = re.findall(r"[^\W_]+", text.lower())
        sets[key] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    out = set()
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if docs[a] == docs[b] or (x | y and len(x & y) / len(x | y) >= threshold):
            out.add((a, b))
    return out


def corpus(seed: int, families: int, members: int) -> dict[str, str]:
    rng = random.Random(seed)
    vocabulary = [f"mot{k}" for k in range(400)]
    docs = {}
    for family in range(families):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        for member in range(members):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            docs[f"f{family}_{member}"] = " ".join(words)
    return docs


def found(spark, docs, threshold=0.6, size=3):
    df = spark.createDataFrame(list(docs.items()), "doc string, text string")
    return {tuple(r) for r in N.similar_pairs(df, threshold, size).select("doc_a", "doc_b").collect()}


def test_equals_brute_force(spark):
    docs = corpus(1, 40, 5)
    expected, got = brute(docs, 0.6, 3), found(spark, docs)
    assert got <= expected and len(got) >= 0.99 * len(expected) > 100


def test_higher_threshold_and_longer_shingles(spark):
    docs = corpus(2, 25, 5)
    assert found(spark, docs, 0.8, 5) == brute(docs, 0.8, 5)


def test_copies_short_and_empty_texts(spark):
    docs = {"a": "un deux", "b": "un deux", "c": "Un deux", "d": "", "e": "", "f": "un deux trois quatre", "g": "UN, deux... trois\nquatre", "h": "mot " * 5000}
    expected = {("a", "b"), ("d", "e"), ("f", "g")}
    assert found(spark, docs) == expected == brute(docs, 0.6, 3)


def test_a_third_of_all_rows_are_copies(spark):
    docs = corpus(3, 10, 3) | {f"copie{k:03}": "le même texte pour tous les sites du groupe entier" for k in range(60)}
    assert found(spark, docs) >= {p for p in brute(docs, 0.6, 3) if p[0].startswith("copie")}


def test_nulls_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x y z t"), ("a", "x y z t"), ("b", None), (None, "x y z t"), ("c", "x y z t")], "doc string, text string")
    assert [tuple(r) for r in N.similar_pairs(df, 0.6, 3).distinct().collect()] == [("a", "c")]
    assert N.similar_pairs(df.limit(0), 0.6, 3).count() == 0


def test_groups_have_one_row_a_document(spark):
    docs = corpus(4, 6, 4)
    df = spark.createDataFrame(list(docs.items()), "doc string, text string")
    rows = {r.doc: r for r in N.duplicate_groups(df, 0.6, 3).collect()}
    assert set(rows) == set(docs)
    for a, b in brute(docs, 0.7, 3):
        assert rows[a].group_id == rows[b].group_id
    assert all(rows[a].group_id != rows[b].group_id for a in rows for b in rows if a.split("_")[0] != b.split("_")[0])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in N.components(links).collect()}
    assert {roots[k] for k in range(41)} == {0} and roots[101] == 100
    assert N.components(links.limit(0)).count() == 0


def test_layout_keeps_recall_and_lengthens_keys_with_the_records():
    assert N.layout(1000, 0.6) == N.layout(1_000_000, 0.6) == (20, 6)
    for records in (1, 10**6, 10**7, 10**9, 10**12):
        for threshold in (0.6, 0.8, 1.0):
            segments, width = N.layout(records, threshold)
            meets = threshold**width + width * threshold ** (width - 1) * (1 - threshold)
            assert 1 - (1 - meets) ** segments >= N.RECALL and width == 6 + max(0, len(str(records)) - 7)


def test_joins_are_never_broadcast_by_estimate(spark):
    docs = corpus(5, 10, 3)
    df = spark.createDataFrame(list(docs.items()), "doc string, text string")
    prints = N.fingerprints(df, 3, 20, 6).withColumn("rid", N.F.monotonically_increasing_id())
    plan = N.candidates(prints, 0.6, 20, 6)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_star_with_a_hot_centre(spark, monkeypatch):
    from parchemin import session

    monkeypatch.setattr(session.hot_keys, "__defaults__", (20,))
    links = spark.createDataFrame([(7, k) for k in range(100, 200)] + [(k, k + 1) for k in range(300, 340)], "a long, b long")
    roots = {r.node: r.root for r in N.components(links).collect()}
    assert {roots[k] for k in range(100, 200)} == {7} and {roots[k] for k in range(300, 341)} == {300}
