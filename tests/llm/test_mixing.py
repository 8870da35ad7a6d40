"""Mixing: quotas, repeats, the splitting tree, skew."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from parchemin.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


def test_plan_reaches_all_shares_where_it_can():
    sources = [M.Source("a", 0.5, 1, 100, 50_000), M.Source("b", 0.3, 4, 10, 1_000), M.Source("c", 0.2, 2, 0, 0)]
    M.plan(sources)
    a, b, c = (s.quota for s in sources)
    assert b <= 4_000 and c == 0 and a / (a + b) == pytest.approx(0.625, abs=0.01)


def test_plan_with_a_total_uses_small_sources_up():
    sources = M.plan([M.Source("a", 0.5, 1, 100, 50_000), M.Source("b", 0.5, 2, 10, 1_000)], 20_000)
    assert [s.quota for s in sources] == [10_000, 2_000]


def test_tiny_source_does_not_shrink_the_mix_to_nothing():
    sources = M.plan([M.Source("a", 0.6, 1, 1000, 500_000), M.Source("b", 0.39, 1, 1000, 400_000), M.Source("c", 0.01, 1, 1, 3)])
    assert sum(s.quota for s in sources) > 100_000


def test_splitting_tree_is_exact():
    tree = M.splitting_tree([1000, 7, 0, 333], 13, 1)
    assert tree.sum(axis=0).tolist() == [1000, 7, 0, 333] and tree.min() >= 0
    sizes = tree.sum(axis=1)
    assert sizes.max() - sizes.min() <= 1
    assert M.splitting_tree([0, 0], 4, 1).sum() == 0 and M.splitting_tree([5], 1, 1).tolist() == [[5]]
    few = [leaf for node in M.top_nodes([1000, 7, 0, 333], 13, 1, most=2) for leaf in M.leaves(node, 1)]
    assert [counts.tolist() for _, _, counts, _ in few] == tree.tolist() and np.array([at for *_, at in few]).tolist() == (np.cumsum(tree, axis=0) - tree).tolist()


def test_a_million_shards_need_few_nodes_on_the_driver():
    nodes = M.top_nodes([3_000_000] * 15, 1_000_000, 7)
    assert len(nodes) == M.TOP_NODES and sum(int(c.sum()) for _, _, c, _ in nodes) == 45_000_000
    assert sum(1 for _ in M.leaves(nodes[-1], 7)) == nodes[-1][1] - nodes[-1][0]


def test_totals(spark):
    targets = spark.createDataFrame([("grand", 0.7, 2), ("petit", 0.2, 3), ("vide", 0.1, 5)], TARGETS)
    rows = M.totals(documents(spark), targets).collect()
    assert [r.used_up for r in rows] == ["petit", "grand"] and [r.chosen for r in rows].count(True) == 1 and rows[0].n_short == 0
    assert M.totals(documents(spark).limit(0), targets).count() == 0


def documents(spark):
    rows = [(k, f"mot{k} " * (5 + k % 7), "grand", 1) for k in range(300)] + [(1000 + k, "petit texte ici", "petit", 1) for k in range(6)]
    rows += [(2000, None, "grand", 1), (2001, "", "petit", 1), (2002, "texte", None, 1), (2003, "texte", "absent de la liste", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_selection(spark):
    targets = spark.createDataFrame([("grand", 0.7, 2), ("petit", 0.2, 3), ("vide", 0.1, 5), ("petit", 0.2, 3)], TARGETS)
    selection, sources = M.mix(documents(spark), targets, shards=5)
    rows = selection.collect()
    used = Counter((r.source, r.doc_id) for r in rows)
    assert {s for s, _ in used} == {"grand", "petit"} and max(n for (s, _), n in used.items() if s == "petit") <= 3
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
    for s in sources:
        assert abs(tokens[s.name] - s.quota) <= 20
    for shard in {r.shard for r in rows}:
        assert sorted(r.position for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    again = {(r.doc_id, r.copy, r.shard, r.position) for r in M.mix(documents(spark).repartition(7), targets, shards=5)[0].collect()}
    assert again == {(r.doc_id, r.copy, r.shard, r.position) for r in rows}


def test_report_and_degenerate_tables(spark):
    targets = spark.createDataFrame([("grand", 0.5, 1), ("vide", 0.5, 5), (None, 0.1, 1), ("nul", None, 1)], TARGETS)
    report = {r.source: r for r in M.shares(documents(spark), targets).collect()}
    assert set(report) == {"grand", "vide"} and report["grand"].share == 1.0 and report["vide"].share == 0.0 and report["grand"].used_up
    assert M.mix(documents(spark).limit(0), targets)[0].count() == 0
    assert M.mix(documents(spark), targets.limit(0))[0].count() == 0


def test_ranks_do_not_depend_on_buckets(spark, monkeypatch):
    targets = spark.createDataFrame([("grand", 0.5, 1), ("petit", 0.5, 3)], TARGETS)
    one = {tuple(r) for r in M.mix(documents(spark), targets)[0].select("doc_id", "copy", "shard", "position").collect()}
    monkeypatch.setattr(M, "BUCKET_ROWS", 10)
    assert {tuple(r) for r in M.mix(documents(spark), targets)[0].select("doc_id", "copy", "shard", "position").collect()} == one
