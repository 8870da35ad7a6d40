"""Lines repeated within a site."""

from __future__ import annotations

from parchemin.llm import sitelines as L


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, document_path string, text string, line_no int")


def page(site: str, k: int, text: str):
    return (f"{site}{k}_0", f"corpus/{site}/html/{k}.html", text, 7)


def test_definition_of_repeated_lines(spark):
    rows = [page("a", k, f"Unique {'xyz'[k % 3] * (k + 1)}\n  MENTIONS   légales {k} \n\nPartagez") for k in range(10)]
    rows += [page("b", k, "Mentions légales 5\nautre " + "q" * k) for k in range(3)]
    rows += [rows[0], ("n_0", None, "Partagez", 1), ("m_0", "sans-site", "Partagez", 1), ("k_0", "corpus/a/html/0.html", None, 1)]
    found = sorted((r.chunk_id, r.line_no) for r in L.occurrences(chunks(spark, rows)).collect())
    assert found == sorted((f"a{k}_0", n) for k in range(10) for n in (2, 4))


def test_share_of_a_large_site(spark):
    rows = [page("g", k, ("Rare\n" if k < 4 else "Assez\n" if k < 10 else "") + "corps " + "z" * k) for k in range(100)]
    assert {r.chunk_id for r in L.occurrences(chunks(spark, rows)).collect()} == {f"g{k}_0" for k in range(4, 10)}


def test_several_chunks_of_one_document_count_once(spark):
    rows = [(f"c_{k}", "corpus/a/html/1.html", "Même ligne", 1) for k in range(9)]
    assert L.occurrences(chunks(spark, rows)).count() == 0


def test_blocks_are_components(spark):
    rows = [page("a", k, "un\ndeux\ntrois\n" + "corps " + "y" * k + "\nseul") for k in range(8)]
    blocks, _ = L.repeated_lines(chunks(spark, rows))
    sizes = sorted(r["count"] for r in blocks.groupBy("block").count().collect())
    assert sizes == [1, 3]


def test_cleaning(spark):
    rows = [page("a", k, f"Bandeau\ncorps {'w' * (k + 1)}\n\nPied {k}") for k in range(6)] + [("s_0", "corpus/b/html/1.html", "Bandeau", 1), ("t_0", None, None, 1)]
    found = {r.chunk_id: (r.clean_text, r.n_removed) for r in L.remove_repeated(chunks(spark, rows)).collect()}
    assert found["a2_0"] == ("corps www\n", 2) and found["s_0"] == ("Bandeau", 0) and found["t_0"] == (None, 0)
    again = chunks(spark, [(k, f"corpus/a/html/{k}.html", v[0], 1) for k, v in found.items() if k.startswith("a")])
    assert L.occurrences(again).count() == 0


def test_empty_table(spark):
    assert L.occurrences(chunks(spark, []) if False else chunks(spark, [page("a", 1, "x")]).limit(0)).count() == 0
