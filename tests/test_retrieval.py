"""The search end to end on small tables."""

from parchemin.plans import search


def test_restriction_dense_side_and_expansions(spark):
    rows = spark.createDataFrame(
        [("a_0", "durée conservation badges", "A", "GUIDE"), ("a_1", "registre sécurité", "A", "GUIDE"), ("b_0", "durée conservation badges archives", "B", "GUIDE"), ("c_0", "caméras piscine municipale", "C", "DOCTRINE"), ("d_0", "autre sujet", "D", "GUIDE"), ("e_0", "encore rien", "E", "GUIDE")],
        "chunk_id string, text string, document_path string, chunk_nature string",
    )
    index = spark.createDataFrame([("A", "badges accueil"), ("B", "archives"), ("C", "piscine"), ("D", "autre sujet"), ("E", "encore rien")], "key string, text string")
    asked = spark.createDataFrame([("q", "durée conservation badges"), ("none", "caméras")], "query_id string, text string")
    expansions = spark.createDataFrame([("q", 1, "registre sécurité")], "query_id string, n int, text string")

    def run(least, expansions):
        return {(r.query_id, r.document_path): r for r in search.retrieve(rows, asked, expansions, index, least=least).collect()}

    found = run(0, expansions)
    assert {d for q, d in found if q == "q"} == {"A"}  # only A is in the summaries of badges, sparsely and densely
    assert found["q", "A"].avg_similarity == 1.0  # the expansion meets a_1, the question a_0
    assert found["q", "A"].best_score == round(2 / 61 + 2 / 61 + 1 / 62, 6)  # a_0 is first densely and sparsely, second of the expansion
    assert {d for q, d in found if q == "none"} == {"A", "B", "C", "D", "E"} and found["none", "C"].best_score == round(4 / 61, 6)  # no summary: not restricted
    topped = run(3, expansions.limit(0))
    assert {d for q, d in topped if q == "q"} == {"A", "B"} and topped["q", "B"].best_score == round(2 / 63, 6)  # topped up after the two chunks of A
