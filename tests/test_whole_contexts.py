"""Contexts and checks of answers over all ranked chunks."""

from pyspark.sql import functions as F

from parchemin.plans import answers


def test_details_of_every_ranked_chunk_support_an_answer(spark, tmp_path):
    texts = ["un", "deux", "trois", "voir article 28", "le 3 mars 2021", "x" * 4000]
    ranked = [("q", f"c{k}", k, t) for k, t in enumerate(texts, 1)] + [("q", "c1", 1, "un"), ("long", "c1", 1, "y" * 40_000)]
    spark.createDataFrame(ranked, "query_id string, chunk_id string, original_rank int, text string").write.parquet(f"{tmp_path}/ranked_chunks.parquet")
    answer = "Selon l'article 28 et la décision du 3 mars 2021, mais non l'article 99, le contrat est requis [1]."
    spark.createDataFrame([("q", "Q ?", answer, 2)], "query_id string, question string, answer string, n_sources int").write.parquet(f"{tmp_path}/rag_responses.parquet")
    assert answers.val_unsupported_whole(spark, str(tmp_path)).first().first_three == "article 99"
    assert answers.val_unsupported(spark, str(tmp_path)).first().n == 3
    assert answers.val_grounding_whole(spark, str(tmp_path)).first().issues == "unsupported"
    whole = "\n".join(texts)
    cut = spark.range(1).select(F.md5(F.lit(whole)), F.md5(F.lit("y" * 32_000 + answers.CUT))).first()
    rows = {r.query_id: r for r in answers.cx_context_whole(spark, str(tmp_path)).collect()}
    assert (rows["q"].n_chars, rows["q"].is_cut, rows["q"].context_md5) == (len(whole), False, cut[0])
    assert (rows["long"].n_chars, rows["long"].is_cut, rows["long"].context_md5) == (40_000, True, cut[1])
