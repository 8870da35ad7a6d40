"""Replies of models: parsing with repair and fallback, and the rules that a parsed reply must pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub_questions(raw: Column, question: Column, most: int = 3, least: int = 10) -> Column:
    """The first ``most`` strings of the first JSON list in a reply, trimmed, those under ``least`` characters left out; the question alone where none is left or nothing parses."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\[.*?\]", 0), "array<string>")
    kept = F.filter(F.transform(F.slice(parsed, 1, most), lambda q: F.trim(q)), lambda q: F.length(q) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))


COMPLETENESS = "is_complete boolean, coverage_pct int, missing_aspects array<string>, suggested_queries array<string>"


def completeness(raw: Column) -> Column:
    """Struct (is_complete, coverage_pct, missing_aspects, suggested_queries) of the first JSON object in a reply; complete with 100 where it is silent or does not parse."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), COMPLETENESS)
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(found["is_complete"], F.lit(True)).alias("is_complete"),
        F.coalesce(found["coverage_pct"], F.lit(100)).alias("coverage_pct"),
        F.coalesce(found["missing_aspects"], none).alias("missing_aspects"),
        F.coalesce(found["suggested_queries"], none).alias("suggested_queries"),
    )


def retried(complete: Column, round_no: Column, rounds: int = 1, least: int = 80) -> Column:
    """Whether another retrieval round is to follow: incomplete, under ``least`` per cent, and rounds left."""
    return ~complete["is_complete"] & (complete["coverage_pct"] < least) & (round_no < rounds) & (F.size(complete["suggested_queries"]) > 0)


def rewritten(raw: Column, question: Column, least: int = 5) -> Column:
    """A rewritten question without its quotes; the question itself where the reply is too short or only repeats it."""
    bare = F.trim(raw)
    for mark in "\"'":
        bare = F.when(F.startswith(bare, F.lit(mark)) & F.endswith(bare, F.lit(mark)) & (F.length(bare) > 1), F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.when((F.length(bare) >= least) & (F.lower(bare) != F.lower(question)), bare).otherwise(question)


def judged(raw: Column) -> Column:
    """Score from 0 to 1 of a judge's reply: 0 on a factual error, read by pattern where the JSON is cut, 0.5 where there is no score."""
    whole = F.from_json(raw, "score int, erreur_factuelle boolean", {"mode": "PERMISSIVE"})
    score = F.coalesce(whole["score"], F.nullif(F.regexp_extract(raw, r'"score"\s*:\s*(\d{1,9})', 1), F.lit("")).cast("int"))
    wrong = F.coalesce(whole["erreur_factuelle"], F.lower(F.regexp_extract(raw, r'(?i)"erreur_factuelle"\s*:\s*(true|false)', 1)) == "true")
    return F.when(score.isNull(), F.lit(0.5)).when(wrong, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / F.lit(100.0))))


def constrained(choice: Column, confidence: Column, first: Column, second: Column, nature: Column) -> Column:
    """Struct (chunk_nature, confidence): a choice outside the two options becomes the first at 0.60, one under 0.60 the document's nature at 0.50; a missing choice is the document's nature, a missing confidence 0.70."""
    said, sure = F.coalesce(choice, nature), F.coalesce(confidence, F.lit(0.7))
    inside = F.coalesce((said == first) | (said == second), F.lit(False))
    sure = F.when(inside, sure).otherwise(F.lit(0.6))
    return F.struct(F.when(sure < 0.6, nature).when(inside, said).otherwise(first).alias("chunk_nature"), F.when(sure < 0.6, F.lit(0.5)).otherwise(sure).alias("confidence"))


def first_long(candidates: list[Column], least: int = 100, words: int = 800) -> Column:
    """The first words of the first candidate with more than ``least`` characters; an empty text where none has."""
    found = F.coalesce(*(F.when(F.length(c) > least, c) for c in candidates), F.lit(""))
    return F.array_join(F.slice(F.filter(F.split(found, r"\s+"), lambda w: w != ""), 1, words), " ")
