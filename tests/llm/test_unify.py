"""One form for text that looks the same."""

from __future__ import annotations

import unicodedata

from parchemin.llm import unify as U


def clean(spark, texts):
    df = spark.createDataFrame([("x", str(k), t, "y") for k, t in enumerate(texts)], "record_type string, record_id string, text string, clean string")
    rows = {int(r.record_id): (r.clean, r.changed) for r in U.unify(df).collect()}
    return [rows[k] for k in range(len(texts))]


def test_each_kind_of_character(spark):
    pairs = {
        "a b c d　e": "a b c d e",
        "co­op​é⁠r﻿er᠎": "coopérer",
        "été ça": "été ça",
        "１２ Ｄｏｎｎéｅｓ": "12 Données",
        "𝐝𝐞 𝒟𝕠𝖈": "de Doc",
        "ﬁche oﬃce": "fiche office",
        "sous‑traitance au‐delà": "sous-traitance au-delà",
        "pаyeѕ Аssocіation": "payes Association",
        "dοnνe": "donve"[:0] + "donve",
        "Съвeт": "Съвет",
    }
    found = clean(spark, list(pairs))
    assert [f for f, _ in found] == list(pairs.values()) and all(changed for _, changed in found)


def test_regular_characters_stay(spark):
    texts = ["œuvre…", "« oui » €©", "a – b — c • d", "1ᵉʳ 2² 3³ xⁿ", "½ journée", "👍 👍🏽 👩‍💻 ❤️", "Επιτροπή Αρχείων", "Съвет за данните", "tab\tligne\r\nfin", "don’t “x”", "Straße ¿Qué?", "", " a  b "]
    assert clean(spark, texts) == [(t, False) for t in texts]


def test_nulls_and_long_texts(spark):
    long = "mot " * 200_000 + "pаye"
    found = clean(spark, [None, long])
    assert found[0] == (None, False) and found[1] == ("mot " * 200_000 + "paye", True)


def test_second_pass_changes_nothing(spark):
    texts = ["".join(chr(c) for c in range(start, start + 200) if unicodedata.category(chr(c)) not in ("Cs", "Cn")) for start in range(0x20, 0x2FFF, 200)]
    once = [t for t, _ in clean(spark, texts)]
    assert [t for t, _ in clean(spark, once)] == once


def test_empty_table(spark):
    assert U.unify(spark.createDataFrame([], "record_type string, record_id string, text string")).count() == 0


def test_private_characters_and_joining_scripts_stay(spark):
    rows = [("chunk", "a", "texte  et ,  et   "), ("chunk", "b", "می‌خواهم"), ("chunk", "c", "क्‍ष"), ("chunk", "d", "ca‌fé")]
    got = {r.record_id: r.clean for r in U.unify(spark.createDataFrame(rows, "record_type string, record_id string, text string")).collect()}
    assert got == {"a": "texte  et ,  et   ", "b": "می‌خواهم", "c": "क्‍ष", "d": "café"}
