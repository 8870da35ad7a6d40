"""Cut texts: spikes, ends, closing formulas."""

from __future__ import annotations

import random

from parchemin.llm import truncation as T

WORDS = "la commune doit conserver les journaux de connexion pendant la durée du contrat selon le registre des activités".split()


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(6, 14))).capitalize() + "." for _ in range(n))


def found(spark, rows):
    df = spark.createDataFrame([(k, t, s, "x") for k, (t, s) in enumerate(rows)], "doc_id long, text string, source string, reason string")
    return {r.doc_id: r for r in T.incomplete(df).collect()}


def test_ends(spark):
    rng = random.Random(1)
    cut = ["La commune doit cons", "La commune doit conserver les", "Selon l'article 5,", "le contrôle…", "le contrôle...", "la [...]", "le (suite)", "les Lire la suite", "d'identit�", "du&eac", "à 12 &#2", "la pl\\u00", "la <", "(cf. art.", "La version 5."]
    whole = ["Tout est dit.", "Vraiment ?", "Oui !", "(voir l'annexe).", "https://a.example/b/3", "Contact : x@a.example", "| Nom | 12 | mai |", "- Annexe 4 : les traceurs", "Et ainsi de suite, jusqu'à la dernière fiche…", "Fini.​ \n"]
    # Learned: lines that recur but for numbers and names, and lines that begin alike and never end with a full stop.
    whole += [f"Réf. : {x}-2021-{x * 7}" for x in range(4)] + [f"Fait à {x}, le 1{len(x)} {m} 2023" for x, m in zip(("Ternois", "Kelta", "Zorg", "Blub"), ("mai", "juin", "mars", "août"), strict=True)]
    whole += [f"Schlagworte: {x}, Dauer" for x in ("Lohn", "ein Register", "der Zugang", "die Frist")] + [f"Paraphé par {x} du greffe" for x in ("la garde", "le chef", "un commis", "les clercs")]
    rows = [(sentences(rng, 3) + "\n" + e, "s") for e in cut + whole] + [(sentences(rng, 3) + f"\nLa commune {e} le registre des activités.", "s") for e in ("tient", "garde", "ouvre", "montre", "classe", "rend", "lit", "date", "copie")]
    whole += [""] * 9
    got = found(spark, rows)
    assert [bool(got[k].reason) for k in range(len(rows))] == [True] * len(cut) + [False] * len(whole)


def test_spike_of_a_field_limit(spark):
    rng = random.Random(2)
    rows = [(sentences(rng, 40)[:500].rstrip(" .") + "x" * 0, "cut") for _ in range(40)]
    rows = [(t.ljust(500, "e"), s) for t, s in rows] + [(sentences(rng, rng.randint(2, 30)), "cut") for _ in range(100)] + [(sentences(rng, rng.randint(2, 30)), "whole") for _ in range(100)]
    got = found(spark, rows)
    assert {k for k, r in got.items() if r.reason} == set(range(40)) and all(got[k].reason == "spike" for k in range(40))


def test_unknown_formula_is_learned(spark):
    rng = random.Random(3)
    rows = [(sentences(rng, rng.randint(2, 20)) + "\nBureau du troisième étage", "s") for _ in range(12)] + [(sentences(rng, 5) + "\nBureau du quatr", "s")]
    got = found(spark, rows)
    assert [k for k, r in got.items() if r.reason] == [12]


def test_nulls_blanks_copies_and_empty_tables(spark):
    rows = [(None, "s"), ("", "s"), (" \n ", None), ("Coupé au mil", None), ("Coupé au mil", "s"), ("Fini.", "s"), ("x" * 1_000_000, "s")]
    got = found(spark, rows)
    assert set(got) == {3, 4, 5, 6} and got[3].reason and got[4].reason and not got[5].reason
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.incomplete(df).count() == 0 and T.truncation_report(df).count() == 0
