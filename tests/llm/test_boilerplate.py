"""Template deduction on invented sites."""

from __future__ import annotations

import random

from parchemin.llm import boilerplate as B


def site(n: int = 12):
    """Pages whose furniture is in no word list: only recurrence tells it."""
    rows = []
    for k in range(n):
        body = [f"Sujet numéro {'abcdefghijklmnop'[k]}", f"Le {'texte ' * (k + 2)}est propre à la page.", f"Une phrase de plus {'x' * k}."]
        lines = ["Zorglub bleu", "Plan vert", *body, "", "Pied carmin", "Fin de zone"]
        rows.append((k, f"corpus/zorg/html/{k}.html", "\n".join(lines), "t"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, document_path string, text string, line_no string")


def found(spark, rows):
    out: dict[int, list[int]] = {}
    for r in B.furniture(frame(spark, rows)).collect():
        out.setdefault(r.page_id, []).append(r.line_no)
    return {k: sorted(v) for k, v in out.items()}


def test_unknown_furniture_is_deduced(spark):
    assert found(spark, site()) == {k: [1, 2, 7, 8] for k in range(12)}


def test_body_lines_that_recur_stay(spark):
    rows = [(k, p, t.replace("est propre", "est propre") + "", x) for k, p, t, x in site()]
    rows = [(k, p, t.replace("\nUne phrase", "\nÀ retenir\nUne phrase") if k % 3 else t, x) for k, p, t, x in rows]
    got = found(spark, rows)
    assert got[0] == [1, 2, 7, 8] and got[1] == [1, 2, 8, 9]


def test_related_links_end_at_the_body():
    lines = ["Titre", "Une phrase du corps.", "Sur le même thème", "Mesures de X pour la biométrie", "", "Gérer Y : étape 3", "La suite du corps est ici.", "- un point", "Nom | 12 | mai", "Lire aussi : Z", "Voir aussi l'article 3 du règlement."]
    assert B.listed_lines(lines) == [3, 4, 6, 10]


def test_sentences_about_furniture_are_body():
    lines = ["Un bandeau cookies doit offrir un bouton « Tout refuser » visible.", "Le menu comporte trois entrées : Accueil, Mon compte, Aide.", "La mention « © » ne suffit pas.", "Refuser.", "© Site 2020", "Tout refuser", "Accueil › Dossiers › Traceurs", "Accueil  Contact  Agenda"]
    assert B.listed_lines(lines) == [5, 6, 7, 8]


def test_nulls_duplicates_and_empty_tables(spark):
    rows = site()
    rows += [rows[0], (50, None, "Contact\nUne phrase.", "t"), (51, "corpus/zorg/html/51.html", None, "t"), (52, "corpus/zorg/html/52.html", "", "t"), (53, "corpus/zorg/html/53.html", "\n\n", "t")]
    got = found(spark, rows)
    assert got[0] == [1, 2, 7, 8] and got[50] == [1] and not {51, 52, 53} & set(got)
    assert B.furniture(frame(spark, rows).limit(0)).count() == 0


def test_main_body(spark):
    bodies = {r.page_id: r.body for r in B.main_body(frame(spark, site())).collect()}
    assert bodies[1].split("\n")[0] == "Sujet numéro b" and len(bodies[1].split("\n")) == 3


def test_furniture_in_words_never_listed(spark):
    """Held-out furniture of two hosts, menus, offers amid the body and lists of links among it: the template alone finds nine of ten lines, and no body line in ten."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeiloprstu", k=rng.randint(3, 9))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(7, 14))).capitalize() + "."
    menu, tail, notice = ["Boutique", "Billetterie", "Nos ateliers", "Nous rejoindre", "Le mur"], ["Terms of use", "Newsletter", "Nous contacter", "Nos engagements verts", "Imprint page"], ["Accepter et fermer", "Un mot sur vos données"]
    offers, heads, subjects = ["Deux mois offerts sur la carte Zorg", "Devenez membre du cercle", "Un café avec la rédaction"], ["Dans le même esprit", "Nos lectures"], ["le tri", "la paie", "le vote", "les badges", "la cantine", "le troc"]
    title = lambda: f"Dossier {rng.choice(subjects)} : fiche {rng.randint(1, 99)}"
    rows, gone = [], set()
    for page in range(160):
        parts = [(x, True) for x in rng.sample(menu, 4)] + ([(x, True) for x in notice] if page % 3 else []) + [(title(), False)]
        for _ in range(rng.randint(3, 6)):
            parts.append((sentence(), False))
            if rng.random() < 0.25:
                parts.append((rng.choice(offers), True))
            elif rng.random() < 0.1:
                parts.append((rng.choice(["À noter", "Et après ?"]), False))
                parts.append((sentence(), False))
        if rng.random() < 0.6:
            parts += [(rng.choice(heads), True)] + [(title(), True) for _ in range(rng.randint(2, 4))]
        parts += [(rng.choice(offers), True)] * (rng.random() < 0.3) + [(x, True) for x in rng.sample(tail, 4)]
        rows.append((page, f"corpus/{'zorg' if page % 2 else 'blub'}/html/{page}.html", "\n".join(x for x, _ in parts), "t"))
        gone |= {(page, k) for k, (_, out) in enumerate(parts, 1) if out}
    listed = sum(len(B.listed_lines(r[2].split("\n"))) for r in rows)
    got = {(r.page_id, r.line_no) for r in B.template_lines(frame(spark, rows)).collect()}
    assert listed < 0.2 * len(gone)
    assert len(got & gone) >= 0.9 * len(gone) and len(got & gone) >= 0.9 * len(got)


def test_long_links_and_one_page_sites(spark):
    assert B.listed_lines(["À lire aussi", "Un lien " + "très " * 60 + "long"]) == [1, 2]
    assert found(spark, [(1, "corpus/solo/html/1.html", "Titre seul\nUne phrase qui tient toute seule dans la page.", "t")]) == {}
