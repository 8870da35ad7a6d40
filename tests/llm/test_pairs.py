"""Defects of prompt and response pairs."""

from __future__ import annotations

import random

import pytest

from parchemin.llm import pairs as P

Q = "Combien de temps garder les journaux de connexion ?"
SOUND = "La commune doit conserver les journaux de connexion pendant six mois, ce que le contrôle a confirmé. Le registre est tenu à jour [2]."


@pytest.mark.parametrize("answer", ["", " \n\t", " ", "​", "-", "...", "Réponse :", "**Réponse**\n", "[1] [2]", "Sources : [1]"])
def test_empty(answer):
    assert P.is_empty(P.plain(answer))


@pytest.mark.parametrize("answer", ["Oui.", "11 jours.", "½", "Article 5 [1]."])
def test_short_answers_are_not_empty(answer):
    assert not P.is_empty(P.plain(answer)) and not P.is_truncated(P.plain(answer))


@pytest.mark.parametrize("answer", [Q, Q[:-2], Q.upper(), f"« {Q} »", f"Question : {Q}", f"Vous demandez : {Q}", f"{Q}\n{Q}", Q.replace(" ", "  "), Q.replace("garder", "ｇａｒｄｅｒ")])
def test_copies(answer):
    assert P.is_copy(P.plain(Q), P.plain(answer))


def test_restated_questions_are_no_copies():
    assert not P.is_copy(P.plain(Q), P.plain(f"{Q} Six mois à compter de la collecte.")) and not P.is_copy(P.plain(Q), "Six mois.")


@pytest.mark.parametrize("end", ["La commune doit cons", "La commune doit conserver les", "La commune…", "Le contrôle, et la...", "La [", "Les points\n-", "Le **", "Selon l'article 5,"])
def test_truncated(end):
    assert P.is_truncated(P.plain(f"{SOUND} {end}"))


@pytest.mark.parametrize("end", ["", "Sources : [1] [3]", "Voir https://a.example/b", "\n- un point sans fin\n- un autre", "\n| a | b |", "Les agents ont noté « rien à signaler ».", "Fini [3].", "Bravo 👍."])
def test_complete(end):
    assert not P.is_truncated(P.plain(f"{SOUND} {end}"))


def test_languages():
    texts = {"fr": SOUND, "en": "The clinic must keep the connection logs within a reasonable time.", "de": "Die Klinik muss die Daten für jeden Zweck aufbewahren.", "es": "La clínica debe conservar los registros en un plazo razonable."}
    texts |= {"it": "La clinica deve conservare i registri di connessione per sei mesi, come ha confermato il controllo.", "pt": "A clínica deve conservar os registos de ligação durante seis meses, como o controlo confirmou.", "nl": "De kliniek moet de gegevens zes maanden bewaren, zoals de controle heeft bevestigd."}
    assert {k: P.language(t)[0] for k, t in texts.items()} == {k: k for k in texts}
    for asked in ("Combien de temps garder la politique de mots de passe ?", "Durée conservation la politique de mots de passe Tafennos", "Durée conservation les relevés de badge Tisqui"):
        assert P.language(asked)[0] == "fr"
    assert P.language("12 [3]")[0] is None


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "query_id string, question string, answer string, defect string")


def test_templates_across_prompts(spark):
    refusals = [f"{start}mes sources restent muettes sur {topic}, rien à en dire." for start, topic in (("Désolé, ", "ce point"), ("", "ce point"), ("", "ce point"), ("Hélas : ", "ce point"))]
    rows = [(f"r{k}", f"Question {k} sur le thème {k} ?", "Je ne peux pas répondre à cette demande." + (" Réessayez plus tard." if k % 2 else "")) for k in range(5)]
    rows += [(f"s{k}", f"Que dit la fiche {k} ?", f"Voici les points à retenir. {SOUND}") for k in range(5)]
    rows += [("d", Q, "Je ne peux pas être contraint de fournir mon numéro : c'est ce que le salarié oppose. " + SOUND), ("u", Q, refusals[0])]
    rows += [("e", Q, None), ("c", Q, Q), ("t", Q, SOUND + " Le registre est"), ("o", Q, "The clinic must keep the connection logs within a reasonable time."), ("n", None, None), ("n2", None, "The clinic must")]
    rows += rows[:3]
    found = {r.query_id: r.defect_type for r in P.defects(frame(spark, rows)).collect()}
    assert found == {f"r{k}": "refusal" for k in range(5)} | {"e": "empty", "c": "copy", "t": "truncated", "o": "other_language"}


UNRELATED = ["Quel budget prévoir pour un audit ?", "Qui nomme le délégué ?", "Les badges sont-ils obligatoires ?", "Que vaut une signature scannée ?"]


def test_templates_outside_the_word_list(spark):
    """A wording that the list lacks is told by its use; recurring short, yes-or-no, valued and topical answers are not."""
    listed = ["Le sujet reste entièrement ouvert de mon côté.", "Le sujet reste entièrement ouvert de mon côté. Réessayez plus tard."]
    assert not any(P.speaks_of_refusal(a) for a in listed)
    rows = [(f"r{k}", q, listed[k % 2]) for k, q in enumerate(UNRELATED)]
    rows += [(f"g{k}", q, "Zu diesem Thema schweigt meine Sammlung leider völlig.") for k, q in enumerate(["Wer ernennt den Beauftragten?", "Welche Kosten hat eine Prüfung?", "Sind Ausweise Pflicht?"])]
    rows += [(f"s{k}", q, "Cela dépend vraiment.") for k, q in enumerate(UNRELATED)] + [(f"p{k}", q, "Non, jamais sans un accord écrit préalable.") for k, q in enumerate(UNRELATED)]
    rows += [(f"v{k}", q, f"{k + 6} mois à compter de la collecte.") for k, q in enumerate(UNRELATED)] + [(f"n{k}", q, f"La décision revient toujours au service {w}.") for k, (q, w) in enumerate(zip(UNRELATED, ["Paie", "Achats", "Juridique", "Accueil"], strict=True))]
    rows += [(f"t{k}", f"{start} les factures ?", "La loi fixe cette obligation pour chaque commerçant.") for k, start in enumerate(["Pourquoi archiver", "Qui doit garder", "Comment classer"])]
    found = {r.query_id: r.defect_type for r in P.defects(frame(spark, rows)).collect()}
    assert found == {x: "refusal" for x in ("r0", "r1", "r2", "r3", "g0", "g1", "g2")}


def test_alike_openings_are_one_cluster(spark):
    rows = [(f"r{k}", UNRELATED[k], f"Je ne suis pas en mesure de me prononcer sur {t}.") for k, t in enumerate(["la biométrie", "les traceurs", "la paie", "le recrutement"])]
    clusters = {r.cluster for r in P.opening_clusters(P._described(P.standing_alone(P.assess(frame(spark, rows))))).collect()}
    assert len(clusters) == 1 and P.templates(P.assess(frame(spark, rows))).count() == 4


def test_empty_table(spark):
    assert P.defects(frame(spark, []) if False else frame(spark, [("a", Q, SOUND)]).limit(0)).count() == 0


def test_refusals_in_words_never_listed(spark):
    """Held-out wordings in three languages with and without courtesies, amid answers of varied length and prompts of many subjects: the templates alone find nine of ten and nothing else."""
    rng = random.Random(5)
    cores = ["Mon corpus reste muet à propos de {}", "Voilà une demande que j'esquive volontiers", "Le moteur a rendu une page blanche pour {}", "That falls in a blind spot of this tool", "My shelves hold not one line on {}", "Der Bestand schweigt sich über {} ganz aus"]
    topics, heads, tails = ["la paie", "les badges", "le vote", "les contrats types"], ["", "Pardonnez-moi, ", "Eh bien, "], ["", " Tentez votre chance demain.", " Un collègue saura."]
    names = ["Orlu", "Vesta", "Kamir", "Dolte", "Pruna", "Zefir", "Malou", "Tibor"]
    rows, refused = [], set()
    for k in range(150):
        q = f"{rng.choice(['Quand', 'Comment', 'Pourquoi', 'Qui doit', 'Faut-il'])} {rng.choice(['ranger', 'noter', 'céder', 'dater', 'classer', 'vendre', 'lier', 'ouvrir', 'trier', 'signer'])} {rng.choice(['le stockage', 'les visites', 'le tri', 'la saisie', 'les accès', 'le quai', 'les cartes', 'la cour', 'les dons', 'le parc'])} {k} ?"
        if k % 3 == 0:
            refused.add(f"q{k}")
            rows.append((f"q{k}", q, (rng.choice(heads) + rng.choice(cores).format(rng.choice(topics)) + "." + rng.choice(tails))))
        else:
            parts = [" ".join(rng.choices([f"mot{x}" for x in range(300)], k=rng.randint(4, 12))).capitalize() + "." for _ in range(rng.randint(1, 4))]
            rows.append((f"q{k}", q, rng.choice(["Oui.", f"{k} jours.", f"Le service {rng.choice(names)}.", " ".join(parts), " ".join(parts), "Cela dépend. " + " ".join(parts)])))
    assert not any(P.speaks_of_refusal(a) for _, _, a in rows)
    found = {r.query_id for r in P.templates(P.assess(frame(spark, rows))).collect()}
    assert found <= refused and len(found) >= 0.9 * len(refused)


def test_hot_buckets_lose_no_cluster(spark):
    """Openings that meet in buckets whose least member is unlike them still find each other; recall of the bands is above their formula."""
    import numpy as np

    kept = [r.opening_id for r in P.opening_clusters(spark.createDataFrame([(k, f"mot{k % 5} suite commune du modèle numéro {chr(97 + k % 7)} {chr(97 + k % 11)}") for k in range(120)], "opening_id long, opening string")).collect()]
    assert len(set(kept)) == 120
    bands = 1 - (1 - np.array([0.5, 0.6, 0.7]) ** P.ROWS) ** P.BANDS
    assert (bands >= [0.95, 0.99, 0.999]).all()


def _in_one_bucket(count: int) -> list[tuple[int, str]]:
    """Openings that share the first dozen of their words, which is enough to meet and too little to be alike."""
    rng = random.Random(9)
    shared = "le comité de suivi du plan teste la charte des agents communaux"
    return [(k, f"{shared} {' '.join(rng.sample([f'mot{x}' for x in range(5000)], 8))}") for k in range(count)]


def test_heads_of_a_bucket_cost_no_jobs(spark, monkeypatch):
    """However many members of a bucket are unlike each other, the clustering takes as many steps on the driver."""
    real, steps = P.checkpoint, []
    monkeypatch.setattr(P, "checkpoint", lambda df: steps.append(1) or real(df))
    taken = []
    for count in (6, 40):
        steps.clear()
        assert P.opening_clusters(spark.createDataFrame(_in_one_bucket(count), "opening_id long, opening string")).count() == 0
        taken.append(len(steps))
    assert taken[0] == taken[1]


def test_buckets_in_parts_lose_no_link(spark):
    """Each member is linked to the first head alike to it; a bucket taken in parts gives the same clusters."""
    families = [[f"famille{a}{w}" for w in "abcdefgh"] for a in range(5)]
    rows = _in_one_bucket(30) + [(100 + 20 * a + k, " ".join([*words, f"fin{k}"])) for a, words in enumerate(families) for k in range(20)]
    bands = P.checkpoint(P._bands(spark.createDataFrame(rows, "opening_id long, opening string")))
    whole, parts = ({tuple(r) for r in P._links(bands, most).collect()} for most in (1000, 3))
    buckets, expected = {}, set()
    for r in sorted(bands.collect(), key=lambda r: r.opening_id):
        heads = buckets.setdefault(r.band, [])
        x = set(P._shingles(r.opening).tolist())
        head = next((k for k, y in heads if len(x & y) >= P.ALIKE * len(x | y)), None)
        heads.append((r.opening_id, x)) if head is None else expected.add((r.opening_id, head))
    assert whole == expected and len(whole) >= 95
    clusters = [{tuple(r) for r in P.components(spark.createDataFrame(sorted(x), "a long, b long")).collect()} for x in (whole, parts)]
    assert clusters[0] == clusters[1] == {(100 + 20 * a + k, 100 + 20 * a) for a in range(5) for k in range(20)}
