"""Broken prompt and response pairs (problem 3).

An answer is cut into clauses at its marks.  A clause that recurs on many
prompts is stock (a courtesy, an advice to try again).  A response stands alone
if next to nothing follows its first clause that is not stock; its opening is
then its longest clause.  The openings of such responses are
clustered by verified MinHash: distinct openings get band keys, each member of a
bucket is compared with the bucket's heads in order and becomes one if it is
alike to none; connected components of the verified links are the clusters.  A cluster is a refusal template by its use, whatever its words: it
recurs across prompts that have no subject in common, its members share most
of their words, take up little of the prompts and give no number or name of
their own.  Members of a template are refusals.  So is a response outside any
template that speaks of not answering in words of a fixed list, because a
refusal is a defect however rare it is; ``told_by`` says which way it was found.
Copy, language and termination checks label the remaining defects.

A response has the first defect that holds of: empty, copy, refusal,
other_language, truncated.  Defined results: responses to null questions are
sound, as are short ones; a null or blank answer is empty; repeated rows of a
query count once; tied openings are the same opening.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint
from .neardup import _mixed, _multipliers, components
from .unify import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

BANDS, ROWS, ALIKE = 24, 3, 0.5
#: Members of a bucket that one task compares; a larger bucket is taken in parts.
BUCKET = 20_000
#: A clause is stock, and a cluster recurs, if it stands on at least so many prompts and this share of all responses.
PROMPTS, STOCK_SHARE, SHARE = 3, 3e-4, 1e-4
#: At most so many words of its own may follow an opening.
REST = 3
#: Of a template: least words of a member (a shorter one may be a short answer), least share of them that half of the members hold, greatest share of its words that the prompts hold, least share of prompts that makes a word their common subject.
SAID, COHESION, TAKEN_UP, COMMON = 5, 0.5, 0.34, 0.5

WORD = re.compile(r"[^\W_]+")
CITATION = re.compile(r"\[\s*\d+(?:\s*[,;-]\s*\d+)*\s*\]")
SOURCES = re.compile(r"(?is)(?:^|\s)(?:sources?|quellen?|fuentes?|références?|references?)\s*:\s*(?:\[\s*\d+\s*\][\s,;]*)*$")

# Labels before an answer, courtesies around a refusal, and ways to say that there is no answer.
LABELS = "réponse|reponse|answer|antwort|respuesta|question|frage|pregunta|résumé|résultat|result|vous demandez|votre question|you ask|you asked|your question|sie fragen|ihre frage|usted pregunta|su pregunta"
LABEL = re.compile(rf"(?i)^[\s*_#>«\"'-]*(?:{LABELS})[\s*_]*:?[\s*_]*")
COURTESY = re.compile(
    r"(?i)désolé|je regrette|malheureusement|hélas|pour tout dire|après vérification|à ce stade|merci (de|pour) votre|toutefois|reformuler|réessayez|adressez-vous|contactez|puis-je vous aider|n'hésitez pas|excuse"
    r"|sorry|unfortunately|at this stage|thank you|please try|feel free|rephrase|can i help|apologi[sz]e|contact"
    r"|tut mir leid|leider|bitte|vielen dank|versuchen sie|umformulieren|neu formulieren|wenden sie sich|entschuldigung"
    r"|lo siento|por desgracia|lamentablemente|reformular|inténtelo|gracias por|disculpe|póngase en contacto"
)
REFUSAL = re.compile(
    r"(?i)\b(je (dois|préfère|souhaite) (décliner|m'abstenir|refuser|ne pas (répondre|me prononcer))|m'abstenir|impossible de (traiter|répondre|fournir|donner|produire)"
    r"|je ne (suis pas (en mesure|capable|autorisée?)|peux( pas)?|saurais|puis)( pas)? ((de|d'|à) ?)?(me prononcer|(vous )?(répondre|aider|renseigner|satisfaire)|traiter|donner|fournir (ce|cet|cette|d'|de réponse)|en dire)"
    r"|(sort|sortent|hors|dépasse) (de )?(mon|notre) (périmètre|domaine|champ|rôle)|ne relève pas de (ma|notre) compétence|laisse cette question à|(n'a|n'ai) pas le droit de (fournir|donner|répondre)"
    r"|trop (minces|lacunaires|insuffisants)|rien dans (mes|nos|les) sources|(documentation|base) ne contient rien|aucun(e)? (passage|document|résultat|élément|source|réponse)\b.{0,40}(permet|exploitable|pour|trouvée?|disponible)|n'a produit aucun"
    r"|a été interrompue?|a échoué|n'a pas (pu être|abouti)|erreur (interne|technique)"
    r"|(unable|not able|not allowed) to (help|answer|assist|respond|discuss|provide)|(can't|cannot|can not|could not|won't|will not|am not going to) (help|answer|assist|discuss|respond|comment|be (written|produced|generated|completed)|provide (an|this|that))"
    r"|outside (what|the scope|my)|leave this to|sources (say|contain|have|hold) nothing|nothing in my sources|prefer not to|(must|have to) decline|no usable (passage|source)|(generation|request|processing) (failed|was interrupted|timed out)"
    r"|nichts (dazu )?sagen|nicht beantworte[nt]|fehlen mir|keine (auskunft|antwort|angaben) (geben|möglich)|(kann|darf|möchte) ich (dazu |darauf |ihnen |hierzu )*(nichts|nicht|keine)|konnte nicht (erstellt|geschrieben|verfasst|erzeugt)|außerhalb meines|quellen (sagen|enthalten) nichts|wurde (abgebrochen|unterbrochen)|lehne .{0,30}ab"
    r"|no puedo (responder|contestar|ayudar|atender)|prefiero no|fuentes no (dicen|contienen) nada|no (se pudo|ha podido|me es posible)|fuera de mi|se interrumpió|ha fallado|dejo (esta|esa) pregunta|no tengo (fuentes|permiso))"
)
#: An opening that answers yes or no.
POLAR = re.compile(r"(?i)^[\W_]*(?:oui|non|si|yes|no|ja|nein|doch|sí)\s*[,.;:!–—-]")
# Frequent words of seven languages; one that several share counts in part for each.
LANGUAGE_WORDS = {
    "fr": "de dit fait font avant si le la les des du un une et est en pour dans sur au aux par avec sans que qui ce cette ne pas plus son sa ses leur il elle nous vous je ou où à été sont doit peut comme lors ainsi dès afin selon chez quels quelles quel quelle combien comment faut oui non jamais jours mois article l d qu s n c j y ans leurs quand lorsque puisque tant après avant sous entre",
    "en": "the of and to in is for on by with without that which this an be are must may as at from or its their when how what who why can not long yes no never days months it has have was were will should each any does do rules apply risks within under after before between whenever since although",
    "de": "der die das und ist im ein eine einen einem einer den dem des für mit ohne auf von zu zur zum nicht wie was wer darf muss kann wird werden sich als bei nach vor aus wenn dass sowie über unter zwischen ja nein nie tage tagen monate monaten obwohl damit welche wissen aufbewahren lange durch um gegen jeden jeder jede am beim vom sind hat wurde",
    "es": "el los las del una y en para con sin que por su sus al se es son debe puede como no sí más cuánto qué cuándo cuál cómo lo un de desde entre hasta según tras antes sobre nunca días meses tiempo quién cada cuando aunque porque ya muy fue está está esta este ante bajo durante",
    "it": "il lo gli la le un una di del della dei delle degli e è in nel nella per con su sul sulla da dal dalla che non si sono come più anche questo questa quando quanto quali chi cosa deve può essere ha hanno suo sua loro prima dopo entro senza tra ogni giorni mesi ma perché ai alle al alla",
    "pt": "o os a as um uma do da dos das de e é em no na nos nas para por com sem que não se são como mais também este esta quando quanto quais quem deve pode ser tem seu sua pelo pela antes após sobre entre cada dias meses mas porque ao aos à às foi",
    "nl": "de het een en van in is op te met voor niet dat die zijn aan bij door om naar uit als ook maar worden wordt deze dit hoe wat wie moet kan mag welke tussen na voordat zonder elke dagen maanden heeft hebben wel geen nog",
}
WEIGHTS: dict[str, dict[str, float]] = {}
for _language, _words in LANGUAGE_WORDS.items():
    for _word in set(_words.split()):
        WEIGHTS.setdefault(_word, {})[_language] = 1.0
for _shares in WEIGHTS.values():
    for _language in _shares:
        _shares[_language] = 1.0 / len(_shares)

_ALIKE = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
#: Text of these characters only is in its plain form already, blanks aside.
_USUAL = re.compile(r"[\n -~¡-¬®-³µ¶¹»-ſ–—“”…€]*")


def plain(text: str) -> str:
    """Comparable form: compatibility forms, invisible characters and look-alikes mapped, blanks within lines as one."""
    if not text.isascii() and not _USUAL.fullmatch(text):
        text = unicodedata.normalize("NFKC", text.replace(" ", " "))
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
        text = WORD.sub(lambda m: m[0].translate(_ALIKE) if re.search(r"[a-zA-Z]", m[0]) else m[0], text)
        text = text.replace("‐", "-").replace("’", "'")
    return "\n".join(" ".join(line.split()) for line in text.split("\n")).strip()


def _language_scores(text: str) -> tuple[Counter[str], int]:
    """Score of each language, and the number of words."""
    lower = text.lower()
    words = WORD.findall(lower)
    score: Counter[str] = Counter()
    for word in filter(WEIGHTS.__contains__, words):
        for name, share in WEIGHTS[word].items():
            score[name] += share
    score["de"] += 0.5 * len(re.findall(r"ß|\b\w*(?:ung|keit|heit|schutz)\b", lower))
    score["es"] += 1.0 * len(re.findall(r"[¿¡ñ]|\w+(?:ción|dad)\b", lower))
    return score, max(1, len(words))


def language(text: str) -> tuple[str | None, float]:
    """The likeliest language and its lead over the next as a share of the words; None where nothing tells."""
    score, words = _language_scores(text)
    ranked = [*score.most_common(2), ("", 0.0)]
    return (ranked[0][0], (ranked[0][1] - ranked[1][1]) / words) if ranked[0][1] > 0 else (None, 0.0)


def likely_languages(text: str) -> set[str]:
    """The languages that come near the likeliest one; none where nothing tells."""
    score, words = _language_scores(text)
    best = max(score.values(), default=0.0)
    return {name for name, x in score.items() if best > 0 and x >= best - 0.03 * words}


def is_empty(answer: str) -> bool:
    """Nothing but blanks, marks, a label or source numbers."""
    rest = LABEL.sub("", CITATION.sub("", answer))
    rest = re.sub(r"(?i)^(sources?|quellen?|fuentes?)\s*:?", "", rest.strip())
    return not any(c.isalnum() for c in rest)


def is_copy(question: str, answer: str) -> bool:
    """Only the question, once or again, with labels, quotes, other case or blanks."""
    asked = WORD.findall(question.lower())
    said = WORD.findall(LABEL.sub("", CITATION.sub("", answer)).lower())
    if not asked or len(said) < min(len(asked), 2):
        return False
    rest, k, times = [], 0, 0
    while k < len(said):
        if said[k : k + len(asked)] == asked:
            k, times = k + len(asked), times + 1
        else:
            rest.append(said[k])
            k += 1
    if times:
        return len(rest) == 0 or (len(rest) <= 3 and bool(LABEL.match(" ".join(rest) + " ")))
    common = sum((Counter(asked) & Counter(said)).values())
    return len(asked) >= 4 and common >= 0.9 * max(len(asked), len(said))


def is_truncated(answer: str) -> bool:
    """Stops inside a word or sentence; lists, tables, links, sources and short answers may stop without a mark."""
    text = answer.rstrip()
    while (shorter := SOURCES.sub("", CITATION.sub("", text[-60:]) if text.endswith("]") else text[-60:])) != text[-60:]:
        text = (text[:-60] + shorter).rstrip()
    last = text.rsplit("\n", 1)[-1].strip()
    if not last:
        return False
    if text.count("**") % 2 or re.fullmatch(r"[-*•–\d.)]{1,3}", last) or last[-1] in "[(«":
        return True
    if re.search(r"(…|\.\.\.)[\"'»)\]*]*$", last):
        return True
    if re.search(r"(?i)(?:^|[\s(])(?:cf|art|nr|vgl|z\.\s?b|e\.g|i\.e)\.$", last):
        return True
    if re.search(r"[.!?。！？][\"'»”’)\]*\s]*$", last) or last[-1] in "|»":
        return False
    if re.match(r"(?:[-*•–◦]|\d{1,3}[.)])\s+\S", last) or re.match(r"(?:https?://|www\.)\S|[^\s@]+@[^\s@]+\.\w+$", last.rsplit(None, 1)[-1]):
        return last[-1] in ",:;"
    if not any(c.isalnum() for c in last[-2:]) and last[-1] not in ",:;-–—/":
        return False
    return len(WORD.findall(text)) > 4 or last[-1] in ",:;-–—/"


def sentences(answer: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", CITATION.sub("", answer)) if any(c.isalnum() for c in s)]


def speaks_of_refusal(answer: str) -> bool:
    """Whether an answer speaks of not answering and, courtesies aside, says next to nothing else: before it in other sentences, or after it in any clause."""
    telling, rest = False, 0
    for sentence in sentences(answer):
        speaks = REFUSAL.search(sentence)
        if not speaks and COURTESY.search(sentence):
            continue
        after = re.split(r"[,;:()]+", sentence[speaks.end() :])[1:] if speaks else [sentence]
        rest += sum(len(WORD.findall(c)) for c in after if not COURTESY.search(c))
        if rest > REST:
            return False
        telling = telling or bool(speaks)
    return telling


def clauses(answer: str) -> list[str]:
    """The clauses of an answer, as their words in order."""
    found = (" ".join(WORD.findall(c)) for c in re.split(r"[.,;:!?()\n–—]+", CITATION.sub("", answer)))
    return [c for c in found if c]


def opening_key(opening: str) -> str:
    """Numbers and names aside, what the opening says."""
    words = [("0" if w.isdigit() else "_" if k and w[0].isupper() else w.lower()) for k, w in enumerate(opening.split())]
    return " ".join(words)


def subjects(asked: str) -> list[str]:
    """Words of a prompt that are not among the frequent ones of a language."""
    return sorted({w for w in WORD.findall(asked.lower()) if w not in WEIGHTS})


def own_values(asked: list[str], opening: str) -> list[str]:
    """Numbers and names of an opening that its prompt, given by its subjects, lacks."""
    known = set(asked)
    return sorted({w.lower() for k, w in enumerate(opening.split()) if (any(c.isdigit() for c in w) or (k and w[0].isupper())) and w.lower() not in known})


def taken_up(asked: list[str], opening: str) -> float:
    """Share of the words of an opening, frequent ones aside, that are among the subjects of its prompt."""
    said = subjects(opening)
    return len(set(said) & set(asked)) / len(said) if said else 0.0


def _shingles(key: str) -> np.ndarray:
    words = key.split()
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64))


ASSESSED = "query_id string, defect string, prompt_id long, telling boolean, polar boolean, subjects array<string>, clauses array<string>"


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def assess(responses: DataFrame) -> DataFrame:
    """Each response once with the checks that need nothing but itself, and its clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, question, answer in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                asked, said = plain(question), plain(answer or "")
                defect, telling, parts = None, False, []
                if is_empty(said):
                    defect = "empty"
                elif is_copy(asked, said):
                    defect = "copy"
                else:
                    telling, parts = speaks_of_refusal(said), clauses(said)
                    (said_in, lead), asked_in = language(said), likely_languages(asked)
                    if said_in and asked_in and said_in not in asked_in and lead >= 0.08:
                        defect = "other_language"
                    elif is_truncated(said):
                        defect = "truncated"
                rows.append((query, defect, _signed(" ".join(WORD.findall(asked.lower()))), telling, bool(POLAR.match(said)), subjects(asked), parts))
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ASSESSED.split(", ")])

    asked = responses.select("query_id", "question", "answer").where("question IS NOT NULL AND query_id IS NOT NULL")
    return asked.dropDuplicates(["query_id"]).mapInArrow(run, ASSESSED)


def standing_alone(assessed: DataFrame) -> DataFrame:
    """(query_id, prompt_id, subjects, opening, said) of the responses whose first clause of their own is followed by stock only.

    ``opening`` is the longest clause (the first of tied ones), left out where it is stock that mostly stands in other answers; ``said`` counts the words of the response.
    """
    own = assessed.where("clauses IS NOT NULL AND size(clauses) > 0 AND NOT polar")
    parts = own.select("query_id", "prompt_id", F.posexplode("clauses").alias("pos", "clause")).withColumn("h", F.xxhash64(F.regexp_replace(F.lower("clause"), "\\p{Nd}+", "0"))).withColumn("w", F.size(F.split("clause", " ")))
    total = F.broadcast(assessed.agg(F.count("*").alias("total")))
    on_prompts = parts.select("h", "prompt_id").distinct().groupBy("h").agg(F.count("*").alias("n"))
    # A stock clause holds a fixed share of the responses, so their number is bounded whatever the size of the table.
    stock = broadcast_if_small(on_prompts.join(total).where((F.col("n") >= PROMPTS) & (F.col("n") >= F.col("total") * F.lit(STOCK_SHARE))).select("h", "n"))
    free = F.col("n").isNull()
    marked = parts.join(stock, "h", "left")
    told = marked.groupBy("query_id").agg(
        F.min(F.when(free, F.struct("pos", "w"))).alias("first"), F.max(F.struct("w", -F.col("pos"), "clause", F.when(~free, F.col("h")).alias("h"))).alias("longest"), F.sum("w").alias("said"), F.coalesce(F.sum(F.when(free, F.col("w"))), F.lit(0)).alias("free")
    )
    alone = checkpoint(told.where(F.col("free") - F.coalesce("first.w", F.lit(0)) <= REST).select("query_id", F.col("longest.clause").alias("opening"), "longest.h", F.col("said").cast("int").alias("said")))
    # Stock that mostly stands in other answers is an addition to them and no opening.
    kept = marked.where(~free).join(alone.select("query_id").hint("merge"), "query_id", "left_semi").select("h", "n", "prompt_id").distinct().groupBy("h", "n").agg(F.count("*").alias("k"))
    added = alone.where("h IS NOT NULL").join(broadcast_if_small(kept.where("k * 2 >= n").select("h")), "h", "left_anti").select("query_id")
    return own.select("query_id", "prompt_id", "subjects").join(alone.hint("merge"), "query_id").join(added.hint("merge"), "query_id", "left_anti").drop("h")


def _described(alone: DataFrame) -> DataFrame:
    """The rows of ``standing_alone`` with the key, words and values of their openings and the share of their words that the prompt holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asked, opening in zip(batch.column("subjects").to_pylist(), batch.column("opening").to_pylist(), strict=True):
                key = opening_key(opening)
                rows.append((_signed(key), key, sorted(set(key.split())), taken_up(asked, opening), own_values(asked, opening)))
            types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.list_(pa.string())]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            names = ["opening_id", "opening", "words", "taken_up", "values"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "prompt_id", "said", "subjects")), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["query_id", "prompt_id", "said", "subjects", *names])

    kept = alone.select("query_id", "prompt_id", "said", "subjects", "opening")
    return kept.mapInArrow(run, "query_id string, prompt_id long, said int, subjects array<string>, opening_id long, opening string, words array<string>, taken_up double, values array<string>")


def _bands(openings: DataFrame) -> DataFrame:
    """(opening_id, opening, band): band keys of each distinct opening."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(BANDS * ROWS)
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = []
                for opening in batch.column(1).to_pylist():
                    least = (_shingles(opening)[:, None] * multipliers).min(axis=0)
                    keys.append([int(xxhash.xxh3_64_intdigest(bytes([b]) + _mixed(least[b * ROWS : (b + 1) * ROWS]).tobytes())) - (1 << 63) for b in range(BANDS)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["opening_id", "opening", "bands"])

    return openings.mapInArrow(run, "opening_id long, opening string, bands array<long>").select("opening_id", "opening", F.explode("bands").alias("band"))


class _Heads:
    """The heads of one bucket, found by the shingles they hold."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.sizes = array("i")
        self.holders: dict[int, array[int]] = {}

    def alike(self, shingles: np.ndarray) -> int | None:
        """The first head alike to the shingles."""
        held = [np.frombuffer(self.holders[x], np.int32) for x in shingles.tolist() if x in self.holders]
        if not held:
            return None
        common = np.bincount(np.concatenate(held), minlength=len(self.ids))
        fits = common >= ALIKE * (len(shingles) + np.frombuffer(self.sizes, np.int32) - common)
        first = int(fits.argmax())
        return self.ids[first] if fits[first] else None

    def add(self, opening_id: int, shingles: np.ndarray) -> None:
        for x in shingles.tolist():
            self.holders.setdefault(x, array("i")).append(len(self.ids))
        self.ids.append(opening_id)
        self.sizes.append(len(shingles))


def _headed(members: DataFrame) -> DataFrame:
    """(band, opening_id, opening, head) of (band, part, opening_id, opening): each member with the least head alike to it within its part of a bucket.

    A member alike to none is a head itself; it has a null ``head`` and comes out
    only where the bucket has parts (``part`` is not null).  Members come in order, and a
    task keeps the heads of one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, alone = None, _Heads(), None
        for batch in batches:
            rows = []
            for band, part, opening_id, opening in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (band, part) != group:
                    # Most buckets have one member, which needs no shingles.
                    group, heads, alone = (band, part), _Heads(), (opening_id, opening)
                    if part is not None:
                        rows.append((band, opening_id, opening, None))
                    continue
                if alone:
                    heads.add(alone[0], _shingles(alone[1]))
                    alone = None
                shingles = _shingles(opening)
                head = heads.alike(shingles)
                if head is None:
                    heads.add(opening_id, shingles)
                if head is not None or part is not None:
                    rows.append((band, opening_id, None if head is not None else opening, head))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["band", "opening_id", "opening", "head"])

    placed = members.select("band", "part", "opening_id", "opening").repartition("band", "part").sortWithinPartitions("band", "part", "opening_id")
    return placed.mapInArrow(run, "band long, opening_id long, opening string, head long")


def _links(bands: DataFrame, most: int = BUCKET) -> DataFrame:
    """(a, b): each member of a bucket and the head it is alike to; a bucket of more than ``most`` members is taken in parts, then the heads of its parts."""
    sizes = checkpoint(bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if sizes.isEmpty():
        return checkpoint(_headed(bands.withColumn("part", F.lit(None).cast("long")))).select(F.col("opening_id").alias("a"), F.col("head").alias("b"))
    parts = broadcast_if_small(sizes.select("band", F.ceil(F.col("n") / most).alias("parts")))
    found = checkpoint(_headed(bands.join(parts, "band", "left").withColumn("part", F.expr("pmod(xxhash64(opening_id), parts)"))))
    again = checkpoint(_headed(found.where("head IS NULL").withColumn("part", F.lit(None).cast("long"))))
    return found.where("head IS NOT NULL").unionByName(again).select(F.col("opening_id").alias("a"), F.col("head").alias("b"))


def opening_clusters(described: DataFrame) -> DataFrame:
    """(opening_id, cluster) of the distinct openings; one that is alike to none is its own cluster and left out.

    The least member of a bucket is its first head; each further one, in order,
    is linked to the first head alike to it or becomes a head.  That is one pass
    over the sorted buckets, so the number of jobs does not grow with the heads.
    """
    openings = checkpoint(described.groupBy("opening_id").agg(F.first("opening").alias("opening")))
    return components(_links(checkpoint(_bands(openings)))).toDF("opening_id", "cluster")


def templates(assessed: DataFrame) -> DataFrame:
    """(query_id) of the responses made of a refusal template: members of recurring clusters that say the same, without values of their own, to prompts of no common subject."""
    described = checkpoint(_described(standing_alone(assessed)))
    placed = described.join(opening_clusters(described).hint("merge"), "opening_id", "left").withColumn("cluster", F.coalesce("cluster", "opening_id"))
    total = F.broadcast(assessed.agg(F.count("*").alias("total")))
    per_prompt = placed.groupBy("cluster", "prompt_id").agg(F.count("*").alias("n"), F.count_if(F.col("taken_up") <= TAKEN_UP).alias("apart"))
    found = per_prompt.groupBy("cluster").agg(F.count("*").alias("prompts"), F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    recurring = checkpoint(found.join(total).where((F.col("prompts") >= PROMPTS) & (F.col("prompts") >= F.col("total") * F.lit(SHARE)) & (F.col("apart") * 2 >= F.col("n"))).select("cluster", "prompts", "n"))
    rows = checkpoint(placed.join(recurring.hint("merge"), "cluster"))
    held = lambda column, by: rows.select("cluster", "prompts", "n", by, F.explode(column).alias("word")).groupBy("cluster", "prompts", "n", "word").agg(F.countDistinct(by).alias("k"))
    related = held("subjects", "prompt_id").where(F.col("k") > COMMON * F.col("prompts")).select("cluster").distinct()
    # A number or name that half of the prompts get belongs to the template, e.g. a noun in German.
    fixed = held("values", "prompt_id").where(F.col("k") * 2 >= F.col("prompts")).select("cluster", "word")
    own = rows.select("cluster", "n", "query_id", F.explode("values").alias("word")).join(fixed.hint("merge"), ["cluster", "word"], "left_anti")
    valued = own.groupBy("cluster", "n").agg(F.countDistinct("query_id").alias("k")).where("k * 2 >= n").select("cluster")
    shared = held("words", "query_id").where(F.col("k") * 2 >= F.col("n")).groupBy("cluster").agg(F.collect_set("word").alias("shared"))
    members = rows.join(shared.hint("merge"), "cluster").withColumn("common", F.size(F.array_intersect("words", "shared")) / F.size("words"))
    loose = members.groupBy("cluster").agg(F.avg("common").alias("cohesion")).where(F.col("cohesion") >= COHESION).select("cluster")
    kept = loose.join(related.hint("merge"), "cluster", "left_anti").join(valued.hint("merge"), "cluster", "left_anti")
    return rows.where(F.col("said") >= SAID).join(kept.hint("merge"), "cluster", "left_semi").select("query_id").distinct()


def assessed_defects(responses: DataFrame) -> DataFrame:
    """(query_id, defect_type, told_by): one row for each defective response; ``told_by`` is template, list or check."""
    assessed = checkpoint(assess(responses))
    known = templates(assessed).withColumn("template", F.lit(True))
    told = F.when(F.col("defect").isin("empty", "copy"), "check").when(F.col("template"), "template").when(F.col("telling"), "list").when(F.col("defect").isNotNull(), "check")
    kind = F.when(told == "check", F.col("defect")).when(told.isNotNull(), "refusal")
    return assessed.join(known.hint("merge"), "query_id", "left").select("query_id", kind.alias("defect_type"), told.alias("told_by")).where("defect_type IS NOT NULL")


def defects(responses: DataFrame) -> DataFrame:
    """(query_id, defect_type): one row for each defective response."""
    return assessed_defects(responses).select("query_id", "defect_type")
