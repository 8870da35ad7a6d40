"""Answers as rows: citations, grounding, cleaning, parsing and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X

CITED = r"\[Source\s+(\d+)\]"


def cited_ids(answer: Column, pattern: str = CITED) -> Column:
    """Ids in order of first appearance; empty for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))


def renumbered(answer: Column) -> Column:
    """Citations numbered by first appearance; placeholders keep a number from being replaced twice."""
    ids = cited_ids(answer)
    marked = F.aggregate(ids, answer, lambda text, x: F.replace(text, F.concat(F.lit("[Source "), x.cast("string"), F.lit("]")), F.concat(F.lit("[\u0001"), F.array_position(ids, x).cast("string"), F.lit("]"))))
    return F.replace(marked, F.lit("[\u0001"), F.lit("[Source "))


def without_invented(answer: Column, available: Column) -> Column:
    """Citations of unknown ids removed and runs of blanks squeezed."""
    invented = F.array_except(cited_ids(answer, r"\[Source (\d+)\]"), available)
    cleaned = F.aggregate(invented, answer, lambda text, x: F.replace(text, F.concat(F.lit("[Source "), x.cast("string"), F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(cleaned, " {2,}", " "))


def unsupported(answer: Column, context: Column) -> Column:
    """Amounts, articles and dates of the answer that the context lacks."""
    text, known = F.lower(answer), F.lower(F.coalesce(context, F.lit("")))
    months = "|".join(vocab.MONTHS)
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d ]*)(?:millions? |milliards? )?(?:d'euros?|€)"), F.lit(1)), lambda x: F.trim(x))
    articles = F.regexp_extract_all(text, F.lit(r"(?:article|art\.?)\s+(\d+(?:[.\-]\d+)?)"), F.lit(1))
    dates = F.regexp_extract_all(text, F.lit(rf"(\d{{1,2}}\s+(?:{months})\s+\d{{4}})"), F.lit(1))
    missing = lambda found, keep: F.filter(found, lambda x: ~F.contains(known, x) & keep(x))
    return F.concat(
        F.transform(missing(amounts, lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("amount "), x)),
        F.transform(missing(articles, lambda x: F.lit(True)), lambda x: F.concat(F.lit("article "), x)),
        F.transform(missing(dates, lambda x: ~x.isin(vocab.KNOWN_DATES)), lambda x: F.concat(F.lit("date "), x)),
    )


def issues(answer: Column, available: Column, context: Column) -> Column:
    """Names of the grounding checks that the answer fails."""
    lower = F.lower(answer)
    tests = {
        "no_citation": ~F.contains(answer, F.lit("Source ")),
        "invented": F.size(F.array_except(cited_ids(answer), available)) > 0,
        "short": F.length(F.trim(answer)) < 50,
        "evasive": X.any_of(lower, vocab.EVASIVE),
        "unsupported": F.size(unsupported(answer, context)) > 0,
    }
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())


def grounding_score(found: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.size(found) * 0.25)


def without_sources(answer: Column) -> Column:
    """Answer without a closing section of sources."""
    closing = r"(?is)\s+(sources|références|liste des sources|fuentes|quellen)\s*:\s*(\[?\d+\]?[\s,]*)*$"
    return F.regexp_replace(F.regexp_replace(answer, closing, ""), X.SPACE + "+$", "")


def polished(answer: Column, proposal: Column) -> Column:
    """The proposal unless it is too short, loses a citation or grows beyond 1.8 times or 500 characters."""
    grown = F.length(proposal) > F.least(F.length(answer) * 1.8, F.length(answer) + 500)
    lost = F.size(F.array_except(cited_ids(answer), cited_ids(proposal))) > 0
    return F.when(proposal.isNull() | (F.length(proposal) < 50) | lost | grown, answer).otherwise(proposal)


def normalised(text: Column) -> Column:
    """Lower case, white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), X.SPACE + "+", " "))


def digits_for_words(text: Column) -> Column:
    """Number words replaced by their digits, word by word."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(X.one_of(w, vocab.NUMBER_WORDS), w)), " ")


def variants(word: Column) -> Column:
    """A word with its plural and gender forms."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    forms = [
        word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.when(F.endswith(word, F.lit("es")) & (F.length(word) > 3), cut(2)), F.when(F.endswith(word, F.lit("s")) & (F.length(word) > 2), cut(1)),
        F.when(F.endswith(word, F.lit("é")), F.concat(word, F.lit("e"))), F.when(F.endswith(word, F.lit("ée")), cut(1)), F.when(F.endswith(word, F.lit("ées")), cut(2)), F.when(F.endswith(word, F.lit("ées")), cut(3)),
    ]
    return F.filter(F.array(*forms), lambda x: x.isNotNull())


def matches(item: Column, answer: Column) -> Column:
    """Item in a normalised answer: as it is, with digits for number words, or all of several words in some form as whole words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(answer, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    parts = F.split(item, " ")
    loose = (F.size(parts) >= 2) & F.forall(parts, lambda w: F.exists(variants(w), lambda v: F.contains(padded, F.concat(F.lit(" "), v, F.lit(" ")))))
    return F.contains(answer, item) | F.contains(digits_for_words(answer), digits_for_words(item)) | loose


def matches_any(item: Column, answer: Column) -> Column:
    """Any of the alternatives of ``a|b|c``."""
    return F.exists(F.split(item, r"\|"), lambda x: matches(normalised(x), answer))


def included(items: Column, answer: Column) -> Column:
    """Share of the items found; 1 where none is asked for."""
    return F.when(F.size(items) == 0, 1.0).otherwise(F.size(F.filter(items, lambda x: matches_any(x, answer))) / F.size(items))


def absent(items: Column, answer: Column) -> Column:
    """Share of the items that do not occur; 1 where none is forbidden."""
    return F.when(F.size(items) == 0, 1.0).otherwise(1 - F.size(F.filter(items, lambda x: F.contains(answer, normalised(x)))) / F.size(items))


def conciseness(n_words: Column, category: Column, intent: Column) -> Column:
    """1 up to the ideal length, then down to 0.7 and 0.4, 0.3 beyond; limits by category, stretched by intent and cut to whole words."""
    factor = F.coalesce(X.one_of(intent, {k: F.lit(v) for k, v in vocab.INTENT_FACTORS.items()}), F.lit(1.0))
    limit = [F.floor(F.coalesce(X.one_of(category, {k: F.lit(v[n]) for k, v in vocab.LENGTHS.items()}), F.lit(vocab.DEFAULT_LENGTHS[n])) * factor) for n in range(3)]
    ideal, soft, hard = limit
    down = lambda top, start, end: top - 0.3 * (n_words - start) / (end - start)
    return F.when(n_words <= ideal, 1.0).when(n_words <= soft, down(F.lit(1.0), ideal, soft)).when(n_words <= hard, down(F.lit(0.7), soft, hard)).otherwise(0.3)


def source_quality(answer: Column, refusal: Column) -> Column:
    """Half without citations (full for refusals), 0.3 with an id above 12, else full."""
    ids = cited_ids(answer, r"\[Source\s*(\d+)\]")
    return F.when(F.size(ids) == 0, F.when(refusal, 1.0).otherwise(0.5)).when(F.array_max(ids) > 12, 0.3).otherwise(1.0)


def parsed_tags(raw: Column, most: int = 3) -> Column:
    """Tags of an answer: prefix dropped, last line with separators (else the last), lower case, 3 to 60 characters, distinct."""
    bare = F.regexp_replace(F.trim(raw), r"(?i)^\[TAGS\]\s*", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.filter(lines, lambda x: x.rlike("[,;]") & (F.length(x) < 200))
    line = F.coalesce(F.when(F.size(lines) == 1, F.get(lines, F.lit(0))), F.get(listed, F.size(listed) - 1), F.get(lines, F.size(lines) - 1), F.lit(""))
    tags = F.transform(F.split(line, "[,;]"), lambda t: F.regexp_replace(F.lower(F.trim(t)), "[.;:!?]+$", ""))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: F.length(t).between(3, 60))), 1, most)


def parsed_questions(raw: Column, most: int = 3) -> Column:
    """Numbered reformulations: markers dropped, at least 10 characters, no chatter, free lines only if they look like questions."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(x.alias("line"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^\d+[.)]\s*", ""), r"^[-•]\s*", "")).alias("clean")))
    asks = ["?", "comment", "quel", "quoi", "quand", "où", "pourquoi", "obligation", "droit", "donnée"]
    good = F.filter(pairs, lambda x: (F.length(x["clean"]) >= 10) & ~F.lower(x["clean"]).rlike("^(voici|bien sûr|note|explication)") & ((x["clean"] != x["line"]) | X.any_of(x["clean"], asks)))
    return F.slice(F.transform(good, lambda x: x["clean"]), 1, most)


def outer_json(raw: Column) -> Column:
    """Text of the fenced object, else of the outermost braces, trailing commas dropped; null without braces."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, outer), r",\s*([}\]])", "$1")


def expanded(query: Column, acronyms: dict[str, str] = vocab.ACRONYMS) -> Column:
    """Query with the expansion after the first occurrence of each known acronym that is one of its words (case matters)."""
    found = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"'-]+|[.,;:!?()\[\]{}\"'-]+$", ""))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in acronyms.items()))

    def add(text: Column, entry: Column) -> Column:
        k, v = entry["k"], entry["v"]
        spaced = F.concat(F.lit(" "), k, F.lit(" "))
        at = F.position(spaced, text)
        inserted = F.when(at > 0, F.overlay(text, F.concat(spaced, v, F.lit(" ")), at, F.length(spaced))).otherwise(text)
        leading = F.when(F.startswith(inserted, k), F.concat(k, F.lit(" "), v, F.lit(" "), F.ltrim(F.substr(inserted, F.length(k) + 1)))).otherwise(inserted)
        return F.when(F.array_contains(found, k) & ~F.contains(text, v), leading).otherwise(text)

    return F.aggregate(entries, query, add)


def sections(text: Column, n: int) -> Column:
    """Bodies under ``###`` headings, padded with empty ones or cut to n; the whole text n times where there are fewer than two."""
    parts = F.transform(F.slice(F.split(text, r"(?:^|\n)###[^\n]*"), 2, 1000), lambda x: F.regexp_replace(x, f"^{X.SPACE}+|{X.SPACE}+$", ""))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)
    return F.when(F.size(parts) < 2, F.array_repeat(text, n)).otherwise(padded)
