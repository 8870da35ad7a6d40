"""One consistent form for text that looks the same (problem 6).

DuckDB runs inside the Arrow partitions: every batch is registered as a table
and one SQL statement maps compatibility forms, invisible characters, spaces,
combining accents and look-alike letters with ``translate``,
``regexp_replace`` and ``nfc_normalize``.

Defined results: a null text stays null and an empty one empty; tabs and line
ends stay; raised letters and digits, fractions, dashes, bullets, typographic
quotes and emoji (with their joiners and selectors) stay; a word wholly in one
script stays; a word that mixes Latin with Greek or Cyrillic look-alikes gets
the letters of the script in which it has letters of its own, Latin if in
doubt.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alike capitals and small letters, Cyrillic and Greek against Latin.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxdqwhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικυραϲϳγ"
GREEK_AS = "ABEZHIKMNOPTYXovikupacjy"

# Spaces that are not the ordinary one, and hyphens that are not the ASCII one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2800"
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Characters that show nothing (RE2 class body); joiners and selectors are treated apart, as emoji need them.
INVISIBLE = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFFB}\x{1D173}-\x{1D17A}"

# Private characters that mark what is set aside, each with what stands for it where the text holds it already.
ESCAPES = [("\ue00e", "\ue00e\ue010"), ("\ue00d", "\ue00e\ue011"), ("\ue00f", "\ue00e\ue012"), ("\ue013", "\ue00e\ue014")]
# Scripts whose words are spelt with joiners and non-joiners (RE2 class body).
JOINING = r"\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Mongolian}"


def _plain_forms() -> tuple[str, str]:
    """Letters and digits with a compatibility form of one character: wide and mathematical ones."""
    wide = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
    maths = [*range(0x2100, 0x2140), *range(0x1D400, 0x1D800)]
    pairs = {}
    for point in wide + maths:
        char = chr(point)
        plain = unicodedata.normalize("NFKC", char)
        if unicodedata.decomposition(char).startswith(("<wide>", "<font>")) and len(plain) == 1 and plain.isalnum():
            pairs[char] = plain
    return "".join(pairs), "".join(pairs.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def statement(table: str = "batch") -> str:
    """The SQL that adds ``clean`` to (record_type, record_id, text)."""
    odd, plain = _plain_forms()
    ligatures = ["ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ"]
    mapped = f"translate(text, {_quoted(SPACES + HYPHENS + odd)}, {_quoted(' ' * len(SPACES) + '-' * len(HYPHENS) + plain)})"
    for ligature in ligatures:
        mapped = f"replace({mapped}, {_quoted(ligature)}, {_quoted(unicodedata.normalize('NFKC', ligature))})"
    # An emoji keeps its joiner and selectors, a word of a script that spells with joiners keeps them: they are set aside
    # as private characters, the rest is dropped.  Private characters of the text itself are escaped meanwhile.
    for char, escape in ESCAPES:
        mapped = f"replace({mapped}, '{char}', '{escape}')"
    shown = f"regexp_replace({mapped}, '([{JOINING}\\p{{M}}])\\x{{200C}}([{JOINING}])', '\\1\ue013\\2', 'g')"
    shown = f"regexp_replace({shown}, '([{JOINING}\\p{{M}}])\\x{{200D}}([{JOINING}])', '\\1\ue00d\\2', 'g')"
    shown = f"regexp_replace({shown}, '([\\p{{So}}\\x{{1F3FB}}-\\x{{1F3FF}}#*0-9])\\x{{FE0F}}', '\\1\ue00f', 'g')"
    shown = f"regexp_replace({shown}, '([\\p{{So}}\\x{{1F3FB}}-\\x{{1F3FF}}\ue00f])\\x{{200D}}([\\p{{So}}])', '\\1\ue00d\\2', 'g')"
    shown = f"regexp_replace({shown}, '[{INVISIBLE}\\x{{200D}}\\x{{FE00}}-\\x{{FE0F}}]+', '', 'g')"
    shown = f"translate({shown}, '\ue00f\ue00d\ue013', '\ufe0f\u200d\u200c')"
    for char, escape in reversed(ESCAPES):
        shown = f"replace({shown}, '{escape}', '{char}')"
    joined = f"nfc_normalize({shown})"
    own_cyrillic = f"regexp_matches(translate(w, {_quoted(CYRILLIC)}, ''), '\\p{{Cyrillic}}')"
    own_greek = f"regexp_matches(translate(w, {_quoted(GREEK)}, ''), '\\p{{Greek}}')"
    own_latin_c = f"regexp_matches(translate(w, {_quoted(CYRILLIC_AS)}, ''), '\\p{{Latin}}')"
    own_latin_g = f"regexp_matches(translate(w, {_quoted(GREEK_AS)}, ''), '\\p{{Latin}}')"
    word = f"""CASE
        WHEN NOT regexp_matches(w, '[\\p{{Cyrillic}}\\p{{Greek}}]') OR NOT regexp_matches(w, '\\p{{Latin}}') THEN w
        WHEN {own_cyrillic} AND NOT {own_latin_c} THEN translate(w, {_quoted(CYRILLIC_AS)}, {_quoted(CYRILLIC)})
        WHEN {own_greek} AND NOT {own_latin_g} THEN translate(w, {_quoted(GREEK_AS)}, {_quoted(GREEK)})
        ELSE translate(w, {_quoted(CYRILLIC + GREEK)}, {_quoted(CYRILLIC_AS + GREEK_AS)}) END"""
    worded = f"array_to_string(list_transform(regexp_extract_all(joined, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), '')"
    # The cheap test comes first: most texts hold no character that could need a change.
    usual = "^[\\t\\n\\r -~\\x{A0}-\\x{AC}\\x{AE}-\\x{17F}\\x{2013}\\x{2014}\\x{2018}-\\x{2026}\\x{20AC}\\x{2122}]*$"
    return f"""
        WITH odd AS (SELECT record_type, record_id, text, text IS NULL OR (regexp_matches(text, '{usual}') AND NOT contains(text, '\u00a0')) AS plain FROM {table}),
        shown AS (SELECT *, CASE WHEN plain THEN text ELSE {joined} END AS joined FROM odd)
        SELECT record_type, record_id, text, CASE WHEN plain OR NOT regexp_matches(joined, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN joined ELSE {worded} END AS clean FROM shown"""


def unify(records: DataFrame, changed_only: bool = False) -> DataFrame:
    """(record_type, record_id, clean, changed) of (record_type, record_id, text)."""
    sql = statement()
    body = f"SELECT record_type, record_id, clean, clean IS DISTINCT FROM text AS changed FROM ({sql})"
    if changed_only:
        body = f"SELECT record_type, record_id, NULL::VARCHAR AS clean, true AS changed FROM ({sql}) WHERE clean IS DISTINCT FROM text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        for batch in batches:
            base.register("batch", pa.Table.from_batches([batch]))
            found = base.sql(body).to_arrow_table()
            base.unregister("batch")
            schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("clean", pa.string()), ("changed", pa.bool_())])
            yield from found.cast(schema).to_batches()

    return records.select("record_type", "record_id", "text").mapInArrow(run, "record_type string, record_id string, clean string, changed boolean")


def corpus_records(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunk texts and answers as one table (record_type, record_id, text)."""
    return chunks.select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("record_id"), "text").unionByName(
        responses.select(F.lit("answer").alias("record_type"), F.col("query_id").alias("record_id"), F.col("answer").alias("text"))
    )
