"""Catalyst expressions for text, URLs, tokens and vectors; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

#: White space of any width for Java patterns.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def total(parts: list[Column]) -> Column:
    """Sum of columns; literal 0 for none."""
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def words(text: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def holds(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, case ignored for all letters."""
    return text.rlike(f"(?iu){pattern}")


def any_of(text: Column, phrases: list[str]) -> Column:
    return either([F.contains(text, F.lit(p)) for p in phrases])


def present(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    return total([F.contains(text, F.lit(p)).cast("int") for p in phrases])


def tokens(text: Column, stop: list[str] = vocab.STOP_WORDS) -> Column:
    """Lower-case tokens without stop words and single letters; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(vocab.TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(sorted(set(stop))))


def one_of(value: Column, mapping: dict[str, str], default: Column | str | None = None) -> Column:
    """Literal lookup."""
    out: Column | None = None
    for key, result in mapping.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out if default is None else out.otherwise(default)


# URLs and identity


def url_key(url: Column) -> Column:
    """Document key: the first 12 hexadecimal digits of the URL's MD5."""
    return F.substring(F.md5(url), 1, 12)


def normal_url(url: Column) -> Column:
    """Lower case without scheme and ``www.``, wherever they stand."""
    return F.replace(F.replace(F.replace(F.lower(url), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("www."), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, empty if none."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))


def file_type(media_type: Column, url: Column, default: str = "html") -> Column:
    """By media type (parameters dropped), then by extension, then the default."""
    media = F.trim(F.lower(F.substring_index(media_type, ";", 1)))
    return F.coalesce(one_of(media, vocab.MEDIA_TYPES), one_of(extension(url), vocab.EXTENSIONS), F.lit(default))


def title_of_url(url: Column) -> Column:
    """Last segment with blanks for hyphens, words capitalised, 100 characters at most."""
    segment = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.substring(F.initcap(F.replace(segment, F.lit("-"), F.lit(" "))), 1, 100)


def shortened(path: Column, most: int = 60) -> Column:
    """Path with its middle left out where it is longer."""
    side = (most - 3) // 2
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.substring(path, 1, side), F.lit("..."), F.right(path, F.lit(side))))


def mail_date(text: Column) -> Column:
    """Timestamp of ``Tue, 15 Nov 1994 12:45:26 GMT``; null where it is none."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^\s*(?:\p{L}{3},\s*)?(\d{1,2} \p{L}{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


# Vectors


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def truncated(text: Column, most: int, marker: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def first_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(words(text), 1, most), " ")
