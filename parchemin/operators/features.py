"""Text features, keyword scores and rule-based classification as one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import expressions as X


def excluded(url: Column, text: Column, patterns: list[str] = vocab.EXCLUDED_URLS, phrases: list[str] = vocab.EXCLUDED_PHRASES) -> Column:
    """The first reason to exclude a page, null for none: a URL pattern, else a phrase said at least twice."""
    lower = F.lower(text)
    reasons = [F.when(X.holds(url, p), F.lit(f"URL pattern: {p}")) for p in patterns]
    reasons += [F.when(X.occurrences(lower, p) >= 2, F.lit(f"Strong keyword: {p}")) for p in phrases]
    return F.coalesce(*reasons)


def keyword_score(text: Column, url: Column, keywords: dict[int, list[str]] = vocab.KEYWORDS) -> Column:
    """0.7 times the weighted keyword occurrences plus 0.3 times the URL's score."""
    lower, address = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(url, F.lit(""))
    by_text = X.total([X.occurrences(lower, word) * weight for weight, words in keywords.items() for word in words])
    by_url = X.total([F.when(X.any_of(address, parts), weight).otherwise(0) for weight, parts in vocab.URL_SCORES.items()])
    return by_text * 0.7 + by_url * 0.3


def band(score: Column) -> Column:
    """Category of a score."""
    return F.when(score >= 8, "essentiel").when(score >= 6, "utile").when(score >= 4, "contexte").when(score >= 2, "marginal").otherwise("hors sujet")


def sectors(lower: Column, groups: dict[str, list[str]] = vocab.SECTORS) -> Column:
    """Sectors of which any keyword occurs, in the vocabulary's order."""
    return F.filter(F.array(*(F.when(X.any_of(lower, words), F.lit(name)) for name, words in groups.items())), lambda x: x.isNotNull())


def with_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """The feature columns of each text; a null text has those of an empty one."""
    own = F.coalesce(text, F.lit(""))
    lower = F.lower(own)
    columns = {name: X.holds(own, pattern) for name, pattern in vocab.FEATURES.items()}
    columns |= {
        "has_numbered_list": own.rlike(vocab.NUMBERED_LIST),
        "doctrine_score": X.present(lower, vocab.DOCTRINE),
        "operational_score": X.present(lower, vocab.OPERATIONAL),
        "detected_sectors": sectors(lower),
        "word_count": X.word_count(own),
    }
    return rows.withColumns(columns)


def classified(rows: DataFrame, nature: str = "document_nature") -> DataFrame:
    """``nature``, ``rule_confidence`` and ``rule`` of rows with features.

    Hard rules come first, then the best of three scores (ties in the order
    doctrine, guide, technique) unless nothing speaks or two tie in a dense
    text, then defaults; texts that stay open have the rule ``open`` and the
    document's nature.
    """
    c, i = F.col, lambda name: F.col(name).cast("int")
    scores = {"DOCTRINE": c("doctrine_score") + i("has_article") + i("has_legal_ref"), "GUIDE": c("operational_score") + i("has_steps") + i("has_numbered_list"), "TECHNIQUE": i("has_technical") * 2}
    ordered = F.sort_array(F.array(*(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")) for place, (name, score) in enumerate(scores.items())), F.struct(F.lit(0).alias("score"), F.lit(-3).alias("place"), F.lit("SANCTION").alias("name"))), asc=False)
    placed = rows.withColumn("_s", ordered)
    first, second = c("_s")[0], c("_s")[1]
    open_ = (first["score"] == 0) | ((second["score"] >= 2) & (first["score"] == second["score"]) & (c("word_count") > 150))

    def result(name: Column | str, confidence: Column | float, rule: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(name).alias("nature"), lit(confidence).cast("double").alias("confidence"), lit(rule).alias("rule"))

    mixed = (scores["DOCTRINE"] >= 2) & (scores["GUIDE"] >= 2) & (c("word_count") < 200)
    told = (
        F.when(c("has_sanction"), result("SANCTION", 1.0, "rule_sanction"))
        .when(c("has_template"), result("GUIDE", 0.95, "rule_template"))
        .when(c("has_steps") & c("has_numbered_list"), result("GUIDE", 0.95, "rule_procedure"))
        .when(c("has_article") & ~c("has_steps") & (c("word_count") > 100), result("DOCTRINE", 0.9, "rule_article"))
        .when(~open_, result(first["name"], F.least(F.lit(0.85), first["score"] * 0.1 + 0.55), F.concat(F.lit("score_"), F.lower(first["name"]))))
        .when(mixed, result(c(nature), 0.6, "mixed_short"))
        .when((c("word_count") >= 60) & ~c("has_steps") & ~c("has_technical"), result("DOCTRINE", 0.65, "default_doctrine"))
        .when(c("word_count") >= 100, result(c(nature), 0.5, "open"))
        .otherwise(result(c(nature), 0.5, "document"))
    )
    return placed.withColumn("_r", told).withColumns({"nature": F.col("_r.nature"), "rule_confidence": F.round("_r.confidence", 4), "rule": F.col("_r.rule")}).drop("_s", "_r")


def index_of(nature: Column) -> Column:
    return X.one_of(nature, vocab.NATURE_INDEX, F.lit(vocab.DEFAULT_INDEX))


def secondary_indexes(nature: Column, found: Column) -> Column:
    """Secondary indexes: doctrine mixed with guidance, and one or two sectors."""
    mixed = F.when(nature == "MIXTE", F.array(F.lit("OPERATIONNEL"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found).between(1, 2), F.array_union(mixed, F.array(F.lit("SECTORIELS")))).otherwise(mixed)


def validated_index(index: Column, text: Column, title: Column) -> Column:
    """Index corrected where the first 2000 characters clearly speak for another one."""
    combined = F.substring(F.concat_ws(" ", F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))), 1, 2000)
    start = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 500))
    sanction = F.contains(combined, F.lit("san-")) | (F.contains(combined, F.lit("délibération")) & X.any_of(combined, ["amende", "mise en demeure", "condamnation"]))
    practical = X.any_of(start, ["comment", "guide pratique", "mode d'emploi", "tutoriel"])
    law = ((X.occurrences(combined, "article ") >= 5) | X.any_of(combined, ["règlement (ue)", "directive"])) & ~X.any_of(start, ["comment", "guide"])
    after_first = F.when(sanction, F.lit("SANCTIONS")).otherwise(index)
    after_second = F.when(practical & (after_first == "FONDAMENTAUX"), F.lit("OPERATIONNEL")).otherwise(after_first)
    return F.when(law & (after_second == "OPERATIONNEL"), F.lit("FONDAMENTAUX")).otherwise(after_second)


def navigation(text: Column, is_html: Column, patterns: list[str] = vocab.NAVIGATION) -> Column:
    """Whether an HTML page is mostly navigation: very short, or short with enough of its phrases."""
    bare = F.length(F.trim(F.coalesce(text, F.lit(""))))
    hits = X.total([F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?iu){p}")) for p in patterns])
    return is_html & F.when(bare < 100, True).when(bare > 2000, False).when((hits >= 3) & (bare < 1000), True).otherwise((bare < 500) & (hits >= 1))


def stance(text: Column) -> Column:
    """Position that the first 300 characters take."""
    start = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 300))
    against, for_ = (X.total([start.rlike(p).cast("int") for p in patterns]) for patterns in (vocab.NEGATIVE, vocab.POSITIVE))
    return F.when(against > for_, "negative").when(for_ > against, "positive").otherwise("neutral")
