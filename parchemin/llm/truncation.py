"""Text cut off by field limits (problem 9).

For each source, length histograms in characters and in bytes are tested for
spikes; a value at a spike length without terminal punctuation was cut by the
field's limit.  Cuts elsewhere are told from the end itself: damaged
characters, entities, escapes and tags, marks such as "[...]" or "Lire la
suite", and prose that stops without terminal punctuation.

How complete texts end without full stop is learned from the last lines of all
texts, numbers and names made alike.  A line that recurs as the last one of
many different texts away from spikes is a closing formula.  The first two
words of a line, or its label, frame closings (signatures, places and dates, keywords) if the
texts that end on such a line mostly end it without terminal punctuation; the
paragraphs of prose that begin with the same words mostly end with it.  Of
fixed forms only links, table rows and list items are told, and they, like
framed lines, say nothing at a spike length.

Everything runs as JVM expressions: one aggregation for the histograms, two for
the last lines, all of hashes and counts only.

Defined results: null, empty and blank texts are never incomplete; republished
texts count once in the histograms and are each reported; a null source is a
source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint

#: A length is a spike with at least this many different texts and this many times the mean of the lengths around it.
SPIKE_COUNT, SPIKE_TIMES, AROUND = 5, 8, 40
#: A last line is a closing formula with at least this many different texts and this share of all.
FORMULA_COUNT, FORMULA_SHARE = 3, 0.0004
#: The first two words of a last line frame closings if at least so many different lines begin so, and this share of their texts ends without terminal punctuation.
FRAME_COUNT, FRAME_OPEN = 3, 0.75

# How cut texts and complete ones end.
DAMAGED = r"(�|&#?[A-Za-z0-9]{0,8}|\\(u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|<[^<>]*)$"
MARKED = r"(?iu)(\[ ?(\.\.\.|…|suite|more) ?\]|\( ?(\.\.\.|…|suite|à suivre|continued|more|fortsetzung|sigue|continuación|continúa) ?\)|(lire|voir) la suite|lire plus|read more|continue reading|weiterlesen|mehr lesen|leer más|seguir leyendo)[\s.…»›>→]*$"
DOTS = r"(…|\.\.\.)[\"'»”’)\]]*$"
IDIOM = r"(?iu)(ainsi de suite|and so (on|forth)|und so (weiter|fort)|así sucesivamente|y así|usw|etc\b)"
STOPPED = r"[.!?。！？](\s?[\"'»”’)\]*_]|\s?\[\d{1,4}\]){0,12}$"
ABBREVIATED = r"(?iu)((^|[\s(])(cf|art|al|pp|mme|dr|nr|núm|vgl|bzw|abs|z\.\s?b|e\.g|i\.e)\.|version \d+\.|\([^()]*)$"
ROW = r"^\s*\|.*\|$|^[^|]+ \| [^|].*[^|]$"
ITEM = r"^\s*([-*•–◦]|\d{1,3}[.)])\s+\S.*[^,;:(\s]$"
LINK = r"(^|[\s(<])((https?://|www\.)\S+\.\S+|[^\s@]+@[^\s@]+\.\p{L}{2,})$"
#: Names in a last line, made alike as its digits are.
NAMES = r"(?<=\s)[(«\"]?(?:\p{L}['’])?\p{Lu}[\p{L}\p{M}'’-]*"


def _source(column: str = "source") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: White space and zero-width characters that may stand after the end.
AFTER = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, text_key, line and the signs of the end): all that is needed of a non-blank text, without its text.

    ``line`` is the key of a last line that may be a closing formula, null for
    other last lines; ``frame`` is the key of its first two words or label.
    """
    last = F.col("last")
    dots, marked, stopped = last.rlike(DOTS), last.rlike(MARKED), last.rlike(STOPPED)
    alike = F.regexp_replace(F.regexp_replace(F.regexp_replace("last", r"\p{Nd}+", "0"), NAMES, "_"), r"_(?:[\s-]+_)+", "_")
    open_end = (~stopped | dots) & ~marked
    frame = F.xxhash64(F.regexp_extract(alike, r"^(\S+:|\S+\s+\S+|\S+)", 1))
    return (
        documents.where("text IS NOT NULL")
        .select("doc_id", _source().alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text_key"), F.rtrim("text", F.lit(AFTER)).alias("bare"))
        .where("bare <> ''")
        .select("doc_id", "source", "chars", "bytes", "text_key", F.trim(F.substring_index("bare", "\n", -1)).alias("last"))
        .select(
            "doc_id", "source", "chars", "bytes", "text_key", F.when(open_end, F.xxhash64(alike)).alias("line"), frame.alias("frame"),
            last.rlike(DAMAGED).alias("damaged"), marked.alias("marked"), dots.alias("dots"), (dots & last.rlike(IDIOM)).alias("idiom"), stopped.alias("stopped"), (stopped & last.rlike(ABBREVIATED)).alias("abbreviated"),
            (~stopped & (last.rlike(ROW) | last.rlike(LINK) | last.rlike(ITEM))).alias("form"),
        )
    )


def spikes(ends: DataFrame, count: int = SPIKE_COUNT, times: float = SPIKE_TIMES) -> DataFrame:
    """(source, unit, size, n): lengths at which far more texts end than around them."""
    sizes = ends.select("source", "text_key", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")))).alias("x"))
    histogram = sizes.select("source", "x.unit", "x.size", "text_key").distinct().groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-AROUND, AROUND)
    around = (F.sum("n").over(near) - F.col("n")) / F.lit(2 * AROUND)
    return histogram.withColumn("around", around).where((F.col("n") >= count) & (F.col("n") >= F.greatest(F.lit(0.25), "around") * F.lit(times))).select("source", "unit", "size", "n")


def ending(formula: Column, framed: Column, at_spike: Column) -> Column:
    """Why a text is incomplete, null where it is complete."""
    c = F.col
    return (
        F.when(c("damaged"), "damaged")
        .when(c("marked"), "marked")
        .when(c("dots"), F.when(~(c("idiom") | formula), "marked"))
        .when(c("stopped"), F.when(c("abbreviated"), "stopped"))
        .when(formula | ((c("form") | framed) & ~at_spike), F.lit(None))
        .when(at_spike, "spike")
        .otherwise("stopped")
    )


def incomplete(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason, at_spike) of every non-blank text; reason is null where the text is complete."""
    ends = checkpoint(measured(documents))
    limits = broadcast_if_small(spikes(ends))
    by = {u: limits.where(F.col("unit") == u).select("source", F.col("size").alias(u), F.lit(True).alias(f"{u}_spike")) for u in ("chars", "bytes")}
    placed = ends.join(by["chars"], ["source", "chars"], "left").join(by["bytes"], ["source", "bytes"], "left")
    placed = placed.withColumn("at_spike", F.coalesce("chars_spike", "bytes_spike", F.lit(False))).drop("chars_spike", "bytes_spike")
    texts = ends.select("text_key").distinct().agg(F.count("*").alias("n_all"))
    recurring = placed.where("line IS NOT NULL").select("line", "text_key", "at_spike").distinct().groupBy("line").agg(F.count("*").alias("n"), F.count_if("at_spike").alias("n_spike"))
    formulas = recurring.join(F.broadcast(texts)).where((F.col("n") >= FORMULA_COUNT) & (F.col("n") >= F.col("n_all") * F.lit(FORMULA_SHARE)) & (F.col("n_spike") * 4 < F.col("n"))).select("line", F.lit(True).alias("formula"))
    starts = placed.where("NOT at_spike").select("frame", "text_key", (F.col("stopped") | F.col("dots") | F.col("marked")).alias("ended"), "line").distinct().groupBy("frame").agg(F.count("*").alias("n"), F.count_if(~F.col("ended")).alias("n_open"), F.countDistinct(F.when(~F.col("ended"), F.col("line"))).alias("n_lines"))
    frames = starts.where((F.col("n_lines") >= FRAME_COUNT) & (F.col("n_open") >= F.col("n") * F.lit(FRAME_OPEN))).select("frame", F.lit(True).alias("framed"))
    told = placed.join(broadcast_if_small(formulas), "line", "left").join(broadcast_if_small(frames), "frame", "left")
    return told.select("doc_id", "source", ending(F.coalesce("formula", F.lit(False)), F.coalesce("framed", F.lit(False)), F.col("at_spike")).alias("reason"), "at_spike")


def truncation_report(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_incomplete, share, n_at_spike): how often each source cuts its texts."""
    return (
        incomplete(documents)
        .groupBy("source")
        .agg(F.count("*").alias("n_texts"), F.count("reason").alias("n_incomplete"), F.count_if(F.col("at_spike") & F.col("reason").isNotNull()).alias("n_at_spike"))
        .withColumn("share", F.col("n_incomplete") / F.col("n_texts"))
    )
