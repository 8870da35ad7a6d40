"""Lines repeated across one site's documents (problem 5).

Lines are the nodes of a graph for each site and consecutive lines its edges;
a node's or edge's weight is the number of distinct documents that hold it.
Nodes and edges of high support are kept, connected components of the kept
graph are the site's boilerplate blocks, and every occurrence of a block's
lines is deleted.

Distinct documents are counted by a first aggregation on (site, line,
document), so neither a line that stands in every document nor a site with a
third of all rows meets in one task.  A site keeps at most 1 / ``share`` times
the lines of its average document, so the kept nodes are few; they are
broadcast only after they have been counted.

Defined results: rows with a null path or a path without a site are neither
counted nor cleaned; null texts have no lines; blank lines never count;
repeated rows of a chunk count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint
from .split import WHITE

LEAST, SHARE = 4, 0.05


def site_of(path: Column) -> Column:
    """The second component of ``corpus/<site>/<kind>/<file>``, null where there is none."""
    return F.nullif(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))


def canonical(line: Column) -> Column:
    """Equal for lines that are the same: trimmed, blanks as one, case ignored, digit runs alike."""
    spaced = F.trim(F.regexp_replace(line, f"[{WHITE}]+", " "))
    return F.regexp_replace(F.lower(spaced), "\\p{Nd}+", "0")


def lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, site, path, ord, line_no, h1, h2): the non-blank lines; ord counts them, line_no counts all; h1 and h2 stand for site and line."""
    numbered = F.transform(F.split("text", "\n"), lambda x, k: F.struct((k + 1).alias("line_no"), canonical(x).alias("line")))
    site = site_of(F.col("document_path"))
    return (
        chunks.where("document_path IS NOT NULL AND text IS NOT NULL")
        .select("chunk_id", site.alias("site"), F.xxhash64("document_path").alias("path"), F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("ord", "x"))
        .where("site IS NOT NULL")
        .select("chunk_id", "site", "path", "ord", "x.line_no", F.xxhash64("site", "x.line").alias("h1"), F.hash("x.line", "site").alias("h2"))
    )


def _supported(counted: DataFrame, totals: DataFrame, least: int, share: float) -> DataFrame:
    return counted.join(totals, "site").where((F.col("support") >= least) & (F.col("support") >= F.col("n_paths") * F.lit(share)))


def _blocks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, h1, h2, support, block): components of each site's kept graph, which is bounded (see above)."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        root = {h: h for h in group["h1"]}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, follows in zip(group["h1"], group["follows"], strict=True):
            for b in follows if follows is not None else ():
                one, two = top(a), top(int(b))
                root[max(one, two)] = min(one, two)
        group["block"] = [top(x) for x in group["h1"]]
        return group[["site", "h1", "h2", "support", "block"]]

    near = edges.groupBy("site", "h1").agg(F.collect_set("next_h1").alias("follows"))
    return nodes.select("site", "h1", "h2", "support").join(near, ["site", "h1"], "left").groupBy("site").applyInPandas(join, "site string, h1 long, h2 int, support long, block long")


def repeated_lines(chunks: DataFrame, least: int = LEAST, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Blocks (site, h1, h2, support, block) and occurrences (chunk_id, line_no, site, path, ord, h1, h2) of their lines."""
    found = lines(chunks)
    sites = chunks.select(site_of(F.col("document_path")).alias("site"), F.xxhash64("document_path").alias("path")).where("site IS NOT NULL")
    totals = sites.distinct().groupBy("site").agg(F.count("*").alias("n_paths"))
    support = found.select("site", "h1", "h2", "path").distinct().groupBy("site", "h1", "h2").agg(F.count("*").alias("support"))
    totals = checkpoint(totals)
    nodes = broadcast_if_small(_supported(support, totals, least, share).select("site", "h1", "h2", "support"))
    met = checkpoint(found.join(nodes.drop("support"), ["site", "h1", "h2"]).dropDuplicates(["chunk_id", "line_no"]))
    following = met.select("chunk_id", (F.col("ord") - 1).alias("ord"), F.col("h1").alias("next_h1"))
    weights = met.join(following, ["chunk_id", "ord"]).select("site", "h1", "next_h1", "path").distinct().groupBy("site", "h1", "next_h1").agg(F.count("*").alias("support"))
    blocks = _blocks(_supported(weights, totals, least, share), nodes)
    return broadcast_if_small(blocks), met


def occurrences(chunks: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(chunk_id, line_no, site, block, support) of every occurrence of a block's line."""
    blocks, met = repeated_lines(chunks, least, share)
    return met.join(blocks, ["site", "h1", "h2"]).select("chunk_id", "line_no", "site", "block", "support")


def remove_repeated(chunks: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The chunks, each once, with ``clean_text`` and ``n_removed``; a chunk without repeated lines keeps its text."""
    gone = occurrences(chunks, least, share).groupBy("chunk_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.coalesce(F.array_contains("_gone", k + 1), F.lit(False)))
    return (
        chunks.select("chunk_id", "document_path", "text")
        .dropDuplicates(["chunk_id"])
        .join(gone, "chunk_id", "left")
        .select("chunk_id", "document_path", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
    )
