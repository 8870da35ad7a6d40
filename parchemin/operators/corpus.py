"""Document-corpus operators: deduplication, snapshots, resumption, routing and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_order(url: Column, last: Column) -> list[Column]:
    """Order in which the first is the canonical one: https, no parameters, shortest URL, then the given key."""
    return [F.when(F.startswith(url, F.lit("https://")), 0).otherwise(1), F.when(F.contains(url, F.lit("?")), 1).otherwise(0), F.length(url), last]


def deduplicate(documents: DataFrame, hash_column: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Rows with ``copy_no`` (1 is kept) and ``copies``; rows without a hash are all kept.

    Rows with a null hash never meet in one task: they get their number
    without a window.
    """
    group = [*(within or []), hash_column]
    hashed = documents.where(F.col(hash_column).isNotNull())
    window = Window.partitionBy(*group)
    numbered = hashed.withColumns({"copy_no": F.row_number().over(window.orderBy(*order)), "copies": F.count("*").over(window)})
    return numbered.unionByName(documents.where(F.col(hash_column).isNull()).withColumns({"copy_no": F.lit(1), "copies": F.lit(1).cast("long")}))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, change): new, removed, modified or unchanged; a null hash is a value like others."""
    one, two = old.select(key, F.col(hash_column).alias("old_hash"), F.lit(True).alias("was")), new.select(key, F.col(hash_column).alias("new_hash"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.equal_null("old_hash", "new_hash"), "unchanged").otherwise("modified")
    return one.join(two, key, "full").select(key, change.alias("change"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key has not been processed yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def merge(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the target with those of the changes in place of rows of the same key, and the new ones."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


#: Ordinals of a block in which the running length of a document is taken.
BLOCK = 1000


def reassembled(chunks: DataFrame, document: str, ordinal: Column, text: str = "text", separator: str = "\n\n", most: int = 8000) -> DataFrame:
    """(document, n_chunks, text): a document's chunks in order, cut at ``most`` characters.

    Only chunks that can reach the cut are gathered: a running length in order
    drops those that start beyond it, so a document of any size needs a
    bounded list.  The length runs in blocks of ordinals, shifted by the blocks
    before, so a long document is shared among tasks.
    """
    length = F.length("_t") + len(separator)
    order = Window.partitionBy(document, "_block").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.select(document, ordinal.alias("_o"), F.coalesce(text, F.lit("")).alias("_t")).withColumn("_block", F.floor(F.col("_o") / BLOCK))
    sums = placed.groupBy(document, "_block").agg(F.sum(length).alias("_n")).select(document, "_block", F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_before"))
    placed = placed.join(sums.where(F.col(document).isNotNull()), [document, "_block"], "left")
    placed = placed.withColumn("_start", F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum(length).over(order), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("_start") < most, F.struct("_o", "_t"))))
    return placed.groupBy(document).agg(F.count("*").alias("n_chunks"), F.substring(F.array_join(F.transform(parts, lambda x: x["_t"]), separator), 1, most).alias("text"))


def shares(rows: DataFrame, by: list[str], digits: int = 1) -> DataFrame:
    """(by, n, pct): counts and their part of the whole."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), digits))
