"""Mixing sources to target weights with exact shares (problem 8).

Sizes are tokens of a public tokenizer.  The total is chosen where the shares
come nearest to the targets (see ``plan``); each source gets a quota of tokens,
filled by whole passes over its documents in a keyed random order, one last
partial pass and one document that closes the gap best, never more than ``max_repeats`` times a document.

The selected copies of a source, permuted again, are cut into blocks.  A
splitting tree hands the blocks to output shards: at each node the block counts
of all sources are divided by a multivariate hypergeometric draw, so that every
shard gets exact, disjoint numbers of blocks of each source; within a shard
the order is a keyed shuffle.

A source may hold any part of the rows: ranks and running sums are taken in
hash buckets and shifted by the buckets' totals, so no task sees a whole
source.  The driver sees one row for each source and at most ``TOP_NODES``
nodes of the tree; the nodes below are divided in tasks, by draws that depend on
the seed and the node alone.

Defined results: null and empty texts have no tokens and are never selected;
sources without target, and null sources, are left out; a listed source without
documents is reported with share 0; equal texts are different documents; a
source listed twice counts with its first target in order of share; an empty
document table gives an empty selection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint
from .encode import FOLDER, VOCABULARY, count_tokens

#: Documents of a block, tokens of an output shard, least number of shards, rows of a hash bucket, and the key of all random choices.
BLOCK, SHARD_TOKENS, LEAST_SHARDS, BUCKET_ROWS, SEED = 4, 1_000_000, 8, 20_000, 20240601
#: Nodes of the tree that the driver divides at most; those below them are divided in tasks.  Blocks at most, as a draw is exact below 10^9 of them.
TOP_NODES, MOST_BLOCKS = 4096, 500_000_000


@dataclass
class Source:
    """A listed source with what its documents hold and what it is to give."""

    name: str
    target: float
    max_repeats: int
    documents: int
    tokens: int
    quota: int = 0

    @property
    def capacity(self) -> int:
        return self.tokens * self.max_repeats


def plan(sources: list[Source], total: int | None = None) -> list[Source]:
    """Set the quotas.

    Without a given total, it is chosen among those at which some source is
    just used up: the one with the least sum of deviations from the targets,
    each source's indivisible documents counted with half a document on
    average.  At a larger total small sources would fall short of their share.
    """
    present = [s for s in sources if s.capacity > 0 and s.target > 0]
    if not present:
        return sources

    def filled(amount: float) -> list[float]:
        return [min(s.target * amount, s.capacity) for s in present]

    def deviation(amount: float) -> float:
        tokens = filled(amount)
        whole = sum(tokens)
        grain = sum(s.tokens / s.documents / 2 for s, t in zip(present, tokens, strict=True) if t < s.capacity)
        return sum(abs(t / whole - s.target) for s, t in zip(present, tokens, strict=True)) + grain / whole

    amounts = [total] if total else sorted({s.capacity / s.target for s in present}, reverse=True)
    best = min(amounts, key=deviation)
    for s, tokens in zip(present, filled(best), strict=True):
        s.quota = round(tokens)
    return sources


#: A node of the tree: its shards (first, last), and of each source the blocks it holds and the number of the first one.
TreeNode = tuple[int, int, np.ndarray, np.ndarray]


def _children(node: TreeNode, seed: int) -> list[TreeNode]:
    """The halves of a node; the draw depends on the seed and the node's shards only, so it is the same wherever it is made."""
    first, last, counts, starts = node
    middle, size = (first + last) // 2, int(counts.sum())
    rng = np.random.default_rng([seed, first, last])
    left = rng.multivariate_hypergeometric(counts, size * (middle - first) // (last - first), method="marginals") if size else counts
    return [(first, middle, left, starts), (middle, last, counts - left, starts + left)]


def top_nodes(blocks: list[int], shards: int, seed: int, most: int = TOP_NODES) -> list[TreeNode]:
    """The nodes of the first level with at least ``most`` of them, or all shards."""
    level: list[TreeNode] = [(0, shards, np.asarray(blocks, np.int64), np.zeros(len(blocks), np.int64))]
    while len(level) < most and any(last - first > 1 for first, last, _, _ in level):
        level = [child for node in level for child in (_children(node, seed) if node[1] - node[0] > 1 else [node])]
    return level


def leaves(node: TreeNode, seed: int) -> Iterator[TreeNode]:
    """The shards below a node, in order."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            stack.extend(reversed(_children(node, seed)))


def splitting_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); shard sizes differ by few blocks at most."""
    return np.array([counts for node in top_nodes(blocks, shards, seed) for _, _, counts, _ in leaves(node, seed)])


def _owners(spark: SparkSession, names: list[str], blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(source, shard, block) of all blocks: the top of the tree comes from the driver, what is below from tasks."""
    rows = [(first, last, counts.tolist(), starts.tolist()) for first, last, counts, starts in top_nodes(blocks, shards, seed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, counts, starts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                node = (first, last, np.asarray(counts, np.int64), np.asarray(starts, np.int64))
                found = [(names[j], shard, int(s), int(n)) for shard, _, many, at in leaves(node, seed) for j, (s, n) in enumerate(zip(at, many, strict=True)) if n]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source", "shard", "first", "n"])

    top = spark.createDataFrame(rows, "first long, last long, counts array<long>, starts array<long>")
    return top.mapInArrow(run, "source string, shard long, first long, n long").select("source", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("block"))


def _placed(rows: DataFrame, key: Column, amount: Column, buckets: int) -> DataFrame:
    """Rows with ``rank`` (from 0) and ``before`` (sum of the amount before it) in the order of the key within each source."""
    keyed = rows.withColumns({"_key": key, "_amount": amount}).withColumn("_bucket", F.floor(F.shiftrightunsigned("_key", 33) * F.lit(buckets) / F.lit(float(1 << 31))).cast("int"))
    sums = keyed.groupBy("source", "_bucket").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_s"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_s0"))
    inner = Window.partitionBy("source", "_bucket").orderBy(F.shiftrightunsigned("_key", 33), "_key", "doc_id", "copy")
    ranked = keyed.withColumns({"_r": F.row_number().over(inner) - 1, "_b": F.coalesce(F.sum("_amount").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return ranked.join(starts, ["source", "_bucket"]).withColumns({"rank": F.col("_n0") + F.col("_r"), "before": F.col("_s0") + F.col("_b")}).drop("_key", "_amount", "_bucket", "_n0", "_s0", "_r", "_b")


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max_by("max_repeats", "target_share").alias("max_repeats"), F.max("target_share").alias("target_share"))


def _sized(documents: DataFrame, targets: DataFrame, folder: str, vocabulary: str) -> tuple[DataFrame, list[Source]]:
    """Documents of listed sources with their tokens, and the sources; the target list is fixed and small."""
    listed = F.broadcast(targets.select("source"))
    own = documents.select("doc_id", "source", "text").join(listed, "source", "left_semi").where("length(text) > 0")
    sized = checkpoint(count_tokens(own, "doc_id", "source", folder=folder, vocabulary=vocabulary).where("n_tokens > 0"))
    totals = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    rows = targets.join(totals, "source", "left").orderBy("source").collect()
    return sized, [Source(r.source, r.target_share, r.max_repeats or 0, r.documents or 0, r.tokens or 0) for r in rows]


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, seed: int = SEED, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[Source]]:
    """The selection (doc_id, source, copy, n_tokens, shard, position) and the sources with their quotas."""
    spark = documents.sparkSession
    sized, sources = _sized(documents, _targets(targets), folder, vocabulary)
    plan(sources, total)
    schema = "source string, quota long, passes int, rest long, max_repeats int"
    quotas = spark.createDataFrame([(s.name, s.quota, s.quota // s.tokens if s.tokens else 0, s.quota % s.tokens if s.tokens else 0, s.max_repeats) for s in sources], schema)
    buckets = max(1, math.ceil(sum(s.documents for s in sources) / BUCKET_ROWS))
    ordered = _placed(sized.withColumn("copy", F.lit(0)), F.xxhash64(F.lit(seed), "doc_id"), F.col("n_tokens"), buckets).join(F.broadcast(quotas), "source")
    # The last pass takes the first documents that fit, and then the one that comes nearest to the gap if it makes it smaller.
    ordered = checkpoint(ordered.withColumn("fits", F.col("before") + F.col("n_tokens") <= F.col("rest")))
    gap = ordered.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    last = ordered.where(~F.col("fits")).join(F.broadcast(gap), "source").where(off < F.col("gap")).groupBy("source").agg(F.min_by("doc_id", F.struct(off, "doc_id")).alias("last"))
    more = (F.col("fits") | F.coalesce(F.col("doc_id") == F.col("last"), F.lit(False))).cast("int")
    copies = F.least(F.col("max_repeats"), F.col("passes") + more)
    ordered = ordered.join(F.broadcast(last), "source", "left")
    chosen = ordered.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    chosen = checkpoint(chosen)
    counts = {r.source: r.n for r in chosen.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    block = max(BLOCK, math.ceil(sum(counts.values()) / MOST_BLOCKS))
    blocks = [math.ceil(counts[n] / block) for n in names]
    shards = shards or max(LEAST_SHARDS, math.ceil(sum(s.quota for s in sources) / SHARD_TOKENS))
    owner = broadcast_if_small(_owners(spark, names, blocks, shards, seed))
    buckets = max(1, math.ceil(sum(counts.values()) / BUCKET_ROWS))
    permuted = _placed(chosen, F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), F.lit(1), buckets).withColumn("block", F.floor(F.col("rank") / block))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")
    return permuted.join(owner, ["source", "block"]).select("doc_id", "source", "copy", "n_tokens", "shard", (F.row_number().over(local) - 1).alias("position")), sources


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """What each listed source reached: (source, target_share, max_repeats, n_documents, available_tokens, quota, n_selected, n_copies, tokens, share, used_up)."""
    selection, sources = mix(documents, targets, total, None, seed, folder, vocabulary)
    got = selection.groupBy("source").agg(F.countDistinct("doc_id").alias("n_selected"), F.count("*").alias("n_copies"), F.sum("n_tokens").alias("tokens"))
    listed = documents.sparkSession.createDataFrame(
        [(s.name, s.target, s.max_repeats, s.documents, s.tokens, s.quota) for s in sources], "source string, target_share double, max_repeats int, n_documents long, available_tokens long, quota long"
    )
    whole = F.sum("tokens").over(Window.partitionBy())
    joined = listed.join(got, "source", "left").na.fill(0, ["n_selected", "n_copies", "tokens"])
    return joined.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0))).withColumn("used_up", F.col("tokens") >= F.col("available_tokens") * F.col("max_repeats"))


def totals(documents: DataFrame, targets: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The totals at which a source is used up, with what each would give: (total, used_up, n_short, tokens, available_share, deviation, chosen).

    ``tokens`` is what the sources can give of the total, ``deviation`` the sum
    of the differences between shares and targets, ``n_short`` the number of
    sources below their target; ``chosen`` marks the default total of ``mix``.
    """
    _, sources = _sized(documents, _targets(targets), folder, vocabulary)
    present = [s for s in sources if s.capacity > 0 and s.target > 0]
    quota = sum(s.quota for s in plan(sources))
    rows = []
    for edge in sorted(present, key=lambda s: s.capacity / s.target):
        total = edge.capacity / edge.target
        given = [min(s.target * total, s.capacity) for s in present]
        off = sum(abs(t / sum(given) - s.target) for s, t in zip(present, given, strict=True))
        short = sum(s.capacity < s.target * total for s in present)
        rows.append((round(total), edge.name, short, round(sum(given)), sum(given) / sum(s.tokens for s in present), off, abs(sum(given) - quota) <= len(present)))
    return documents.sparkSession.createDataFrame(rows, "total long, used_up string, n_short int, tokens long, available_share double, deviation double, chosen boolean")
