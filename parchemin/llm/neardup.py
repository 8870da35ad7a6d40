"""Near-duplicate records with small edits, by multi-index hashing (problem 2).

Every distinct set of word shingles gets a fingerprint of ``segments * width``
min-hash symbols of 16 bits.  The fingerprint is cut into segments; the Hamming
ball of radius one around a segment is entered into a table by blanking each of
its symbols in turn, so that two segments at distance zero or one meet under at
least one key.  Where two records meet, their complete fingerprints are compared
before a row is made of it: each symbol gives one bit, and the 128-bit code is
carried beside the key.  What is left is verified on the exact sets.

``layout`` takes width and segments from the number of records and the
threshold: a tenfold number lengthens the keys by a symbol, so that chance
meetings of one record stay about as many, and the segments are as many as a
pair at the threshold needs to meet with probability ``RECALL``.  Up to a million records and at
0.6 these are 20 segments of 6 symbols: a pair at 0.60 meets with probability
0.995, at 0.65 with 0.9995 and at 0.70 with 0.99998.

Sizes of exploded tables cannot be seen by the planner, so every join here asks
for a sort-merge join; AQE splits its skewed partitions.

Defined results: null texts take no part; equal texts always form a pair, even
those with fewer words than a shingle; repeated rows count once; an empty table
gives no rows.  Records with equal sets are one class (a 128-bit digest) and
only its representative enters the search, so a group of copies costs one
fingerprint however large it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint, hot_keys, lookup

WORDS = re.compile(r"[^\W_]+")
#: Probability with which a pair at the threshold is to meet, and the records beyond which keys grow.
RECALL, RECORDS = 0.995, 1_000_000
WIDTH = 6
#: Standard deviations by which the complete fingerprints of a pair may differ more than expected at the threshold.
LEEWAY = 3.5
_BLOCK = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word; kept while the table is small."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = value
        return value


def shingle_set(text: str, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` consecutive words."""
    found = WORDS.findall(text.lower())
    n = len(found) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    x = ids[:n].copy()
    for k in range(1, size):
        x = _mixed(x + _GOLDEN) ^ ids[k : n + k]
    return np.unique(_mixed(x + _GOLDEN))


def fingerprint(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """The least of each hash family member over the set, cut to 16 bits."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(least, (shingles[at : at + _BLOCK, None] * multipliers).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def _multipliers(count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def layout(records: int, threshold: float) -> tuple[int, int]:
    """(segments, width) of the fingerprint: longer keys for more records, as many segments as the recall asks for."""
    width = WIDTH + max(0, math.ceil(math.log10(max(records, 1) / RECORDS)))
    meets = threshold**width + width * threshold ** (width - 1) * (1 - threshold)
    return (math.ceil(math.log(1 - RECALL) / math.log(1 - meets)) if meets < 1 else 1), width


def code_distance(symbols: int, threshold: float) -> int:
    """Greatest number of differing bits of the codes of a pair at the threshold: expected number and ``LEEWAY`` deviations."""
    differ, bits = (1 - threshold) / 2, min(symbols, 128)
    return math.floor(bits * differ + LEEWAY * math.sqrt(bits * differ * (1 - differ)))


def code(prints: bytes) -> tuple[int, int]:
    """One bit of each symbol (of the first 128), as two signed 64-bit numbers."""
    bits = np.zeros(128, np.uint8)
    symbols = np.frombuffer(prints, "<u2")[:128]
    bits[: len(symbols)] = symbols & 1
    one, two = np.packbits(bits).view(">i8")
    return int(one), int(two)


def _set_key(shingles: np.ndarray, text: str) -> bytes:
    """128-bit digest of the set; of the text itself where it is shorter than a shingle."""
    return b"s" + xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b"t" + xxhash.xxh3_128_digest(text)


def fingerprints(docs: DataFrame, size: int, segments: int, width: int) -> DataFrame:
    """(doc, set_key, n, fp, c1, c2) for each row of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, multipliers = _Words(), _multipliers(segments * width)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for text in batch.column(1).to_pylist():
                    shingles = shingle_set(text, size, words)
                    prints = fingerprint(shingles, multipliers) if len(shingles) else None
                    rows.append((_set_key(shingles, text), len(shingles), prints, *(code(prints) if prints else (None, None))))
                types = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc", "set_key", "n", "fp", "c1", "c2"])

    return docs.select("doc", "text").where("text IS NOT NULL AND doc IS NOT NULL").mapInArrow(run, "doc string, set_key binary, n int, fp binary, c1 long, c2 long")


def _ball(segment: Column, width: int, number: Column) -> Column:
    """Keys of the segment's ball: one for each symbol left out."""
    keys = []
    for k in range(width):
        left = F.substring(segment, 1, 2 * k) if k else F.lit(b"")
        right = F.substring(segment, 2 * k + 3, 2 * (width - k - 1)) if k < width - 1 else F.lit(b"")
        keys.append(F.xxhash64(number, F.lit(k), left, right))
    return F.array(*keys)


def candidates(reps: DataFrame, threshold: float, segments: int, width: int) -> DataFrame:
    """(a, b) with a < b: distinct pairs of representatives that meet in the table and whose complete fingerprints are near enough."""
    number = F.col("segment")
    table = (
        reps.select("rid", "n", "c1", "c2", "fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
        .select("rid", "n", "c1", "c2", F.explode(_ball(F.col("fp").substr(number * (2 * width) + 1, F.lit(2 * width)), width, number)).alias("key"))
        .select("key", "rid", "n", "c1", "c2")
    )
    left, right = table.alias("l"), table.hint("merge").alias("r")
    fits = (F.col("l.n") >= F.col("r.n") * threshold) & (F.col("r.n") >= F.col("l.n") * threshold)
    apart = F.bit_count(F.col("l.c1").bitwiseXOR(F.col("r.c1"))) + F.bit_count(F.col("l.c2").bitwiseXOR(F.col("r.c2")))
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.rid") < F.col("r.rid")) & fits & (apart <= code_distance(segments * width, threshold))
    return left.join(right, met).select(F.col("l.rid").alias("a"), F.col("r.rid").alias("b")).distinct()


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """(rid, shingles) of (rid, set_key, text); a row whose text has another set than its class is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = []
                for rid, key, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    shingles = shingle_set(text, size, words)
                    if _set_key(shingles, text) == key:
                        kept.append((rid, shingles.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], names=["rid", "shingles"])

    return docs.mapInArrow(run, "rid long, shingles binary").dropDuplicates(["rid"])


def _exact(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs with the sets in set_a and set_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for one, two in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(common / max(1, len(x) + len(y) - common))
            result = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
            yield result.filter(pa.array(np.asarray(found, float) >= threshold))

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def similar_sets(docs: DataFrame, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc, rid) and verified links (a, b, similarity) between the classes of equal sets."""
    segments, width = layout(docs.count(), threshold)
    prints = checkpoint(fingerprints(docs, size, segments, width))
    classes = prints.groupBy("set_key").agg(F.min("doc").alias("doc"), *(F.first(c).alias(c) for c in ("n", "fp", "c1", "c2")))
    reps = checkpoint(classes.withColumn("rid", F.monotonically_increasing_id()))
    members = prints.select("doc", "set_key").distinct().join(reps.select("set_key", "rid").hint("merge"), "set_key").select("doc", "rid")
    near = checkpoint(candidates(reps.where("fp IS NOT NULL"), threshold, segments, width))
    wanted = near.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(reps.select("rid", "set_key", "doc").hint("merge"), "rid")
    texts = docs.select("doc", "text").where("text IS NOT NULL").join(broadcast_if_small(wanted), "doc").select("rid", "set_key", "text")
    sets = _shingles(texts, size)
    one, two = (sets.select(F.col("rid").alias(k), F.col("shingles").alias(f"set_{k}")).hint("merge") for k in "ab")
    return members, checkpoint(_exact(near.join(one, "a").join(two, "b"), threshold))


def similar_pairs(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b: all pairs of documents at or above the threshold, copies expanded."""
    members, links = similar_sets(docs, threshold, size)
    one, two = members.select(F.col("doc").alias("x"), F.col("rid").alias("a")), members.select(F.col("doc").alias("y"), F.col("rid").alias("b"))
    across = links.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    within = one.join(two.hint("merge"), (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"))
    return across.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b), by label hooking with pointer jumping; each round is checkpointed.

    Each node takes the least label of its neighbours, then its label's label.
    A root that many nodes share is looked up by broadcast (``session.lookup``),
    so a giant component does not meet in one task.
    """
    edges = checkpoint(links.select("a", "b").where("a <> b").distinct())
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    hot = hot_keys(both, "other")
    labels = checkpoint(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = lookup(both, labels.toDF("other", "least"), "other", hot).groupBy("node").agg(F.min("least").alias("least"))
        hooked = labels.join(near.hint("merge"), "node").select("node", F.least("root", "least").alias("root"), (F.col("least") < F.col("root")).alias("moved"))
        hooked = checkpoint(hooked)
        jumped = lookup(hooked, hooked.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", hot_keys(hooked, "root"))
        now = checkpoint(jumped.select("node", F.least("root", "up").alias("root"), (F.col("moved") | (F.col("up") < F.col("root"))).alias("moved")))
        labels = now.select("node", "root")
        if now.where("moved").isEmpty():
            return labels


def duplicate_groups(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """(doc, class_id, group_id, n_links): one row for each document; n_links counts linked classes other than its own."""
    members, links = similar_sets(docs, threshold, size)
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("n_links"))
    roots = components(links).withColumnsRenamed({"node": "rid", "root": "group_id"})
    return (
        members.join(degree.hint("merge"), "rid", "left")
        .join(roots.hint("merge"), "rid", "left")
        .select("doc", F.col("rid").alias("class_id"), F.coalesce("group_id", "rid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
