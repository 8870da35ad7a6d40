"""Splitting oversized sections at natural boundaries by structure-tree packing (problem 1).

A text is parsed into a tree: headings open sections that nest by level, a
section holds paragraphs, lists and tables (runs of lines of one kind), these
hold lines, lines hold sentences, sentences hold words.  Sibling subtrees are
merged bottom-up while they fit; only nodes above the limit are descended into,
so a cut falls at the highest boundary that allows it.  A single word is never
cut.

Pieces are slices of the text: dropping each piece's shared words and joining
the rest gives the text back exactly.  Every piece after the first starts with
the last ``overlap`` words before its own part.

Defined results: a text of at most ``limit`` words is one piece, the text
itself; a null text gives one piece with null text, an empty text one empty
piece; repeated rows of a chunk count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 50
#: Two sides of a section's border stay apart if both hold at least this part of the limit (one fourth).
ALONE = 4
#: The characters of Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^{WHITE}]+")
HEADING = re.compile(r"(#{1,6})\s+\S")
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)[.)]?\s+[^\W\d_]")
ITEM = re.compile(r"\s*(?:[-*•–◦‣]|\d{1,3}[.)]|[a-z]\))\s+\S")
ROW = re.compile(r".*\s\|\s.*|\s*\|.*")
SENTENCE = re.compile(r"(?<=[.!?…;:])[\"'»”)\]]*\s+")


@dataclass
class Node:
    """A slice of the text with the nodes it consists of; ``headed`` if it begins with a heading, ``heading`` if it is one."""

    start: int
    end: int
    words: int
    children: list[Node] = field(default_factory=list)
    headed: bool = False
    heading: bool = False


def word_count(text: Column) -> Column:
    """Words by the definition above; 0 for an empty text."""
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+"))


def _leaf(text: str, start: int, end: int) -> Node:
    return Node(start, end, sum(1 for _ in WORD.finditer(text, start, end)))


def _cut(text: str, start: int, end: int, at: list[int]) -> list[tuple[int, int]]:
    edges = [start, *(x for x in at if start < x < end), end]
    return list(zip(edges, edges[1:], strict=False))


def _sentences(text: str, node: Node, limit: int) -> None:
    """Give a node above the limit its sentences, and those above it their words."""
    spans = _cut(text, node.start, node.end, [m.end() for m in SENTENCE.finditer(text, node.start, node.end)])
    for start, end in spans:
        child = _leaf(text, start, end)
        if child.words > limit:
            words = [m.start() for m in WORD.finditer(text, start, end)][1:]
            child.children = [Node(a, b, 1) for a, b in _cut(text, start, end, words)]
        node.children.append(child)


def _level(line: str) -> int:
    """Depth of a heading line, 0 for other lines."""
    if m := HEADING.match(line):
        return len(m[1])
    bare = line.strip()
    if not bare or len(bare) > 120 or bare[-1] in ".;,:!?…|" or ITEM.match(line) or ROW.match(line):
        return 0
    if m := NUMBERED.match(bare):
        return 2 + m[1].count(".")
    return 7 if bare[0].isupper() and len(bare.split()) <= 14 else 0


def tree(text: str, limit: int) -> Node:
    """The structure tree of a text; leaves are lines, or finer where a line is above the limit."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line))
        at += len(line)
    root = Node(0, len(text), 0)
    path: list[tuple[int, Node]] = [(0, root)]
    block, kind = None, ""
    for start, end, line in lines:
        leaf = _leaf(text, start, end)
        if leaf.words > limit:
            _sentences(text, leaf, limit)
        level = _level(line)
        now = "blank" if not line.strip() else "heading" if level else "item" if ITEM.match(line) else "row" if ROW.match(line) else "text"
        if level:
            while path[-1][0] >= level:
                path.pop()
            section = Node(start, end, 0, headed=True)
            path[-1][1].children.append(section)
            path.append((level, section))
            section.children.append(block := Node(start, end, 0, [leaf], True, True))
        elif now == "blank" and block:
            block.children.append(leaf)
        elif block is None or now != kind or kind == "heading":
            path[-1][1].children.append(block := Node(start, end, 0, [leaf]))
        else:
            block.children.append(leaf)
        kind = "" if now == "blank" else now
    return _measured(root)


def _measured(node: Node) -> Node:
    """Fill in ends and word counts from the leaves; iterative, as headings may nest as deep as the text wishes."""
    order, stack = [], [node]
    while stack:
        order.append(x := stack.pop())
        stack.extend(c for c in x.children if c.words == 0 or c.children)
    for x in reversed(order):
        if x.children:
            x.words, x.end = sum(c.words for c in x.children), max(x.end, x.children[-1].end)
    return node


def _merged(units: list[Node], limit: int) -> list[Node]:
    """Merge neighbours while their sum fits; not over the border of a section when both sides are large enough to stand alone (an ``ALONE``-th of the limit)."""
    out: list[Node] = []
    for unit in units:
        apart = unit.headed and out and min(out[-1].words, unit.words) * ALONE >= limit
        if out and not apart and out[-1].words + unit.words <= limit:
            out[-1] = Node(out[-1].start, unit.end, out[-1].words + unit.words, [*out[-1].children, unit] if len(out[-1].children) else [out[-1], unit], out[-1].headed)
        else:
            out.append(unit)
    return out


def pack(node: Node, limit: int, text: str) -> list[Node]:
    """Units of at most ``limit`` words: siblings merged bottom-up, oversized nodes descended into; a heading stays with what follows it."""
    if node.words <= limit or not node.children:
        return [node]
    units: list[Node] = []
    heading: Node | None = None
    for child in node.children:
        if child.heading and child.words < limit:
            heading = child if heading is None else Node(heading.start, child.end, heading.words + child.words, [heading, child], True, True)
            if heading.words >= limit:
                units.append(heading)
                heading = None
            continue
        found = [child] if child.words <= limit else pack(child, limit, text)
        if heading:
            first = found[0]
            if heading.words + first.words > limit:
                # The unit after the heading is cut once more, so that its beginning fits beside the heading.
                cut = Node(first.start, first.end, first.words)
                _sentences(text, cut, limit - heading.words)
                found[:1] = pack(cut, limit - heading.words, text)
            if heading.words + found[0].words <= limit:
                found[0] = Node(heading.start, found[0].end, heading.words + found[0].words, [heading, found[0]], True)
            else:
                found.insert(0, heading)
            heading = None
        units.extend(found)
    return _merged([*units, heading] if heading else units, limit)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(piece, its words, words shared with the piece before) in order."""
    starts = [m.start() for m in WORD.finditer(text)]
    if len(starts) <= limit:
        return [(text, len(starts), 0)]
    body = limit - overlap
    units = pack(tree(text, body), body, text)
    cuts, total = [], 0
    for unit in units:
        cuts.append(total)
        total += unit.words
    # The first piece must hold the words that the second one shares, so a shorter one takes words from its neighbour.
    while len(cuts) > 1 and cuts[1] < overlap:
        following = cuts[2] if len(cuts) > 2 else len(starts)
        if following <= limit:
            cuts.pop(1)
        else:
            ends = {m.end() for m in SENTENCE.finditer(text)}
            bounds = [k for k in range(max(overlap, following - body), min(limit, following - 1) + 1) if starts[k] in ends]
            cuts[1] = bounds[0] if bounds else max(overlap, following - body)
    out = []
    for k, first in enumerate(cuts):
        last = cuts[k + 1] if k + 1 < len(cuts) else len(starts)
        shared = overlap if k else 0
        begin = starts[first - shared] if k else 0
        end = starts[last] if last < len(starts) else len(text)
        out.append((text[begin:end], last - first + shared, shared))
    return out


PIECES = "chunk_id string, chunk_index string, piece_no int, n_pieces int, n_words int, n_shared int, text string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (from 1) of the chunks above the limit; the word count runs in the JVM, so Python sees only those chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for chunk_id, index, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = pieces(text, limit, overlap)
                rows.extend((chunk_id, index, k, len(found), n, shared, piece) for k, (piece, n, shared) in enumerate(found, 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    large = oversized(chunks, limit).dropDuplicates(["chunk_id"])
    return large.mapInArrow(run, PIECES)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks with more words than the limit; a text shorter than that many words and spaces isn't counted."""
    return chunks.select("chunk_id", "chunk_index", "text").where((F.length("text") > 2 * limit) & (word_count(F.col("text")) > limit))


def split_all(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all chunks; those within the limit stay in the JVM as one piece."""
    words = F.when(F.col("text").isNotNull(), word_count(F.col("text")))
    counted = chunks.select("chunk_id", "chunk_index", "text").withColumn("n_words", words).dropDuplicates(["chunk_id"])
    whole = counted.where(F.coalesce("n_words", F.lit(0)) <= limit).select(
        "chunk_id", "chunk_index", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.lit(0).alias("n_shared"), "text"
    )
    return whole.unionByName(split_oversized(chunks, limit, overlap))
