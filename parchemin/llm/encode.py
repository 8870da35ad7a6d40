"""Token ids of the whole corpus by a public byte-level BPE (problem 7).

Prefix dynamic programming: the BPE encoding of every byte prefix of a word has
one last token, and it is the only token that ends there and may follow the
last token of the prefix before it.  The table of these last tokens gives the
encoding of every prefix, so bytes may be appended without encoding again what
stands before them, and an edit needs the table again only from the edited
word on.

Words are those of the tokenizer's pattern; a table is built once for each
distinct word that a worker meets and kept while there is room.

Defined results: an empty or null text has no ids; special tokens' strings are
ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The folder of the public tokenizers' files; a parameter everywhere.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KEPT = 400_000


class PrefixEncoder:
    """Exact BPE by the last token of each prefix."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY):
        self.ranks: dict[bytes, int] = {}
        with open(f"{folder}/{vocabulary}", "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _merged_from(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: the last step of encoding its own bytes."""
        if rank not in self.parts:
            token, found = self.tokens[rank], None
            if len(token) > 1:
                pieces = [self.ranks[token[i : i + 1]] for i in range(len(token))]
                while len(pieces) > 2:
                    merges = [self.ranks.get(self.tokens[a] + self.tokens[b], rank) for a, b in zip(pieces, pieces[1:], strict=False)]
                    at = min(range(len(merges)), key=merges.__getitem__)
                    if merges[at] >= rank:
                        break
                    pieces[at : at + 2] = [merges[at]]
                found = tuple(pieces) if len(pieces) == 2 else None
            self.parts[rank] = found
        return self.parts[rank]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens: walking down the merges at their border, no earlier merge would cross it."""
        key = (left, right)
        known = self.follows.get(key)
        if known is not None:
            return known
        limit, a, b, result = 1 << 31, left, right, True
        while True:
            crossing = self.ranks.get(self.tokens[a] + self.tokens[b])
            if crossing is not None and crossing < limit:
                result = False
                break
            if a > b:
                limit = a
                parts = self._merged_from(a)
                if parts is None:
                    limit = b + 1
                    parts_b = self._merged_from(b)
                    if parts_b is None:
                        break
                    b = parts_b[0]
                else:
                    a = parts[1]
                    if a == limit:
                        break
            else:
                limit = b + 1
                parts = self._merged_from(b)
                if parts is None:
                    limit = a
                    parts_a = self._merged_from(a)
                    if parts_a is None:
                        break
                    a = parts_a[1]
                else:
                    b = parts[0]
        if len(self.follows) < _KEPT:
            self.follows[key] = result
        return result

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` (the last token of each prefix known so far) the last tokens of the remaining prefixes."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and self._is_whole(token) and (start == 0 or self.may_follow(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def _is_whole(self, token: int) -> bool:
        """A token that its own bytes are encoded as; others never come out of merging."""
        return len(self.tokens[token]) == 1 or self._merged_from(token) is not None

    def ids_of(self, last: list[int]) -> list[int]:
        """Walk the table back from its end."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        out.reverse()
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern; a word that is a token is known without a table."""
        ids = self.words.get(word)
        if ids is None:
            ids = tuple(self.ids_of(self.extend(word.encode(), [])))
            if len(self.words) >= _KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, extend, word = self.words.get, out.extend, self.word
        for x in self.split(text or ""):
            extend(known(x) or word(x))
        return out

    def count(self, text: str | None) -> int:
        known, word = self.words.get, self.word
        return sum(len(known(x) or word(x)) for x in self.split(text or ""))


class PrefixTable:
    """A text with the last token of every prefix of each of its words, for appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.words, self.tables = encoder, [], []
        self._grow(text)

    def _grow(self, text: str) -> None:
        for word in self.encoder.split(text):
            self.words.append(word)
            self.tables.append(self.encoder.extend(word.encode(), []))

    def append(self, more: str) -> None:
        """The last two words may change where the pattern looks ahead over white space; a last word that only grows keeps its table."""
        tail, tables = self.words[-2:], self.tables[-2:]
        del self.words[-2:], self.tables[-2:]
        fresh = self.encoder.split("".join(tail) + more)
        for k, word in enumerate(fresh):
            kept = list(tables[k]) if k < len(tail) and word.startswith(tail[k]) else []
            self.words.append(word)
            self.tables.append(self.encoder.extend(word.encode(), kept))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end: tables of words before and, once the split agrees again, after the edit are kept."""
        old, tables = self.words, self.tables
        text = "".join(old)
        fresh = self.encoder.split(text[:start] + new + text[end:])
        known = dict(zip(old, tables, strict=True))
        self.words, self.tables = fresh, [known[w] if w in known else self.encoder.extend(w.encode(), []) for w in fresh]

    def ids(self) -> list[int]:
        return [x for t in self.tables for x in self.encoder.ids_of(t)]


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> PrefixEncoder:
    """One encoder for each worker process."""
    key = (folder, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(folder, vocabulary)
    return _ENCODERS[key]


def encode_documents(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            # Ids are handed on in slices, so that a batch of long texts needs no second copy.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, *keep: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with ``n_tokens`` of ``text`` in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, vocabulary)
        for batch in batches:
            counts = pa.array([own.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, n_tokens long")
