"""Model calls behind one interface, with deterministic defaults that need neither network nor weights.

A provider is made once for each worker process; rows reach it in Arrow
batches.  Work is done once for each distinct input.
"""

from __future__ import annotations

import json
import re
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .. import vocab

_TOKEN = re.compile(vocab.TOKEN)
_STOP = frozenset(vocab.STOP_WORDS)


def tokens(text: str | None) -> list[str]:
    return [t for t in _TOKEN.findall((text or "").lower()) if len(t) > 1 and t not in _STOP]


class Provider(ABC):
    """What the pipelines ask of a model."""

    @abstractmethod
    def generate(self, prompts: list[str], context: list[str]) -> list[str]:
        """An answer to each prompt from its context."""

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one row for each text."""

    @abstractmethod
    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        """Relevance of each text to its query, 0 to 1."""

    def available(self) -> bool:
        return True


class Deterministic(Provider):
    """Extractive answers, hashed bag-of-tokens vectors, and token overlap as relevance."""

    def __init__(self, dimensions: int = 64, sentences: int = 2):
        self.dimensions, self.sentences = dimensions, sentences

    def generate(self, prompts: list[str], context: list[str]) -> list[str]:
        out = []
        for prompt, text in zip(prompts, context, strict=True):
            asked = set(tokens(prompt))
            parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
            best = sorted(range(len(parts)), key=lambda k: (-len(asked & set(tokens(parts[k]))), k))[: self.sentences]
            out.append(" ".join(parts[k] for k in sorted(best)))
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for token in tokens(text):
                value = xxhash.xxh3_64_intdigest(token)
                row[value % self.dimensions] += 1.0 if value >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for query, text in zip(queries, texts, strict=True):
            asked = set(tokens(query))
            out.append(len(asked & set(tokens(text))) / len(asked) if asked else 0.0)
        return out


class Http(Deterministic):
    """Generation by a server that takes ``{"prompt", "context"}`` and gives ``{"text"}``; vectors and scores stay deterministic."""

    def __init__(self, url: str, timeout: float = 60.0, **options: int):
        super().__init__(**options)
        self.url, self.timeout = url, timeout

    def generate(self, prompts: list[str], context: list[str]) -> list[str]:
        out = []
        for prompt, text in zip(prompts, context, strict=True):
            body = json.dumps({"prompt": prompt, "context": text}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                out.append(json.load(reply)["text"])
        return out

    def available(self) -> bool:
        try:
            urllib.request.urlopen(self.url, timeout=2).close()
        except OSError:
            return False
        return True


Maker = Callable[[], Provider]
_MADE: dict[str, Provider] = {}


def _own(make: Maker, name: str) -> Provider:
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def _apply(df: DataFrame, inputs: list[str], keep: list[str], output: str, run: Callable[[Provider, list[list]], list], make: Maker, kind: pa.DataType, name: str) -> DataFrame:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = _own(make, name)
        for batch in source:
            values = run(provider, [[v or "" for v in batch.column(c).to_pylist()] for c in inputs])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values, kind)], names=[*keep, output.split()[0]])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), output])
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(batches, schema)


def with_embedding(df: DataFrame, text: str, keep: list[str], make: Maker = Deterministic, name: str = "default") -> DataFrame:
    """The kept columns and ``embedding`` of the text; a null text has the zero vector."""
    return _apply(df, [text], keep, "embedding array<double>", lambda p, v: list(p.embed(v[0])), make, pa.list_(pa.float64()), name)


def with_score(df: DataFrame, query: str, text: str, keep: list[str], make: Maker = Deterministic, name: str = "default") -> DataFrame:
    return _apply(df, [query, text], keep, "rerank_score double", lambda p, v: p.score(v[0], v[1]), make, pa.float64(), name)


def with_answer(df: DataFrame, prompt: str, context: str, keep: list[str], make: Maker = Deterministic, name: str = "default") -> DataFrame:
    return _apply(df, [prompt, context], keep, "answer string", lambda p, v: p.generate(v[0], v[1]), make, pa.string(), name)
