"""Documents to chunks over Arrow batches, and other row-wise folds that expressions can't hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import html as H


def explode_rows(df: DataFrame, columns: list[str], expand: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of ``expand(*columns)`` for each row; results leave in batches, so one row may give any number."""
    out = [part.strip() for part in schema.split(",")]
    names = [part.split()[0] for part in out]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[part.split()[1]] for part in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(batch.column(c).to_pylist() for c in range(len(columns))), strict=True):
                rows.extend(expand(*values))
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """(key, chunk_no, heading, text) of (key, html); tables become sentences."""

    def expand(key: str, html: str | None) -> list[tuple]:
        parts = []
        for section in H.sections(html):
            if section["rows"]:
                for zone in C.zones(section["rows"]):
                    for part in C.sub_zones(zone):
                        text = C.as_sentences(C.zone_text(part, section["heading"]))
                        parts += [(x, section["heading"]) for x in C.by_paragraph(text) if C.n_words(x) >= 10]
            else:
                parts.append((section["text"], section["heading"]))
        return [(key, k, heading, text) for k, (text, heading) in enumerate(C.processed(parts))]

    return explode_rows(pages, ["key", "html"], expand, "key string, chunk_no int, heading string, text string")


def chunk_texts(texts: DataFrame) -> DataFrame:
    """(key, chunk_no, text) of (key, text); null and blank texts give none."""

    def expand(key: str, text: str | None) -> list[tuple]:
        return [(key, k, piece) for k, (piece, _) in enumerate(C.processed([(text, "")]))] if text and text.strip() else []

    return explode_rows(texts, ["key", "text"], expand, "key string, chunk_no int, text string")


def with_ids(chunks: DataFrame, most: int = 5000) -> DataFrame:
    """Chunk ids ``{key}_{ordinal}`` and texts cut to their stored length."""
    return chunks.withColumns({"chunk_id": F.concat_ws("_", "key", "chunk_no"), "stored": F.substring("text", 1, most)})
