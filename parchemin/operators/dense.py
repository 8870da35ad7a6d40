"""Exact nearest neighbours of a stated query set, in blocks of queries.

A block of queries is a small matrix sent to every task; each Arrow batch is
multiplied with it and only what may be among the k best of its task for a query
leaves it, so what is shuffled is k rows for each query and task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block: bounds what is collected and sent at once.
BLOCK = 4096


def _block(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The k least distances so far of each query: what is farther is none of the task's k best.
        least = np.full((len(ids), k), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.array(batch.column(1).to_pylist(), np.float64)
            for at in range(0, len(ids), 256):
                distance, most = 1.0 - rows @ matrix[at : at + 256].T, least[at : at + 256, -1]
                if len(rows) > k and np.isinf(most).any():
                    most = np.minimum(most, np.partition(distance, k - 1, axis=0)[k - 1])
                # As distances are rounded, those within the last digit may tie.
                query, row = np.nonzero((distance <= most + 1e-6).T)
                near = np.round(distance[row, query], 6)
                order = np.lexsort((keys[row], near, query))
                query, row, near = query[order], row[order], near[order]
                first = np.arange(len(query)) - np.searchsorted(query, query) < k
                query, row, near = query[first], row[first], near[first]
                for q, start, end in zip(*np.unique(query, return_index=True), [*np.unique(query, return_index=True)[1][1:], len(query)], strict=True):
                    least[at + q] = np.sort(np.concatenate([least[at + q], near[start:end]]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + query]), pa.array(keys[row]), pa.array(near)], names=["query_id", "key", "distance"])

    return vectors.mapInArrow(run, "query_id long, key long, distance double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(query_id, key, distance, rank): the k least cosine distances of unit vectors; both tables are (key, embedding).

    Null vectors are left out; ties are broken by key; no queries give no rows.
    Each task gives k rows for each query; ``tasks`` is how many there are at most.
    """
    vectors = vectors.select("key", "embedding").where("embedding IS NOT NULL")
    vectors = vectors if tasks is None else vectors.coalesce(tasks)
    queries = queries.select("key", "embedding").where("embedding IS NOT NULL")
    blocks = -(-queries.count() // block)
    found = None
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).orderBy("key").collect()
        if rows:
            part = _block(vectors, np.array([r.key for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, key long, distance double, rank int")
    best = Window.partitionBy("query_id").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
