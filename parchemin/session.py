"""Session defaults, table access, shared checkpoints and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast after it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows beyond which one key of a looked-up side is taken out of the shuffle.
HOT_ROWS = 1_000_000


def build_session(app: str = "parchemin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans assume: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Projections after a shuffle of few bytes are long here, so small partitions are worth a task.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that tell the rows of the tables with repeated rows apart.
KEYS = {"chunks": ["chunk_id"], "rag_responses": ["query_id"], "ranked_chunks": ["query_id", "chunk_id"], "doc_metadata": ["url_hash", "scraped_at", "content_hash"]}


def unique(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table without its repeated rows, which are equal in every column.

    Rows are told apart by their key, so that only the key and the columns that
    a query uses are read and shuffled.
    """
    return table(spark, sf_dir, name).dropDuplicates(KEYS[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and written tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Where
    the setting is absent a temporary folder serves a local session (tests); on
    a cluster that folder would lie on single machines, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="parchemin-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder: for texts, which a checkpoint would not compress, and of which later reads need only some columns."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(name))), F.lit(0)) * 2
    return F.lit(8)


def measured(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` as a checkpoint, and whether it has at most ``limit`` rows and ``limit_bytes`` bytes."""
    kept = checkpoint(df)
    row = sum((_width(f.name, f.dataType) for f in kept.schema), F.lit(8))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return kept, rows <= limit and size <= limit_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Checkpoint and measure ``df``; a broadcast where it is small, otherwise a sort-merge join.

    The second hint keeps the planner from a broadcast of its own, which it
    would base on an estimate that counts neither exploded nor Python rows.
    """
    kept, small = measured(df, limit, limit_bytes)
    return F.broadcast(kept) if small else kept.hint("merge")


def hot_keys(df: DataFrame, on: str, rows: int = HOT_ROWS) -> DataFrame | None:
    """The values of ``on`` with more than ``rows`` rows, at most a ``rows``-th of all; None where there is none."""
    keys = checkpoint(df.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(on))
    return None if keys.isEmpty() else broadcast_if_small(keys)


def lookup(df: DataFrame, values: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``df`` with ``values``, which has one row for each key.

    The rows of the keys in ``hot`` stay where they are and get their value by
    broadcast, so that no key meets in one task; the others are shuffled.
    """
    if hot is None:
        return df.join(values.hint("merge"), on)
    often = df.join(hot, on, "left_semi").join(broadcast_if_small(values.join(hot, on, "left_semi")), on)
    return often.unionByName(df.join(hot, on, "left_anti").join(values.hint("merge"), on))
