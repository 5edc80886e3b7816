"""Reading the project's tables and the views of them that most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the row with the greatest ``stamp`` (null stamps are the oldest).

    A grouped ``max_by`` combines on the map side, so a key that holds a third of all rows never
    meets one sort. Rows whose key is null are dropped. Rows that tie on the stamp are told apart
    by a hash of their values, so the result doesn't depend on partitions; only the named columns
    are read from the scan.
    """
    row = F.struct(*columns)
    order = F.struct(F.col(stamp).isNotNull(), F.col(stamp), F.xxhash64(*columns))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(row, order).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in columns])
    )


def current_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The current revision of each nid: the row with the latest ``changed_at``."""
    return latest(nodes, "nid", "changed_at", columns)


def current_chunks(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Each chunk_id once: the row written last, by ``synced_at``."""
    return latest(chunks, "chunk_id", "synced_at", columns)
