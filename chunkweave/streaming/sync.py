"""Incremental synchronisation: one changed node, many, or a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.operators import graph
from chunkweave.operators.chunks import chunk_windows, published, usable
from chunkweave.session import stage
from chunkweave.sources import store
from chunkweave.sources.store import with_neighbours, without_nodes


def resync(changed: DataFrame, nodes: DataFrame, stored: DataFrame, enrich: Callable[[DataFrame], DataFrame], threshold: float = config.FALLBACK_THRESHOLD) -> DataFrame:
    """The new chunks of the changed nodes, with neighbours in the store without those nodes.

    ``changed(nid)``; ``enrich`` adds ``entities`` and ``vector``. An unpublished or deleted node gives
    no chunks, which removes it. Edges that point at deleted chunks stay and dangle.
    """
    # any type of node may be asked for by id, only published ones come
    ids = changed.select("nid").where("nid is not null").distinct()
    fresh = nodes.join(ids, "nid", "left_semi")
    rows = _export(fresh)
    new = stage(enrich(chunk_windows(rows)), "new")
    edges = graph.incremental(new, without_nodes(stored, ids), threshold)
    return with_neighbours(new, graph.neighbour_lists(edges))


def _export(nodes: DataFrame) -> DataFrame:
    """Current published nodes of any type, in the form of the export."""
    return published(nodes.withColumn("type", F.lit("topic")))


def apply(changed: DataFrame, nodes: DataFrame, path: str, enrich: Callable[[DataFrame], DataFrame]) -> None:
    """Bring a built store (see ``build.build_graph``) up to date with the changed nodes (``nid``).

    The nodes' old chunks are deleted and their new ones, with neighbours among the others at the stored
    corpus threshold, take their place; only the buckets of those nodes are rewritten. Edges of other
    chunks to deleted ones stay and dangle. Applying the same change twice gives the same chunks.
    """
    spark = nodes.sparkSession
    threshold = store.load_threshold(spark, f"{path}/threshold")
    stored = store.read(spark, f"{path}/chunks")
    new = resync(changed, nodes, stored.withColumn("vector", F.when(usable("vector"), F.col("vector"))), enrich, threshold)
    store.change_nodes(spark, f"{path}/chunks", changed, stage(new, "synced"))


def watch(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch of changed nids (Parquet files in ``folder``) to ``apply``.

    Batches are applied exactly once per batch id if ``apply`` is idempotent for it; it takes all
    files there are and stops.
    """
    changes = spark.readStream.schema(schema).parquet(folder)
    return (
        changes.writeStream.foreachBatch(lambda df, i: apply(df.select("nid").distinct(), i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
