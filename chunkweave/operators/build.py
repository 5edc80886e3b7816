"""The full build: nodes to windows, entities and vectors, neighbours, and a store that searches read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.operators import graph, knn
from chunkweave.operators.chunks import chunk_windows, published, usable
from chunkweave.operators.stats import percentile
from chunkweave.sources import store


def build_graph(nodes: DataFrame, path: str, enrich: Callable[[DataFrame], DataFrame], model: str, resume: bool = False, probes: int = 6) -> DataFrame:
    """Build the graph of all published topics under ``path`` and return its chunks with neighbours.

    ``enrich`` adds ``entities`` (packed) and ``vector`` to chunks; ``model`` names it. Under ``path``
    lie ``chunks`` (the store, replaced), ``index`` (cells of the vectors), ``threshold`` (the corpus
    percentile that pruned the edges). Each step is written under a fingerprint of the nodes, the model
    and the parameters; with ``resume`` steps of the same fingerprint are taken up again, and a store with
    rows is left alone if no step is there to rebuild it from. No nodes give an empty store.
    """
    spark = nodes.sparkSession
    state = nodes.agg(F.count("*"), F.sum(F.xxhash64("nid", "changed_at", "body").cast("decimal(38,0)"))).first()
    key = store.fingerprint(model, probes, config.CHUNK_WORDS, config.NEIGHBOURS, list(state))
    steps = store.Stages(spark, store.fingerprint(path))
    if not resume:
        steps.clear()
    elif not store.may_rebuild(spark, f"{path}/chunks", True, steps.has("windows", key)):
        return store.read(spark, f"{path}/chunks")
    windows = steps.run("windows", key, lambda: chunk_windows(published(nodes)))
    full = steps.run("enriched", key, lambda: enrich(windows))
    rows = full.where(usable("vector")).select(F.col("chunk_id").alias("id"), "vector")
    knn.build_index(rows, f"{path}/index", probes)
    near = steps.run("candidates", key, lambda: graph.score_candidates(knn.search_index(spark, f"{path}/index", config.NEIGHBOURS), full))
    threshold = percentile(near, "score", config.PRUNE_PERCENTILE)
    store.save_threshold(spark, config.FALLBACK_THRESHOLD if threshold is None else threshold, f"{path}/threshold")
    lists = graph.neighbour_lists(graph.prune(near, threshold))
    store.create(spark, f"{path}/chunks", recreate=True)
    store.insert(store.with_neighbours(full, lists), f"{path}/chunks")
    return store.read(spark, f"{path}/chunks")
