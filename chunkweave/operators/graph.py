"""The chunk graph: candidate edges, their scores and types, the pruning threshold, neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.functions import scoring as sc
from chunkweave.operators import knn
from chunkweave.operators.stats import percentile
from chunkweave.session import stage


def score_candidates(near: DataFrame, chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Scored, typed edges from ``near(query, id, score, rank)`` and the chunks' entities and keywords.

    ``src, dst, ann_rank, cosine, ent_jaccard, kw_jaccard, score, edge_type``. Edges are directed, and
    the type is read from the source's entities. Ids without a chunk drop out. ``sources`` are the
    chunks of the queries where they are not among ``chunks``.
    """
    facts = lambda df, p: df.select(F.col("chunk_id").alias(p), F.col("entities").alias(f"{p}_e"), F.col("keywords").alias(f"{p}_k"))
    pairs = near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("ann_rank"), F.col("score").alias("cosine"))
    both = pairs.join(facts(chunks if sources is None else sources, "src"), "src").join(facts(chunks, "dst"), "dst")
    both = both.select(
        "src", "dst", "ann_rank", "cosine", sc.jaccard(F.col("src_e"), F.col("dst_e")).alias("ent_jaccard"),
        sc.jaccard(F.col("src_k"), F.col("dst_k")).alias("kw_jaccard"), sc.classify_edge(F.col("src_e"), F.col("dst_e")).alias("edge_type"),
    )
    return both.withColumn("score", sc.edge_score(F.col("cosine"), F.col("ent_jaccard"), F.col("kw_jaccard")))


def exact_candidates(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidate edges of a stated set of source chunks against all chunks, exactly."""
    asked = sources.where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("query"), "vector")
    rows = chunks.where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector")
    near = knn.exact_search(asked, rows, config.NEIGHBOURS)
    return score_candidates(near, chunks, sources)


def all_candidates(chunks: DataFrame, probes: int = 6) -> DataFrame:
    """Candidate edges of all chunks by the index; written once, since they are used twice."""
    rows = chunks.where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector")
    return stage(score_candidates(knn.index_search(rows, config.NEIGHBOURS, probes), chunks), "candidates")


def prune(candidates: DataFrame, threshold: float | None = None, q: float = config.PRUNE_PERCENTILE) -> DataFrame:
    """The edges that score at least the threshold: given, or the percentile of all candidates."""
    if threshold is None:
        threshold = percentile(candidates, "score", q)
    return candidates.where(F.col("score") >= F.lit(threshold)) if threshold is not None else candidates


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """``chunk_id, neighbors``: packed 'TYPE:chunk_id', in the order of the search, at most ten."""
    ordered = F.array_sort(F.collect_list(F.struct("ann_rank", "edge_type", "dst")))
    packed = F.transform(ordered, lambda x: F.substring(F.concat(x["edge_type"], F.lit(":"), x["dst"]), 1, 220))
    return edges.groupBy(F.col("src").alias("chunk_id")).agg(packed.alias("neighbors"))


def build(chunks: DataFrame, probes: int = 6) -> DataFrame:
    """The whole graph: candidates of all chunks, pruned at the corpus percentile."""
    return prune(all_candidates(chunks, probes))


def score_range(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def with_neighbours(edges: DataFrame) -> DataFrame:
    """How many chunks keep at least one edge, and how many edges there are."""
    return edges.agg(F.countDistinct("src").alias("n_chunks"), F.count("*").alias("n_edges"))


def resolve_types(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: a neighbour reached in several ways keeps its most telling edge type."""
    best = F.max_by("edge_type", F.struct(sc.priority(F.col("edge_type")), F.col("edge_type")))
    return found.groupBy(*keys).agg(best.alias("edge_type"))


def incremental(new: DataFrame, stored: DataFrame, threshold: float = config.FALLBACK_THRESHOLD) -> DataFrame:
    """Edges of new chunks to the stored ones, at a fixed threshold.

    New chunks get no edges to each other, and stored chunks none to them, as the store is searched
    before the new chunks are in it. The new chunks are the stated query set.
    """
    return prune(exact_candidates(new, stored), threshold)
