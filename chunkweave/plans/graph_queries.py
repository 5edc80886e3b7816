"""Queries of similarity, the graph and its upkeep.

Where a query is exact, its sources are a stated set: every chunk whose number is divisible by 20,
searched against all chunks. ``build_neighbors`` and those after it take all chunks as sources, by
the index.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave import config
from chunkweave.functions import scoring as sc
from chunkweave.operators import build, embed, entities, graph, knn
from chunkweave.operators.stats import percentile
from chunkweave.plans import views as v
from chunkweave.session import fresh
from chunkweave.sources import store
from chunkweave.sources.tables import table
from chunkweave.streaming import sync


def _siblings(s, d):
    """Each chunk beside the next one of its node."""
    rows = v.chunks(s, d, "source_nid", "vector", "entities", "keywords")
    a = rows.select("source_nid", "idx", *[F.col(c).alias(f"a_{c}") for c in ("chunk_id", "vector", "entities", "keywords")])
    b = rows.select("source_nid", (F.col("idx") - 1).alias("idx"), *[F.col(c).alias(f"b_{c}") for c in ("chunk_id", "vector", "entities", "keywords")])
    return a.join(b, ["source_nid", "idx"])  # a key per chunk, so a node with many chunks is no hot key


def dot_product(s, d):
    x = _siblings(s, d)
    return x.select(F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"), F.round(sc.dot(F.col("a_vector"), F.col("b_vector")), 6).alias("dot"))


def cosine(s, d):
    x = _siblings(s, d)
    return x.select(F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"), F.round(sc.cosine(F.col("a_vector"), F.col("b_vector")), 6).alias("cosine"))


def jaccard(s, d):
    x = _siblings(s, d)
    return x.select(
        F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"), F.round(sc.jaccard(F.col("a_entities"), F.col("b_entities")), 6).alias("ent_jaccard"),
        F.round(sc.jaccard(F.col("a_keywords"), F.col("b_keywords")), 6).alias("kw_jaccard"),
    )


def edge_score(s, d):
    x = _siblings(s, d)
    score = sc.edge_score(sc.cosine(F.col("a_vector"), F.col("b_vector")), sc.jaccard(F.col("a_entities"), F.col("b_entities")), sc.jaccard(F.col("a_keywords"), F.col("b_keywords")))
    return x.select(F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"), F.round(score, 6).alias("score"))


def classify_edge(s, d):
    x = _siblings(s, d)
    kind = sc.classify_edge(F.col("a_entities"), F.col("b_entities"))
    return x.select(F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"), kind.alias("edge_type"), sc.priority(kind).alias("priority"))


def entity_overlap(s, d):
    x = _siblings(s, d)
    return x.where(F.arrays_overlap("a_entities", "b_entities")).select(F.col("a_chunk_id").alias("src"), F.col("b_chunk_id").alias("dst"))


def knn_join(s, d):
    rows = v.stored_chunks(s, d, "vector").where(F.col("vector").isNotNull())
    asked = v.every_20th(rows).select(F.col("chunk_id").alias("query"), "vector")
    near = knn.exact_search(asked, rows.select(F.col("chunk_id").alias("id"), "vector"), config.NEIGHBOURS)
    return near.select(F.col("query").alias("src"), F.col("id").alias("dst"), F.round("score", 6).alias("cosine"), F.col("rank").cast("long").alias("ann_rank"))


def _rounded(df):
    for c in ("cosine", "ent_jaccard", "kw_jaccard", "score"):
        df = df.withColumn(c, F.round(c, 6))
    return df.withColumn("ann_rank", F.col("ann_rank").cast("long"))


def edge_candidates(s, d):
    return _rounded(v.candidates(s, d))


def percentile_threshold(s, d):
    """The percentile over the candidates of the stated set; ``corpus_threshold`` takes all chunks."""
    c = v.candidates(s, d)
    return graph.score_range(c).select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(F.lit(percentile(c, "score", config.PRUNE_PERCENTILE)), 6).alias("threshold"))


def filter_threshold(s, d):
    """Edges of the stated set at the fixed threshold."""
    return _rounded(graph.prune(v.candidates(s, d), config.FALLBACK_THRESHOLD))


def topk_neighbors(s, d):
    """Packed neighbour lists of the stated set, pruned at the percentile of its candidates."""
    return graph.neighbour_lists(graph.prune(v.candidates(s, d))).withColumn("neighbors", F.array_join("neighbors", "|"))


def count_with_neighbors(s, d):
    """Counts of the stated set; ``corpus_with_neighbors`` takes all chunks."""
    return graph.with_neighbours(graph.prune(v.candidates(s, d)))


def _linked_columns(s, d):
    """What edges are made of, without the texts, written once."""
    return v.stored_chunks(s, d, *v.LINKED)


def corpus_threshold(s, d):
    """The percentile over the candidates of all chunks, by the index: the one that prunes the whole graph."""
    c = graph.all_candidates(_linked_columns(s, d))
    return graph.score_range(c).select("n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(F.lit(percentile(c, "score", config.PRUNE_PERCENTILE)), 6).alias("threshold"))


def corpus_with_neighbors(s, d):
    """How many chunks of the whole graph keep an edge, and how many edges it has."""
    return graph.with_neighbours(graph.build(_linked_columns(s, d)))


def build_neighbors(s, d):
    """The whole graph by the index: every chunk's best edges, pruned at the corpus percentile."""
    return _rounded(graph.build(_linked_columns(s, d)))


def neighbor_lists(s, d):
    """The whole graph as packed lists."""
    return graph.neighbour_lists(graph.build(_linked_columns(s, d)))


def index_recall(s, d):
    """Recall of the index against exact search, over the stated set."""
    rows = v.stored_chunks(s, d, "vector").where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector", "idx")
    exact = knn.exact_search(v.every_20th(rows.withColumnRenamed("id", "query")).select("query", "vector"), rows.select("id", "vector"), config.NEIGHBOURS)
    found = knn.index_search(rows.select("id", "vector"), config.NEIGHBOURS).select("query", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query", "id"], "left")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def build_index(s, d):
    """An index of all vectors, written and kept; the rows at home in each of its cells."""
    rows = v.chunks(s, d, "vector").where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector")
    path = fresh(s, "index")
    knn.build_index(rows, path)
    return knn.cell_sizes(s, path)


def search_index(s, d):
    """The nearest chunk of each chunk, by an index that was built and kept before."""
    rows = v.chunks(s, d, "vector").where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector")
    path = fresh(s, "index")
    knn.build_index(rows, path)
    return knn.search_index(s, path, 1).select(F.col("query").alias("src"), F.col("id").alias("dst"), F.round("score", 4).alias("cosine"))


def neighbors_incremental(s, d):
    """Edges of the newest chunks (by number, a twentieth) to the rest, at the fixed threshold."""
    rows = v.stored_chunks(s, d, *v.LINKED)
    new = F.col("idx") % 20 == 0
    return _rounded(graph.incremental(rows.where(new), rows.where(~new)))


def _enrich(chunks):
    """Offline stand-ins for the models: pattern names and hashed vectors."""
    found = entities.extract(chunks.select("chunk_id", "text"), "chunk_id")
    vectors = embed.embed_texts(chunks.select("chunk_id", "text"), "chunk_id", embed.hashing())
    return chunks.join(found, "chunk_id").join(vectors, "chunk_id")


def _changed(s, d):
    """The nodes that were exported more than once."""
    return table(s, d, "nodes").groupBy("nid").agg(F.count("*").alias("n")).where("n > 1").select("nid")


def sync_incremental(s, d):
    """The new chunks of those nodes, built beside the store, with their neighbours in it."""
    new = sync.resync(_changed(s, d), table(s, d, "nodes"), v.stored_chunks(s, d, "source_nid", *v.LINKED), _enrich)
    return new.select("chunk_id", "source_nid", F.length("text").alias("n_chars"), F.size("entities").alias("n_entities"), F.size("neighbors").alias("n_neighbors"))


def sync_incremental_chunks(s, d):
    """The new chunks without what the models and the index make of them."""
    return sync_incremental(s, d).select("chunk_id", "source_nid", F.col("n_chars"))


def _store(s, d):
    """A store of the clean chunks with a threshold, as a build leaves it."""
    base = fresh(s, "graph")
    store.create(s, f"{base}/chunks")
    store.insert(v.chunks(s, d), f"{base}/chunks")
    store.save_threshold(s, config.FALLBACK_THRESHOLD, f"{base}/threshold")
    return base


def _rows_of(chunks):
    return chunks.select("chunk_id", "source_nid", F.length("text").alias("n_chars"))


def sync_applied(s, d):
    """The whole store after the changed nodes were synchronised into it."""
    base = _store(s, d)
    sync.apply(_changed(s, d), table(s, d, "nodes"), base, _enrich)
    return _rows_of(store.read(s, f"{base}/chunks"))


def sync_stream(s, d):
    """The same changes as a stream of files, applied to the store per micro-batch; the whole store after it."""
    base = _store(s, d)
    nodes = table(s, d, "nodes")
    _changed(s, d).write.parquet(f"{base}/changes")
    sync.watch(s, f"{base}/changes", "nid long", lambda changed, batch: sync.apply(changed, nodes, base, _enrich), f"{base}/progress").awaitTermination()
    return _rows_of(store.read(s, f"{base}/chunks"))


def _built(s, d):
    return build.build_graph(table(s, d, "nodes"), fresh(s, "graph"), _enrich, "stand-ins")


def build_graph(s, d):
    """Nodes to a stored graph: the chunks of the store, and whether each list of neighbours is as long as it may be."""
    return _built(s, d).select("chunk_id", "source_nid", F.length("text").alias("n_chars"), (F.size("neighbors") <= config.NEIGHBOURS).alias("capped"))


def build_graph_edges(s, d):
    """The neighbours in the built store, one row an edge."""
    return _built(s, d).select("chunk_id", F.posexplode("neighbors").alias("place", "neighbor"))


def embed_doc(s, d):
    """Hashed vectors of all chunk texts: how many are zero, and their mean length."""
    rows = embed.embed_texts(v.chunks(s, d, "text").select("chunk_id", "text"), "chunk_id", embed.hashing())
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.agg(F.count("*").alias("n"), F.sum((norm == 0).cast("long")).alias("n_zero"), F.round(F.avg(norm), 6).alias("mean_norm"))


QUERIES = {
    "dot_product": dot_product, "cosine": cosine, "jaccard": jaccard, "edge_score": edge_score, "classify_edge": classify_edge, "entity_overlap": entity_overlap,
    "knn_join": knn_join, "edge_candidates": edge_candidates, "percentile_threshold": percentile_threshold, "filter_threshold": filter_threshold,
    "topk_neighbors": topk_neighbors, "count_with_neighbors": count_with_neighbors, "corpus_threshold": corpus_threshold,
    "corpus_with_neighbors": corpus_with_neighbors, "build_neighbors": build_neighbors, "neighbor_lists": neighbor_lists,
    "index_recall": index_recall, "build_index": build_index, "search_index": search_index, "build_graph": build_graph, "build_graph_edges": build_graph_edges,
    "sync_applied": sync_applied, "neighbors_incremental": neighbors_incremental, "sync_incremental": sync_incremental, "sync_incremental_chunks": sync_incremental_chunks,
    "sync_stream": sync_stream, "embed_doc": embed_doc,
}

_CAND = v.candidates_sql("idx % 20 = 0")
_THR = "thr AS (SELECT quantile_cont(score, 0.85) AS t FROM cand)"
_COLS = "src, dst, ann_rank, round(cosine, 6) AS cosine, round(ent_jaccard, 6) AS ent_jaccard, round(kw_jaccard, 6) AS kw_jaccard, round(score, 6) AS score, edge_type"
_CHANGED = f"{v.NODES}, g AS (SELECT nid FROM nodes GROUP BY nid HAVING count(*) > 1), x AS (SELECT nid, regexp_replace(coalesce(body, ''), '{v.TAGS}', '', 'g') AS body FROM n JOIN g USING (nid) WHERE status = 1)"
_WINDOWS = r"""w AS (SELECT nid, list_filter(string_split_regex(body, '[\t\n\x0B\f\r\x{85}\p{Z}]+'), lambda w: w <> '') AS ws FROM x),
  o AS (SELECT *, unnest(range(0, len(ws), 100)) AS o FROM w), t AS (SELECT nid, o, array_to_string(ws[o + 1:o + 120], ' ') AS text FROM o),
  k AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY o) - 1 AS idx FROM t WHERE length(trim(text)) > 10)"""
_SYNCED = f"""WITH {_CHANGED}, {_WINDOWS}, {v.CHUNKS} SELECT 'nid_' || nid || '_c_' || idx AS chunk_id, nid AS source_nid, length(text) AS n_chars FROM k
  UNION ALL SELECT chunk_id, source_nid, length(text) FROM c WHERE source_nid IS NULL OR source_nid NOT IN (SELECT nid FROM g WHERE nid IS NOT NULL)"""
SQL = {
    "dot_product": f"WITH {v.SIBLINGS} SELECT src, dst, round(dot, 6) AS dot FROM sib",
    "cosine": f"WITH {v.SIBLINGS} SELECT src, dst, round(cosine, 6) AS cosine FROM sib",
    "jaccard": f"WITH {v.SIBLINGS} SELECT src, dst, round(ent_jaccard, 6) AS ent_jaccard, round(kw_jaccard, 6) AS kw_jaccard FROM sib",
    "edge_score": f"WITH {v.SIBLINGS} SELECT src, dst, round(0.60 * cosine + 0.25 * ent_jaccard + 0.15 * kw_jaccard, 6) AS score FROM sib",
    "classify_edge": f"WITH {v.SIBLINGS} SELECT src, dst, edge_type, {v.PRIORITY} AS priority FROM sib",
    "entity_overlap": f"WITH {v.SIBLINGS} SELECT src, dst FROM sib WHERE ent_jaccard > 0",
    "knn_join": f"WITH {_CAND} SELECT src, dst, round(cosine, 6) AS cosine, ann_rank FROM near",
    "edge_candidates": f"WITH {_CAND} SELECT {_COLS} FROM cand",
    "percentile_threshold": f"WITH {_CAND} SELECT count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high, round(quantile_cont(score, 0.85), 6) AS threshold FROM cand",
    "filter_threshold": f"WITH {_CAND} SELECT {_COLS} FROM cand WHERE score >= 0.55",
    "topk_neighbors": f"WITH {_CAND}, {_THR} SELECT src AS chunk_id, string_agg(edge_type || ':' || dst, '|' ORDER BY ann_rank) AS neighbors FROM cand, thr WHERE score >= t GROUP BY src",
    "count_with_neighbors": f"WITH {_CAND}, {_THR} SELECT count(DISTINCT src) AS n_chunks, count(*) AS n_edges FROM cand, thr WHERE score >= t",
    "neighbors_incremental": "WITH " + v.candidates_sql("idx % 20 = 0").replace("c.vector IS NOT NULL AND c.chunk_id <> q0.chunk_id", "c.vector IS NOT NULL AND (c.idx % 20 <> 0)") + f" SELECT {_COLS} FROM cand WHERE score >= 0.55",
    "sync_stream": _SYNCED,
    "sync_applied": _SYNCED,
    "build_graph": f"WITH {v.EXPORT}, {_WINDOWS} SELECT 'nid_' || nid || '_c_' || idx AS chunk_id, nid AS source_nid, length(text) AS n_chars, true AS capped FROM k",
    "sync_incremental_chunks": f"WITH {_CHANGED}, {_WINDOWS} SELECT 'nid_' || nid || '_c_' || idx AS chunk_id, nid AS source_nid, length(text) AS n_chars FROM k",
}
