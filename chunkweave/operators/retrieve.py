"""Retrieval for a whole table of queries: seeds, two hops, reranking, documents, entity pages.

Every phase is a join or a window keyed by ``query_id``; a batch of queries is one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkweave import config
from chunkweave.functions import scoring as sc
from chunkweave.functions.text import parse_typed, strip_type, tokenize
from chunkweave.operators import graph, intent, knn
from chunkweave.operators.chunks import usable
from chunkweave.session import stage

#: Sources of edges: a function from ``(chunk_id)`` rows to their edges ``(src, dst, edge_type)``.
Edges = Callable[[DataFrame], DataFrame]


def answerable(queries: DataFrame) -> DataFrame:
    return queries.where(usable("vector"))


def status(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """``query_id, status``: 'ok', or why a query has no result instead of an error."""
    some = seeds.select("query_id").distinct().withColumn("seeded", F.lit(True))
    return queries.join(some, "query_id", "left").select(
        "query_id", F.when(~usable("vector"), "no query vector").when(F.col("seeded").isNull(), "no seeds").otherwise("ok").alias("status")
    )


def seeds(queries: DataFrame, chunks: DataFrame, k: int = config.SEEDS) -> DataFrame:
    """``query_id, chunk_id, cosine, rank``. The age filter holds before the cut, and only here."""
    age = F.when(F.col("age_range").isNotNull() & ~F.col("age_range").isin("", "All"), F.col("age_range"))
    asked = answerable(queries).select(F.col("query_id").alias("query"), "vector", age.alias("tag"))
    rows = chunks.where(F.col("vector").isNotNull()).select(F.col("chunk_id").alias("id"), "vector", F.col("age_range").alias("tag"))
    found = knn.exact_search(asked, rows, k)
    return found.select(F.col("query").alias("query_id"), F.col("id").alias("chunk_id"), F.col("score").alias("cosine"), "rank")


def hop(start: DataFrame, seen: DataFrame, edges: Edges) -> DataFrame:
    """``query_id, chunk_id, edge_type``: neighbours of ``start(query_id, chunk_id)`` that were not seen."""
    out = edges(start.select("chunk_id").distinct()).select(F.col("src").alias("chunk_id"), "dst", "edge_type")
    found = start.select("query_id", "chunk_id").join(out, "chunk_id").select("query_id", F.col("dst").alias("chunk_id"), "edge_type")
    best = graph.resolve_types(found, ["query_id", "chunk_id"])
    return best.join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def _with_dot(rows: DataFrame, queries: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Rows with the dot product of the query's and the chunk's vector; dangling ids drop out."""
    asked = queries.select("query_id", F.col("vector").alias("qv"))
    got = chunks.select("chunk_id", "vector", *columns)
    return rows.join(got, "chunk_id").join(asked, "query_id").withColumn("dot", sc.dot(F.col("qv"), F.col("vector"))).drop("qv", "vector")


def expand_from(hop1: DataFrame, queries: DataFrame, chunks: DataFrame, most: int = config.HOP2_FROM) -> DataFrame:
    """The hop-1 chunks that hop 2 starts from: the best by raw dot product, without any weights."""
    scored = _with_dot(hop1.select("query_id", "chunk_id"), queries, chunks).where("dot is not null")
    order = Window.partitionBy("query_id").orderBy(F.round("dot", knn.DIGITS).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, weights: DataFrame, top: int = config.RERANK_TOP, boost_hop2: bool = False, lexical: bool = False) -> DataFrame:
    """``query_id, chunk_id, edge_type, hop, has_vector, score, rank`` of the best candidates.

    Rows with a usable vector are scored by dot product x intent x hop x keyword boost and always
    precede the rest, which are scored by words (so are all, with ``lexical``). Hop-2 rows get no
    keyword boost in the vector score unless ``boost_hop2``: they are fetched without keywords.
    Without query terms the lexical score is 0 for all. Ties go by chunk_id.
    """
    rows = _with_dot(candidates, queries, chunks, "text", "entities", "keywords")
    asked = queries.select("query_id", tokenize("text").alias("terms"), F.coalesce("keyword_hints", F.array().cast("array<string>")).alias("hints"))
    rows = rows.join(asked, "query_id").join(weights.select("query_id", F.col("type").alias("edge_type"), "weight"), ["query_id", "edge_type"], "left")
    kws = F.col("keywords") if boost_hop2 else F.when(F.col("hop") == 2, F.array().cast("array<string>")).otherwise(F.col("keywords"))
    factor = F.coalesce("weight", F.lit(1.0)) * sc.hop_factor(F.col("hop")) * sc.keyword_boost(F.col("hints"), kws)
    words = F.when(F.size("terms") > 0, sc.lexical_score(F.col("terms"), F.col("text"), F.col("entities"))).otherwise(0.0)
    has = F.lit(False) if lexical else F.col("dot").isNotNull()
    scored = rows.select("query_id", "chunk_id", "edge_type", "hop", has.alias("has_vector"), (F.when(has, F.col("dot")).otherwise(words) * factor).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("has_vector").desc(), F.round("score", knn.DIGITS).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def traverse(queries: DataFrame, chunks: DataFrame, edges: Edges, signals: DataFrame, upto: str = "best") -> dict[str, DataFrame]:
    """The phases down to ``upto``, each written once because later phases read it again."""
    queries = answerable(queries)
    done = {"seeds": stage(seeds(queries, chunks), "seeds")}

    def candidates() -> DataFrame:
        return done["hop1"].withColumn("hop", F.lit(1)).unionByName(done["hop2"].withColumn("hop", F.lit(2)))

    def seen() -> DataFrame:
        return done["seeds"].select("query_id", "chunk_id").unionByName(done["hop1"].select("query_id", "chunk_id"))

    phases = {
        "hop1": lambda: hop(done["seeds"], done["seeds"], edges),
        "start": lambda: expand_from(done["hop1"], queries, chunks),
        "hop2": lambda: hop(done["start"], seen(), edges),
        "weights": lambda: intent.weights(queries, signals),
        "best": lambda: rerank(candidates(), queries, chunks, done["weights"]),
    }
    for name, make in phases.items():
        if upto in done:
            break
        done[name] = stage(make(), name)
    return done


def merged(seeds_: DataFrame, best: DataFrame) -> DataFrame:
    """``query_id, chunk_id, pos``: seeds in the order of the search, then the reranked neighbours."""
    return seeds_.select("query_id", "chunk_id", F.col("rank").alias("pos")).unionByName(
        best.select("query_id", "chunk_id", (F.col("rank") + config.SEEDS).alias("pos"))
    )


def documents(merged_: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """``query_id, pos, nid, chunk_id, title, text, entities``: the first chunk of each document."""
    rows = merged_.join(chunks.select("chunk_id", "source_nid", "text", "entities"), "chunk_id")
    order = Window.partitionBy("query_id", "source_nid").orderBy("pos")
    first = rows.withColumn("i", F.row_number().over(order)).where("i = 1")
    return first.join(titles.select(F.col("nid").alias("source_nid"), "title"), "source_nid", "left").select(
        "query_id", "pos", F.col("source_nid").alias("nid"), "chunk_id", F.coalesce("title", F.lit("")).alias("title"), "text", "entities"
    )


def entity_frequency(merged_: DataFrame, chunks: DataFrame, most: int = config.ENTITIES_TRIED) -> DataFrame:
    """``query_id, name, n, type, rank``: names over all retrieved chunks; ties by first appearance."""
    rows = merged_.join(chunks.select("chunk_id", "entities"), "chunk_id").select("query_id", "pos", F.posexplode("entities").alias("i", "e"))
    rows = rows.select("query_id", F.struct("pos", "i").alias("at"), parse_typed("e").alias("p"))
    counts = rows.groupBy("query_id", F.col("p.value").alias("name")).agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max_by(F.col("p.type"), F.struct(sc.priority(F.col("p.type")), F.col("p.type"))).alias("type")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("first")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk per document: the one of lowest index (then id); a null index comes last."""
    row = F.struct(F.coalesce("idx", F.lit(2**62)).alias("i"), "chunk_id")
    return chunks.groupBy("source_nid").agg(F.min(row).alias("x")).select("source_nid", F.col("x.chunk_id").alias("chunk_id"))


def entity_pages(freq: DataFrame, docs: DataFrame, chunks: DataFrame, topics: DataFrame, most: int = config.PAGES_ADDED) -> DataFrame:
    """Topic pages titled like a frequent name that are not among the documents yet, with a chunk each."""
    page = topics.where("title <> ''").groupBy(F.col("title").alias("name")).agg(F.min("nid").alias("nid"))
    found = freq.join(page, "name").join(docs.select("query_id", "nid"), ["query_id", "nid"], "left_anti")
    found = found.groupBy("query_id", "nid").agg(F.min_by("name", "rank").alias("name"), F.min("rank").alias("rank"))
    found = found.join(first_chunks(chunks).withColumnRenamed("source_nid", "nid"), "nid")
    order = Window.partitionBy("query_id").orderBy("rank")
    found = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    return found.join(chunks.select("chunk_id", "text", "entities"), "chunk_id").select(
        "query_id", (F.col("i") + config.SEEDS + config.RERANK_TOP).alias("pos"), "nid", "chunk_id", F.col("name").alias("title"), "text", "entities"
    )


def payload(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``query_id, result_count, results, all_entities``: at most 35 documents, 30 names.

    Each query's rows are few by construction, so they are gathered in one row.
    """
    rows = docs.unionByName(pages).select(
        "query_id", "pos", "nid", "title", F.concat(F.lit("/node/"), F.col("nid")).alias("url"), "text", F.transform("entities", lambda e: strip_type(e)).alias("entities")
    )
    packed = F.array_sort(F.collect_list(F.struct("pos", "nid", "title", "url", "text", "entities")))
    out = rows.groupBy("query_id").agg(packed.alias("r"))
    names = F.slice(F.array_distinct(F.flatten(F.transform("r", lambda x: x["entities"]))), 1, config.ALL_ENTITIES)
    results = F.transform("r", lambda x: F.struct(x["nid"].alias("nid"), x["title"].alias("title"), x["url"].alias("url"), x["text"].alias("text"), x["entities"].alias("entities")))
    return out.select("query_id", F.size("r").alias("result_count"), results.alias("results"), names.alias("all_entities"))


def retrieve(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: Edges, signals: DataFrame) -> DataFrame:
    """The whole retrieval: one payload per answerable query that finds something.

    ``chunks`` is the clean view (``graph_chunks``), ``nodes`` the current nodes with ``nid, title,
    type, status``. The age filter holds for seeds only. Null hints count as none.
    """
    steps = traverse(queries, chunks, edges, signals)
    rows = merged(steps["seeds"], steps["best"])
    docs = stage(documents(rows, chunks, nodes), "documents")
    topics = nodes.where("type = 'topic' and status = 1")
    pages = entity_pages(entity_frequency(rows, chunks), docs, chunks, topics)
    return payload(docs, pages)


def exact_edges(chunks: DataFrame, threshold: float = config.FALLBACK_THRESHOLD) -> Edges:
    """Edges worked out when asked for: those of the asked chunks, exactly, at a fixed threshold."""

    def of(sources: DataFrame) -> DataFrame:
        rows = chunks.join(sources, "chunk_id", "left_semi")
        return graph.prune(graph.exact_candidates(rows, chunks), threshold)

    return of


def stored_edges(edges: DataFrame) -> Edges:
    """Edges of a graph that was built before."""
    return lambda sources: edges.join(sources.select(F.col("chunk_id").alias("src")), "src", "left_semi")
